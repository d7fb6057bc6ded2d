import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    prose = " ".join(f"word{i % 97} thing{i % 13}" for i in range(300))
    rows = [
        (1, "One plain line of text that is long enough to count as words.\nAnother line here.", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "b", 4),
        (None, "text without an id but with some words in it, ten of them at least.", "en", "b", 5),
        (5, prose, "en", "a", len(prose)),
        (6, prose, "en", "a", len(prose)),
        (7, prose + " end", "en", "c", len(prose)),
        (7, prose + " end", "en", "c", len(prose)),
        (8, "### $$$ *** %%% &&& ||| " * 50, "xx", "a", 1200),
        (9, "very long " * 20000, "en", "a", 200000),
        (10, "naïve café ß İ ς 日本語 テスト 123́\x1c\x85 it's I'LL <|endoftext|>", "fr", "d", 40),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: c for c in ("start", "length", "fp", "key", "shard", "slot", "spans", "score", "held_out", "kept", "votes", "place", "h", "stratum", "survivor_id", "row", "node", "g", "bands", "component", "digest_", "kept_0", "k1", "data", "pattern", "n")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in clash.items()}).cache()


@pytest.fixture(scope="session")
def nothing(spark, messy):
    return spark.createDataFrame([], messy.schema)
