"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good, bad, or abstains. Expectation-maximisation over the counts of vote patterns
estimates every rule's vote rates on good and on bad documents; a document is kept if its posterior
probability of being good is at least ``threshold``. No rule alone rejects, except the base test
(too few words or too much repetition) that callers ask for by ``base_failed``.

Rule statistics are made row by row from whole texts, without a shuffle. Only counts of vote
patterns, at most 3 ** rules rows whatever the input, reach the driver, and the posteriors go back as
a table of that many rows at most, joined by pattern.

Defined results: null, empty and blank texts have no words and fail the base test; repeated rows
repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, small, spread_to

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

GOOD, BAD, ABSTAIN = 1, 0, -1


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the array, the first occurrence included.

    Windows are compared by 64-bit hashes. Most texts repeat none, which one distinct over the
    hashes shows; only the others sort (hash, place) pairs and mark neighbours that are equal.
    """
    zero = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            twin = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, zero, lambda a, x: a + x)

        return _let(_let(pairs, places), total)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW, zero).otherwise(counted)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` as kept_0, kept_1 and so on, and doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks, n_distinct, n_symbol_runs."""
    carried, names = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], [f"kept_{i}" for i in range(len(keep))]
    text = docs.select(*carried, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", "[ \\t-\\r]+"), "")
    solid = F.translate("text", SPACES, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    split = text.select(*names, "doc_id", "text", words.alias("words"), solid.alias("solid"), lines.alias("lines"))
    outside = lambda chars: (F.length("solid") - F.length(F.translate("solid", chars, ""))).cast("long")
    return split.select(
        *names,
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        outside(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        outside("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊÍÑÓÖÚÜ").alias("n_upper"),
        outside("!?").alias("n_marks"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("solid", F.lit(f"[{SYMBOLS}]+")).cast("long").alias("n_symbol_runs"),
    )


def votes() -> dict[str, Column]:
    """The rules: name to a column of GOOD, BAD or ABSTAIN over ``statistics``."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))

    def rule(value: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    mean, symbols, repeats = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_repeat_words", "n_words")
    lines, upper, marks, variety = share("n_dup_lines", "n_lines"), share("n_upper", "word_chars"), share("n_marks", "n_words"), share("n_distinct", "n_words")
    density, runs = share("n_symbols", "word_chars"), share("n_symbol_runs", "n_words")
    # three measures of symbols: a class that a single rule tells apart can't be learnt from votes alone
    return {
        "length": rule(F.col("n_words"), F.col("n_words") >= 50, F.col("n_words") < 10),
        "word_length": rule(mean, (mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 14)),
        "symbols": rule(symbols, symbols <= 0.05, symbols > 0.2),
        "symbol_chars": rule(density, density <= 0.02, density > 0.05),
        "symbol_runs": rule(runs, runs <= 0.03, runs > 0.15),
        "duplicate_lines": rule(lines, lines <= 0.1, lines > 0.3),
        "repetition": rule(repeats, repeats <= 0.02, repeats > 0.15),
        "capitals": rule(upper, upper <= 0.12, upper > 0.35),
        "marks": rule(marks, marks <= 0.1, marks > 0.3),
        "variety": F.when(F.col("n_words") < 30, ABSTAIN).otherwise(rule(variety, variety >= 0.3, variety < 0.12)),
    }


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 0.8) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation over pattern counts.

    Rules are independent given the class. A rule's accuracy is the share of its votes that agree
    with the class; whether it abstains says nothing. It starts from rules that seldom fault a good
    document but catch only some of the bad ones, and a few pseudo-votes keep accuracies from 0 and
    1; the bounds on a rule's accuracy keep the two classes from changing names.
    """
    if not patterns:
        return {}
    rules = len(next(iter(patterns)))
    right = {(j, c): 0.99 if c == GOOD else 0.2 for j in range(rules) for c in (GOOD, BAD)}
    total = sum(patterns.values())

    def posterior(p: tuple[int, ...]) -> float:
        logit = math.log(prior) - math.log(1 - prior)
        for j, v in enumerate(p):
            if v == GOOD:
                logit += math.log(right[j, GOOD]) - math.log(1 - right[j, BAD])
            elif v == BAD:
                logit += math.log(1 - right[j, GOOD]) - math.log(right[j, BAD])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))

    for _ in range(rounds):
        post = {p: posterior(p) for p in patterns}
        prior = min(0.99, max(0.5, (sum(n * post[p] for p, n in patterns.items()) + 4) / (total + 5)))
        for j in range(rules):
            for c in (GOOD, BAD):
                weight = lambda p, c=c: post[p] if c == GOOD else 1 - post[p]
                voted = sum(n * weight(p) for p, n in patterns.items() if p[j] != ABSTAIN)
                agreed = sum(n * weight(p) for p, n in patterns.items() if p[j] == c)
                # a good document seldom gets a bad vote; a bad one may well pass most rules
                low = 0.5 if c == GOOD else 0.05
                right[j, c] = min(0.999, max(low, (agreed + 9) / (voted + 10)))
    return {p: posterior(p) for p in patterns}


def _voted(stats: DataFrame) -> DataFrame:
    return stats.withColumn("votes", F.array(*[v.cast("int") for v in votes().values()]))


def posteriors(stats: DataFrame) -> dict[tuple[int, ...], float]:
    """Posterior probability of good by vote pattern. Pattern counts, at most 3 ** rules rows, reach the driver."""
    counted = _voted(stats).groupBy("votes").agg(F.count("*").alias("n")).collect()
    return fit({tuple(r["votes"]): r["n"] for r in counted})


def decided(stats: DataFrame, post: dict[tuple[int, ...], float], threshold: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """``stats`` with base_failed, p_good and kept."""
    known = json.dumps([{"pattern": ",".join(map(str, p)), "p_good": float(v)} for p, v in post.items()])
    table = stats.sparkSession.range(1).select(F.inline(F.from_json(F.lit(known), "array<struct<pattern:string,p_good:double>>")))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    voted = _voted(stats).withColumn("pattern", F.concat_ws(",", F.col("votes").cast("array<string>"))).drop("votes")
    scored = voted.join(F.broadcast(table), "pattern", "left").drop("pattern").withColumn("p_good", F.coalesce("p_good", F.lit(0.0)))
    return scored.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Statistics with base_failed, p_good and kept, one row per document."""
    stats = cut(statistics(docs, id_col, text_col))
    return decided(stats, posteriors(stats), **limits)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    A verdict depends on the text alone. Statistics are made once, with the text's digest, and saved;
    rows whose digest was rejected go, by a join that leaves texts where they lie if these digests are few
    and that deals rows of a frequent text, such as the empty one, over several tasks if not.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    own = docs.select(F.col(id_col), F.col(text_col), digest.alias("digest_"))
    stats = cut(statistics(own, id_col, text_col, keep=("digest_",)))
    gone = cut(decided(stats, posteriors(stats), **limits).filter(~F.col("kept")).groupBy(F.col("kept_0").alias("digest_")).agg(F.count("*").alias("n")))
    marked = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest_"))
    if small(gone):
        return marked.join(F.broadcast(gone), "digest_", "left_anti").select("row.*")
    return spread_to(marked, gone, ["digest_"], "left_anti", salt=F.monotonically_increasing_id()).select("row.*")
