"""How often operators on models work out the table that they are given."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import growing, models, splits, wrappers

ROWS = 400
STUMP = models.make_model("small", n_trees=2, depth=1)


def permuted(df, valid):
    return wrappers.permutation_importance(STUMP.clone().fit(df, "y", ["x", "z"]), df, "y", n_repeats=1)


CALLS = {
    "rfe": lambda df, s: wrappers.rfe(df, "y", ["x", "z"], model=STUMP),
    "cross_validate": lambda df, s: models.cross_validate(df, "y", ["x", "z"], model=STUMP),
    "symmetric": lambda df, s: models.cross_validate(df, "y", ["x", "c"], model=models.make_model("symmetric", n_trees=2, depth=1)),
    "backward_elimination": lambda df, s: wrappers.backward_elimination(s.train, s.val, "y", ["x", "z"], model=STUMP),
    "forward_addition": lambda df, s: wrappers.forward_addition(s.train, s.val, "y", ["x"], ["z"], model=STUMP),
    "permutation_importance": permuted,
    "incremental": lambda df, s: wrappers.incremental_feature_eval(df, "y", ["x", "z"], model=STUMP),
    "train_model": lambda df, s: models.train_model(s, ["x", "z"], STUMP),
    "sample_size": lambda df, s: models.sample_size_curve(s, ["x", "z"], [100, 200], model=STUMP),
    "univariate_tree": lambda df, s: models.univariate_tree_scores(df, "y", ["x", "z"]).collect(),
    "univariate_scores": lambda df, s: models.univariate_scores(df, "y", ["x", "z"]).collect(),
}


@pytest.mark.parametrize("name", CALLS)
def test_the_source_is_worked_out_once(spark, tmp_path, name):
    seen = spark.sparkContext.accumulator(0)

    def noted(v):
        seen.add(1)
        return v

    value = F.udf(noted, "double")
    plain = spark.range(ROWS).select(F.col("id").alias("row_id"), F.rand(1).alias("x0"), F.rand(2).alias("z"), F.concat(F.lit("k"), F.col("id") % 3).alias("c"), F.rand(3).alias("u"), (F.col("id") % 2).cast("int").alias("fold"))
    plain = plain.withColumn("y", (F.col("u") < F.col("x0")).cast("int")).withColumn("part", F.when(F.col("row_id") % 4 == 0, "val").otherwise("train")).drop("u")
    plain.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("x", value("x0")).drop("x0")
    CALLS[name](df, splits.DataSplit(df, "y"))
    # train and val are kept apart where they are given apart; a fit of the test itself reads once more
    assert seen.value <= (2 if name in ("backward_elimination", "forward_addition", "permutation_importance") else 1) * ROWS


def test_the_plan_of_a_symmetric_model_does_not_grow_with_its_sets(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.rand(1).alias("x"), F.concat(F.lit("k"), F.col("id") % 3).alias("c"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    seen, stats = [], models.with_ordered_stats
    monkeypatch.setattr(models, "with_ordered_stats", lambda df, *rest: seen.append(len(df._jdf.queryExecution().analyzed().toString())) or stats(df, *rest))
    models.fit_many(df, "y", [models.Fit(models.make_model("symmetric", n_trees=1, depth=1), ["x", "c"], k) for k in range(3)], [models.RowSet(F.col("fold") != k) for k in range(3)])
    assert len(seen) == 3 and seen[2] < 1.5 * seen[0]


def test_rows_are_drawn_as_sql_draws_them(spark):
    import numpy as np

    rows = spark.range(-50, 50).select("id", F.expr(f"pmod(xxhash64(id, 123456789012L), {growing.DRAW})").alias("d")).collect()
    assert growing.drawn_part(np.array([r["id"] for r in rows], "i8").view("u8"), 123456789012).tolist() == [r["d"] for r in rows]
