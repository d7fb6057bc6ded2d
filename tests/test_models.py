"""Behaviour of models, wrappers and tests on a table with known signal."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import feature_testing, growing, models, report, splits, tracking, wrappers


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.randn(1).alias("x1"), F.randn(2).alias("x2"), F.randn(3).alias("noise"), F.rand(4).alias("u"), F.rand(7).alias("m"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.floor(F.rand(5) * 3) + 1).cast("int")).alias("cat"))
    df = df.withColumn("x2", F.when(F.col("m") > 0.1, F.col("x2")))
    logit = -1 + F.col("x1") + 0.6 * F.coalesce(F.col("x2"), F.lit(0.0)) + F.when(F.col("cat") == "c", 1.0).otherwise(0.0)
    df = df.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-logit))).cast("int")).drop("u", "m")
    return splits.make_folds(df, "y", "row_id", 2).cache()


def test_boosting_learns_and_survives_export(spark, data, tmp_path):
    m = models.make_model("small").fit(data.filter("fold = 0"), "y", ["x1", "x2", "noise", "cat"])
    scored = m.predict(data.filter("fold = 1"), "p")
    assert models._value(scored, "roc_auc", "y", "p")[()] > 0.72
    assert next(iter(m.feature_importance())) == "x1"
    models.export_model(m, str(tmp_path / "m"), data)
    unseen = spark.createDataFrame([(0.0, None, 0.0, "zzz")], "x1 double, x2 double, noise double, cat string")
    assert 0 < models.load_model(str(tmp_path / "m")).predict(unseen, "p").first()["p"] < 1
    with pytest.raises(KeyError):
        m.predict(data.drop("x1"))


def test_cross_validation_covers_every_row(data):
    cv = models.cross_validate(data, "y", ["x1", "x2"], model="small", segment="cat")
    assert cv.oof.count() == 3000 and len(cv.scores) == 2 and 0.65 < cv.mean < 0.9
    assert {s["segment"] for s in cv.segments} == {"a", "b", "c"}


def test_boosting_on_bins_is_boosting_on_rows(data):
    for f, cats in (("x2", []), ("cat", ["cat"])):
        options = {"n_trees": 6, "depth": 4, "num_leaves": 5, "min_leaf": 30, "max_bins": 12}
        m = models.make_model("small", **options).fit(data.filter("fold <> 0"), "y", [f], cats)
        rows = m.preparer.transform(data.select("fold", "y", f)).groupBy("fold", "__bin_0").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.first(f).alias(f)).toPandas()
        full = lambda k, c, rows=rows, m=m: np.bincount(rows["__bin_0"], np.where((rows["fold"] == 0) == k, rows[c], 0), m.preparer.width())
        margin, history = models.boosted_bins(full(False, "n"), full(False, "pos"), m.params, bool(cats), (full(True, "n"), full(True, "pos")), patience=100)
        again, _ = models.boosted_bins(full(False, "n"), full(False, "pos"), m.params, bool(cats))
        shown = {r["b"]: r["p"] for r in m.predict(m.preparer.transform(data), "p").select(F.col("__bin_0").alias("b"), "p").distinct().collect()}
        assert all(abs(1 / (1 + np.exp(-again[b])) - p) < 1e-9 for b, p in shown.items())
        assert len(history) == 6 and abs(models._value(m.predict(data.filter("fold = 0"), "p"), "roc_auc", "y", "p")[()] - history[-1]) < 1e-9
        assert margin.shape == again.shape


def test_univariate_scores_rank_signal_first(data):
    rows = models.univariate_scores(data.withColumn("one", F.lit(1.0)), "y", ["noise", "x1", "one"]).collect()
    assert rows[0]["feature"] == "x1" and {r["feature"]: r["status"] for r in rows}["one"] == "constant_or_all_nan"


def test_rfe_keeps_signal(data):
    r = wrappers.rfe(data, "y", ["x1", "noise"], model="small", tol=0.005)
    assert r.selected == ["x1"]
    assert [x["action"] for x in r.table.collect()][-1] == "final"


def test_feature_test_verdict(data):
    split = splits.random_split(data.drop("fold"), "y", "row_id", 0.2)
    t = feature_testing.test_features(split, ["noise"], ["x1"], n_splits=3)
    row = t.summary.first()
    assert row["verdict"] == "better" and row["delta_cv"] > 0.1
    with pytest.raises(KeyError):
        feature_testing.test_features(split, ["noise"], ["absent"])


def test_report_and_experiment(data, tmp_path):
    split = splits.random_split(data.drop("fold"), "y", "row_id", 0.2)
    m = models.train_model(split, ["x1", "x2"], "small")
    assert set(m.scores_) == {"train", "val"}
    r = report.model_report(m, split, segment="cat")
    with tracking.Experiment(str(tmp_path), "p") as e:
        e.log_params(a=1)
        e.save_model(m)
        e.save_report(r)
        assert e.load_model().n_iterations_ == m.n_iterations_
    assert tracking.Experiment(str(tmp_path), "p").version == 2
    with pytest.raises(FileExistsError):
        tracking.Experiment(str(tmp_path), "p", version=1)
    rows = {x["part"]: x for x in r.tables["metrics"].collect()}
    assert rows["train"]["score_psi"] == 0 and rows["val"]["auc"] > 0.6


def brute_boosting(bins, y, cats, trees, depth, rate, ridge=1.0, min_leaf=20):
    """Margins of Newton boosting over bins by plain loops over the rows' histograms."""
    q = y.mean()
    margin = np.full(len(y), np.log(q / (1 - q)))
    score = lambda g, h: g * g / (h + ridge)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        step, leaves = np.zeros(len(y)), [np.arange(len(y))]
        for level in range(depth + 1):
            following = []
            for rows in leaves:
                sg, sh, best = g[rows].sum(), h[rows].sum(), None
                step[rows] = rate * sg / (sh + ridge)
                for f in range(bins.shape[1]) if level < depth else ():
                    b = bins[rows, f]
                    present = sorted(set(b.tolist()) - {0})
                    if f in cats:
                        order = sorted(set(b.tolist()), key=lambda v, b=b, rows=rows: (g[rows][b == v].sum() / (h[rows][b == v].sum() + ridge), v))
                        sides = [set(order[:k]) for k in range(1, len(order))]
                    else:
                        sides = [s for k in range(1, len(present)) for s in (set(present[:k]), *([set(present[:k]) | {0}] if (b == 0).any() else []))]
                        sides += [set(present)] if (b == 0).any() and present else []
                    for side in sides:
                        left = np.isin(b, list(side))
                        if min(left.sum(), (~left).sum()) < min_leaf:
                            continue
                        lg, lh = g[rows][left].sum(), h[rows][left].sum()
                        gain = score(lg, lh) + score(sg - lg, sh - lh) - score(sg, sh)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, rows[left], rows[~left])
                if best:
                    following += best[1:]
            leaves = following
        margin = margin + step
    return margin


def test_boosting_equals_plain_loops(spark, data):
    features = ["x1", "x2", "cat"]
    rows = data.filter("row_id < 800").cache()
    m = models.make_model("small", n_trees=13, depth=2, learning_rate=0.3, max_bins=8).fit(rows, "y", features)
    table = m.predict(m.preparer.transform(rows), "p").select("y", "p", "__bin_0", "__bin_1", "__bin_2").toPandas()
    margin = brute_boosting(table[["__bin_0", "__bin_1", "__bin_2"]].to_numpy(), table["y"].to_numpy().astype("f8"), {2}, 13, 2, 0.3)
    assert np.allclose(table["p"], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_the_exported_scorer_needs_neither_spark_nor_the_library(spark, data, tmp_path):
    import json
    import subprocess
    import sys

    odd = data.select("row_id", "y", F.when(F.col("row_id") % 5 > 0, F.col("x1").cast("string")).otherwise(F.lit("nan")).alias("x1"), "x2", F.when(F.col("cat") == "a", F.lit("1.0")).otherwise(F.col("cat")).alias("cat"), F.timestamp_seconds(F.col("row_id") * 86400).alias("t"), (F.col("row_id") % 2 == 0).alias("b"))
    m = models.make_model("small", n_trees=8, max_categories=2).fit(odd, "y", ["x1", "x2", "cat", "t", "b"])
    folder = tmp_path / "m"
    models.export_model(m, str(folder), odd)
    want = [r["p"] for r in m.predict(odd.orderBy("row_id").limit(200), "p").collect()]
    odd.orderBy("row_id").limit(200).toPandas().to_parquet(folder / "in.parquet")
    code = "import sys, json, pandas as pd; sys.path.insert(0, '.'); import inference; assert not any(x.startswith(('pyspark', 'riskloom')) for x in sys.modules); print(json.dumps(inference.predict(pd.read_parquet('in.parquet')).tolist()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": ""}, capture_output=True, text=True, check=True)
    assert np.allclose(json.loads(ran.stdout), want, atol=1e-12)
    text = (folder / "inference.py").read_text().replace("    return df\n\n\ndef absent", "    return df.assign(x1=0.0)\n\n\ndef absent")
    (folder / "inference.py").write_text(text)
    changed = json.loads(subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": ""}, capture_output=True, text=True, check=True).stdout)
    assert np.allclose(changed, [r["p"] for r in m.predict(odd.orderBy("row_id").limit(200).withColumn("x1", F.lit(0.0)), "p").collect()], atol=1e-12)


def test_parzen_search_beats_random_points_on_a_fixed_surface():
    space = {"a": (1, 50), "b": (0.001, 10.0), "c": ["x", "y", "z"]}
    loss = lambda p: ((p["a"] - 37) / 20) ** 2 + (np.log(p["b"]) - np.log(0.05)) ** 2 / 4 + (p["c"] != "y")

    def best(start, seed):
        s = models.ParzenSearch(space, seed, start)
        for _ in range(60):
            p = s.ask()
            assert 1 <= p["a"] <= 50 and 0.001 <= p["b"] <= 10 and p["c"] in "xyz"
            s.tell(p, loss(p))
        return min(v for _, v in s.trials)

    found = [(best(10, seed), best(60, seed)) for seed in range(12)]
    assert sum(a < b for a, b in found) >= 9 and np.median([a for a, _ in found]) < 0.5 * np.median([b for _, b in found])
    assert best(10, 3) == best(10, 3)


def test_tuning_is_judged_on_val_and_reports_test(data):
    split = splits.random_split(data.drop("fold"), "y", "row_id", 0.2, 0.2)
    table, best = models.tune_hyperparams(split, ["x1", "x2"], n_trials=3, space={"depth": (1, 2), "learning_rate": (0.1, 0.6)}, fixed={"n_trees": 3, "num_leaves": None}, together=3)
    rows = table.collect()
    top = max(rows, key=lambda r: r["val"])
    assert len(rows) == 3 and best["n_trees"] == top["n_trees"] <= 3 and all(0.5 < r["test"] < 1 and 0.5 < r["train"] < 1 for r in rows)


def test_large_models_are_scored_in_batches(spark, data, monkeypatch):
    m = models.make_model("small", n_trees=3).fit(data.filter("fold = 0"), "y", ["x1", "x2", "cat"])
    plain = {r["row_id"]: r["p"] for r in m.predict(data, "p").collect()}
    monkeypatch.setattr(models, "EXPRESSION_TREES", 1)
    batches = {r["row_id"]: r["p"] for r in m.predict(data, "p").collect()}
    assert all(abs(plain[k] - batches[k]) < 1e-12 for k in plain)


def test_a_tree_costs_the_same_however_many_went_before(spark, data, monkeypatch):
    monkeypatch.setattr(models, "CHUNK", 5)
    seen = []
    grown = growing.grown
    monkeypatch.setattr(growing, "grown", lambda rows, *rest: seen.append(len(rows._jdf.queryExecution().optimizedPlan().toString())) or grown(rows, *rest))
    models.make_model("small", n_trees=12, depth=1).fit(data.filter("row_id < 300"), "y", ["x1"])
    assert len(seen) == 12 and abs(seen[10] - seen[5]) < 0.2 * seen[5] and max(seen[6:10]) < 1.2 * max(seen[1:5])


def test_many_models_are_those_fitted_alone_and_take_no_more_jobs(spark, data, monkeypatch):
    rounds = []
    monkeypatch.setattr(growing, "with_tree", lambda rows, trees, *kind, f=growing.with_tree: rounds.append(len([t for t in trees if kind or t["on"]])) or f(rows, trees, *kind))
    fit = lambda fs, k, n: models.Fit(models.make_model("small", n_trees=n, depth=2), fs, k)
    sets = [models.RowSet(F.col("fold") != 0, F.col("fold") == 0), models.RowSet(F.col("fold") != 1), models.RowSet(F.col("row_id") < 900)]
    fits = [fit(["x1", "cat"], 0, 3), fit(["x1", "x2", "noise"], 0, 2), fit(["x1", "x2", "cat"], 1, 3), fit(["cat"], 2, 1)]
    together = models.fit_many(data, "y", fits, sets)
    assert len(rounds) <= 3 * (2 + 1) and max(rounds) == 4  # two levels and one step of the margins for each tree
    for x, m in zip(fits, together, strict=True):
        valid = None if sets[x.rows].valid is None else data.filter(sets[x.rows].valid)
        alone = models.make_model("small", n_trees=m.params["n_trees"], depth=2).fit(data.filter(sets[x.rows].train), "y", x.features, valid=valid)
        assert alone.trees_ == m.trees_ and alone.base_ == m.base_ and alone.history_ == m.history_


def test_trees_grow_best_leaf_first_and_count_the_smaller_half(data, monkeypatch):
    asked, told = [], growing.Tree.told

    def note(self, nodes, cells):
        for k in nodes:
            if k:
                parent = self.nodes[self.nodes[k]["parent"]]
                asked.append((self.nodes[k]["sums"][2], parent["sums"][2]))
        told(self, nodes, cells)

    monkeypatch.setattr(growing.Tree, "told", note)
    rows = data.filter("row_id < 1500").cache()
    options = {"n_trees": 1, "depth": 6, "learning_rate": 0.3, "max_bins": 8, "min_leaf": 10}
    wide = models.make_model("small", **options).fit(rows, "y", ["x1", "x2", "cat"]).trees_[0]
    few = models.make_model("small", num_leaves=6, **options).fit(rows, "y", ["x1", "x2", "cat"])
    assert sum("left" not in n for n in few.trees_[0]) == 6 < sum("left" not in n for n in wide)
    assert asked and all(2 * n <= whole for n, whole in asked)
    # plain best-first growth over the bins
    table = few.preparer.transform(rows).select("y", "__bin_0", "__bin_1", "__bin_2").toPandas()
    bins, y = table[["__bin_0", "__bin_1", "__bin_2"]].to_numpy(), table["y"].to_numpy().astype("f8")
    grower = growing.Tree({**few.params}, [0, 1, 2], {2}, few.preparer.width())
    p = 1 / (1 + np.exp(-few.base_))

    def hist(at):
        own = np.zeros((3, grower.bins, 3))
        for f in range(3):
            np.add.at(own[f], bins[at, f], np.stack([y[at] - p, np.full(at.sum(), p * (1 - p)), np.ones(at.sum())], axis=1))
        return own

    leaves = [(np.ones(len(y), bool), 0)]
    while len(leaves) < 6:
        splits_ = [(grower.best(hist(at), hist(at)[0].sum(axis=0)), k) for k, (at, depth) in enumerate(leaves) if depth < 6]
        (_, f, rule, _), k = max((s for s in splits_ if s[0]), key=lambda s: (s[0][0], -s[1]))
        at, depth = leaves.pop(k)
        left = np.isin(bins[:, f], rule["left_bins"]) if "left_bins" in rule else (bins[:, f] <= rule["cut"]) & ((bins[:, f] > 0) | rule["missing_left"])
        leaves += [(at & left, depth + 1), (at & ~left, depth + 1)]
    value = lambda at: round(0.3 * (y[at] - p).sum() / (p * (1 - p) * at.sum() + 1), 9)
    assert sorted(value(at) for at, _ in leaves) == sorted(round(n["value"], 9) for n in few.trees_[0] if "left" not in n)


def test_symmetric_trees_split_alike_and_learn_without_leakage(spark, data):
    rows = data.withColumn("one_each", F.concat(F.lit("id"), F.col("row_id")))
    options = {"n_trees": 6, "depth": 3, "learning_rate": 0.5}
    m = models.make_model("symmetric", **options).fit(rows.filter("fold = 0"), "y", ["x1", "x2", "cat"])
    for t in m.trees_:
        level = [0]
        while "left" in t[level[0]]:
            assert len({(t[k]["feature"], t[k]["cut"], t[k]["missing_left"]) for k in level}) == 1
            level = [c for k in level for c in (t[k]["left"], t[k]["right"])]
        assert all("left" not in t[k] for k in level)
    assert models._value(m.predict(rows.filter("fold = 1"), "p"), "roc_auc", "y", "p")[()] > 0.72 and m.gain_["cat"] > 0
    # an id tells nothing: the rows before a row never hold its own target
    own = models.make_model("symmetric", **options).fit(rows.filter("fold = 0"), "y", ["one_each"])
    assert sum(own.gain_.values()) == 0 and len(own.trees_[0]) == 1
    again = models.Boosting.from_json(m.to_json())
    both = again.predict(m.predict(rows, "a"), "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-12


def test_ordered_statistics_see_only_rows_before(spark):
    import hashlib
    import random

    random.seed(3)
    table = [(k, random.choice(["a", "b", None]), random.randint(0, 1), k % 4 > 0) for k in range(200)]
    df = spark.createDataFrame(table, "row_id long, c string, y int, train boolean").repartition(4)
    found, stats, mean = models.with_ordered_stats(df, "y", F.col("c"), F.col("train"), "s", 2.0)
    order = sorted(table, key=lambda r: (hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0]))
    got = {r["row_id"]: r["s"] for r in found.collect()}
    assert abs(mean - np.mean([r[2] for r in table if r[3]])) < 1e-12
    for i, r in enumerate(order):
        before = [x[2] for x in order[:i] if x[3] and x[1] == r[1]]
        assert abs(got[r[0]] - (sum(before) + 2 * mean) / (len(before) + 2)) < 1e-12
    every = [r[2] for r in table if r[3] and r[1] is None]
    assert abs(stats[""] - (sum(every) + 2 * mean) / (len(every) + 2)) < 1e-12 and set(stats) == {"a", "b", ""}


def test_shares_of_rows_and_features_are_drawn_anew_for_each_tree(data):
    options = {"n_trees": 4, "depth": 2, "subsample": 0.5, "colsample": 0.34}
    a, b = (models.make_model("small", **options).fit(data, "y", ["x1", "x2", "cat"]) for _ in range(2))
    assert a.trees_ == b.trees_ and all(len({n["feature"] for n in t if "left" in n}) <= 1 for t in a.trees_)
    assert all(0.4 * 3000 < t[0]["n"] < 0.6 * 3000 for t in a.trees_) and len({t[0]["n"] for t in a.trees_}) > 1
    assert models.make_model("small", seed=1, **options).fit(data, "y", ["x1", "x2", "cat"]).trees_ != a.trees_


def test_categories_beyond_the_cap_share_a_bin(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(40) for _ in range(41 - i)] + [(None,)], "c string")
    prepared = models.FeaturePreparer(["c"], ["c"], max_categories=30).fit(df)
    bins = {r["c"]: r["b"] for r in df.select("c", prepared.bin(df, "c").alias("b")).distinct().collect()}
    assert bins[None] == 0 and {bins[f"c{i:02d}"] for i in range(30, 40)} == {31} and len({bins[f"c{i:02d}"] for i in range(30)}) == 30
    every = models.FeaturePreparer(["c"], ["c"]).fit(df)
    assert len(every.categories["c"]) == 40  # more than the bins of numbers
    unseen = spark.createDataFrame([("new",)], "c string")
    assert unseen.select(every.bin(unseen, "c")).first()[0] == 0 and unseen.select(prepared.bin(unseen, "c")).first()[0] == 31


def test_screened_candidates_are_reported(data):
    split = splits.random_split(data.drop("fold"), "y", "row_id", 0.2)
    t = feature_testing.test_features(split, ["noise"], ["x1", "x2", "cat"], n_splits=2, max_exact=1)
    rows = {r["candidate"]: r for r in t.summary.collect()}
    assert set(rows) == {"x1", "x2", "cat", "ALL"} and t.info["screened"] == 2
    assert rows["x1"]["verdict"] != "screened" and rows["x2"]["verdict"] == rows["cat"]["verdict"] == "screened" and rows["x2"]["screen_delta"] is not None


def test_domains_tell_shares_and_contributions(data):
    split = splits.random_split(data.drop("fold"), "y", "row_id", 0.2)
    t = feature_testing.test_domains(split, ["noise"], {"d": ["x1", "x2"]}, n_splits=2)
    rows = t.info["features"].collect()
    assert 0.5 < t.info["gain_share"]["d"] <= 1 and abs(sum(r["share"] for r in rows) - 1) < 1e-9 and rows[0]["feature"] == "x1"


def test_leaves_of_a_univariate_tree(data):
    rows = models.univariate_leaves(data, "y", ["x1", "cat"]).collect()
    x1 = [r for r in rows if r["feature"] == "x1"]
    assert sum(r["n"] for r in x1) == 3000 and abs(sum(r["share"] for r in x1) - 1) < 1e-9
    assert all(a["largest"] <= b["least"] for a, b in zip(sorted(x1, key=lambda r: r["leaf"]), sorted(x1, key=lambda r: r["leaf"])[1:], strict=False))
    scores = {r["feature"]: r for r in models.univariate_tree_scores(data, "y", ["x1", "cat"]).collect()}
    assert scores["x1"]["n_leaves"] == len(x1) and scores["x1"]["monotonic"] and scores["cat"]["monotonic"] is None


def test_scores_of_expressions_equal_those_of_bins(spark):
    """Rows on an edge, missing, infinite and of unseen categories are scored as their bins say."""
    rows = [(k, float(k % 50) if k % 7 else None, "abcd"[k % 4] if k % 11 else None, int(k % 50 > 20 or k % 4 == 1)) for k in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string, y int")
    m = models.make_model("small", n_trees=4, depth=3).fit(df, "y", ["x", "c"])
    odd = [float(e) for e in m.preparer.edges["x"]] + [-0.0, float("inf"), float("-inf"), float("nan"), None, 1e9]
    asked = spark.createDataFrame([(x, c) for x in odd for c in ("a", "d", "new", None)], "x double, c string")
    scored = m.preparer.transform(m.predict(asked, "p")).collect()
    edges = m.preparer.edges["x"]
    for r in scored:
        missing = r["x"] is None or r["x"] != r["x"]
        assert r["__bin_0"] == (0 if missing else 1 + sum(e < r["x"] for e in edges))
        bins = (r["__bin_0"], r["__bin_1"])
        margin = m.base_ + sum(_leaf(t, bins) for t in m.trees_)
        assert abs(r["p"] - 1 / (1 + math.exp(-margin))) < 1e-12
    assert not [c for c in scored[0].asDict() if c.startswith(("__r_", "__s_"))]
    plan = m.predict(asked, "p")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "filter(" not in plan  # what Spark doesn't compile


def test_cuts_of_a_high_accuracy_are_exact(spark, monkeypatch):
    """Ranks are exact for ties, nulls, infinities and where the brackets miss them."""
    values = [(k, float((k * 7919) % 30011), float(k % 5), None if k % 3 else float("-inf") if k % 2 else k / 7, None) for k in range(30_000)]
    df = spark.createDataFrame(values, "i long, a double, b double, c double, d double").repartition(7)
    shares = [k / 31 for k in range(1, 31)]
    columns = {name: (F.col(name), shares) for name in "abcd"}

    def want(name):
        x = sorted(r["abcd".index(name) + 1] for r in values if r["abcd".index(name) + 1] is not None)
        return sorted({x[max(1, math.ceil(q * len(x))) - 1] for q in shares}) if x else []

    for accuracy in (10_000, 5_000_000, 50):  # brackets of no width and wide ones
        monkeypatch.setattr(models, "APPROXIMATE", accuracy)
        found = models.exact_cuts(df, columns)
        assert {name: sorted(v) for name, v in found.items()} == {name: want(name) for name in "abcd"}


def _leaf(nodes, bins):
    node = nodes[0]
    while "left" in node:
        b = bins[node["feature"]]
        goes = b in node["left_bins"] if "left_bins" in node else b <= node["cut"] and (b > 0 or node["missing_left"])
        node = nodes[node["left"] if goes else node["right"]]
    return node["value"]


def test_texts_that_are_no_numbers_cost_no_failed_casts(spark):
    """The numbers are those of the cast alone, and categories are told from numbers in much less time."""
    import time

    from riskloom.functions.columns import category_strings, normalize_missing, to_number

    texts = ["1", " 2.5 ", "\t3", "4\n", "5.", ".5", ".", "1e3", "-1E-3", "+7", "1e", "e5", "--1", "1-URGENT", "5-LOW", "12a", "1d", "2f", "1.5D ", "inf", "-inf", "Infinity", "-infinity", "NaN", "nan", "0x1p3", "0x1p3d", "0x", "", " ", None, "1,000", "1 2", "٣", "1_0", "\x015", "5\x01", "1d\t", "1f\n", "9" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    s = F.trim(normalize_missing(F.col("t")))
    before = F.when(~s.rlike("[dDfF]$") | s.rlike("(?i)inf$"), s.try_cast("double"))
    for r in df.select("t", to_number(F.col("t")).alias("got"), F.when(~F.isnan(before), before).alias("want")).collect():
        assert r["got"] == r["want"], r

    def text_of(number):
        return F.when(number.isNotNull() & (number == F.floor(number)), number.cast("bigint").cast("string")).otherwise(normalize_missing(F.col("t")))

    def spent(x):
        times = []
        for _ in range(2):
            rows = spark.range(0, 500_000, 1, 4).select(F.concat((F.col("id") % 5).cast("string"), F.lit("-URGENT")).alias("t")).groupBy(x).count()  # anew, as the shuffle of a table is kept
            began = time.perf_counter()
            rows.collect()
            times.append(time.perf_counter() - began)
        return min(times)

    now, then = spent(category_strings(F.col("t"))), spent(text_of(F.when(~F.isnan(before), before)))
    assert now < 0.6 * then, (now, then)


def test_backward_elimination_judges_segments_and_the_set_after_each_removal(data):
    rows = data.drop("fold").withColumn("seg", F.when(F.col("row_id") < 60, "rare").when(F.col("cat") != "a", F.col("cat")))
    split = splits.random_split(rows, "y", "row_id", 0.3)
    small = models.make_model("small", n_trees=2)
    r = wrappers.backward_elimination(split.train, split.val, "y", ["x1", "x2", "noise"], metric="logloss", model=small, segment="seg", min_features=2)
    got = r.table.orderBy("step").collect()
    assert [(x["n_features"], x["removed"]) for x in got] == [(3, "noise"), (2, "x2")] and r.info["segments"] == ["NaN", "b", "c"]

    def judged(features):
        m = small.clone().fit(split.train, "y", features, valid=split.val, metric="logloss")
        named = split.val.withColumn("s", F.coalesce("seg", F.lit("NaN")))
        of = lambda df: models._value(m.predict(df, "p"), "logloss", "y", "p")[()]
        return m, {"train": of(split.train), "valid": of(split.val)}, {s: of(named.filter(F.col("s") == s)) for s in ("NaN", "b", "c")}

    (m, own, inner), (_, then, then_inner) = judged(["x1", "x2"]), judged(["x1"])
    last = got[-1]
    assert last["removed_importance"] == pytest.approx(m.feature_importance()["x2"])
    assert {p: last[p] for p in own} == pytest.approx(own) and last["segments"] == pytest.approx(inner)
    assert last["delta_valid"] == pytest.approx(own["valid"] - then["valid"]) and last["delta_valid"] < 0  # a greater loss is worse
    assert last["delta_train"] == pytest.approx(own["train"] - then["train"])
    assert last["delta_segments"] == pytest.approx({s: inner[s] - then_inner[s] for s in inner})
    whole = wrappers.backward_elimination(split.train, split.val, "y", ["x1", "noise"], model=small).table.orderBy("step").collect()
    assert [x["removed"] for x in whole] == ["noise", "x1"] and whole[-1]["delta_valid"] is None and whole[-1]["segments"] == {}


def test_importances_are_of_the_trees_that_are_kept(data):
    m = models.make_model("small", n_trees=20, depth=4, learning_rate=0.9).fit(data.filter("fold = 0"), "y", ["x1", "noise"], valid=data.filter("fold = 1"), patience=5)
    assert len(m.trees_) < len(m.history_) and sum(m.splits_.values()) == sum("left" in n for t in m.trees_ for n in t)


@pytest.mark.parametrize("test", ["features", "domains"])
def test_models_of_a_test_see_every_training_row(spark, monkeypatch, test):
    df = spark.range(252_000).select(F.col("id").alias("row_id"), F.rand(1).alias("x"), F.rand(2).alias("noise"), F.rand(3).alias("u"))
    split = splits.random_split(df.withColumn("y", (F.col("u") < F.col("x")).cast("int")).drop("u"), "y", "row_id", 0.2)
    seen, fit = [], feature_testing.fit_many

    def noted(rows, target, fits, sets, *rest):
        seen.append([rows.filter(x.train).count() for x in sets])
        return fit(rows, target, fits, sets, *rest)

    monkeypatch.setattr(feature_testing, "fit_many", noted)
    stump, n = models.make_model("small", n_trees=1, depth=1), split.train.count()
    if test == "features":
        feature_testing.test_features(split, ["noise"], ["x"], n_splits=2, model=stump)
    else:
        feature_testing.test_domains(split, ["noise"], {"d": ["x"]}, n_splits=2, model=stump)
    assert n > 200_000 and len(seen) >= 4 and all(sum(s) == n for s in seen)


def test_no_domain_is_screened_out(data):
    split = splits.random_split(data.drop("fold"), "y", "row_id", 0.2)
    t = feature_testing.test_domains(split, ["noise"], {f"d{k}": ["x1"] for k in range(21)}, n_splits=2, model=models.make_model("small", n_trees=1, depth=1))
    rows = {r["candidate"]: r for r in t.summary.collect()}
    assert set(rows) == {"ALL", *(f"d{k}" for k in range(21))} and t.info["screened"] == 0
    assert all(r["verdict"] != "screened" and r["delta_cv"] == rows["d0"]["delta_cv"] for r in rows.values())
