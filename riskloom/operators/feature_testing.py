"""Does a new feature or domain add to a base model: paired cross-validation, intervals, verdicts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import numeric, prob_to_logit
from riskloom.functions.mathx import student_quantile
from riskloom.operators.models import Boosting, Fit, RowSet, _value, fit_many, held, long_predictions, make_model, predict_many, score_many
from riskloom.operators.ranking import direct_auc, get_metric
from riskloom.operators.selection import correlation_matrix
from riskloom.operators.splits import DataSplit, make_folds, stratified_cap
from riskloom.operators.stability import feature_psi
from riskloom.plans.relational import running, safe_div, settled


def cv_interval(deltas: Sequence[float], train_share: float, alpha: float = 0.05) -> tuple[float, float]:
    """Corrected resampled t interval of paired fold differences: the variance is raised for overlapping training sets."""
    m = len(deltas)
    if m < 2:
        return math.nan, math.nan
    mean = sum(deltas) / m
    var = sum((d - mean) ** 2 for d in deltas) / (m - 1)
    se = math.sqrt((1 / m + (1 - train_share) / train_share) * var)
    t = student_quantile(1 - alpha / 2, m - 1)
    return mean - t * se, mean + t * se


def poisson_steps(most: int = 8) -> list[float]:
    """Distribution function of Poisson(1) at 0, 1, ... ``most`` - 1."""
    out, p = [], math.exp(-1)
    for k in range(most):
        out.append((out[-1] if out else 0.0) + p)
        p /= k + 1
    return out


def bootstrap_aucs(df: DataFrame, label: str, base: str, new: str, key: str, n_boot: int = 50, seed: int = 42, together: int = 20) -> DataFrame:
    """(b, base_auc, new_auc) of each repeat of a paired Poisson bootstrap.

    A row's count in repeat b is a Poisson(1) draw from 16 bits of the md5 of seed, b div 8 and key,
    so repeats are the same in any engine. Counts are columns: the histogram of a score is cut into
    ranges and summed up once for ``together`` repeats, and no row is written once a repeat.
    """
    steps = poisson_steps()
    rows = df.filter(F.col(label).isNotNull() & F.col(base).isNotNull() & F.col(new).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(label).cast("int").alias("y"), F.array(F.struct(F.lit("base").alias("s"), F.col(base).cast("double").alias("p")), F.struct(F.lit("new").alias("s"), F.col(new).cast("double").alias("p"))).alias("both"))
    parts = []
    for first in range(0, n_boot, together):
        repeats = range(first, min(n_boot, first + together))
        digests = {f"d_{c}": F.md5(F.concat(F.lit(f"{seed}|{c}|"), "k")) for c in sorted({r // 8 for r in repeats})}
        u = lambda r: F.conv(F.substring(f"d_{r // 8}", 1 + 4 * (r % 8), 4), 16, 10).cast("int") / 65536.0
        draws = rows.withColumns(digests).withColumns({f"u_{r}": u(r) for r in repeats}).withColumns({f"w_{r}": reduce(lambda c, t, r=r: c + (F.col(f"u_{r}") >= t).cast("int"), steps[1:], (F.col(f"u_{r}") >= steps[0]).cast("int")) for r in repeats})
        h = draws.select("y", F.explode("both").alias("x"), *[f"w_{r}" for r in repeats]).groupBy("x.s", "x.p").agg(*[F.sum(F.col(f"w_{r}") * F.col("y")).alias(f"q_{r}") for r in repeats], *[F.sum(F.col(f"w_{r}") * (1 - F.col("y"))).alias(f"g_{r}") for r in repeats])
        c = running(h, ["s"], "p", {f"c_{r}": F.col(f"g_{r}") for r in repeats})
        auc = lambda r: safe_div(F.sum(F.col(f"q_{r}") * (F.col(f"c_{r}") - F.col(f"g_{r}") / 2)), F.sum(f"q_{r}").cast("double") * F.max(f"c_{r}_all"))
        listed = c.groupBy("s").agg(F.array(*[F.struct(F.lit(r).alias("b"), auc(r).alias("auc")) for r in repeats]).alias("a")).select("s", F.inline("a"))
        parts.append(listed.groupBy("b").agg(F.max(F.when(F.col("s") == "base", F.col("auc"))).alias("base_auc"), F.max(F.when(F.col("s") == "new", F.col("auc"))).alias("new_auc")))
    return reduce(DataFrame.union, parts)


def bootstrap_interval(df: DataFrame, label: str, base: str, new: str, key: str, n_boot: int = 50, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row (ci_low, ci_high) of the AUC difference of two scores by a paired Poisson bootstrap."""
    delta = bootstrap_aucs(df, label, base, new, key, n_boot, seed).select((F.col("new_auc") - F.col("base_auc")).alias("d"))
    return delta.agg(F.percentile("d", alpha / 2).alias("ci_low"), F.percentile("d", 1 - alpha / 2).alias("ci_high"))  # one value a repeat


def cheap_stats(df: DataFrame, target: str, candidates: Sequence[str], base: Sequence[str], date: str | None = None, reference=None, freq: str = "month") -> DataFrame:
    """Per candidate, without a model: coverage, first and last filled date, AUC, strongest correlation with the base, largest psi by period."""
    filled = lambda f: numeric(df, f).isNotNull() if dict(df.dtypes)[f] != "string" else F.col(f).isNotNull()
    parts = [F.struct(F.lit(f).alias("feature"), (F.count_if(filled(f)) / F.count("*")).alias("coverage"), *([F.min(F.when(filled(f), F.col(date))).alias("filled_from"), F.max(F.when(filled(f), F.col(date))).alias("filled_to")] if date else [])) for f in candidates]
    out = df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    out = out.join(direct_auc(df, target, candidates), "feature", "left")
    numbers = [f for f in [*candidates, *base] if dict(df.dtypes)[f] != "string"]
    pairs = correlation_matrix(df, list(dict.fromkeys(numbers)))
    both = pairs.union(pairs.select("b", "a", "corr")).filter(F.col("a").isin(list(candidates)) & F.col("b").isin([b for b in base if b not in candidates]))
    out = out.join(both.groupBy(F.col("a").alias("feature")).agg(F.max(F.abs("corr")).alias("max_corr"), F.max_by("b", F.abs("corr")).alias("corr_with")), "feature", "left")
    if date:
        period = df.withColumn("__period", F.date_trunc(freq, date))
        first = reference if reference is not None else F.col("__period") == F.lit(period.agg(F.min("__period")).first()[0])
        worst = feature_psi(period, candidates, first, period="__period").groupBy("feature").agg(F.max("psi").alias("max_psi"))
        out = out.join(worst, "feature", "left")
    return out


@dataclass
class FeatureTest:
    """Tables of a test: summary (a row per candidate), folds, metrics by part, segments, and cheap statistics."""

    summary: DataFrame
    folds: DataFrame
    parts: DataFrame
    stats: DataFrame
    info: dict = field(default_factory=dict)

    def replacement(self, threshold: float = 0.7) -> list[tuple[str, str]]:
        """(candidate, base feature it may replace): correlated at least so much and not worse."""
        rows = self.summary.join(self.stats.select("feature", "max_corr", "corr_with"), self.summary["candidate"] == F.col("feature")).filter((F.col("max_corr") >= threshold) & (F.col("verdict") != "worse"))
        return [(r["candidate"], r["corr_with"]) for r in rows.collect()]

    def save(self, folder: str) -> None:
        import os

        from riskloom.sources.tables import write_csv

        os.makedirs(folder, exist_ok=True)
        for name in ("summary", "folds", "parts", "stats"):
            write_csv(getattr(self, name), f"{folder}/{name}.csv", single_file=True)


def _compared(train: DataFrame, conditions: Sequence[Column], evals: dict, target: str, base, extras: dict[str, Sequence[str]], metric, mode: str, model, key: str) -> dict:
    """{(eval, name): (base score, score with the extra features)} for all evals and extras.

    ``conditions`` choose rows of ``train`` to fit on; an eval is (number of its condition, table to score).
    ``base`` is features, a fitted model, or a score column. The base is fitted once for each condition, all
    extras of all conditions are fitted together, and all scores come from one plan.
    """
    fixed = isinstance(base, str) or (isinstance(base, Boosting) and bool(base.trees_))
    names = base.features if isinstance(base, Boosting) else [] if isinstance(base, str) else list(base)
    bases = [] if fixed else fit_many(train, target, [Fit(make_model(model), names, i) for i in range(len(conditions))], [RowSet(c) for c in conditions])

    def based(df: DataFrame, i: int, name: str) -> DataFrame:
        return df.withColumn(name, F.col(base)) if isinstance(base, str) else predict_many(df, {name: base if fixed else bases[i]})

    on_top = mode == "on_top"
    fits = [Fit(make_model("small" if on_top else model), [*([] if on_top else names), *extra], i) for extra in extras.values() for i in range(len(conditions))]
    if on_top:
        for i in range(len(conditions)):
            train = based(train, i, f"__base_{i}").withColumn(f"__margin_{i}", prob_to_logit(F.col(f"__base_{i}")))
    fit_many(train, target, fits, [RowSet(c, margin=F.col(f"__margin_{i}") if on_top else None) for i, c in enumerate(conditions)])
    keep, parts = list(dict.fromkeys([key, target])), []
    for e, (i, df) in enumerate(evals.values()):
        scored = based(df, i, "__base").withColumn("__margin", prob_to_logit(F.col("__base")))
        own = [x.model for x in fits if x.rows == i]
        new = long_predictions(scored, own, [*keep, "__base"], "__margin" if on_top else None)
        parts += [new.drop("__base").withColumn("e", F.lit(e)), scored.select(*keep, F.lit(-1).alias("model"), F.col("__base").alias("pred"), F.lit(e).alias("e"))]
    found = _value(reduce(DataFrame.unionByName, parts), metric, target, "pred", ["e", "model"], key)
    return {(label, name): (found.get((e, -1)), found.get((e, t))) for e, label in enumerate(evals) for t, name in enumerate(extras)}


def test_features(split: DataSplit, base, candidates: Sequence[str], key: str = "row_id", metric="roc_auc", mode: str = "on_top", n_splits: int = 3, max_rows: int | None = None, max_exact: int = 20, date: str | None = None, model="small", groups: dict[str, Sequence[str]] | None = None) -> FeatureTest:
    """Each candidate, and ALL together, against the base by paired folds of the training part: all its rows, if the caller sets no ``max_rows``.

    The verdict comes from the fold interval alone; val and test differences are for information.
    With more than ``max_exact`` candidates all are screened first by a small model of each upon the
    base, judged on val; those that gain least there are not tested and have the verdict ``screened``.
    """
    columns = set(split.data.columns)
    groups = {g: list(fs) for g, fs in groups.items()} if groups else {c: [c] for c in candidates}
    if absent := [c for fs in groups.values() for c in fs if c not in columns]:
        raise KeyError(f"columns are absent: {', '.join(absent)}")
    if not groups:
        raise ValueError("there are no candidates")
    if isinstance(base, str):
        bad = split.data.filter(F.col(base).isNull() | (F.col(base) < 0) | (F.col(base) > 1)).limit(1).count()
        if bad:
            raise ValueError("a base score must be a probability without nulls")
        if mode == "retrain":
            raise ValueError("a base score can only be built upon (mode on_top)")
    with held(split.data) as kept:
        out = _tested(DataSplit(kept, split.target), base, groups, key, metric, mode, n_splits, max_rows, max_exact, date, model)
        out.stats = settled(out.stats)  # a row a candidate
    return out


def _tested(split: DataSplit, base, groups: dict[str, list[str]], key: str, metric, mode: str, n_splits: int, max_rows: int | None, max_exact: int, date: str | None, model) -> FeatureTest:
    m = get_metric(metric)
    rows = split.train if max_rows is None else stratified_cap(split.train, split.target, key, max_rows)
    train = make_folds(rows, split.target, key, n_splits).cache()
    names = base.features if isinstance(base, Boosting) else [] if isinstance(base, str) else list(base)
    flat = list(dict.fromkeys(c for fs in groups.values() for c in fs))
    stats = cheap_stats(split.train, split.target, flat, names, date)
    tested, screen = dict(groups), {}
    of = lambda rows, conditions, evals, extras, how=mode: _compared(rows, conditions, evals, split.target, base, extras, metric, how, model, key)
    if len(groups) > max_exact:
        first = of(train, [F.lit(True)], {"val": (0, split.val)}, groups, "on_top")
        screen = {g: m.delta(first["val", g][1], first["val", g][0]) if None not in first["val", g] else -math.inf for g in groups}
        tested = dict(sorted(groups.items(), key=lambda g: (-screen[g[0]], g[0]))[:max_exact])
    if len(groups) > 1:
        tested["ALL"] = flat
    numbers = list(range(n_splits)) if n_splits > 1 else [0]
    by_fold = of(train, [F.col("fold") != k for k in numbers], {k: (k, train.filter(F.col("fold") == k)) for k in numbers}, tested)
    by_part = of(split.train, [F.lit(True)], {p: (0, d) for p, d in split.items() if p != "train"}, tested)
    summary, folds, parts = [], [], []
    share = 1 - 1 / n_splits
    for name, extra in tested.items():
        pairs = [(k, *by_fold[k, name]) for k in numbers]
        deltas = [m.delta(b, a) for _, a, b in pairs]
        folds += [(name, k, a, b, d) for (k, a, b), d in zip(pairs, deltas, strict=True)]
        low, high = cv_interval(deltas, share)
        mean = sum(deltas) / len(deltas)
        verdict = "better" if low > 0 else "worse" if high < 0 else "same"
        summary.append((name, len(extra), mean, None if math.isnan(low) else low, None if math.isnan(high) else high, verdict, screen.get(name)))
        parts += [(name, part, a, b, m.delta(b, a) if None not in (a, b) else None) for (part, n), (a, b) in by_part.items() if n == name]
    train.unpersist()
    summary += [(g, len(fs), None, None, None, "screened", screen[g]) for g, fs in groups.items() if g not in tested]
    spark = split.data.sparkSession
    table = spark.createDataFrame(summary, "candidate string, n_features int, delta_cv double, ci_low double, ci_high double, verdict string, screen_delta double").orderBy(F.desc_nulls_last("delta_cv"), "candidate")
    return FeatureTest(table, spark.createDataFrame(folds, "candidate string, fold int, base double, new double, delta double"), spark.createDataFrame(parts, "candidate string, part string, base double, new double, delta double"), stats, {"mode": mode, "screened": len(groups) - len([g for g in tested if g != "ALL"])})


def test_domains(split: DataSplit, base, domains: dict[str, Sequence[str]], **options) -> FeatureTest:
    """Whole domains of features against the base; none is screened out, if the caller sets no ``max_exact``.

    ``info`` has for each domain the AUC of a model of it ``alone`` on val, its ``gain_share`` of the
    importance of the model of base and domain (bases of features), and ``features``: domain,
    feature, importance, share of the domain's, coverage and direct_auc.
    """
    with held(split.data) as kept:
        return _domains(DataSplit(kept, split.target), base, domains, options)


def _domains(split: DataSplit, base, domains: dict[str, Sequence[str]], options: dict) -> FeatureTest:
    out = test_features(split, base, [], groups=domains, **{"max_exact": len(domains), **options})
    model = options.get("model", "small")
    alone, gains, rows = {}, {}, []
    names = base.features if isinstance(base, Boosting) else [] if isinstance(base, str) else list(base)
    cheap = {r["feature"]: r for r in out.stats.select("feature", "coverage", "direct_auc").collect()}
    sets = [list(fs) for fs in domains.values()] + [list(dict.fromkeys([*names, *fs])) for fs in domains.values()]
    fitted = fit_many(split.train, split.target, [Fit(make_model(model), fs, 0) for fs in sets], [RowSet(F.lit(True))])
    scores = score_many(split.val, fitted[: len(domains)], split.target, "roc_auc")
    for k, (name, fs) in enumerate(domains.items()):
        alone[name] = scores[k].get(())
        both = fitted[len(domains) + k].feature_importance()
        own, total = sum(both[f] for f in fs), sum(both.values())
        gains[name] = own / total if names and total else None
        rows += [(name, f, float(both[f]), both[f] / own if own else 0.0, cheap[f]["coverage"], cheap[f]["direct_auc"]) for f in fs]
    table = split.data.sparkSession.createDataFrame(rows, "domain string, feature string, importance double, share double, coverage double, direct_auc double")
    out.info |= {"alone": alone, "gain_share": gains, "features": table.orderBy("domain", F.desc("importance"), "feature")}
    return out


test_features.__test__ = test_domains.__test__ = False
