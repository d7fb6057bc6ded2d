"""Selection with models in the loop: importance, elimination, addition, incremental evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.models import Fit, RowSet, _value, cross_validate, cross_validate_many, fit_many, held, make_model, predict_many, score_many
from riskloom.operators.ranking import get_metric
from riskloom.operators.results import Result
from riskloom.operators.selection import Step
from riskloom.operators.splits import hash_rank

def permutation_importance(model, df: DataFrame, target: str, key: str = "row_id", metric="roc_auc", n_repeats: int = 3, features: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """feature, importance, std: how much the metric drops when the feature's values are dealt anew among the rows.

    Rows are numbered in two seeded orders; a row takes the value of the row with its number in the
    other order, by a join on the number: one a repeat, as the order doesn't depend on the feature.
    """
    m, names = get_metric(metric), list(features or model.features)
    with held(df, [*names, *model.features, key, target, "row_id"]) as kept:
        base = _value(model.predict(kept, "__p"), metric, target, "__p", (), key)[()]
        numbered = hash_rank(kept, key, seed).withColumnRenamed("__rank", "__i").drop("__n").persist()
        drops: dict[str, list[float]] = {f: [] for f in names}
        for r in range(n_repeats):
            other = hash_rank(kept.select(key, *names), key, seed + 1 + r).select(F.col("__rank").alias("__i"), *[F.col(f).alias(f"__other_{k}") for k, f in enumerate(names)])
            mixed = numbered.join(other, "__i")
            for k, f in enumerate(names):
                mixed = predict_many(mixed.withColumns({"__own": F.col(f), f: F.col(f"__other_{k}")}), {f"__p_{k}": model}).withColumn(f, F.col("__own"))
            found = mixed.select(key, target, F.posexplode(F.array(*[f"__p_{k}" for k in range(len(names))])).alias("model", "pred"))
            scores = _value(found, metric, target, "pred", ["model"], key)
            for k, f in enumerate(names):
                drops[f].append(m.delta(base, scores[(k,)]))
        numbered.unpersist()
    rows = []
    for f, own in drops.items():
        mean = sum(own) / len(own)
        rows.append((f, mean, math.sqrt(sum((d - mean) ** 2 for d in own) / len(own))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, std double").orderBy(F.desc("importance"), "feature")


def cumulative_importance_selection(df: DataFrame, target: str, features: Sequence[str], key: str = "row_id", threshold: float = 0.9, importance: str = "gain", model="boosting", metric="roc_auc", test_size: float = 0.2, seed: int = 42) -> Result:
    """The smallest set of leading features whose importances add up to the threshold's share; at least one."""
    ranked = hash_rank(df, key, seed, [target])
    part = ranked.withColumn("__val", F.col("__rank") <= F.bround(F.col("__n") * test_size)).drop("__rank", "__n").cache()
    train, val = part.filter("NOT __val"), part.filter("__val")
    full = make_model(model).fit(train, target, features, valid=val, metric=metric)
    if importance == "permutation":
        values = {r["feature"]: max(0.0, r["importance"]) for r in permutation_importance(full, val, target, key, metric).collect()}
    else:
        values = full.feature_importance(importance)
    order = sorted(features, key=lambda f: (-values[f], f))
    total = sum(values.values())
    kept, acc = [], 0.0
    for f in order:
        kept.append(f)
        acc += values[f]
        if total <= 0 or acc >= threshold * total - 1e-12:
            break
    small = make_model(model).fit(train, target, kept, valid=val, metric=metric)
    score = lambda m: _value(m.predict(val, "__p"), metric, target, "__p", (), key)[()]
    info = {"score_full": score(full), "score_selected": score(small), "threshold": threshold}
    part.unpersist()
    running, rows = 0.0, []
    for f in order:
        running += values[f]
        rows.append((f, float(values[f]), running / total if total > 0 else None, "keep" if f in kept else "drop"))
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double, cumulative_share double, action string")
    return Result("importance", table, [f for f in features if f in set(kept)], info)


def _scores(models: Sequence, parts: dict[str, DataFrame], target: str, metric, key: str) -> list[dict[str, float]]:
    """For each model its score on each part, all in one plan."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("__part", F.lit(p)) for p, d in parts.items()])
    return [{k[0]: v for k, v in s.items()} for s in score_many(whole, models, target, metric, ["__part"], key)]


def _fitted(train: DataFrame, valid: DataFrame | None, target: str, sets: Sequence[Sequence[str]], model, metric) -> list:
    """A model for each set of features, fitted together."""
    whole = train.withColumn("__role", F.lit(1))
    if valid is not None:
        whole = whole.unionByName(valid.withColumn("__role", F.lit(2)), allowMissingColumns=True)
    rows = RowSet(F.col("__role") == 1, None if valid is None else F.col("__role") == 2)
    return fit_many(whole, target, [Fit(make_model(model), list(fs)) for fs in sets], [rows], metric)


def drop_column_importance(train: DataFrame, val: DataFrame, features: Sequence[str], target: str, test: DataFrame | None = None, model="small", metric="roc_auc", key: str = "row_id") -> DataFrame:
    """feature, delta_val, delta_test: the loss of a model fitted without the feature; positive is useful. All models are fitted together."""
    parts = {"val": val} | ({"test": test} if test is not None else {})
    m = get_metric(metric)
    models = _fitted(train, val, target, [features, *([x for x in features if x != f] for f in features)], model, metric)
    full, *found = _scores(models, parts, target, metric, key)
    rows = [(f, m.delta(full["val"], s["val"]), m.delta(full["test"], s["test"]) if test is not None else None) for f, s in zip(features, found, strict=True)]
    return train.sparkSession.createDataFrame(rows, "feature string, delta_val double, delta_test double").orderBy(F.desc("delta_val"), "feature")


def rfe(df: DataFrame, target: str, features: Sequence[str], key: str = "row_id", fold: str = "fold", min_features: int = 1, step: int = 1, tol: float = 0.0, segment: str | None = None, segment_tol: float = 0.0, metric="roc_auc", model="small", missing_threshold: float = 0.999, importance: str = "gain") -> Result:
    """Recursive elimination by cross-validation.

    Each round tries the ``step`` least important features one by one and drops one if the mean
    metric falls by no more than ``tol`` and no segment by more than ``segment_tol``; the score then
    becomes the new base. It ends when a round drops nothing.
    """
    with held(df, [*features, target, key, fold, "row_id", *([segment] if segment else [])]) as kept:
        return _rfe(kept, target, features, key, fold, min_features, step, tol, segment, segment_tol, metric, model, missing_threshold, importance)


def _rfe(df: DataFrame, target: str, features: Sequence[str], key: str, fold: str, min_features: int, step: int, tol: float, segment: str | None, segment_tol: float, metric, model, missing_threshold: float, importance: str) -> Result:
    from riskloom.functions.columns import numeric

    m = get_metric(metric)
    stats = df.agg(F.count("*").alias("n"), *[F.count_if(numeric(df, f).isNull() if dict(df.dtypes)[f] != "string" else F.col(f).isNull()).alias(f"m_{k}") for k, f in enumerate(features)], *[F.count_distinct(f).alias(f"u_{k}") for k, f in enumerate(features)]).first()
    log, now = [], []
    for k, f in enumerate(features):
        share = stats[f"m_{k}"] / max(1, stats["n"])
        reason = "missing" if share >= missing_threshold else "constant" if stats[f"u_{k}"] <= 1 else None
        if reason:
            log.append((0, f, "prefilter", None, None, reason))
        else:
            now.append(f)

    def evaluate(fs: list[str]):
        cv = cross_validate(df, target, fs, key, fold, model, metric, segment)
        by: dict = {}
        for s in cv.segments:
            by.setdefault(s["segment"], []).append(s["score"])
        return cv, {k: sum(v) / len(v) for k, v in by.items() if None not in v}

    base, base_segments = evaluate(now)
    log.append((0, None, "baseline", base.mean, None, None))
    iteration = 0
    while len(now) > min_features:
        iteration += 1
        fitted = make_model(model, n_trees=max(1, base.mean_best_iteration)).fit(df, target, now)
        weakest = sorted(now, key=lambda f: (fitted.feature_importance(importance)[f], now.index(f)))[:step]
        dropped = False
        for f in weakest:
            if len(now) <= min_features:
                break
            trial, segments = evaluate([x for x in now if x != f])  # a drop changes what the next trial starts from
            delta = m.delta(trial.mean, base.mean)
            worst = min((m.delta(segments[s], base_segments[s]) for s in segments if s in base_segments), default=0.0)
            good = delta >= -tol and worst >= -segment_tol
            log.append((iteration, f, "drop" if good else "keep", trial.mean, delta, None))
            if good:
                now, base, base_segments, dropped = [x for x in now if x != f], trial, segments, True
        if not dropped:
            log.append((iteration, None, "stop", base.mean, None, None))
            break
    log.append((iteration, None, "final", base.mean, None, None))
    table = df.sparkSession.createDataFrame(log, "iteration int, feature string, action string, score double, delta double, reason string")
    return Result("rfe", table, now, {"score": base.mean})


def backward_elimination(train: DataFrame, valid: DataFrame, target: str, features: Sequence[str], key: str = "row_id", min_features: int = 1, metric="roc_auc", model="small", importance: str = "gain", segment: str | None = None, min_segment_size: int = 100, patience: int = 50) -> Result:
    """Drop the least important feature one after another, for as long as there are ``min_features``.

    A row for each feature dropped, the last one too: the scores of the model that still has it on train, on valid and on valid's
    segments of at least ``min_segment_size`` rows (a null segment is NaN), its importance there, and what each score gains
    (below 0: loses) without it; null if no feature is left. The features of the best valid score are selected.
    """
    columns = [*features, target, key, "row_id", *([segment] if segment else [])]
    with held(train, columns) as kept, held(valid, columns) as judged:
        return _eliminated(kept, judged, target, features, key, min_features, metric, model, importance, segment, min_segment_size, patience)


def _eliminated(train: DataFrame, valid: DataFrame, target: str, features: Sequence[str], key: str, min_features: int, metric, model, importance: str, segment: str | None, min_segment_size: int, patience: int) -> Result:
    m, now, steps = get_metric(metric), [f for f in features if f != segment], []
    label = [F.concat(F.lit("="), F.coalesce(F.col(segment).cast("string"), F.lit("NaN")))] if segment else []  # no segment is named like a part
    large = [r["s"] for r in valid.groupBy(label[0].alias("s")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_segment_size).collect()] if segment else []
    twice = valid.withColumn("__part", F.explode(F.array(F.lit("valid"), *label))).filter(F.col("__part").isin("valid", *large))
    whole = train.withColumn("__part", F.lit("train")).unionByName(twice, allowMissingColumns=True)

    def judged(fs: list[str]) -> tuple:
        fitted = make_model(model).fit(train, target, fs, valid=valid, metric=metric, patience=patience)
        return fitted, {k[0]: v for k, v in score_many(whole, [fitted], target, metric, ["__part"], key)[0].items()}

    while now and len(now) >= min_features:
        fitted, scores = judged(now)
        own = fitted.feature_importance(importance)
        worst = min(now, key=lambda f: (own[f], now.index(f)))
        steps.append((now, worst, float(own[worst]), scores))
        now = [f for f in now if f != worst]
    after = [s for *_, s in steps[1:]] + [judged(now)[1] if now and steps else {}]  # the set without the last one is judged too

    def gained(before: dict, then: dict) -> dict:
        return {p: m.delta(then[p], v) if v is not None and then.get(p) is not None else None for p, v in before.items()}

    inner = lambda scores: {p[1:]: v for p, v in sorted(scores.items()) if p.startswith("=")}
    rows = []
    for k, ((fs, worst, value, s), then) in enumerate(zip(steps, after, strict=False)):
        delta = gained(s, then)
        rows.append((k, len(fs), worst, s.get("train"), s.get("valid"), list(fs), delta.get("valid"), value, delta.get("train"), inner(s), inner(delta)))
    table = train.sparkSession.createDataFrame(rows, "step int, n_features int, removed string, train double, valid double, features_set array<string>, delta_valid double, removed_importance double, delta_train double, segments map<string,double>, delta_segments map<string,double>")
    best = max((r for r in rows if r[4] is not None), key=lambda r: (r[4] if m.greater_is_better else -r[4], -r[1]), default=None)
    return Result("backward", table, best[5] if best else list(features), {"best_step": best[0] if best else None, "segments": sorted(s[1:] for s in large)})


def forward_addition(train: DataFrame, valid: DataFrame, target: str, base: Sequence[str], candidates: Sequence[str], mode: str = "one_by_one", groups: dict[str, Sequence[str]] | None = None, key: str = "row_id", metric="roc_auc", model="small") -> Result:
    """BASE, then each candidate, all together, or each group, with deltas against BASE. Candidates in the base are left out."""
    fresh = [c for c in candidates if c not in set(base)]
    trials = {"one_by_one": {c: [c] for c in fresh}, "all_together": {"ALL": fresh}, "groups": {g: [c for c in cs if c not in set(base)] for g, cs in (groups or {}).items()}}.get(mode)
    if trials is None:
        raise ValueError("mode is one_by_one, all_together or groups")
    m = get_metric(metric)

    sets = [list(base), *([*base, *extra] for extra in trials.values())]
    columns = [*(f for fs in sets for f in fs), target, key, "row_id"]
    with held(train, columns) as kept, held(valid, columns) as judged:
        models = _fitted(kept, judged, target, sets, model, metric)
        start, *found = _scores(models, {"train": kept, "valid": judged}, target, metric, key)
    rows = [("BASE", start["train"], start["valid"], 0.0, 0.0)] + [(n, s["train"], s["valid"], m.delta(s["train"], start["train"]), m.delta(s["valid"], start["valid"])) for n, s in zip(trials, found, strict=True)]
    table = train.sparkSession.createDataFrame(rows, "added string, train double, valid double, delta_train double, delta_valid double")
    good = {n for n, s in zip(trials, found, strict=True) if m.delta(s["valid"], start["valid"]) > 0}
    return Result("forward", table, [*base, *dict.fromkeys(c for n in trials if n in good for c in trials[n])])


def incremental_feature_eval(df: DataFrame, target: str, features: Sequence[str], key: str = "row_id", fold: str = "fold", direction: str = "forward", mode: str = "ordered", eval_sets: dict[str, DataFrame] | None = None, max_steps: int | None = None, metric="roc_auc", model="small") -> Result:
    """Add (or remove) features step by step in the given order or greedily by cross-validation.

    Per step: mean and std over folds, delta, share of the full score and of its signal above one
    half. ``eval_sets`` are scored for information and never influence the choice.
    """
    with held(df, [*features, target, key, fold, "row_id"]) as kept:
        return _incremental(kept, target, features, key, fold, direction, mode, eval_sets, max_steps, metric, model)


def _incremental(df: DataFrame, target: str, features: Sequence[str], key: str, fold: str, direction: str, mode: str, eval_sets: dict[str, DataFrame] | None, max_steps: int | None, metric, model) -> Result:
    m, eval_sets = get_metric(metric), eval_sets or {}
    full = cross_validate(df, target, list(features), key, fold, model, metric)
    rows, last = [], None

    def note(name: str | None, fs: list[str], cv) -> None:
        nonlocal last
        external = {}
        if eval_sets:
            fitted = make_model(model, n_trees=max(1, cv.mean_best_iteration)).fit(df, target, fs)
            external = _scores([fitted], eval_sets, target, metric, key)[0]
        signal = (cv.mean - 0.5) / (full.mean - 0.5) if full.mean != 0.5 else None
        rows.append((len(rows) + 1, name, len(fs), cv.mean, cv.std, None if last is None else m.delta(cv.mean, last), cv.mean / full.mean if full.mean else None, signal, {k: v for k, v in external.items()}, list(fs)))
        last = cv.mean

    left = list(features)
    steps = min(max_steps or len(left), len(left))
    # In a given order all steps are known beforehand and fitted together.
    planned = [features[: k + 1] for k in range(steps)] if direction == "forward" else [left[: len(left) - k - 1] for k in range(min(steps, len(left) - 1))]
    ready = iter(cross_validate_many(df, target, [(list(fs), model) for fs in planned], key, fold, metric) if mode == "ordered" and planned else [])
    if direction == "forward":
        now: list[str] = []
        for _ in range(steps):
            if mode == "greedy":
                trials = dict(zip(left, cross_validate_many(df, target, [([*now, f], model) for f in left], key, fold, metric), strict=True))
                pick = max(left, key=lambda f: trials[f].mean if m.greater_is_better else -trials[f].mean)
                cv = trials[pick]
            else:
                pick, cv = left[0], next(ready)
            now.append(pick)
            left.remove(pick)
            note(pick, now, cv)
    elif direction == "backward":
        note(None, left, full)
        for _ in range(min(steps, len(left) - 1)):
            if mode == "greedy":
                trials = dict(zip(left, cross_validate_many(df, target, [([x for x in left if x != f], model) for f in left], key, fold, metric), strict=True))
                pick = max(left, key=lambda f: trials[f].mean if m.greater_is_better else -trials[f].mean)
                cv = trials[pick]
            else:
                pick, cv = left[-1], next(ready)
            left = [x for x in left if x != pick]
            note(pick, left, cv)
    else:
        raise ValueError("direction is forward or backward")
    table = df.sparkSession.createDataFrame(rows, "step int, feature string, n_features int, mean double, std double, delta double, ratio double, signal_ratio double, eval_scores map<string,double>, features_set array<string>")
    best = max(rows, key=lambda r: r[3] if m.greater_is_better else -r[3])
    return Result("incremental", table, best[9], {"best_step": best[0]})


def univariate_step(**options) -> Step:
    from riskloom.operators.models import univariate_filter

    return Step("univariate", lambda df, y, fs, cats, **o: univariate_filter(df, y, fs, **o), options)


def importance_step(**options) -> Step:
    return Step("importance", lambda df, y, fs, cats, **o: cumulative_importance_selection(df, y, fs, **o), options)


def rfe_step(**options) -> Step:
    return Step("rfe", lambda df, y, fs, cats, **o: rfe(df, y, fs, **o), options)


def model_strength(df: DataFrame, target: str, fold: str = "fold", key: str = "row_id") -> Callable[[str], float]:
    """A feature's cross-validated AUC, for the correlation filter's model and hybrid strategies."""
    return lambda f: cross_validate(df, target, [f], key, fold, "small").mean
