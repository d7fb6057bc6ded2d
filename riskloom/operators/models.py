"""Models: preparation, boosting on binned features, cross-validation, training, comparison, tuning.

The learner is Newton boosting over histograms, leaf by leaf. Features are cut into at most ``max_bins`` bins once
(missing values have a bin of their own); trees grow as ``growing`` tells, those of all folds, candidates and
parameter sets of a call together (``fit_many``). Each row carries its margin, so the
work a tree costs doesn't grow with the trees before it. Predictions of small models are column
expressions; those of large ones are worked out in Arrow batches.
"""

from __future__ import annotations

import json
import math
import time
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.columns import category_of_number, category_strings, normalize_missing, numeric, to_number
from riskloom.operators import growing
from riskloom.operators.ranking import get_metric
from riskloom.operators.splits import DataSplit, exact_sample, hash_rank
from riskloom.plans.relational import TableInFolder, running, settled

# Fixed values of the usual sizes: trees, depth, leaves, rate, shares of rows and features a tree sees, rounds without improvement.
BOOSTING = {"n_trees": 5000, "depth": 4, "num_leaves": 16, "learning_rate": 0.03, "subsample": 0.8, "colsample": 0.8, "min_leaf": 20, "ridge": 1.0, "max_bins": 32, "max_categories": 1000, "accuracy": 10_000, "seed": 42}
PLAIN = {**BOOSTING, "num_leaves": None, "subsample": 1.0, "colsample": 1.0}
#: Trees split alike at every depth, categories by the target statistics of the rows before them in a seeded order, which ``prior`` rows of the mean precede.
SYMMETRIC = {**PLAIN, "symmetric": True, "ridge": 3.0, "prior": 1.0}
SMALL_BOOSTING = {**PLAIN, "n_trees": 5, "depth": 2, "learning_rate": 0.6}
FOREST_LIKE = {**PLAIN, "n_trees": 5, "depth": 4, "learning_rate": 0.5}
#: Fixed values of the small model that tells a feature's own strength, and its rounds without improvement.
UNIVARIATE = {**PLAIN, "n_trees": 500, "learning_rate": 0.05, "num_leaves": 8, "depth": 7, "min_leaf": 50}
UNIVARIATE_STOPPING = 30
EARLY_STOPPING = 100

#: Trees that are grown before the validation metric is looked at again and the margins are written anew.
CHUNK = 10
#: Quantiles are approximate up to this accuracy; those of a greater one are exact.
APPROXIMATE = 10_000
#: Models of more trees are scored in Arrow batches.
EXPRESSION_TREES = 64


def merge_params(base: dict, changes: dict | None) -> dict:
    return {**base, **(changes or {})}


@dataclass
class FeaturePreparer:
    """Bins of each feature, learnt on training rows alone: quantile edges of numbers, sorted categories of texts.

    Bin 0 is missing. The ``max_categories`` most frequent categories have a bin each; all others,
    unseen ones too, share one more, or are missing if there were no more. Absent columns raise KeyError.
    ``accuracy`` is that of the approximate quantiles: ranks are off by rows / accuracy at most; above APPROXIMATE they are exact.
    """

    features: list[str]
    categorical: list[str] | None = None
    max_bins: int = 32
    edges: dict[str, list[float]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    max_categories: int = 1000
    others: list[str] = field(default_factory=list)
    accuracy: int = 10_000
    #: Target statistics of categories that are used as numbers; the empty text stands for missing, and what isn't there has the mean.
    encoders: dict[str, dict[str, float]] = field(default_factory=dict)
    mean: float = 0.0

    def _check(self, df: DataFrame) -> None:
        if absent := [f for f in self.features if f not in df.columns]:
            raise KeyError(f"columns are absent: {', '.join(absent)}")

    def fit(self, df: DataFrame) -> FeaturePreparer:
        prepare_many(df, [(self, F.lit(True))])
        return self

    def fit_categories(self, df: DataFrame, f: str) -> None:
        self.take_categories(f, df.groupBy(self._text(df, f).alias("v")).agg(F.count("*").alias("n")).filter("v IS NOT NULL"))

    def take_categories(self, f: str, counts: DataFrame) -> None:
        """Learn the categories from the counts ``n`` of the texts ``v``."""
        found = [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(self.max_categories + 1).collect()]
        self.categories[f] = sorted(found[: self.max_categories])
        if len(found) > self.max_categories:
            self.others.append(f)

    def part(self, features: Sequence[str]) -> FeaturePreparer:
        """The same bins for some of the features."""
        own = lambda d: {f: d[f] for f in features if f in d}
        return FeaturePreparer(list(features), [f for f in self.categorical or [] if f in features], self.max_bins, own(self.edges), own(self.categories), self.max_categories, [f for f in self.others if f in features], self.accuracy, own(self.encoders), self.mean)

    def width(self) -> int:
        """Bins of the feature that has most, that of missing values included."""
        return 2 + max([0, *map(len, self.edges.values()), *map(len, self.categories.values())])

    @staticmethod
    def _text(df: DataFrame, f: str) -> Column:
        return category_strings(F.col(f)) if dict(df.dtypes)[f] == "string" else category_of_number(F.col(f))

    def bin(self, df: DataFrame, f: str) -> Column:
        if f in self.categories:
            return self.bin_of_text(self._text(df, f), f)
        return self.bin_of(self.encoded(df, f) if f in self.encoders else numeric(df, f), f)

    def bin_of_text(self, text: Column, f: str) -> Column:
        at = F.element_at(F.from_json(F.lit(json.dumps({c: k for k, c in enumerate(self.categories[f], 1)})), "map<string,int>"), text)
        rest = F.coalesce(at, F.when(text.isNotNull(), len(self.categories[f]) + 1)) if f in self.others else at
        return F.coalesce(rest, F.lit(0))

    def encoded(self, df: DataFrame, f: str) -> Column:
        """A category's target statistic."""
        return self.encoded_text(self._text(df, f), f)

    def encoded_text(self, text: Column, f: str) -> Column:
        known = F.from_json(F.lit(json.dumps(self.encoders[f])), "map<string,double>")
        return F.coalesce(F.element_at(known, F.coalesce(text, F.lit(""))), F.lit(float(self.mean)))

    def bin_of(self, x: Column, f: str) -> Column:
        return cell_of(x, self.edges[f])

    def transform(self, df: DataFrame, prefix: str = "__bin_") -> DataFrame:
        self._check(df)
        valued, names = with_values(df, [(self, f) for f in self.features])
        bins = {f"{prefix}{k}": self.bin_of(F.col(v), f) if f in self.edges else F.col(v) for k, (f, v) in enumerate(zip(self.features, names, strict=True))}
        return valued.withColumns(bins).select(*df.columns, *bins)

    def spec(self) -> dict:
        return {"features": self.features, "categorical": self.categorical, "max_bins": self.max_bins, "edges": self.edges, "categories": self.categories, "max_categories": self.max_categories, "others": self.others, "accuracy": self.accuracy, "encoders": self.encoders, "mean": self.mean}


def cell_of(x: Column, edges: Sequence[float]) -> Column:
    """0 for null, otherwise one more than the sorted ``edges`` below x: nested comparisons by halves, which Spark compiles.

    x is repeated for each edge, so let it be a column and no long expression.
    """

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(x > F.lit(float(edges[middle])), among(middle + 1, high)).otherwise(among(low, middle))

    return F.when(x.isNull(), 0).otherwise(among(0, len(edges)))


def with_values(df: DataFrame, wanted: Sequence[tuple[FeaturePreparer, str]]) -> tuple[DataFrame, list[str]]:
    """``df`` with the value of each (preparer, feature), a number or the bin of a category, and the columns' names.

    A feature's number or text is a column of its own, worked out once for all preparers; bins that are alike are one column.
    """
    raw: dict[tuple, tuple[str, Column]] = {}
    own: dict[tuple, tuple[str, Column]] = {}
    names = []
    for p, f in wanted:
        text = f in p.categories or f in p.encoders
        source = raw.setdefault((f, text), (f"__r_{len(raw)}", p._text(df, f) if text else numeric(df, f)))[0]
        if not text:
            names.append(source)
        elif f in p.encoders:
            names.append(own.setdefault((f, p.mean, *p.encoders[f].items()), (f"__s_{len(own)}", p.encoded_text(F.col(source), f)))[0])
        else:
            names.append(own.setdefault((f, f in p.others, *p.categories[f]), (f"__s_{len(own)}", p.bin_of_text(F.col(source), f)))[0])
    return df.withColumns(dict(raw.values())).withColumns(dict(own.values())) if own else df.withColumns(dict(raw.values())), names


class Boosting:
    """Binary boosting (or regression with ``loss='squared'``) with early stopping on a validation table and a starting margin."""

    def __init__(self, loss: str = "logistic", name: str = "boosting", **params):
        self.loss, self.name, self.params = loss, name, merge_params(BOOSTING, params)
        self.trees_: list[list[dict]] = []

    def clone(self, **changes) -> Boosting:
        return Boosting(self.loss, self.name, **merge_params(self.params, changes))

    def fit(self, train: DataFrame, target: str, features: Sequence[str], categorical: Sequence[str] | None = None, valid: DataFrame | None = None, metric="roc_auc", patience: int = EARLY_STOPPING, weight: str | None = None, margin: str | None = None) -> Boosting:
        """Fit on ``train``, stop early by ``valid``; absent columns raise KeyError."""
        for df in (train, valid):
            if df is not None and (absent := [f for f in features if f not in df.columns]):
                raise KeyError(f"columns are absent: {', '.join(absent)}")
        keep = list(dict.fromkeys([*features, target, *(c for c in (weight, margin, "row_id") if c and c in train.columns)]))
        whole = train.select(*keep, F.lit(1).alias("__role"))
        if valid is not None:
            whole = whole.unionByName(valid.select(*(c for c in keep if c in valid.columns), F.lit(2).alias("__role")), allowMissingColumns=True)
        rows = RowSet(F.col("__role") == 1, None if valid is None else F.col("__role") == 2, F.col(weight) if weight else None, F.col(margin) if margin else None)
        fit_many(whole, target, [Fit(self, list(features), 0, None if categorical is None else list(categorical))], [rows], metric, patience)
        return self

    def _link(self, m: Column) -> Column:
        return 1 / (1 + F.exp(-m)) if self.loss == "logistic" else m

    def _rule(self, node: dict, x: Sequence[str]) -> str:
        """SQL that is true for rows that go left, over the columns ``x`` of ``with_values``: numbers are compared with the edge itself, without bins; missing ones go where the rule says."""
        f, v = self.features[node["feature"]], x[node["feature"]]
        if "left_bins" in node:
            return f"{v} IN ({', '.join(map(str, node['left_bins']))})"
        if f not in self.preparer.edges:
            return f"{v} <= {node['cut']}" + ("" if node["missing_left"] else f" AND {v} > 0")
        edges = self.preparer.edges[f]
        within = f"{v} <= double('{edges[node['cut'] - 1]!r}')" if node["cut"] <= len(edges) else f"{v} IS NOT NULL"
        return f"({v} IS NULL OR {within})" if node["missing_left"] else within

    def _sql(self, nodes: list[dict], x: Sequence[str], at: int = 0) -> str:
        """A tree as one nested SQL expression over the columns ``x``."""
        node = nodes[at]
        if "left" not in node:
            return f"({float(node['value'])!r}D)"
        return f"IF({self._rule(node, x)}, {self._sql(nodes, x, node['left'])}, {self._sql(nodes, x, node['right'])})"

    def _margin(self, start: Column, x: Sequence[str]) -> Column:
        """``start`` with the trees' values added, two by two so that the expression stays shallow."""
        start = start + F.lit(float(self.base_))
        if len(self.trees_) > EXPRESSION_TREES:
            p = self.preparer
            return start + _batch_scorer(self.trees_)(F.array(*[p.bin_of(F.col(v), f) if f in p.edges else F.col(v) for f, v in zip(self.features, x, strict=True)]))
        parts = [self._sql(t, x) for t in self.trees_]
        while len(parts) > 1:
            parts = [" + ".join(parts[k : k + 2]) if k + 1 == len(parts) else f"({parts[k]} + {parts[k + 1]})" for k in range(0, len(parts), 2)]
        return start + F.expr(parts[0]) if parts else start

    def predict(self, df: DataFrame, name: str = "prediction", margin: str | None = None) -> DataFrame:
        """``df`` with the prediction: a probability, or a value for regression."""
        return predict_many(df, {name: self}, margin)

    def feature_importance(self, kind: str = "gain") -> dict[str, float]:
        return dict(sorted((self.gain_ if kind == "gain" else self.splits_).items(), key=lambda x: (-x[1], x[0])))

    def to_json(self) -> str:
        return json.dumps({"loss": self.loss, "name": self.name, "params": self.params, "base": self.base_, "trees": self.trees_, "gain": self.gain_, "splits": self.splits_, "n": self.n_iterations_, "preparer": self.preparer.spec()})

    @classmethod
    def from_json(cls, text: str) -> Boosting:
        x = json.loads(text)
        out = cls(x["loss"], x["name"], **x["params"])
        out.preparer = FeaturePreparer(**x["preparer"])
        out.features, out.base_, out.trees_, out.gain_, out.splits_, out.n_iterations_ = x["preparer"]["features"], x["base"], x["trees"], x["gain"], x["splits"], x["n"]
        return out


def predict_many(df: DataFrame, models: dict[str, Boosting], margin: str | None = None) -> DataFrame:
    """``df`` with a column for each model's prediction."""
    for m in models.values():
        m.preparer._check(df)
    valued, names = with_values(df, [(m.preparer, f) for m in models.values() for f in m.features])
    start, left = F.col(margin).cast("double") if margin else F.lit(0.0), iter(names)
    made = {name: m._link(m._margin(start, [next(left) for _ in m.features])) for name, m in models.items()}
    return valued.withColumns(made).drop(*names, *(c for c in valued.columns if c.startswith("__r_")))


def long_predictions(df: DataFrame, models: Sequence[Boosting], keep: Sequence[str], margin: str | None = None) -> DataFrame:
    """A row for each row and model: ``keep``, the model's number and its prediction."""
    scored = predict_many(df, {f"__p_{k}": m for k, m in enumerate(models)}, margin)
    return scored.select(*keep, F.posexplode(F.array(*[f"__p_{k}" for k in range(len(models))])).alias("model", "pred"))


def score_many(df: DataFrame, models: Sequence[Boosting], target: str, metric, by: Sequence[str] = (), key: str | None = None, margin: str | None = None) -> list[dict]:
    """For each model the metric by group, all in one plan."""
    keep = list(dict.fromkeys([*by, target, *([key] if key and key in df.columns else [])]))
    found = _value(long_predictions(df, models, keep, margin), metric, target, "pred", ["model", *by], key if key in df.columns else None)
    return [{k[1:]: v for k, v in found.items() if k[0] == i} for i in range(len(models))]


@dataclass
class RowSet:
    """Rows of a table to fit on, to stop early by, their weights, and a margin to start from."""

    train: Column
    valid: Column | None = None
    weight: Column | None = None
    margin: Column | None = None


@dataclass
class Fit:
    """A model to be fitted on the features, on the row set of that number."""

    model: Boosting
    features: list[str]
    rows: int = 0
    categorical: list[str] | None = None


def prepare_many(df: DataFrame, wanted: Sequence[tuple[FeaturePreparer, Column]], ordered: dict[int, tuple] | None = None, tables: list[TableInFolder] | None = None) -> DataFrame:
    """Learn the bins of several preparers, each on its rows of one table: as each alone, but with one job for all types and one for all quantiles.

    Preparers in ``ordered``, with (target, prior, seed), have their categories encoded by ordered target statistics; the table
    comes back with these as columns. Each is worked out on a table of its own in ``tables``, for the caller to delete, as
    the plan of a statistic holds its table's plan several times.
    """
    ordered = ordered or {}
    strings = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    odd = {}
    for k, (p, rows) in enumerate(wanted):
        p._check(df)
        if p.categorical is None:
            odd |= {f"{k}|{f}": F.count_if(rows & F.col(f"__odd_{f}")) for f in p.features if f in strings}
    told = {f"__odd_{f}": normalize_missing(F.col(f)).isNotNull() & to_number(F.col(f)).isNull() for f in sorted({name.split("|", 1)[1] for name in odd})}
    seen = df.withColumns(told).agg(*[x.alias(name) for name, x in odd.items()]).first() if odd else {}
    for k, (p, _) in enumerate(wanted):
        if p.categorical is None:
            p.categorical = [f for f in p.features if f in strings and seen[f"{k}|{f}"]]
    for k, (p, rows) in enumerate(wanted):
        if k in ordered:
            target, prior, seed = ordered[k]
            for f in p.categorical:
                if (rank := f"__rank_{seed}") not in df.columns:
                    df = _in_table(_ranked(df, seed).withColumnRenamed("__rank", rank), tables)
                df, p.encoders[f], p.mean = with_ordered_stats(df, target, p._text(df, f), rows, f"__ts_{k}_{f}", prior, seed, p.max_categories, rank)
                df = _in_table(df, tables)
    cuts, exact = {}, {}
    for k, (p, rows) in enumerate(wanted):
        shares = [i / (p.max_bins - 1) for i in range(1, p.max_bins - 1)]
        values = {f"{k}|{f}": F.when(rows, F.col(f"__ts_{k}_{f}") if f in p.encoders else numeric(df, f)) for f in p.features if f in p.encoders or f not in p.categorical}
        if p.accuracy > APPROXIMATE:
            exact |= {name: (x, shares) for name, x in values.items()}
        else:
            cuts |= {name: F.percentile_approx(x, F.array(*map(F.lit, shares)), p.accuracy) for name, x in values.items()}
    found = df.agg(*[x.alias(name) for name, x in cuts.items()]).first().asDict() if cuts else {}
    found |= exact_cuts(df, exact) if exact else {}
    for k, (p, rows) in enumerate(wanted):
        p.edges = {f: sorted(set(found[f"{k}|{f}"] or [])) for f in p.features if f in p.encoders or f not in p.categorical}
    plain = [(k, f) for k, (p, _) in enumerate(wanted) for f in p.features if f in p.categorical and f not in p.encoders]
    for f in dict.fromkeys(f for _, f in plain):  # counts of a text for all preparers at once
        users = [k for k, g in plain if g == f]
        counts = df.groupBy(wanted[users[0]][0]._text(df, f).alias("v")).agg(*[F.count_if(wanted[k][1]).alias(f"n_{k}") for k in users]).filter("v IS NOT NULL").persist()
        for k in users:
            wanted[k][0].take_categories(f, counts.select("v", F.col(f"n_{k}").alias("n")).filter("n > 0"))
        counts.unpersist()
    return df


def exact_cuts(df: DataFrame, columns: dict[str, tuple[Column, Sequence[float]]]) -> dict[str, list[float]]:
    """For each (column, shares) the values of rank ceil(share * n), at least 1, among the n that are present; exact.

    Approximate quantiles give a bracket about each value. One aggregation counts what lies between the brackets and
    the values inside, a small share of the rows, and only these are ordered, each bracket by itself.
    """
    names, slack = list(columns), 2 / APPROXIMATE
    df = df.select(*[columns[name][0].cast("double").alias(f"__v_{k}") for k, name in enumerate(names)])
    around = [[min(max(q + d, 0.0), 1.0) for q in columns[name][1] for d in (-slack, slack)] for name in names]
    near = df.agg(*[F.percentile_approx(f"__v_{k}", F.array(*map(F.lit, at)), APPROXIMATE).alias(f"q_{k}") for k, at in enumerate(around)], *[F.count(f"__v_{k}").alias(f"n_{k}") for k in range(len(names))]).first()
    ends, ordered, n = [], [], [near[f"n_{k}"] for k in range(len(names))]
    for k in range(len(names)):
        low, high = (near[f"q_{k}"] or [])[0::2], (near[f"q_{k}"] or [])[1::2]
        ends.append(sorted({math.nextafter(x, -math.inf) for x in low} | set(high)))
        ordered.append({c for a, b in zip(low, high, strict=True) for c in range(bisect_left(ends[k], a) + 1, bisect_left(ends[k], b) + 2)})
    ranks = [sorted({max(1, math.ceil(q * n[k])) for q in columns[name][1]}) if n[k] else [] for k, name in enumerate(names)]
    while True:
        cells = df.select("*", *[cell_of(F.col(f"__v_{k}"), ends[k]).alias(f"__c_{k}") for k in range(len(names))])
        parts = [F.struct(F.col(f"__c_{k}").alias("c"), F.when(F.col(f"__c_{k}").isin(sorted(ordered[k])), F.col(f"__v_{k}")).alias("x")) for k in range(len(names))]
        rows = cells.select(F.posexplode(F.array(*parts)).alias("k", "p")).filter("p.c > 0").select("k", "p.c", "p.x")
        counts = rows.groupBy("k", "c", "x").agg(F.count("*").alias("n")).persist()
        try:
            sizes = {(r["k"], r["c"]): r["n"] for r in counts.groupBy("k", "c").agg(F.sum("n").alias("n")).collect()}
            asked, missed = [], False
            for k in range(len(names)):
                before, left = 0, list(ranks[k])
                for c in range(1, len(ends[k]) + 2):
                    size = sizes.get((k, c), 0)
                    while left and left[0] <= before + size:
                        asked.append((k, c, left.pop(0) - before))
                        missed |= c not in ordered[k]
                        ordered[k].add(c)
                    before += size
            if missed:  # a bracket that doesn't hold its rank: order that cell too
                continue
            wanted = df.sparkSession.createDataFrame(asked, "k int, c int, r long") if asked else None
            upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("k", "c").orderBy("x")))
            hits = upto.join(F.broadcast(wanted), ["k", "c"]).filter("r > upto - n AND r <= upto").select("k", "x").distinct().collect() if asked else []
        finally:
            counts.unpersist()
        found: dict[str, list[float]] = {name: [] for name in names}
        for r in hits:
            found[names[r["k"]]].append(r["x"])
        return found


def _in_table(df: DataFrame, tables: list[TableInFolder]) -> DataFrame:
    """``df`` written as the last of ``tables`` and read again; the one before, which it came from, is deleted."""
    tables.append(TableInFolder(df))
    while len(tables) > 1:
        tables.pop(0).delete()
    return tables[-1].df


def _ranked(df: DataFrame, seed: int) -> DataFrame:
    """``df`` with ``__rank`` in the order of the seeded hash."""
    keyed = df.withColumn("__key", F.col("row_id") if "row_id" in df.columns else F.monotonically_increasing_id())
    return hash_rank(keyed, "__key", seed).drop("__n", "__key")


def with_ordered_stats(df: DataFrame, target: str, category: Column, rows: Column, name: str, prior: float = 1.0, seed: int = 42, most: int = 1000, rank: str | None = None) -> tuple[DataFrame, dict[str, float], float]:
    """``df`` with the ordered target statistic of a category, the statistics of all rows by category, and the mean.

    A row of ``rows`` sees the target of the rows before it in the order of a seeded hash, and ``prior`` rows of the mean,
    never its own; other rows see none of their own anyway. The ``most`` frequent categories are told; a missing
    category is the empty text. Running sums are made in ranges, so no category meets in one task. ``rank`` is a column
    that already has the order.
    """
    y = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    used = rows & F.col(target).isNotNull()
    mean = df.agg(F.avg(F.when(used, y))).first()[0] or 0.0
    named = df.withColumns({"__cat": F.coalesce(category, F.lit("")), "__used": used.cast("int")})
    ranked = named if rank else _ranked(named, seed)
    summed = running(ranked, ["__cat"], rank or "__rank", {"__sum": F.col("__used") * y, "__count": F.col("__used")})
    own = lambda total, part: F.col(total) - part
    before = (own("__sum", F.col("__used") * y) + prior * mean) / (own("__count", F.col("__used")) + prior)
    top = named.groupBy("__cat").agg(F.sum("__used").alias("n"), F.sum(F.col("__used") * y).alias("s")).filter("n > 0").orderBy(F.desc("n"), "__cat").limit(most)
    stats = {r["__cat"]: (r["s"] + prior * mean) / (r["n"] + prior) for r in top.collect()}
    return summed.withColumn(name, before).select(*df.columns, name), stats, float(mean)


def fit_many(df: DataFrame, target: str, fits: Sequence[Fit], sets: Sequence[RowSet], metric="roc_auc", patience: int = EARLY_STOPPING) -> list[Boosting]:
    """Fit several models together: the jobs are as many as for the one of most trees and greatest depth.

    The result of each is the same as that of fitting it alone.
    """
    scorer = get_metric(metric)
    bins = ("max_bins", "max_categories", "accuracy", "symmetric", "prior", "seed")
    groups: dict[tuple, list[int]] = {}
    for j, x in enumerate(fits):
        groups.setdefault((x.rows, *(x.model.params.get(k) for k in bins), None if x.categorical is None else tuple(x.categorical)), []).append(j)
    prepared = []
    ordered = {}
    for i, ((rows, max_bins, max_categories, accuracy, symmetric, prior, seed, categorical), members) in enumerate(groups.items()):
        if symmetric:
            ordered[i] = target, prior, seed
        features = list(dict.fromkeys(f for j in members for f in fits[j].features))
        own = None if categorical is None else [f for f in categorical if f in features]
        prepared.append((FeaturePreparer(features, own, max_bins, max_categories=max_categories, accuracy=accuracy), sets[rows], members))
    for p, _, _ in prepared:
        p._check(df)
    df, sets = narrowed(df, target, fits, sets)
    prepared = [(p, sets[rows], members) for (p, _, members), (rows, *_) in zip(prepared, groups, strict=True)]
    source, tables = df.persist(), []
    try:
        return _fit_prepared(source, target, fits, sets, prepared, ordered, scorer, patience, tables)
    finally:
        source.unpersist()
        for t in tables:
            t.delete()


def narrowed(df: DataFrame, target: str, fits: Sequence[Fit], sets: Sequence[RowSet]) -> tuple[DataFrame, list[RowSet]]:
    """The features, target, key, hash and what the row sets say as columns, of the rows that are in a set; and the row sets by these columns."""
    named, own = {}, []
    for i, x in enumerate(sets):
        parts = {"train": x.train, "valid": x.valid, "weight": x.weight, "margin": x.margin}
        named |= {f"__{k}_{i}": c for k, c in parts.items() if c is not None}
        own.append(RowSet(**{k: None if c is None else F.col(f"__{k}_{i}") for k, c in parts.items()}))
    keep = dict.fromkeys([*(f for x in fits for f in x.features), target, *(["row_id"] if "row_id" in df.columns else [])])
    key = F.xxhash64(F.col("row_id") if "row_id" in df.columns else F.struct(*df.columns))
    used = [F.coalesce(c, F.lit(False)) for x in own for c in (x.train, x.valid) if c is not None]
    return df.select(*keep, key.alias("__draw"), *[c.alias(k) for k, c in named.items()]).filter(reduce(lambda a, b: a | b, used)), own


def _fit_prepared(df: DataFrame, target: str, fits: Sequence[Fit], sets: Sequence[RowSet], prepared: list[tuple], ordered: dict[int, tuple], scorer, patience: int, tables: list[TableInFolder]) -> list[Boosting]:
    source, yes = df, lambda c: F.coalesce(c, F.lit(False))
    df = prepare_many(df, [(p, yes(x.train)) for p, x, _ in prepared], ordered, tables)
    y = F.col(target).cast("double")
    weight = lambda x: F.lit(1.0) if x.weight is None else x.weight.cast("double")
    used = lambda x: yes(x.train) & y.isNotNull()
    sums = df.agg(*[s.alias(f"{k}{i}") for i, (_, x, _) in enumerate(prepared) for k, s in (("a", F.sum(F.when(used(x), y * weight(x)))), ("b", F.sum(F.when(used(x), weight(x)))))]).first()
    start = {}
    for i, (p, x, members) in enumerate(prepared):
        mean = (sums[f"a{i}"] or 0.0) / sums[f"b{i}"] if sums[f"b{i}"] else 0.0
        for j in members:
            m = fits[j].model
            m.features = list(fits[j].features)
            m.preparer = p.part(m.features)
            q = min(max(mean, 1e-6), 1 - 1e-6)
            m.base_ = 0.0 if x.margin is not None else math.log(q / (1 - q)) if m.loss == "logistic" else mean
            m.trees_, m.gain_, m.splits_, m.history_ = [], dict.fromkeys(m.features, 0.0), dict.fromkeys(m.features, 0), []
            start[j] = (i, m.base_, [p.features.index(f) for f in m.features])

    n_columns = [0]
    for p, _, _ in prepared:
        n_columns.append(n_columns[-1] + len(p.features))
    layout = growing.Layout([[n_columns[start[j][0]] + c for c in start[j][2]] for j in range(len(fits))], [start[j][0] for j in range(len(fits))], max(p.width() for p, _, _ in prepared), len(prepared), n_columns[-1])

    def role(x: RowSet) -> Column:
        return F.when(yes(x.train), 1).when(F.lit(False) if x.valid is None else yes(x.valid), 2).otherwise(0)

    df, names = with_values(df, [(p, f) for p, _, _ in prepared for f in p.features])
    values: dict[tuple, int] = {}
    valued: list[Column] = []
    cuts, left = [], iter(names)
    for i, (p, x, _) in enumerate(prepared):
        for f in p.features:
            own = next(left)
            name = (own, i) if f in p.encoders else (own,)
            if name not in values:
                values[name] = len(valued)
                valued.append(F.when(role(x) == 1, F.col(f"__ts_{i}_{f}")).otherwise(F.col(own)) if f in p.encoders else F.col(own))
            cuts.append((values[name], p.edges.get(f)))
    by_set = lambda value, kind: F.array(*[value(x).cast(kind) for _, x, _ in prepared])
    margin = lambda x: F.coalesce(F.lit(0.0) if x.margin is None else x.margin.cast("double"), F.lit(math.nan))
    ids = dict(df.dtypes)["row_id"] if scorer.counted is None and "row_id" in df.columns and any(x.valid is not None for _, x, _ in prepared) else None
    shared = df.filter(y.isNotNull()).select(y.alias("y"), F.col("__draw").alias("h"), *([F.col("row_id")] if ids else []), by_set(role, "tinyint").alias("role"), by_set(lambda x: F.coalesce(weight(x), F.lit(math.nan)), "double").alias("w"), by_set(margin, "double").alias("m"), F.array(*[v.cast("double") for v in valued]).alias("x"))
    base = growing.blocks(shared.filter(F.exists("role", lambda r: r > 0)), layout, cuts, [start[j][1] for j in range(len(fits))], ids).persist()
    active, best, number = set(range(len(fits))), dict.fromkeys(range(len(fits)), (None, 0)), 0
    since: dict[int, list] = {}
    grown_gains: list[list] = [[] for _ in fits]
    moved: list[TableInFolder] = []
    try:
        while active := {j for j in active if number < fits[j].model.params["n_trees"]}:
            trees, drawn = {}, {}
            for j in sorted(active):
                m = fits[j].model
                columns, share, seed = growing.draws(m.params, len(m.features), number)
                cats = {k for k, f in enumerate(m.features) if f in m.preparer.categories}
                trees[j], drawn[j] = (growing.SymmetricTree if m.params.get("symmetric") else growing.Tree)(m.params, columns, cats, m.preparer.width()), (share, seed)
            growing.grown(base, trees, drawn, {j for j in active if fits[j].model.loss != "logistic"}, layout, since)
            for j, t in trees.items():
                lasting, gains = t.finished()
                fits[j].model.trees_.append(lasting)
                since.setdefault(j, []).append(lasting)
                grown_gains[j].append(gains)
            source.unpersist()  # the blocks hold all that is needed from here on
            number += 1
            judged = [j for j in active if sets[fits[j].rows].valid is not None]
            if due := judged if number % CHUNK == 0 else [j for j in judged if fits[j].model.params["n_trees"] <= number]:
                active -= _judge(base, {j: since[j] for j in due}, layout, fits, number, scorer, best, patience)
            if number % CHUNK == 0 and any(number < fits[j].model.params["n_trees"] for j in active):  # a table of its own, so that neither plans nor the trees a row goes through grow
                moved.append(TableInFolder(growing.moved(base, {j: t for j, t in since.items() if j in active}, layout)))
                base.unpersist()
                base, since = moved[-1].df.persist(), {}
                if len(moved) > 1:
                    moved.pop(0).delete()
    finally:
        base.unpersist()
        for t in moved:
            t.delete()
    for j, x in enumerate(fits):
        m = x.model
        m.n_iterations_ = max(1, best[j][1] if sets[x.rows].valid is not None else len(m.trees_))
        m.trees_ = m.trees_[: m.n_iterations_]
        for gains in grown_gains[j][: m.n_iterations_]:  # trees beyond the best count for nothing
            for f, gain in gains:
                m.gain_[m.features[f]] += gain
                m.splits_[m.features[f]] += 1
    return [x.model for x in fits]


def _judge(rows: DataFrame, trees: dict[int, list], layout: growing.Layout, fits: Sequence[Fit], number: int, scorer, best: dict, patience: int) -> set[int]:
    """The metric after each of the last ``trees`` of all models that are judged, in one plan; ``best`` gets (value, trees). Returns those that have waited too long."""
    judged = list(trees)
    plain = [j for j in judged if fits[j].model.loss != "logistic"]
    link = lambda m: F.when(F.col("job").isin(plain), m).otherwise(1 / (1 + F.exp(-m))) if plain else 1 / (1 + F.exp(-m))
    first = (number - 1) // CHUNK * CHUNK
    long = growing.judged_margins(rows, trees, layout, scorer.counted is not None).filter("NOT isnan(m)").withColumn("p", link(F.col("m"))).drop("m")
    rows = scorer.func(long.drop("n"), "y", "p", ["job", "k"], None).collect() if scorer.counted is None else _of_counts(long, scorer, "y", "p", ["job", "k"], "n")
    found = {(r["job"], r["k"]): r["value"] for r in rows}
    over = set()
    for j in judged:
        m = fits[j].model
        for k in range(len(m.history_) + 1, number + 1):
            value = found.get((j, k - 1 - first))
            m.history_.append(value)
            if value is not None and (best[j][0] is None or scorer.delta(value, best[j][0]) > 0):
                best[j] = (value, k)
            elif k - best[j][1] >= patience:
                over.add(j)
                break
    return over


def _batch_scorer(trees: list[list[dict]]):
    """A function of the array of bins that adds up the values of many trees in Arrow batches."""
    import numpy as np
    import pandas as pd

    width = 2 + max((n.get("cut", 0) if "cut" in n else max(n.get("left_bins", [0]), default=0)) for t in trees for n in t)
    tables = []
    for nodes in trees:
        goes_left = np.zeros((len(nodes), width), bool)
        for k, n in enumerate(nodes):
            if "left_bins" in n:
                goes_left[k, n["left_bins"]] = True
            elif "left" in n:
                goes_left[k, : n["cut"] + 1] = True
                goes_left[k, 0] = n["missing_left"]
        inner = np.array(["left" in n for n in nodes])
        column = lambda name, nodes=nodes: np.array([n.get(name, 0) for n in nodes])
        tables.append((inner, column("feature"), goes_left, column("left"), column("right"), column("value").astype("f8")))

    def total(x):
        bins = np.minimum(np.stack(x.to_numpy()), width - 1) if len(x) else np.zeros((0, 1), "i4")
        out, every = np.zeros(len(bins)), np.arange(len(bins))
        for inner, feature, goes_left, left, right, value in tables:
            at = np.zeros(len(bins), "i8")
            while (deeper := inner[at]).any():
                down = np.where(goes_left[at, bins[every, feature[at]]], left[at], right[at])
                at = np.where(deeper, down, at)
            out += value[at]
        return pd.Series(out)

    total.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(total, "double")


MODELS = {"boosting": BOOSTING, "symmetric": SYMMETRIC, "small": SMALL_BOOSTING, "deep": FOREST_LIKE}


def make_model(model="boosting", **params) -> Boosting:
    """A model by name, or a clone of an instance."""
    if isinstance(model, Boosting):
        return model.clone(**params)
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")
    return Boosting(name=model, **merge_params(MODELS[model], params))


def _value(df: DataFrame, metric, target: str, score: str, by: Sequence[str] = (), key: str | None = None) -> dict:
    m = get_metric(metric)
    rows = m.func(df, target, score, by, key).collect() if m.counted is None else _of_counts(df.withColumn("__n", F.lit(1).cast("long")), m, target, score, by, "__n")
    return {tuple(r[b] for b in by): r["value"] for r in rows}


def _of_counts(df: DataFrame, metric, target: str, score: str, by: Sequence[str], weight: str) -> list:
    """The metric from the counts of (group, label, score), which are worked out once; the plan of a metric reads them several times."""
    counts = df.groupBy(*by, target, score).agg(F.sum(weight).alias("__n")).persist()
    rows = metric.counted(counts, target, score, by, "__n").collect()
    counts.unpersist()
    return rows


@contextmanager
def held(df: DataFrame, columns: Sequence[str] | None = None) -> Iterator[DataFrame]:
    """``df``, or some columns of it, kept while several jobs read it; what is kept already stays as it is."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield df
        return
    kept = (df.select(*dict.fromkeys(c for c in columns if c in df.columns)) if columns and "row_id" in df.columns else df).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


@dataclass
class CVResult:
    scores: list[float]
    segments: list[dict]
    oof: DataFrame
    best_iterations: list[int]
    metric: str

    @property
    def mean(self) -> float:
        s = [x for x in self.scores if x is not None]
        return sum(s) / len(s) if s else math.nan

    @property
    def std(self) -> float:
        s = [x for x in self.scores if x is not None]
        return math.sqrt(sum((x - self.mean) ** 2 for x in s) / len(s)) if s else math.nan

    @property
    def mean_best_iteration(self) -> int:
        return round(sum(self.best_iterations) / len(self.best_iterations))


def cross_validate(df: DataFrame, target: str, features: Sequence[str], key: str = "row_id", fold: str = "fold", model="boosting", metric="roc_auc", segment: str | None = None, min_size: int = 30, categorical: Sequence[str] | None = None, margin: str | None = None) -> CVResult:
    """Fit on all folds but one and score that one, for each fold; metrics by fold and segment in one plan."""
    return cross_validate_many(df, target, [(features, model)], key, fold, metric, segment, min_size, categorical, margin)[0]


def cross_validate_many(df: DataFrame, target: str, trials: Sequence[tuple], key: str = "row_id", fold: str = "fold", metric="roc_auc", segment: str | None = None, min_size: int = 30, categorical: Sequence[str] | None = None, margin: str | None = None) -> list[CVResult]:
    """Cross-validation of several (features, model) over the same folds: all folds of all trials are fitted and scored together."""
    columns = [*(f for features, _ in trials for f in features), key, fold, target, "row_id", *(c for c in (segment, margin) if c)]
    with held(df, columns) as kept:
        return _cross_validated(kept, target, trials, key, fold, metric, segment, min_size, categorical, margin)


def _cross_validated(df: DataFrame, target: str, trials: Sequence[tuple], key: str, fold: str, metric, segment: str | None, min_size: int, categorical: Sequence[str] | None, margin: str | None) -> list[CVResult]:
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None and r[0] >= 0)
    start = F.col(margin) if margin else None
    sets = [RowSet(F.col(fold) != k, F.col(fold) == k, None, start) for k in folds]
    fits = [Fit(make_model(model), list(features), i, None if categorical is None else [c for c in categorical if c in features]) for features, model in trials for i in range(len(folds))]
    fit_many(df, target, fits, sets, metric)
    keep = list(dict.fromkeys([key, fold, target, *([segment] if segment else [])]))
    parts = [long_predictions(df.filter(F.col(fold) == k), [fits[t * len(folds) + i].model for t in range(len(trials))], keep, margin) for i, k in enumerate(folds)]
    oof = reduce(DataFrame.unionByName, parts)
    by_fold = _value(oof, metric, target, "pred", ["model", fold], key)
    by_segment, sizes = {}, {}
    if segment:
        sizes = {(r[0], r[1]): r[2] for r in df.filter(F.col(fold) >= 0).groupBy(fold, segment).count().collect()}
        by_segment = _value(oof, metric, target, "pred", ["model", fold, segment], key)
    out = []
    for t in range(len(trials)):
        segments = [{"fold": k[1], "segment": k[2], "score": v} for k, v in by_segment.items() if k[0] == t and sizes[k[1:]] >= max(min_size, 2)]
        iterations = [fits[t * len(folds) + i].model.n_iterations_ for i in range(len(folds))]
        out.append(CVResult([by_fold.get((t, k)) for k in folds], segments, oof.filter(F.col("model") == t).drop("model"), iterations, get_metric(metric).name))
    return out


def train_model(split: DataSplit, features: Sequence[str], model="boosting", metric="roc_auc", balance: bool = False, refit: bool = False, categorical: Sequence[str] | None = None) -> Boosting:
    """Early stopping on val; ``refit`` trains again on train and val with the trees found; ``scores_`` by part."""
    with held(split.data, [*features, split.target, "part", "row_id"]) as kept:
        return _trained(DataSplit(kept, split.target), features, model, metric, balance, refit, categorical)


def _trained(split: DataSplit, features: Sequence[str], model, metric, balance: bool, refit: bool, categorical: Sequence[str] | None) -> Boosting:
    train = split.train
    weight = None
    if balance:
        n, pos = train.agg(F.count("*"), F.sum(split.target)).first()
        train, weight = train.withColumn("__weight", F.when(F.col(split.target) == 1, (n - pos) / max(pos, 1)).otherwise(1.0)), "__weight"
    fitted = make_model(model).fit(train, split.target, features, categorical, valid=split.val, metric=metric, weight=weight)
    if refit:
        again = make_model(model, n_trees=fitted.n_iterations_)
        fitted = again.fit(split.data.filter(F.col("part").isin("train", "val")), split.target, features, categorical)
    scored = fitted.predict(split.data, "__score")
    fitted.scores_ = {k[0]: v for k, v in _value(scored, metric, split.target, "__score", ["part"]).items()}
    return fitted


def compare_models(df: DataFrame, target: str, features: Sequence[str], models: Sequence[str] = ("boosting", "small"), key: str = "row_id", fold: str = "fold", metric="roc_auc") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(table, out-of-fold predictions): every model over the same folds, all fitted together, so each has an equal share of the time."""
    began, rows, oof = time.time(), [], {}
    found = cross_validate_many(df, target, [(features, m) for m in models], key, fold, metric)
    spent = (time.time() - began) / max(1, sum(len(cv.scores) for cv in found))
    for name, cv in zip(models, found, strict=True):
        s = [x for x in cv.scores if x is not None]
        std = math.sqrt(sum((x - cv.mean) ** 2 for x in s) / (len(s) - 1)) if len(s) > 1 else math.nan
        rows.append((str(name), cv.mean, std, spent))
        oof[str(name)] = cv.oof
    return df.sparkSession.createDataFrame(rows, "model string, mean double, std double, mean_fit_time_sec double"), oof


SEARCH_SPACE = {"depth": (2, 8), "num_leaves": (4, 64), "learning_rate": (0.01, 0.3), "subsample": (0.5, 1.0), "colsample": (0.5, 1.0), "min_leaf": (10, 200), "ridge": (0.1, 10.0)}


class ParzenSearch:
    """Tree-structured Parzen estimation: the next point has the greatest ratio of its density among good trials to that among the others.

    The space has (low, high) of whole numbers, or of numbers searched in logarithms, or a list of choices. The first
    ``start`` points are drawn at random; then the best ``share`` of the trials are the good ones, each parameter has a mixture
    of normal densities cut to its range for either side, with the prior as one of its parts, and the best of ``draws`` points
    of the good density is tried. Seeded.
    """

    def __init__(self, space: dict, seed: int = 42, start: int = 10, share: float = 0.1, draws: int = 24):
        self.space, self.start, self.share, self.draws = space, start, share, draws
        self.rng = np.random.default_rng(seed)
        self.trials: list[tuple[dict, float]] = []

    def tell(self, params: dict, loss: float) -> None:
        self.trials.append((params, loss))

    def ask(self) -> dict:
        done = sorted((t for t in self.trials if t[1] == t[1]), key=lambda t: t[1])
        if len(done) < self.start:
            return {k: self._read(v, self.rng.integers(len(v)) if isinstance(v, list) else self.rng.uniform(*self._ends(v))) for k, v in self.space.items()}
        n = max(1, min(25, math.ceil(self.share * len(done))))
        return {k: self._best(v, [t[0][k] for t in done[:n]], [t[0][k] for t in done[n:]]) for k, v in self.space.items()}

    @staticmethod
    def _ends(v: tuple) -> tuple[float, float]:
        return (v[0] - 0.5, v[1] + 0.5) if isinstance(v[0], int) else (math.log(v[0]), math.log(v[1]))

    @staticmethod
    def _read(v, x: float):
        """The parameter's value at a place of the search."""
        if isinstance(v, list):
            return v[int(x)]
        return min(max(round(float(x)), v[0]), v[1]) if isinstance(v[0], int) else min(max(math.exp(float(x)), v[0]), v[1])

    def _best(self, v, good: list, others: list):
        if isinstance(v, list):
            share = lambda seen: (np.bincount([v.index(x) for x in seen], minlength=len(v)) + 1) / (len(seen) + len(v))
            drawn = self.rng.choice(len(v), self.draws, p=share(good))
            return v[int(max(drawn, key=lambda k: share(good)[k] / share(others)[k]))]
        low, high = self._ends(v)
        at = lambda seen: np.array([float(x) if isinstance(v[0], int) else math.log(x) for x in seen])
        a, b = self._mixture(at(good), low, high), self._mixture(at(others), low, high)
        part = self.rng.integers(len(a[0]), size=self.draws)
        drawn = np.clip(self.rng.normal(a[0][part], a[1][part]), low, high)
        return self._read(v, drawn[int(np.argmax(self._density(drawn, *a, low, high) - self._density(drawn, *b, low, high)))])

    @staticmethod
    def _mixture(x: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations: each point with the distance to its farther neighbour, and the prior over the range."""
        x = np.sort(np.append(x, (low + high) / 2))
        gaps = np.diff(np.concatenate(([low], x, [high])))
        spread = np.clip(np.maximum(gaps[:-1], gaps[1:]), (high - low) / min(100, 1 + len(x)), high - low)
        spread[np.searchsorted(x, (low + high) / 2)] = high - low
        return x, spread

    @staticmethod
    def _density(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, low: float, high: float) -> np.ndarray:
        """Logarithm of the mixture's density, its parts cut to the range."""
        under = lambda z: 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
        inside = under((high - mean) / spread) - under((low - mean) / spread)
        parts = np.exp(-0.5 * ((x[:, None] - mean) / spread) ** 2) / (spread * math.sqrt(2 * math.pi) * np.maximum(inside, 1e-12))
        return np.log(parts.mean(axis=1) + 1e-300)


def tune_hyperparams(split: DataSplit, features: Sequence[str], n_trials: int = 10, space: dict | Callable | None = None, metric="roc_auc", seed: int = 42, max_train_size: int = 300_000, key: str = "row_id", search: str = "parzen", together: int = 4, fixed: dict | None = None) -> tuple[DataFrame, dict]:
    """(trials, best parameters): a seeded search judged on val alone; train and test are only reported.

    ``search`` is parzen or random; ``space`` may also be a function of a random.Random. ``together`` trials are asked for and
    fitted at once; the best has the trees found by early stopping.
    """
    import random

    rng, space, m = random.Random(seed), space or SEARCH_SPACE, get_metric(metric)
    train = split.train
    if train.count() > max_train_size:
        train = exact_sample(train, key, max_train_size, seed)
    data = train.unionByName(split.data.filter("part <> 'train'"), allowMissingColumns=True).cache()
    finder = None if callable(space) else ParzenSearch(space, seed, n_trials if search == "random" else min(10, max(2, n_trials // 3)))
    rows = []
    while len(rows) < n_trials:
        asked = [space(rng) if finder is None else finder.ask() for _ in range(min(together, n_trials - len(rows)))]
        fits = [Fit(make_model("boosting", **merge_params(fixed or {}, p)), list(features)) for p in asked]
        fit_many(data, split.target, fits, [RowSet(F.col("part") == "train", F.col("part") == "val")], metric)
        for p, x, found in zip(asked, fits, score_many(data, [x.model for x in fits], split.target, metric, ["part"], key), strict=True):
            value = found.get(("val",))
            rows.append((len(rows), found.get(("train",)), value, found.get(("test",)), x.model.n_iterations_, json.dumps(p)))
            if finder is not None and value is not None:
                finder.tell(p, -value if m.greater_is_better else value)
    data.unpersist()
    best = max((r for r in rows if r[2] is not None), key=lambda r: r[2] if m.greater_is_better else -r[2])
    table = split.data.sparkSession.createDataFrame(rows, "trial int, train double, val double, test double, n_trees int, params string")
    return table, {**(fixed or {}), **json.loads(best[5]), "n_trees": best[4]}


def sample_size_curve(split: DataSplit, features: Sequence[str], sizes: Sequence[int], repeats: int = 1, metric="roc_auc", key: str = "row_id", model="small") -> DataFrame:
    """size, repeat, score on val: sizes are capped at the training rows and taken once each; all are fitted together."""
    with held(split.data, [*features, split.target, "part", key, "row_id"]) as kept:
        return _sizes(DataSplit(kept, split.target), features, sizes, repeats, metric, key, model)


def _sizes(split: DataSplit, features: Sequence[str], sizes: Sequence[int], repeats: int, metric, key: str, model) -> DataFrame:
    n = split.train.count()
    trials = [(size, r) for size in sorted({min(int(s), n) for s in sizes}) for r in range(repeats)]
    train = split.train
    for r in range(repeats):
        train = hash_rank(train, key, 42 + r).withColumnRenamed("__rank", f"__rank_{r}").drop("__n")
    fits = [Fit(make_model(model), list(features), i) for i in range(len(trials))]
    train = train.cache()
    fit_many(train, split.target, fits, [RowSet(F.col(f"__rank_{r}") <= size) for size, r in trials], metric)
    train.unpersist()
    scores = score_many(split.val, [x.model for x in fits], split.target, metric)
    return split.data.sparkSession.createDataFrame([(size, r, s.get(())) for (size, r), s in zip(trials, scores, strict=True)], "size int, repeat int, score double")


def learning_curve(model: Boosting) -> list[tuple[int, float]]:
    """(trees, validation metric) of a model fitted with a validation table."""
    return list(enumerate(model.history_, 1))


def export_model(model: Boosting, folder: str, check: DataFrame | None = None, atol: float = 1e-6, sample: int = 1000) -> None:
    """Write the model, its preprocessing and a scorer that stands alone; verify on ``check`` that what is read back scores alike, and the scorer on ``sample`` of its rows."""
    import os

    from riskloom.operators.scorer import load_scorer, write_scorer

    os.makedirs(folder, exist_ok=True)
    write_scorer(folder, model.to_json(), model.preparer.spec())
    if check is None:
        return
    again = load_model(folder)
    both = again.predict(model.predict(check, "__a"), "__b")
    if (worst := both.agg(F.max(F.abs(F.col("__a") - F.col("__b")))).first()[0] or 0.0) > atol:
        raise RuntimeError(f"exported model differs by {worst}")
    rows = model.predict(check, "__a").select(*model.features, "__a").limit(sample).toPandas()
    if len(rows) and (worst := float(np.abs(load_scorer(folder).predict(rows) - rows["__a"]).max())) > atol:
        raise RuntimeError(f"the scorer differs by {worst}")


def load_model(folder: str) -> Boosting:
    with open(f"{folder}/model.json") as f:
        return Boosting.from_json(f.read())


def feature_metric_dynamics(train: DataFrame, data: DataFrame, features: Sequence[str], target: str, date: str, freq: str = "month", metric="roc_auc", bins: int = 32, min_size: int = 30, accuracy: int = 10_000, key: str = "row_id") -> DataFrame:
    """feature, period, n, value: one-feature models of ``train``, each scored on every period of ``data``; null below ``min_size`` rows.

    A one-feature model is the smoothed target rate of its bins, as in ``univariate_scores``; all
    features are fitted by one histogram and scored by one join with it, a row for each bin.
    """
    names = F.array(*map(F.lit, features))
    binned = F.posexplode(F.array(*[f"__bin_{k}" for k in range(len(features))])).alias("f", "b")
    with held(train, [*features, target, "row_id"]) as kept:
        prepared = FeaturePreparer(list(features), None, bins, accuracy=accuracy).fit(kept)
        seen = settled(prepared.transform(kept.filter(F.col(target).isNotNull())).select(F.col(target).cast("int").alias("y"), binned).groupBy("f", "b").agg(F.count("*").alias("n"), F.sum("y").alias("pos")))
    whole = seen.groupBy("f").agg((F.sum("pos") / F.sum("n")).alias("rate"))
    model = F.broadcast(seen.join(F.broadcast(whole), "f").select("f", "b", ((F.col("pos") + 5 * F.col("rate")) / (F.col("n") + 5)).alias("p")))
    keys = [c for c in (key,) if c in data.columns]
    rows = prepared.transform(data.filter(F.col(date).isNotNull())).select(*keys, F.date_trunc(freq, date).alias("period"), F.col(target).cast("int").alias("y"), binned)
    m = get_metric(metric)
    if m.counted:  # rows of a bin score alike: as many cells as bins and periods
        rows = settled(rows.groupBy("period", "y", "f", "b").agg(F.count("*").alias("n")))
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    kept = [c for c in keys if c in rows.columns]
    scored = rows.join(model, ["f", "b"], "left").join(F.broadcast(whole), "f").select(*kept, F.get(names, F.col("f")).alias("feature"), "period", "y", F.coalesce("p", "rate").alias("p"), "n")
    sizes = scored.groupBy("feature", "period").agg(F.sum("n").alias("n"))
    found = m.counted(scored, "y", "p", ["feature", "period"], "n") if m.counted else m.func(scored, "y", "p", ["feature", "period"], key)
    return sizes.join(found, ["feature", "period"], "left").select("feature", "period", "n", F.when(F.col("n") >= min_size, F.col("value")).alias("value"))


def bin_auc(margin: np.ndarray, n: np.ndarray, pos: np.ndarray) -> float | None:
    """AUC of a score by bin with so many rows and positives; null if a class is absent."""
    if not 0 < pos.sum() < n.sum():
        return None
    _, at = np.unique(margin, return_inverse=True)
    p, q = np.bincount(at, pos), np.bincount(at, n - pos)
    return float((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum()))


def boosted_bins(n: np.ndarray, pos: np.ndarray, params: dict, categorical: bool = False, valid: tuple[np.ndarray, np.ndarray] | None = None, patience: int = UNIVARIATE_STOPPING) -> tuple[np.ndarray, list]:
    """(margin of each bin, AUC on ``valid`` by tree) of the one-feature model on so many rows and positives a bin.

    All rows of a bin have the same margin, so the trees are those that ``Boosting`` grows on the rows.
    """
    q = min(max(pos.sum() / n.sum(), 1e-6), 1 - 1e-6)
    margin = np.full(len(n), math.log(q / (1 - q)))
    best, history = (None, margin, 0), []
    for k in range(1, params["n_trees"] + 1):
        q = 1 / (1 + np.exp(-margin))
        cells = np.stack([pos - n * q, n * np.maximum(q * (1 - q), 1e-6), n], axis=1)
        tree = growing.Tree(params, [0], {0} if categorical else set(), len(n))
        inside = {0: n > 0}
        while wanted := tree.wanted():
            asked = tree.asked(wanted)
            for c in asked:
                _members(tree, inside, c)
            tree.told(asked, {c: [(0, b, *cells[b]) for b in np.flatnonzero(inside[c])] for c in asked})
        nodes, _ = tree.finished()
        step = np.asarray([_leaf_value(nodes, b) for b in range(len(n))])
        margin = margin + step
        if valid is None:
            continue
        value = bin_auc(margin, *valid)
        history.append(value)
        if value is not None and (best[0] is None or value > best[0]):
            best = (value, margin, k)
        elif k - best[2] >= patience:
            break
    return (margin if valid is None else best[1]), history


def _members(tree: growing.Tree, inside: dict[int, np.ndarray], k: int) -> np.ndarray:
    """The bins of a node, by the rules on the way to it."""
    if k not in inside:
        parent = tree.nodes[k]["parent"]
        own, rule, b = _members(tree, inside, parent), tree.nodes[parent]["split"][2], np.arange(tree.bins)
        left = np.isin(b, rule["left_bins"]) if "left_bins" in rule else (b <= rule["cut"]) & ((b > 0) | rule["missing_left"])
        inside[tree.nodes[parent]["left"]], inside[tree.nodes[parent]["right"]] = own & left, own & ~left
    return inside[k]


def _leaf_value(nodes: list[dict], b: int) -> float:
    node = nodes[0]
    while "left" in node:
        goes = b in node["left_bins"] if "left_bins" in node else b <= node["cut"] and (b > 0 or node["missing_left"])
        node = nodes[node["left"] if goes else node["right"]]
    return node["value"]


def _bin_counts(df: DataFrame, target: str, features: Sequence[str], fold: str, bins: int, accuracy: int) -> tuple[FeaturePreparer, DataFrame]:
    """The bins and their counts (f, fold, b, n, pos), worked out once from rows that are kept meanwhile; as many cells whatever the rows."""
    with held(df, [*features, target, fold, "row_id"]) as kept:
        prepared = FeaturePreparer(list(features), None, bins, accuracy=accuracy).fit(kept)
        binned = prepared.transform(kept).select(F.col(target).cast("int").alias("y"), F.col(fold).alias("fold"), F.posexplode(F.array(*[f"__bin_{k}" for k in range(len(features))])).alias("f", "b"))
        return prepared, settled(binned.filter("y IS NOT NULL").groupBy("f", "fold", "b").agg(F.count("*").alias("n"), F.sum("y").alias("pos")))


def univariate_scores(df: DataFrame, target: str, features: Sequence[str], fold: str = "fold", bins: int = 32, tree_depth: int | None = None, min_leaf_share: float = 0.0, accuracy: int = 10_000, model: str | dict = "boosting", patience: int = UNIVARIATE_STOPPING) -> DataFrame:
    """feature, auc_mean, auc_std, auc_gain, status, auc_min, auc_max, n_splits_ok: one-feature models of all features and folds from one histogram.

    Any model of one binned feature is a function of its counts by (fold, bin): ``model`` is the small boosting
    model of UNIVARIATE, changes to its parameters, or ``rates``, the smoothed target rate of the bins outside the fold;
    with ``tree_depth`` it is the leaves of one tree. Boosting stops early by the fold that it is scored on.
    Sorted by auc_gain = |auc_mean - 0.5|.
    """
    prepared, counts = _bin_counts(df, target, features, fold, bins, accuracy)
    names, cats, width = list(features), set(prepared.categories), prepared.width()
    params = merge_params(UNIVARIATE, model if isinstance(model, dict) else None)

    def margins(train, valid, categorical):
        """A score for each bin."""
        if tree_depth:
            leaf = _histogram_tree(train.rename_axis("b"), tree_depth, min_leaf_share)
            return np.asarray([leaf.get(b, 0.5) for b in range(width)])
        full = lambda t, c: np.bincount(t.index, t[c], width)
        if model == "rates":
            rate = train["pos"].sum() / train["n"].sum()
            return (full(train, "pos") + 5 * rate) / (full(train, "n") + 5)
        return boosted_bins(full(train, "n"), full(train, "pos"), params, categorical, (full(valid, "n"), full(valid, "pos")), patience)[0]

    def run(key, pdf):
        import pandas as pd

        f = names[int(key[0])]
        aucs = []
        for k in sorted(pdf["fold"].unique()):
            train = pdf[pdf["fold"] != k].groupby("b")[["n", "pos"]].sum()
            valid = pdf[pdf["fold"] == k].groupby("b")[["n", "pos"]].sum()
            if k >= 0 and len(train) and 0 < valid["pos"].sum() < valid["n"].sum():
                aucs.append(bin_auc(margins(train, valid, f in cats)[valid.index], valid["n"].to_numpy("f8"), valid["pos"].to_numpy("f8")))
        status = "constant_or_all_nan" if pdf["b"].nunique() < 2 else "ok" if aucs else "no_valid_folds"
        fine = status == "ok"
        mean = sum(aucs) / len(aucs) if fine else None
        std = math.sqrt(sum((a - mean) ** 2 for a in aucs) / len(aucs)) if fine else None
        return pd.DataFrame({"feature": [f], "auc_mean": [mean], "auc_std": [std], "auc_gain": [abs(mean - 0.5) if fine else None], "status": [status], "auc_min": [min(aucs) if fine else None], "auc_max": [max(aucs) if fine else None], "n_splits_ok": [len(aucs) if fine else 0]})

    out = counts.groupBy("f").applyInPandas(run, "feature string, auc_mean double, auc_std double, auc_gain double, status string, auc_min double, auc_max double, n_splits_ok int")
    return out.orderBy(F.desc_nulls_last("auc_gain"), "feature")


def _histogram_tree(counts, depth: int, min_share: float, categorical: bool = False, number: bool = False) -> dict[int, float]:
    """Leaf target rate of each bin (or with ``number`` the leaf's number): best Gini splits between bins next to each other, categories by their rates."""
    total, leaves = counts["n"].sum(), 0
    out: dict[int, float] = {}

    def grow(bins: list[int], left: int) -> None:
        n, pos = counts.loc[bins, "n"].sum(), counts.loc[bins, "pos"].sum()
        best = None
        impurity = lambda a, b: 2 * a * (b - a) / b if b else 0.0
        if left:
            for k in range(1, len(bins)):
                a, b = counts.loc[bins[:k], "pos"].sum(), counts.loc[bins[:k], "n"].sum()
                if min(b, n - b) < min_share * total or min(b, n - b) == 0:
                    continue
                gain = impurity(pos, n) - impurity(a, b) - impurity(pos - a, n - b)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, k)
        if best is None:
            nonlocal leaves
            leaves += 1
            out.update(dict.fromkeys(bins, leaves if number else float(pos / n) if n else 0.5))
        else:
            grow(bins[: best[1]], left - 1)
            grow(bins[best[1] :], left - 1)

    grow(sorted(counts.index, key=lambda b: (counts.loc[b, "pos"] / counts.loc[b, "n"], b) if categorical else b), depth)
    return out


def univariate_tree_scores(df: DataFrame, target: str, features: Sequence[str], fold: str = "fold", max_depth: int = 3, min_leaf_share: float = 0.05) -> DataFrame:
    """As ``univariate_scores`` for one readable tree a feature, with n_leaves and whether the leaves' rates are monotonic (numbers alone)."""
    with held(df, [*features, target, fold, "row_id"]) as kept:
        scores = univariate_scores(kept, target, features, fold, tree_depth=max_depth, min_leaf_share=min_leaf_share).drop("auc_min", "auc_max", "n_splits_ok")
        leaves = univariate_leaves(kept, target, features, max_depth, min_leaf_share)
    shape = leaves.groupBy("feature").agg(F.count("*").alias("n_leaves"), F.array_sort(F.collect_list(F.when(~F.col("categorical") & F.col("least").isNotNull(), F.struct("leaf", "target_rate")))).alias("r"))
    steps = F.zip_with(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0))), lambda a, b: a["target_rate"] - b["target_rate"])
    even = F.when(F.size("r") > 1, F.forall(steps, lambda d: d >= 0) | F.forall(steps, lambda d: d <= 0))
    return scores.join(shape.select("feature", "n_leaves", even.alias("monotonic")), "feature", "left")


def univariate_leaves(df: DataFrame, target: str, features: Sequence[str], max_depth: int = 3, min_leaf_share: float = 0.05, bins: int = 32) -> DataFrame:
    """feature, categorical, leaf, n, share, n_target, target_rate, least, largest, with_missing, categories: the leaves of one tree a feature on all rows.

    Leaves of numbers are numbered by value, one of missing values alone last; leaves of categories by target rate.
    """
    with held(df, [*features, target, "row_id"]) as kept:
        prepared = FeaturePreparer(list(features), None, bins).fit(kept)
        names, cats = list(features), set(prepared.categories)
        value = lambda f: F.struct(F.lit(None).cast("double") if f in cats else numeric(kept, f), prepared._text(kept, f) if f in cats else F.lit(None).cast("string"))
        rows = prepared.transform(kept).filter(F.col(target).isNotNull()).select(F.col(target).cast("int").alias("y"), F.posexplode(F.array(*[F.struct(F.col(f"__bin_{k}").alias("b"), value(f).alias("v")) for k, f in enumerate(features)])).alias("f", "c"))
        counts = settled(rows.groupBy("f", F.col("c.b").alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.min("c.v.col1").alias("least"), F.max("c.v.col1").alias("largest"), F.min("c.v.col2").alias("category")))

    def run(key, pdf):
        import pandas as pd

        f = names[int(key[0])]
        own = pdf.set_index("b").sort_index()
        tree = _histogram_tree(own[["n", "pos"]], max_depth, min_leaf_share, f in cats, number=True)
        own["leaf"] = pd.Series(tree)
        total, out = own["n"].sum(), []
        for _, part in own.groupby("leaf"):
            low, high = part["least"].min(), part["largest"].max()
            known = sorted(c for c in part["category"] if isinstance(c, str))
            out.append((f, f in cats, int(part["n"].sum()), float(part["n"].sum() / total), int(part["pos"].sum()), float(part["pos"].sum() / part["n"].sum()), None if low != low else low, None if high != high else high, 0 in part.index, known))
        out.sort(key=lambda r: r[5] if f in cats else (r[6] is None, r[6] or 0.0))
        return pd.DataFrame([(r[0], r[1], k, *r[2:]) for k, r in enumerate(out, 1)], columns=["feature", "categorical", "leaf", "n", "share", "n_target", "target_rate", "least", "largest", "with_missing", "categories"])

    return counts.groupBy("f").applyInPandas(run, "feature string, categorical boolean, leaf int, n long, share double, n_target long, target_rate double, least double, largest double, with_missing boolean, categories array<string>")


def univariate_filter(df: DataFrame, target: str, features: Sequence[str], fold: str = "fold", min_auc: float = 0.52):
    from riskloom.operators.results import Result

    table = univariate_scores(df, target, features, fold).withColumn("action", F.when((F.col("status") == "ok") & (F.col("auc_mean") >= min_auc), "keep").otherwise("drop"))
    kept = {r[0] for r in table.filter("action = 'keep'").select("feature").collect()}
    return Result("univariate", table, [f for f in features if f in kept], {"min_auc": min_auc})
