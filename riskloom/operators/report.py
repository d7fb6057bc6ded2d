"""Model reports: every table is a grouped aggregate of one scored, cached table."""

from __future__ import annotations

import html
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import prob_to_logit
from riskloom.operators import calibration, ranking, stability
from riskloom.operators.models import Boosting
from riskloom.operators.splits import DataSplit
from riskloom.sources.tables import write_csv


def bar_spec(title: str, x: Sequence, y: Sequence) -> dict:
    """A plot specification: data and layout, ready for a plotting front end."""
    return {"data": [{"type": "bar", "x": list(x), "y": list(y)}], "layout": {"title": title}}


def line_spec(title: str, lines: dict[str, tuple[Sequence, Sequence]]) -> dict:
    return {"data": [{"type": "scatter", "mode": "lines", "name": n, "x": list(x), "y": list(y)} for n, (x, y) in lines.items()], "layout": {"title": title}}


def thinned(spec: dict, most: int = 2000) -> dict:
    """A specification with every n-th point of longer series."""
    out = {**spec, "data": []}
    for d in spec["data"]:
        step = max(1, -(-len(d["x"]) // most))
        out["data"].append({**d, "x": d["x"][::step], "y": d["y"][::step]})
    return out


@dataclass
class ModelReport:
    tables: dict[str, DataFrame]
    info: dict = field(default_factory=dict)

    def show(self, n: int = 20) -> None:
        for name, t in self.tables.items():
            print(name)
            t.show(n, truncate=False)

    def to_html(self, path: str, rows: int = 1000) -> None:
        parts = ["<!DOCTYPE html><meta charset='utf-8'><title>Model report</title>"]
        for name, t in self.tables.items():
            parts.append(f"<h2>{html.escape(name)}</h2><table border='1'><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in t.columns) + "</tr>")
            parts += ["<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in t.limit(rows).collect()]
            parts.append("</table>")
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(parts))

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for name, t in self.tables.items():
            write_csv(t, f"{folder}/{name}.csv", single_file=True)
        self.to_html(f"{folder}/report.html")


def model_report(model: Boosting, split: DataSplit, date: str | None = None, segment: str | None = None, freq: str = "quarter", buckets: int = 10) -> ModelReport:
    """Metrics and score psi by part, gain charts, feature psi, dynamics, psi by period, segments."""
    scored = model.predict(split.data, "score").cache()
    y = split.target
    by = ranking.ranking_metrics(scored, y, "score", ["part"]).select("part", "n", (F.col("n_target") / F.col("n")).alias("target_rate"), "auc", "gini", "ks")
    by = by.join(ranking.losses(scored, y, "score", ["part"]), "part").join(scored.groupBy("part").agg(F.avg("score").alias("mean_score")), "part")
    train = F.col("part") == "train"
    parts = [r[0] for r in scored.select("part").distinct().collect()]
    shifts = None
    for p in parts:
        one = stability.psi(scored.filter(train | (F.col("part") == p)), "score", train) if p != "train" else scored.limit(1).select(F.lit(0.0).alias("psi"))
        one = one.select(F.lit(p).alias("part"), F.col("psi").alias("score_psi"))
        shifts = one if shifts is None else shifts.union(one)
    last = "test" if "test" in parts else "val"
    logits = scored.withColumn("__logit", F.round(prob_to_logit(F.col("score")), 6))
    tables = {"metrics": by.join(shifts, "part"), "gain": calibration.gain_chart_table(logits, "__logit", y, buckets, by=["part"])}
    tables["feature_psi"] = stability.feature_psi(scored.filter(F.col("part").isin("train", last)), model.features, train)
    if date:
        tables["dynamics"] = ranking.metric_dynamics(scored, y, "score", date, "part", freq)
        tables["psi_by_period"] = stability.psi_by_period(scored, "score", date, freq, reference=train)
        tables["feature_psi_by_period"] = stability.feature_psi(scored.withColumn("__period", F.date_trunc(freq, date)), model.features, train, period="__period")
    if segment:
        tables["segments"] = ranking.metrics_by_segment(scored.filter(F.col("part") == last), y, "score", segment)
    return ModelReport(tables, {"features": model.features, "n_trees": model.n_iterations_})
