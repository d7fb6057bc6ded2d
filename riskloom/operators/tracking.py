"""Experiments as versioned folders: <root>/<project>/v_<N>/{models, logs, meta.json}."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
from typing import Any

from pyspark.sql import DataFrame

from riskloom.operators.models import Boosting, export_model, load_model
from riskloom.operators.results import Result, jsonable
from riskloom.sources.tables import write_csv


class Tracker:
    """What a tracking server would be told; the default tells nobody."""

    def report(self, kind: str, name: str, value: Any) -> None:
        return None


class Experiment:
    """One version of a project. Without a number the next is taken; an existing one is only replaced with ``overwrite``."""

    def __init__(self, root: str, project: str, version: int | None = None, overwrite: bool = False, tracker: Tracker | None = None):
        self.folder_of = lambda v: os.path.join(root, project, f"v_{v}")
        existing = list_versions(root, project)
        self.version = version if version is not None else max(existing, default=0) + 1
        self.path = self.folder_of(self.version)
        if self.version in existing:
            if not overwrite:
                raise FileExistsError(f"version {self.version} of {project} exists")
            shutil.rmtree(self.path)
        for d in ("models", "logs"):
            os.makedirs(os.path.join(self.path, d))
        self.tracker = tracker or Tracker()
        self.meta: dict = {"project": project, "version": self.version, "created": time.strftime("%Y-%m-%dT%H:%M:%S"), "params": {}, "metrics": {}, "status": "running"}
        self.flush()

    def __enter__(self) -> Experiment:
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.close("failed" if kind else "completed")

    def flush(self) -> None:
        with open(os.path.join(self.path, "meta.json"), "w") as f:
            json.dump(jsonable(self.meta), f, indent=1)

    def log_params(self, **params) -> None:
        self.meta["params"].update(params)
        self.flush()

    def log_metrics(self, **metrics) -> None:
        self.meta["metrics"].update(metrics)
        for k, v in metrics.items():
            self.tracker.report("metric", k, v)
        self.flush()

    def log(self, text: str) -> None:
        with open(os.path.join(self.path, "logs", "log.txt"), "a") as f:
            f.write(f"{time.strftime('%H:%M:%S')} {text}\n")

    def save_features(self, features: list[str], name: str = "features") -> None:
        with open(os.path.join(self.path, f"{name}.json"), "w") as f:
            json.dump(list(features), f)

    def load_features(self, name: str = "features") -> list[str]:
        with open(os.path.join(self.path, f"{name}.json")) as f:
            return json.load(f)

    def save_model(self, model: Boosting, name: str = "model") -> None:
        export_model(model, os.path.join(self.path, "models", name))

    def load_model(self, name: str = "model") -> Boosting:
        return load_model(os.path.join(self.path, "models", name))

    def save_table(self, table: DataFrame, name: str) -> None:
        write_csv(table, os.path.join(self.path, "logs", f"{name}.csv"), single_file=True)
        self.tracker.report("table", name, table.limit(1000))

    def save_result(self, result: Result) -> None:
        result.save(os.path.join(self.path, "logs"))

    def save_figure(self, spec: dict, name: str) -> None:
        with open(os.path.join(self.path, "logs", f"{name}.json"), "w") as f:
            json.dump(jsonable(spec), f)
        self.tracker.report("figure", name, spec)

    def save_report(self, report, name: str = "report") -> None:
        report.save(os.path.join(self.path, "logs", name))

    save_feature_test = save_report

    def save_pipeline(self, pipeline, name: str = "pipeline") -> None:
        self.save_table(pipeline.log_, f"{name}_log")
        self.save_table(pipeline.summary(), f"{name}_summary")
        self.save_features(pipeline.selected_, name)

    def close(self, status: str = "completed") -> None:
        self.meta["status"] = status
        self.flush()


def list_versions(root: str, project: str) -> list[int]:
    folder = os.path.join(root, project)
    found = os.listdir(folder) if os.path.isdir(folder) else []
    return sorted(int(m[1]) for x in found if (m := re.fullmatch(r"v_(\d+)", x)))
