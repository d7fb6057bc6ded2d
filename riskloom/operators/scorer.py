"""A scorer that stands alone: a Python file made from a model, which needs pandas and numpy, but neither Spark nor this library."""

from __future__ import annotations

import importlib.util
import json
from pathlib import Path
from types import ModuleType

from riskloom.functions.columns import MISSING

TEMPLATE = '''"""Scores tables with the exported model: predict(df) for a pandas table, or as a command: python inference.py in.csv out.csv.

Needs pandas and numpy, and the files model.json and preprocessing.json beside it.
"""

import json
import math
import os
import re
import sys

import numpy as np
import pandas as pd

HERE = os.path.dirname(os.path.abspath(__file__))
with open(os.path.join(HERE, "preprocessing.json"), encoding="utf-8") as f:
    SPEC = json.load(f)
with open(os.path.join(HERE, "model.json"), encoding="utf-8") as f:
    MODEL = json.load(f)
MISSING = __MISSING__
NUMBER = re.compile(r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?inf(inity)?", re.IGNORECASE)


def custom_preprocess(df):
    """Put here what is to be done before the usual preparation; as it is, nothing."""
    return df


def absent(v):
    return v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v))


def number(v):
    """A value as float: texts parsed, booleans 0 or 1, times in nanoseconds; NaN if it has none."""
    if absent(v):
        return math.nan
    if isinstance(v, str):
        text = v.strip(" ")
        return float(text) if v not in MISSING and NUMBER.fullmatch(text) else math.nan
    return float(pd.Timestamp(v).value) if hasattr(v, "year") else float(v)


def category(v):
    """The canonical text of a category: whole numbers lose their fraction, missing is None."""
    if absent(v) or (isinstance(v, str) and v in MISSING):
        return None
    x = number(v)
    if not math.isnan(x) and not math.isinf(x) and x == math.floor(x):
        return str(int(x))
    return v if isinstance(v, str) else repr(float(v))


def bins(df):
    """The bin of each row and feature; 0 is missing."""
    lacking = [c for c in SPEC["features"] if c not in df.columns]
    if lacking:
        raise KeyError("columns are absent: " + ", ".join(lacking))
    out = np.zeros((len(df), len(SPEC["features"])), "i4")
    for k, name in enumerate(SPEC["features"]):
        values = df[name].tolist()
        if name in SPEC["categories"]:
            known = {c: i for i, c in enumerate(SPEC["categories"][name], 1)}
            rest = len(known) + 1 if name in SPEC["others"] else 0
            texts = [category(v) for v in values]
            out[:, k] = [0 if t is None else known.get(t, rest) for t in texts]
        else:
            if name in SPEC["encoders"]:
                known = SPEC["encoders"][name]
                x = np.array([known.get(category(v) or "", SPEC["mean"]) for v in values], "f8")
            else:
                x = np.array([number(v) for v in values], "f8")
            out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(np.array(SPEC["edges"][name], "f8"), x, "left") + 1)
    return out


def tree_values(tree, x):
    out, at = np.zeros(len(x)), np.zeros(len(x), "i4")
    for k, node in enumerate(tree):
        own = at == k
        if "left" not in node:
            out[own] = node["value"]
            continue
        b = x[own, node["feature"]]
        if "left_bins" in node:
            left = np.isin(b, node["left_bins"])
        else:
            left = (b <= node["cut"]) & ((b > 0) | node["missing_left"])
        at[own] = np.where(left, node["left"], node["right"])
    return out


def predict(df):
    """The probability of the target, or the value of a regression, for each row."""
    x = bins(custom_preprocess(df))
    margin = np.full(len(x), float(MODEL["base"]))
    for tree in MODEL["trees"]:
        margin += tree_values(tree, x)
    return 1 / (1 + np.exp(-margin)) if MODEL["loss"] == "logistic" else margin


if __name__ == "__main__":
    table = pd.read_csv(sys.argv[1])
    table.assign(prediction=predict(table)).to_csv(sys.argv[2], index=False)
'''


def scorer_source() -> str:
    return TEMPLATE.replace("__MISSING__", repr(tuple(MISSING)))


def write_scorer(folder: str, model_json: str, spec: dict) -> None:
    """model.json, preprocessing.json, inference.py and requirements.txt in ``folder``."""
    files = {"model.json": model_json, "preprocessing.json": json.dumps(spec, indent=1), "requirements.txt": "numpy\npandas\n", "inference.py": scorer_source()}
    for name, content in files.items():
        Path(folder, name).write_text(content, encoding="utf-8")


def load_scorer(folder: str) -> ModuleType:
    """The scorer of a folder as a module."""
    spec = importlib.util.spec_from_file_location(f"scorer_{abs(hash(folder))}", Path(folder, "inference.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module
