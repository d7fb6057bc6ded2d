"""Document quality from a linear-chain conditional random field over lines.

Every line has bounded features of its own text and those of the lines before and behind it. The
chain labels lines good or bad; training maximises the conditional likelihood of labelled documents,
whose lines take the document's label. A document's score is the mean of its lines' forward-backward
marginals of good, weighted by their lengths, put through a logistic map fitted on the same sample.

The model is fitted on at most ``max_docs`` labelled documents, drawn by a seeded hash among those
not held out, and on those of them with at most ``max_lines`` lines; that sample alone reaches the
driver, as features. Of texts that share an id the one with the least features is taken. Scoring reads whole texts in one
pass without a shuffle.

Defined results: texts without a word score 0; with no labels every text with a word scores one
half, with labels of one class alone 0 or 1; repeated rows repeat; a null id is held out; an empty
table gives no rows; other columns are ignored. Labels that are null or neither 0 nor 1 are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = b"#*$%&<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
FEATURES = 12


def line_features(line: bytes) -> tuple[float, ...]:
    """FEATURES values between 0 and about 1."""
    words = line.split()
    n = len(words) or 1
    solid = b"".join(words)
    size = len(solid) or 1
    without = lambda chars: len(solid) - len(solid.translate(None, chars))
    return (
        1.0 if words else 0.0,
        math.log1p(len(words)) / 5,
        1 - len(set(words)) / n,
        min(1.0, without(MARKS) / n),
        min(1.0, without(b"|") / n),
        min(1.0, without(b"!?") / n),
        without(UPPER) / size,
        without(b"0123456789") / size,
        1 - without(LETTERS) / size,
        min(1.0, size / n / 16),
        1.0 if solid.endswith((b".", b"!", b"?", b":")) else 0.0,
        1.0 if 0 < len(words) < 4 else 0.0,
    )


def featured(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, line lengths in bytes without white space at the ends, and lines per text."""
    rows, sizes, counts = [], [], []
    for text in texts:
        lines = text.encode("utf-8", "surrogatepass").split(b"\n")
        counts.append(len(lines))
        rows += map(line_features, lines)
        sizes += [len(x.strip()) for x in lines]
    return np.asarray(rows, "f8").reshape(-1, FEATURES), np.asarray(sizes, "f8"), np.asarray(counts, "i8")


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before, those of the line behind (zeros beyond the ends), and 1."""
    ends = np.cumsum(counts)
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    before[ends[:-1][counts[1:] > 0]] = 0
    before[:1] = 0
    behind[ends[counts > 0] - 1] = 0
    return np.hstack((x, before, behind, np.ones((len(x), 1))))


def marginals(score: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good per line, expected moves (2 x 2), and the sum of log partition values.

    ``score`` is the potential of good against bad, ``moves`` that of each step. All chains advance
    together, the longest first, so that step t works on a leading slice.
    """
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    counts = counts[order]
    steps = int(counts.max(initial=0))
    active = [int(np.searchsorted(-counts, -t, side="left")) for t in range(steps)]
    kernel = np.exp(moves - moves.max())
    node = np.empty((len(score), 2))
    top = np.maximum(score, 0)
    node[:, 0], node[:, 1] = np.exp(-top), np.exp(score - top)
    forward, scale = np.empty_like(node), np.ones(len(score))
    log_z = float(top.sum()) + float(moves.max()) * float((counts - 1)[counts > 0].sum())
    for t in range(steps):
        at = first[: active[t]] + t
        a = node[at] if t == 0 else (forward[at - 1] @ kernel) * node[at]
        total = a.sum(axis=1)
        scale[at] = total
        forward[at] = a / total[:, None]
    log_z += float(np.log(scale).sum())
    backward = np.ones_like(node)
    expected = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        ahead = backward[at + 1] * node[at + 1] / scale[at + 1][:, None]
        backward[at] = ahead @ kernel.T
        expected += (forward[at].T @ ahead) * kernel
    both = forward * backward
    return both[:, 1] / both.sum(axis=1) if len(both) else np.zeros(0), expected, log_z


class LineCrf:
    """Weights of a two-label chain; ``fixed`` replaces the model where there is nothing to learn."""

    def __init__(self) -> None:
        self.weights = np.zeros(3 * FEATURES + 1)
        self.moves = np.zeros((2, 2))
        self.fixed: float | None = None
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 0.02) -> LineCrf:
        """Maximise the conditional likelihood by Adam steps over all chains; ``good`` is 0 or 1 per document."""
        if not len(good) or good.min() == good.max():
            self.fixed = float(good[0]) if len(good) else 0.5
            return self
        full = with_neighbours(x, counts)
        label = np.repeat(good, counts).astype("f8")
        seen = np.diag([float(((1 - good) * (counts - 1)).sum()), float((good * (counts - 1)).sum())])
        params = np.zeros(len(self.weights) + 4)
        first, second = np.zeros_like(params), np.zeros_like(params)
        for k in range(1, rounds + 1):
            w, moves = params[:-4], params[-4:].reshape(2, 2)
            p, expected, _ = marginals(full @ w, counts, moves)
            gradient = np.concatenate((full.T @ (label - p), (seen - expected).ravel())) / len(good) - ridge * params / 10
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            params = params + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        self.weights, self.moves = params[:-4], params[-4:].reshape(2, 2)
        return self

    def calibrate(self, raw: np.ndarray, good: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> LineCrf:
        """Fit the logistic map from aggregated marginals to the probability of label 1 by Newton steps."""
        if self.fixed is not None:
            return self
        x = np.column_stack((raw, np.ones(len(raw))))
        w = np.zeros(2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(2), x.T @ (good - p) / len(x) - ridge * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(1e-3, float(w[0])), float(w[1])
        return self

    def lines(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Marginal probability of good per line."""
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        return marginals(with_neighbours(x, counts) @ self.weights, counts, self.moves)[0]

    def aggregate(self, x: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of good, per text."""
        if not len(counts):
            return np.zeros(0)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        weight = np.add.reduceat(sizes, starts)
        return np.clip(np.add.reduceat(sizes * self.lines(x, counts), starts) / np.maximum(weight, 1), 0, 1)

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that a text's label is 1; 0 for texts without a word."""
        x, sizes, counts = featured(texts)
        raw = self.aggregate(x, sizes, counts)
        if self.fixed is None:
            raw = 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))
        some = np.asarray([bool(t.strip()) for t in texts], bool)
        return np.where(some, raw, 0.0)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that no label is learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_lines: int = 5000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineCrf:
    """A model of at most ``max_docs`` labelled documents of at most ``max_lines`` lines that are not held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("good")).filter(F.col("doc_id").isNotNull() & F.col("good").isin(0, 1) & ~held_out("doc_id"))
    sample = known.groupBy("doc_id").agg(F.max("good").alias("good")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, sizes, counts = featured([t.as_py() or "" for t in batch.column("text")])
            x = np.column_stack((x, sizes))
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts * x.shape[1]))), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), cells], names=["doc_id", "good", "cells"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").filter(F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), "\n", "")) < max_lines).select(F.col("doc_id").cast("long").alias("doc_id"), "good", "text")
    rows = texts.mapInArrow(run, "doc_id long, good int, cells array<double>").groupBy("doc_id").agg(F.min(F.struct("good", "cells")).alias("x")).select("doc_id", "x.good", "x.cells").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return LineCrf().fit(np.zeros((0, FEATURES)), np.zeros(0, "i8"), np.zeros(0, "i8"))
    cells = rows.column("cells").combine_chunks()
    counts = np.diff(cells.offsets.to_numpy()) // (FEATURES + 1)
    x = cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES + 1)
    good = rows.column("good").to_numpy().astype("i8")
    model = LineCrf().fit(x[:, :-1], counts, good)
    return model.calibrate(model.aggregate(x[:, :-1], x[:, -1], counts), good)


def scored(docs: DataFrame, model: LineCrf, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and the columns ``keep`` as kept_0, kept_1 and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k in range(0, batch.num_rows, 1000):  # lines of so many texts are held at once
                parts.append(model.score([t.as_py() or "" for t in batch.column("text").slice(k, 1000)]))
            score = np.concatenate(parts) if parts else np.zeros(0)
            made = [pa.array(score), pa.array((score >= threshold).astype("i4"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in sent.values()), *made], names=[*sent, "score", "predicted"])

    # a kept text goes to the workers once
    sent = {"doc_id": "doc_id", "held_out": "held_out"} | {f"kept_{i}": "text" if c == text_col else f"kept_{i}" for i, c in enumerate(keep)}
    carried = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep) if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), *carried)
    types = dict(rows.dtypes)
    kinds = ", ".join(f"{name} {types[column]}" for name, column in sent.items())
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")
