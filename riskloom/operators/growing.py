"""Growth of many boosted models in one sequence of jobs.

All models of a call share one table of binned rows with a margin for each model. It is held as blocks, one for each
Arrow batch of rows, whose columns are arrays. A round is one aggregation of gradients by (model, node, feature, bin) for all
models together: a task adds up its blocks, Spark the tasks. So the number of jobs follows the trees and their depth, not the models. Histograms,
whose size doesn't depend on the rows, reach the driver; there each model grows its tree best first: of all leaves the
one that gains most is split next. Leaves whose histograms would decide the next splits are asked for together.
Only the smaller of two children is aggregated; the other is the parent less it.

Trees go to the rows as data, not as code, so that the same compiled plan serves all rounds. Those that the margins don't
hold yet go with them.
"""

from __future__ import annotations

import heapq
import json
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gains that differ by less are equal; the first feature and cut wins.
TIE = 1e-12


@dataclass
class Tree:
    """One tree of a model while it grows: ``nodes`` as plain dictionaries, ``hist`` by node as (feature, bin, sums of g, h and rows)."""

    params: dict
    columns: list[int]
    categorical: set[int]
    bins: int
    nodes: list[dict] = field(default_factory=lambda: [{"depth": 0}])
    hist: dict[int, np.ndarray] = field(default_factory=dict)
    chosen: list[int] | None = None

    def wanted(self) -> list[int]:
        """Nodes whose histograms decide what is split next; none when the tree is finished."""
        if 0 not in self.hist:
            return [0]
        p = self.params
        left = (p.get("num_leaves") or 2 ** p["depth"]) - 1
        queue, chosen, unknown = [], [], []

        def offer(k: int) -> None:
            if "split" in self.nodes[k]:
                heapq.heappush(queue, (-self.nodes[k]["split"][0], k))

        offer(0)
        while queue and left:
            _, k = heapq.heappop(queue)
            chosen.append(k)
            left -= 1
            for child in self._children(k):
                if child in self.hist:
                    offer(child)
                elif self.nodes[child]["depth"] < p["depth"] and self.nodes[child]["sums"][2] >= 2 * p["min_leaf"]:
                    unknown.append(child)
        if not unknown:
            self.chosen = chosen
        return unknown

    def _children(self, k: int) -> tuple[int, int]:
        node = self.nodes[k]
        if "left" not in node:
            _, _, _, left = node["split"]
            node["left"], node["right"] = len(self.nodes), len(self.nodes) + 1
            for sums in (left, node["sums"] - left):
                self.nodes.append({"depth": node["depth"] + 1, "sums": sums, "parent": k})
        return node["left"], node["right"]

    def asked(self, wanted: Sequence[int]) -> list[int]:
        """The nodes to aggregate: the root, or of each pair of children the smaller."""
        pairs = {self.nodes[k]["parent"] for k in wanted if k}
        smaller = lambda k: min((self.nodes[k]["left"], self.nodes[k]["right"]), key=lambda c: (self.nodes[c]["sums"][2], c))
        return [0] if 0 in wanted else sorted(map(smaller, pairs))

    def told(self, asked: Sequence[int], cells: dict[int, list[tuple]]) -> None:
        """Take in the histograms of ``asked`` (cells of node: feature, bin, g, h, n) and work out their siblings'."""
        for k in asked:
            own = np.zeros((max(self.columns) + 1, self.bins, 3))
            rows = cells.get(k, [])
            if rows:
                at = np.asarray([r[:2] for r in rows], int)
                own[at[:, 0], at[:, 1]] = [r[2:] for r in rows]
            self._known(k, own)
            if k:
                parent = self.nodes[self.nodes[k]["parent"]]
                other = self.hist[self.nodes[k]["parent"]] - own
                other[other[..., 2] == 0] = 0
                self._known(parent["left"] + parent["right"] - k, other)

    def _known(self, k: int, own: np.ndarray) -> None:
        self.hist[k] = own
        node = self.nodes[k]
        if "sums" not in node:
            node["sums"] = own[self.columns[0]].sum(axis=0)
        if node["depth"] < self.params["depth"] and (split := self.best(own, node["sums"])):
            node["split"] = split

    def best(self, own: np.ndarray, sums: np.ndarray):
        """(gain, feature, rule, sums of the left side) of the best split, or none."""
        p, found = self.params, None
        part = lambda s: s[..., 0] ** 2 / (s[..., 1] + p["ridge"])
        for f in self.columns:
            cells = own[f]
            if f in self.categorical:
                kept = np.flatnonzero(cells[:, 2])
                order = kept[np.lexsort((kept, cells[kept, 0] / (cells[kept, 1] + p["ridge"])))]
                lefts, rules = np.cumsum(cells[order], axis=0)[:-1], [("left_bins", order[: k + 1]) for k in range(len(order) - 1)]
            else:
                upto = np.cumsum(cells[1:], axis=0)
                lefts = np.stack([upto, upto + cells[0]], axis=1).reshape(-1, 3) if cells[0, 2] else upto
                step = 2 if cells[0, 2] else 1
                rules = [("cut", (k // step + 1, k % step == 1)) for k in range(len(lefts))]
            if not len(lefts):
                continue
            rest = sums - lefts
            gain = np.where((lefts[:, 2] >= max(1, p["min_leaf"])) & (rest[:, 2] >= max(1, p["min_leaf"])), part(lefts) + part(rest) - part(sums), -np.inf)
            k = int(np.flatnonzero(gain >= gain.max() - TIE)[0])
            if gain[k] > 1e-9 and (found is None or gain[k] > found[0] + TIE):
                kind, what = rules[k]
                rule = {"left_bins": sorted(map(int, what))} if kind == "left_bins" else {"cut": what[0], "missing_left": bool(what[1])}
                found = float(gain[k]), f, rule, lefts[k]
        return found

    def value(self, k: int) -> float:
        g, h, _ = self.nodes[k].get("sums", (0.0, 0.0, 0))
        return float(self.params["learning_rate"] * g / (h + self.params["ridge"]))

    def open_nodes(self, asked: Sequence[int]) -> dict:
        """The tree so far as data for the rows, with the nodes whose rows are to be aggregated."""
        return {"on": True, "open": list(asked), "columns": self.columns, "nodes": [_plain(n, n.get("split"), 0.0) for n in self.nodes]}

    def finished(self) -> tuple[list[dict], list[tuple[int, float]]]:
        """The tree in its lasting form, leaves with values, and (feature, gain) of its splits."""
        chosen, order, gains = set(self.chosen or []), [0], []
        for k in order:
            if k in chosen:
                order += [self.nodes[k]["left"], self.nodes[k]["right"]]
        place = {k: i for i, k in enumerate(order)}
        out = []
        for k in order:
            node = self.nodes[k]
            n = int(node["sums"][2]) if "sums" in node else 0
            if k in chosen:
                gain, f, rule, _ = node["split"]
                gains.append((f, gain))
                out.append({"feature": f, **rule, "left": place[node["left"]], "right": place[node["right"]], "n": n})
            else:
                out.append({"value": self.value(k), "n": n})
        return out, gains


class SymmetricTree(Tree):
    """A tree whose leaves of one depth are all split by the same feature and cut: the one with the greatest gain over all of them.

    Bins are numbers; a side without rows is a leaf of value 0.
    """

    def best(self, own: np.ndarray, sums: np.ndarray):
        return None

    def wanted(self) -> list[int]:
        level, depth = [0], 0
        while depth < self.params["depth"]:
            if unknown := [k for k in level if k not in self.hist]:
                return unknown
            if "split" not in self.nodes[level[0]] and not self._split(level):
                break
            level = [c for k in level for c in self._children(k)]
            depth += 1
        self.chosen = [k for k, n in enumerate(self.nodes) if "left" in n]
        return []

    def _split(self, level: list[int]) -> bool:
        part = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.params["ridge"])
        own = np.stack([self.hist[k] for k in level])[:, self.columns]
        sums = np.stack([self.nodes[k]["sums"] for k in level])[:, None, None, None]
        upto = np.cumsum(own[:, :, 1:], axis=2)
        left = np.stack([upto, upto + own[:, :, :1]], axis=3)  # leaf, feature, cut, whether missing goes left
        rest = sums - left
        gain = (part(left) + part(rest) - part(sums)).sum(axis=0)
        both = (left[..., 2].sum(axis=0) >= self.params["min_leaf"]) & (rest[..., 2].sum(axis=0) >= self.params["min_leaf"])
        gain = np.where(both, gain, -np.inf)
        best = int(np.flatnonzero(gain >= gain.max() - TIE)[0])
        f, cut, missing = np.unravel_index(best, gain.shape)
        if not gain[f, cut, missing] > 1e-9:
            return False
        rule = {"cut": int(cut) + 1, "missing_left": bool(missing)}
        for i, k in enumerate(level):
            self.nodes[k]["split"] = float(gain[f, cut, missing]) / len(level), self.columns[int(f)], rule, left[i, f, cut, missing]
        return True


def _plain(node: dict, split, value: float) -> dict:
    if split is None or "left" not in node:
        return {"v": value}
    _, f, rule, _ = split
    return {"f": f, "c": rule.get("cut"), "m": rule.get("missing_left"), "s": rule.get("left_bins"), "l": node["left"], "r": node["right"], "v": 0.0}


def as_data(tree: Sequence[dict]) -> list[dict]:
    """The nodes of a lasting tree as data for the rows."""
    return [{"f": n.get("feature"), "c": n.get("cut"), "m": n.get("missing_left"), "s": n.get("left_bins"), "l": n.get("left"), "r": n.get("right"), "v": n.get("value", 0.0)} for n in tree]


OFF = {"on": False}

#: Parts of a row's hash that a share of the rows is drawn by.
DRAW = 1 << 20


def with_tree(rows: DataFrame, trees: Sequence, kind: str = "tree") -> DataFrame:
    """``rows`` (blocks) with the trees of all models as one constant text."""
    return rows.select("*", F.lit(json.dumps(list(trees))).alias(kind))


def draws(params: dict, features: int, number: int) -> tuple[list[int], int, int]:
    """(features, rows in DRAW, seed) that tree ``number`` of a model sees, the same for each run."""
    rng = random.Random(f"{params.get('seed', 42)}|{number}")
    share = params.get("colsample") or 1.0
    columns = sorted(rng.sample(range(features), max(1, round(share * features)))) if share < 1 else list(range(features))
    return columns, round((params.get("subsample") or 1.0) * DRAW), rng.getrandbits(40)


@dataclass
class Layout:
    """How a block holds its rows: the columns of ``x`` and the row set of each model, and the number of sets and bins."""

    columns: list[list[int]]
    sets: list[int]
    width: int
    n_sets: int
    n_columns: int

    def arrays(self, batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
        """(y, h, role, w, m, x) of block ``k`` of a batch: rows in the first dimension."""
        part = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
        y = part("y", "f8")
        shaped = lambda name, kind, n: part(name, kind).reshape(len(y), n)
        return y, part("h", "u8"), shaped("role", "i1", self.n_sets), shaped("w", "f8", self.n_sets), shaped("m", "f8", len(self.sets)), shaped("x", "i2", self.n_columns)


BLOCK = "y binary, h binary, role binary, w binary, m binary, x binary"


def blocks(rows: DataFrame, layout: Layout, cuts: Sequence[tuple[int, list[float] | None]], bases: Sequence[float], ids: str | None = None) -> DataFrame:
    """Rows (y, h, and by set role, w, m; values; perhaps row_id of the type ``ids``) as blocks of an Arrow batch each, so that a round costs no conversion of rows.

    Each column of a block's bins comes from the value of that number: by edges, or the value is the bin.
    """
    sets, n_sets, base = list(layout.sets), layout.n_sets, np.asarray(bases)
    cuts, n_values = [(k, None if edges is None else np.asarray(edges, "f8")) for k, edges in cuts], 1 + max(k for k, _ in cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = t.num_rows
            if not n:
                continue
            flat = lambda name, kind, width: t.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, width)  # noqa: B023, E731
            m = flat("m", "f8", n_sets)[:, sets] + base
            values = flat("x", "f8", n_values)
            x = np.stack([np.where(np.isnan(values[:, k]), 0, values[:, k] if edges is None else np.searchsorted(edges, values[:, k]) + 1) for k, edges in cuts], axis=1)
            made = [t.column("y").to_numpy(zero_copy_only=False).astype("f8"), t.column("h").to_numpy(zero_copy_only=False).astype("i8"), flat("role", "i1", n_sets), flat("w", "f8", n_sets), m, x.astype("i2")]
            parts = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in made]
            names = ["y", "h", "role", "w", "m", "x"]
            if ids:
                parts, names = [*parts, pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t.column("row_id"))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(parts, names=names)

    return rows.mapInArrow(run, BLOCK + (f", ids array<{ids}>" if ids else ""))


def _as_table(nodes: Sequence[dict], width: int) -> tuple[np.ndarray, ...]:
    """A tree as arrays by node: whether it is split, feature, bins that go left, children and value."""
    inner = np.array([n.get("l") is not None for n in nodes])
    goes_left = np.zeros((len(nodes), width), bool)
    for k, n in enumerate(nodes):
        if not inner[k]:
            continue
        if n.get("s") is not None:
            goes_left[k, n["s"]] = True
        else:
            goes_left[k, : n["c"] + 1] = True
            goes_left[k, 0] = bool(n["m"])
    column = lambda name, kind: np.array([n.get(name) or 0 for n in nodes], kind)
    return inner, column("f", "i8"), goes_left, column("l", "i8"), column("r", "i8"), column("v", "f8")


def _reached(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node that each row of bins leads to."""
    inner, feature, goes_left, left, right, _ = tree
    at = np.zeros(len(x), "i8")
    every = np.arange(len(x))
    while (deeper := inner[at]).any():
        down = np.where(goes_left[at, x[every, feature[at]]], left[at], right[at])
        at = np.where(deeper, down, at)
    return at


def _rotated(v: np.ndarray, n: int) -> np.ndarray:
    return (v << np.uint64(n)) | (v >> np.uint64(64 - n))


def drawn_part(h: np.ndarray, seed: int) -> np.ndarray:
    """pmod(xxhash64(h, seed), DRAW) as SQL has it."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def mixed(v: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = start + p5 + np.uint64(8)
        out = out ^ (_rotated(v * p2, 31) * p1)
        out = _rotated(out, 27) * p1 + p4
        out = (out ^ (out >> np.uint64(33))) * p2
        out = (out ^ (out >> np.uint64(29))) * p3
        return out ^ (out >> np.uint64(32))

    first = mixed(h, np.full(1, 42, "u8"))
    return (mixed(np.full(1, seed, "u8"), first) & np.uint64(DRAW - 1)).astype("i8")


def _cells(layout: Layout, squared: set[int]):
    """The function of a task: sums of g, h and rows of its blocks by (job, node, feature, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, trees, sums = None, [], {}
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("tree")[k].as_py() != text:
                    text = batch.column("tree")[k].as_py()
                    trees = [{**t, "table": _as_table(t["nodes"], layout.width), "before": [_as_table(n, layout.width) for n in t["since"]]} if t["on"] else t for t in json.loads(text)]
                y, h, role, w, m, x = layout.arrays(batch, k)
                for j, t in enumerate(trees):
                    if not t["on"]:
                        continue
                    i = layout.sets[j]
                    used = role[:, i] == 1
                    if t["share"] < DRAW:
                        used = used & (drawn_part(h, t["seed"]) < t["share"])
                    at = np.flatnonzero(used)
                    own = x[np.ix_(at, layout.columns[j])]
                    node = _reached(t["table"], own)
                    slot = np.full(len(t["nodes"]), -1)
                    slot[t["open"]] = np.arange(len(t["open"]))
                    here = slot[node]
                    keep = here >= 0
                    at, own, here = at[keep], own[keep], here[keep]
                    margin = m[at, j]
                    for tree in t["before"]:
                        margin = margin + tree[5][_reached(tree, own)]
                    weight = w[at, i]
                    if j in squared:
                        g, hess = (y[at] - margin) * weight, weight
                    else:
                        q = 1 / (1 + np.exp(-margin))
                        g, hess = (y[at] - q) * weight, np.maximum(q * (1 - q), 1e-6) * weight
                    g, hess = np.nan_to_num(g, nan=0.0), np.nan_to_num(hess, nan=0.0)  # rows without a weight or margin
                    size = len(t["open"]) * layout.width
                    if j not in sums:
                        sums[j] = t["open"], t["columns"], np.zeros((3, len(t["columns"]), size))
                    for n, c in enumerate(t["columns"]):
                        cell = here * layout.width + own[:, c]
                        sums[j][2][0, n] += np.bincount(cell, g, size)
                        sums[j][2][1, n] += np.bincount(cell, hess, size)
                        sums[j][2][2, n] += np.bincount(cell, minlength=size)
        for j, (opened, columns, found) in sums.items():
            c, cell = np.nonzero(found[2])
            made = [np.full(len(c), j, "i4"), np.asarray(opened, "i4")[cell // layout.width], np.asarray(columns, "i4")[c], (cell % layout.width).astype("i4"), found[0, c, cell], found[1, c, cell], found[2, c, cell].astype("i8")]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], names=["job", "node", "c", "b", "g", "h", "n"])

    return run


def grown(rows: DataFrame, trees: dict[int, Tree], drawn: dict[int, tuple[int, int]], squared: set[int], layout: Layout, since: dict[int, list[list[dict]]]) -> None:
    """Grow the trees (by model) on ``rows`` (blocks) until they are finished; ``since`` are trees whose values the margins don't hold yet."""
    size = max(trees) + 1
    while True:
        asked = {j: t.asked(w) for j, t in trees.items() if t.chosen is None and (w := t.wanted())}
        if not asked:
            return
        now = [{**trees[j].open_nodes(asked[j]), "share": drawn[j][0], "seed": drawn[j][1], "since": [as_data(t) for t in since.get(j, [])]} if j in asked else OFF for j in range(size)]
        cells = with_tree(rows, now).mapInArrow(_cells(layout, squared), "job int, node int, c int, b int, g double, h double, n long")
        found: dict[int, dict[int, list]] = {}
        for job, node, c, b, sg, sh, n in cells.groupBy("job", "node", "c", "b").agg(F.expr("sum(g)"), F.expr("sum(h)"), F.expr("sum(n)")).collect():
            found.setdefault(job, {}).setdefault(node, []).append((c, b, sg, sh, n))
        for j, nodes in asked.items():
            trees[j].told(nodes, found.get(j, {}))


def moved(rows: DataFrame, trees: dict[int, list[list[dict]]], layout: Layout) -> DataFrame:
    """``rows`` (blocks) with the margins after some trees of each model."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, tables = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("tree")[k].as_py() != text:
                    text = batch.column("tree")[k].as_py()
                    tables = [[_as_table(n, layout.width) for n in own] for own in json.loads(text)]
                _, _, role, _, m, x = layout.arrays(batch, k)
                m = m.copy()
                for j, own in enumerate(tables):
                    bins = x[:, layout.columns[j]]
                    for tree in own:
                        m[:, j] += tree[5][_reached(tree, bins)]
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) if c == "m" else batch.column(c).slice(k, 1) for c in names], names=names)

    now = [[as_data(t) for t in trees.get(j, [])] for j in range(max(trees, default=-1) + 1)]
    return with_tree(rows, now, "tree").mapInArrow(run, rows.schema)


def judged_margins(rows: DataFrame, trees: dict[int, list[list[dict]]], layout: Layout, counted: bool) -> DataFrame:
    """(job, k, y, m, n): margins of the rows to be judged after each of some trees of each model.

    With ``counted`` rows of a block that are alike are one with their number ``n``, otherwise each has its own, with ``row_id`` if blocks have it.
    """
    ids = dict(rows.dtypes).get("ids", "")[len("array<") : -1]
    with_ids = bool(ids) and not counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, tables = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("tree")[k].as_py() != text:
                    text = batch.column("tree")[k].as_py()
                    tables = [[_as_table(n, layout.width) for n in own] for own in json.loads(text)]
                y, _, role, _, m, x = layout.arrays(batch, k)
                for j, own in enumerate(tables):
                    at = np.flatnonzero(role[:, layout.sets[j]] == 2) if own else ()
                    if not len(at):
                        continue
                    bins, margin, label = x[np.ix_(at, layout.columns[j])], m[at, j], y[at]
                    for number, tree in enumerate(own):
                        margin = margin + tree[5][_reached(tree, bins)]
                        if counted:
                            parts = [(v, *np.unique(margin[label == v], return_counts=True)) for v in np.unique(label)]
                            out = [np.concatenate([np.full(len(u), v) for v, u, _ in parts]), np.concatenate([u for _, u, _ in parts]), np.concatenate([n for _, _, n in parts]).astype("i8")]
                        else:
                            out = [label, margin, np.ones(len(at), "i8")]
                        made = [pa.array(v) for v in (np.full(len(out[0]), j, "i4"), np.full(len(out[0]), number, "i4"), *out)]
                        if with_ids:
                            made.append(batch.column("ids").slice(k, 1).flatten().take(pa.array(at)))
                        yield pa.RecordBatch.from_arrays(made, names=["job", "k", "y", "m", "n"] + ["row_id"] * with_ids)

    now = [[as_data(t) for t in trees.get(j, [])] for j in range(max(trees, default=-1) + 1)]
    return with_tree(rows, now, "tree").mapInArrow(run, "job int, k int, y double, m double, n long" + (f", row_id {ids}" if with_ids else ""))
