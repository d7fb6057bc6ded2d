"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, spread_to

#: Edges of one node, two longs each, that one task may join.
HUB_EDGES = 1_000_000


def _told(near: DataFrame, least: DataFrame, hot_rows: int | None) -> DataFrame:
    """``near`` (node, other) with the least node around ``node``; nodes of more than ``hot_rows`` neighbours are dealt over several tasks."""
    return near.join(least, "node") if hot_rows is None else spread_to(near, least, ["node"], hot_rows=hot_rows)


def _star(edges: DataFrame, small: bool, hot_rows: int | None) -> DataFrame:
    """Connect neighbours of each node to the least node around it: the smaller neighbours (small star) or the larger ones."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    else:
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    least = near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"), F.count("*").alias("n"))
    least = least.drop("n") if hot_rows is None else cut(least)
    if small:
        moved = _told(near, least, hot_rows).select(F.col("other").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    else:
        moved = _told(near.filter("other > node"), least, hot_rows).select(F.col("other").alias("a"), F.col("least").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60, hot_rows: int = HUB_EDGES) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge. Ids are compared as they are.

    Each round is one large and one small star over narrow rows; it ends when a round changes
    nothing. A node of more than ``hot_rows`` edges is dealt over several tasks; while all edges are no
    more than that there is none to look for. Nothing but two sums reaches the driver. Raises if ``most_rounds`` do not suffice.
    """
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        sign = seen
        hubs = hot_rows if seen[0] > hot_rows else None
        now = cut(_star(_star(now, False, hubs), True, hubs))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
