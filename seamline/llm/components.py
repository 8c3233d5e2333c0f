"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is two joins and two grouped minima over the edges; every node's edges are
pre-aggregated before they move, no list of a node's neighbours is gathered, and the edges
are written to the shared folder after each round, so lineage stays short. The number of
edges never grows. (Kiveris et al., Connected Components in MapReduce and Beyond, 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points neighbours at the smallest node around: the larger neighbours (large) or the smaller ones."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        # Each edge seen from its larger end.
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    if large:
        kept = around.where("v > u").join(least, "u")
        out = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        kept = around.join(least, "u")
        out = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u, component (the smallest node reachable): one row for each node of an edge (columns u and v, of one type).

    Edges in either direction, repeated edges and loops are taken alike; a null end is no edge; a
    node with loops only has no row; empty edges give no rows. Nodes compare by the order of their type.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    if now.isEmpty():
        return now.select("u", F.col("v").alias("component"))
    for _ in range(most_rounds):
        following = written(_star(_star(now, True), False), "edges")
        # A fixed point of both steps is a set of stars, each around its component's smallest node.
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = following
        if state == before:
            return now.select("u", F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components not found in {most_rounds} rounds")
