"""Knowledge graph: vertices, edges, ranks, paths and neighbourhoods."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

c = F.col


def cooccurrence(members: DataFrame, least: int = 3) -> DataFrame:
    """a < b, n, weight: values that share ``least`` groups (group, value); weight is n / 10, at most 3."""
    m = members.select("group", "value").distinct()
    pairs = m.withColumnRenamed("value", "a").join(m.withColumnRenamed("value", "b"), "group").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(c("n") >= least).withColumn("weight", F.least(c("n") / 10, F.lit(3.0)))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """id, rank after so many rounds over (src, dst, weight); what dangling vertices hold is spread evenly.

    Each round is one join and one grouped sum; ranks are written to the shared folder every few rounds.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = written(edges.join(out, "src").select("src", "dst", (c("weight") / c("total")).alias("share")), "shares")
    nodes = written(shares.select(c("src").alias("id")).unionByName(shares.select(c("dst").alias("id"))).distinct().join(shares.select(c("src").alias("id")).distinct().withColumn("out", F.lit(True)), "id", "left"), "nodes")
    n = max(1, nodes.count())
    rank = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        lost = nodes.where("out is null").join(rank, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = shares.join(rank.withColumnRenamed("id", "src"), "src").groupBy(c("dst").alias("id")).agg(F.sum(c("rank") * c("share")).alias("got"))
        rank = nodes.select("id").join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + c("lost") / n)).alias("rank"))
        if (k + 1) % every == 0:
            rank = written(rank, "rank")
    return rank


def distances(edges: DataFrame, start, most: int | None = None) -> DataFrame:
    """id, hops: breadth first from ``start`` over undirected edges (src, dst), to all that can be reached, or ``most`` hops."""
    both = edges.select("src", "dst").unionByName(edges.select(c("dst").alias("src"), c("src").alias("dst"))).distinct()
    seen = both.where(c("src") == F.lit(start)).select(c("src").alias("id")).distinct().withColumn("hops", F.lit(0))
    front = seen
    for k in count(1) if most is None else range(1, most + 1):
        front = written(both.join(front.select(c("id").alias("src")), "src").select(c("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
    return seen


def betweenness(edges: DataFrame, sources: list) -> DataFrame:
    """id, score: shortest paths from the given sources that pass through each vertex (Brandes), undirected and unweighted.

    Sources are a bounded, stated sample; each costs two sweeps of frontier joins.
    """
    both = written(edges.select("src", "dst").unionByName(edges.select(c("dst").alias("src"), c("src").alias("dst"))).distinct(), "both")
    spark = edges.sparkSession
    level = spark.createDataFrame([(s, s) for s in sources], both.select(c("src").alias("s"), c("src").alias("id")).schema).withColumn("k", F.lit(0)).withColumn("paths", F.lit(1.0))
    levels, seen = [level], level.select("s", "id")
    for k in count(1):
        step = both.join(levels[-1].withColumnRenamed("id", "src"), "src").groupBy("s", c("dst").alias("id")).agg(F.sum("paths").alias("paths")).join(seen, ["s", "id"], "left_anti")
        step = written(step.select("s", "id", F.lit(k).alias("k"), "paths"), "level")
        if step.isEmpty():
            break
        levels.append(step)
        seen = written(seen.unionByName(step.select("s", "id")), "seen")
    carried = levels[-1].select("s", "id", "paths", F.lit(0.0).alias("d"))
    total = carried
    for up in reversed(levels[:-1]):
        down = carried.select("s", c("id").alias("dst"), c("paths").alias("pd"), "d")
        parts = both.join(up.withColumnRenamed("id", "src"), "src").join(down, ["s", "dst"]).groupBy("s", c("src").alias("id")).agg(F.sum(c("paths") / c("pd") * (1 + c("d"))).alias("d"))
        carried = written(up.join(parts, ["s", "id"], "left").select("s", "id", "paths", F.coalesce("d", F.lit(0.0)).alias("d")), "carried")
        total = total.unionByName(carried)
    return total.where("id <> s").groupBy("id").agg(F.sum("d").alias("score"))


def expand(edges: DataFrame, start, hops: int = 3, most: int = 200) -> DataFrame:
    """src, dst: distinct directed edges within ``hops`` of ``start``, the first ``most`` by name."""
    front = edges.where(c("src") == F.lit(start)).select("src", "dst").distinct()
    found = front
    for _ in range(hops - 1):
        front = edges.select("src", "dst").join(front.select(c("dst").alias("src")).distinct(), "src").select("src", "dst").distinct()
        found = found.unionByName(front).distinct()
    return found.orderBy("src", "dst").limit(most)
