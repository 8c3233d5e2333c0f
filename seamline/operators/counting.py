"""Joins by inequality that count instead of making pairs.

Points and questions are sorted together in ranges; counts run up within a range, and what stands
in the ranges before is added. A group, however large, is so dealt over as many ranges as it fills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def subsets(values: Column) -> Column:
    """All subsets of a small array but the empty one, each sorted; 2^n - 1 of n distinct values."""
    own = F.sort_array(F.array_distinct(values))
    some = F.transform(F.sequence(F.lit(1), F.pow(2, F.size(own)).cast("int") - 1), lambda m: F.filter(own, lambda _, i: F.getbit(m, i) == 1))
    return F.when(F.size(own) > 0, some).otherwise(F.array().cast("array<array<string>>"))


def counts_below(points: DataFrame, asked: DataFrame, group: Sequence[str]) -> DataFrame:
    """``asked`` (group, x, inclusive, name) with below: the sum of n of its group's points (group, x, n) under x, or up to it.

    Points of one group and x should be summed up beforehand; a range then holds as many of a group as of any other rows.
    """
    p = points.select(*group, "x", F.lit(1).alias("turn"), "n", F.lit(None).cast(asked.schema["name"].dataType).alias("name"), F.lit(None).cast("boolean").alias("inclusive"))
    q = asked.select(*group, "x", F.when(F.col("inclusive"), 2).otherwise(0).alias("turn"), F.lit(0).cast("bigint").alias("n"), "name", "inclusive")
    # Written, as ranges are sampled and may fall otherwise a second time.
    dealt = written(p.unionByName(q).repartitionByRange(*group, "x").withColumn("range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(*group, "range").agg(F.sum("n").alias("n"))
    before = held.select(*group, "range", F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("n").over(Window.partitionBy(*group, "range").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("upto", upto).where("turn <> 1").join(before, [*group, "range"]).select(*group, "x", "inclusive", "name", (F.col("upto") + F.col("before")).alias("below"))
