"""Relational operators that Spark has no single call for. All map DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_garbage(flag: Column) -> Column:
    """False and unknown both pass."""
    return ~F.coalesce(flag, F.lit(False))


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive substring; % and _ in the needle stand for themselves."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def contains_either_way(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def proper_prefixes(df: DataFrame, column: str) -> DataFrame:
    """A row for each prefix of ``column`` that is shorter than it and not empty."""
    text = F.col(column)
    cuts = F.when(F.length(text) > 1, F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("__cut", F.explode(cuts)).withColumn(column, F.substring(text, F.lit(1), F.col("__cut"))).drop("__cut")


def relaxing(df: DataFrame, strict: Column, order: Sequence[Column], strict_limit: int, relaxed_limit: int) -> DataFrame:
    """The best rows that pass ``strict``; where none does, the best of all."""
    best = df.where(strict).orderBy(*order).limit(strict_limit)
    any_ = df.where(strict).limit(1).agg((F.count("*") > 0).alias("__any"))
    rest = df.orderBy(*order).limit(relaxed_limit).join(F.broadcast(any_), ~F.col("__any")).drop("__any")
    return best.unionByName(rest)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; Catalyst limits each partition's groups before they move."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= k)
    return ranked.withColumnRenamed("__rank", rank) if rank else ranked.drop("__rank")


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def insert_ignore(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``table`` with those new rows whose key it lacks; of new rows with one key the first."""
    return table.unionByName(first_per_key(new, keys, order).join(table.select(*keys), list(keys), "left_anti").select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``table`` with new rows in place of those with their key; of new rows with one key the first."""
    return table.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*table.columns).unionByName(first_per_key(new, keys, order).select(*table.columns))


def keyed_update(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``table`` with the non-null values of ``changes`` (one row for each key) in ``columns``."""
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = table.join(new, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def outlier(df: DataFrame, group: str, value: str, least: int = 3, deviations: float = 2.0) -> DataFrame:
    """``df`` with is_outlier: further than so many sample deviations from its group's mean.

    Group statistics are pre-aggregated and joined back, so no group is sorted in one task.
    """
    stats = df.groupBy(group).agg(F.count(value).alias("__n"), F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    flag = (F.col("__n") >= least) & (F.col("__sd") > 0) & (F.abs(F.col(value) - F.col("__mean")) > deviations * F.col("__sd"))
    return df.join(stats, group).withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("__n", "__mean", "__sd")


def bad_streak(df: DataFrame, keys: Sequence[str], order: Sequence[Column], good: Column) -> DataFrame:
    """Rows with ``streak``: bad rows in a row up to and with this one, reset by a good one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = df.withColumn("__good", good.cast("int")).withColumn("__run", F.sum("__good").over(w))
    inside = Window.partitionBy(*keys, "__run").orderBy(*order)
    return run.withColumn("streak", F.sum(1 - F.col("__good")).over(inside).cast("bigint")).drop("__good", "__run")


def with_columns_if_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """ADD COLUMN IF NOT EXISTS: name to type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
