"""Reading and writing tables: appends, registries, fall-through between stores."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..storage import place

__all__ = ["Store", "append", "first_readable", "place", "registry", "spread"]

#: Tables of fewer bytes may be dealt out again: one row group of Parquet can hold them whole.
SMALL = 256 << 20
#: Compressed bytes for which a task of its own is worth while.
SHARE = 256 << 10


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table; a failed write leaves none of them."""
    df.write.mode("append").parquet(path)


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry kept as JSON lines, with a stated schema."""
    return spark.read.schema(schema).json(path)


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several stores that can be read."""
    for path in paths[:-1]:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            continue
    return spark.read.parquet(paths[-1])


class Store:
    """A table that is changed as a whole: each commit is a new version, and the highest one counts.

    A version is written beside the table and renamed into place, so readers see a change whole or not at
    all, and a failed one leaves nothing. Of two writers at once the second one's rename fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        if not self._fs.exists(self._hadoop(self.path)):
            return 0
        names = (s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path)))
        return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), default=0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}")

    def commit(self, rows: DataFrame) -> None:
        """``rows`` are the table from now on."""
        self._change(rows, keep=True)

    def transaction(self, change: Callable[[DataFrame], DataFrame], dry_run: bool = False) -> int:
        """Runs ``change`` on the table and commits it; the number of rows. A dry run computes all and keeps nothing."""
        return self._change(change(self.read()), keep=not dry_run)

    def _change(self, rows: DataFrame, keep: bool) -> int:
        number = self.version() + 1
        at = self._hadoop(f"{self.path}/new-{uuid.uuid4().hex}")
        try:
            rows.write.parquet(at.toString())
            n = self.spark.read.schema(rows.schema).parquet(at.toString()).count()
            target = self._hadoop(f"{self.path}/v{number}")
            if keep and (self._fs.exists(target) or not self._fs.rename(at, target)):
                raise RuntimeError(f"version {number} of {self.path} was committed by another writer")
            return n
        finally:
            if self._fs.exists(at):
                self._fs.delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, read from files, with its rows dealt to all cores where it is small and in fewer files than that.

    A row group is read by one task, so that a small table of long texts would be worked on by one core. Tables
    of ``SMALL`` bytes and more stay as they are read, and only partitions change, not rows.
    """
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    if size >= SMALL:
        return df
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))
    return df if len(df.inputFiles()) >= parts else df.repartition(parts)
