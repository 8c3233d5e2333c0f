"""Tables in the shared folder: they survive lost executors and cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own in local mode (as in tests), else an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if (at := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seamline-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder goes with the cluster's own clean-up
        pass


def _clean() -> None:
    while _made:
        _remove(*_made.pop())


atexit.register(_clean)


def place(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; it is removed when the application ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove a table made by written() that nothing reads any more."""
    files = df.inputFiles()
    for item in [x for x in _made if any(x[1].split(":")[-1] in f for f in files[:1])]:
        _remove(*item)
        _made.remove(item)
