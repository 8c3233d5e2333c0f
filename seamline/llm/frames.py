"""Reading tables; cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread
from ..storage import dropped, place, shared, written

__all__ = ["dropped", "place", "shared", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; documents, on whose texts the operators work long, go to all cores where they are few."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df
