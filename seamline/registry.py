"""Where queries are registered: a function of ``Tables`` by name, with its SQL where DuckDB can express it.

Its SQL is written against the base tables, behind the model tables named in ``lens``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .lens import Tables, with_lens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, lens: str = "") -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_lens(sql, *lens.split())
        return f

    return register
