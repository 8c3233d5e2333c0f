"""Exact top-k search by inner product: distributed histogram selection.

Every candidate is scored against every query by matrix products, block by block. Each
round histograms the scores in the interval that still holds the k-th one of each query
and narrows the interval to one bin, until it is a single integer: the exact k-th score.
A last pass keeps the scores from there on and breaks ties by the smaller id. A partition
reports only the uppermost bins that hold its own k best scores, as lower ones can't hold
the k-th of all, so what moves is at most k rows for each query and partition.

Queries are taken in blocks of QUERY_BLOCK, one after another; only one such block is ever
at the driver or broadcast, and its answers are written. Candidates stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import place, written

QUERY_BLOCK = 16384
BINS = 1024
#: Scores held at once in a worker: rows of candidates times queries.
CELLS = 1 << 22


def integers(column: pa.Array, scale: float, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors that take part, as doubles padded with zeros, and which rows those are."""
    values = column.flatten().cast(pa.float64())
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    good = np.ones(len(column), bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row[~np.isfinite(flat)]] = False
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(column), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = np.floor(np.where(np.isfinite(flat), flat, 0.0) * scale)
    return out[good], np.flatnonzero(good)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products (queries x rows), modulo 2**64 where they exceed that."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (queries, rows))
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(width, 1)
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    return np.clip(queries, -(2.0**62), 2.0**62).astype(np.int64) @ np.clip(rows, -(2.0**62), 2.0**62).astype(np.int64).T


def _candidates(batches: Iterator[pa.RecordBatch], scale: float, n_queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    most = max(1, CELLS // max(1, n_queries))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            rows, kept = integers(part.column("vector"), scale)
            ids = part.column("id").to_numpy(zero_copy_only=False)[kept]
            if len(ids):
                yield rows, ids


def _own(ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a query meets its own key: positions among the (sorted) queries, and among the candidates."""
    first, last = np.searchsorted(block, ids), np.searchsorted(block, ids, "right")
    times = last - first
    at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
    return at, np.repeat(np.arange(len(ids)), times)


def _top_bins(bins: np.ndarray, k: int) -> np.ndarray:
    """Which of each row's descending counts are within its first k."""
    above = np.cumsum(bins, axis=1) - bins
    return (bins > 0) & (above < k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, bins: int = BINS) -> DataFrame:
    """query_id, rank (from 1), <key>, score: each query's k highest inner products.

    Queries are the rows whose key is divisible by ``every``, each for itself where rows repeat a key;
    candidates all rows but those with the query's own key. Ties go to the smaller key. Rows with a null
    key, a null vector, or a null or non-finite component take no part; vectors of different lengths, very
    long ones too, are compared as if filled up with zeros. Empty tables and tables without queries give no
    rows; other columns are not read.
    """
    kind = vectors.schema[key].dataType.simpleString()
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector")).where("id is not null and vector is not null")
    good = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # Equal rows ask once; their answers are repeated.
    asked = written(good.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "vector").agg(F.count("*").alias("times")), "queries")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    longest = good.agg(F.max(F.sqrt(norm))).first()[0] or 0.0
    at = place(spark, "top")
    some, found = asked, False
    while True:
        table = some.orderBy("id", "vector").limit(query_block).toArrow()
        if table.num_rows == 0:
            break
        ids = table.column("id").to_numpy()
        matrix, _ = integers(table.column("vector").combine_chunks(), scale)
        held = spark.sparkContext.broadcast((ids, matrix))
        best = _search(spark, rows, held, longest, k, scale, bins)
        times = spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "times": table.column("times")}))
        # Each block's answers are kept in the shared folder, and its queries leave the executors.
        best.join(F.broadcast(times), "q").select("query_id", "rank", "id", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("__time")).drop("__time").write.mode("append").parquet(at)
        held.destroy()
        found = True
        if table.num_rows < query_block:
            break
        low, last = int(ids[-1]), table.slice(table.num_rows - 1).select(["vector"])
        edge = spark.createDataFrame(last).select(F.col("vector").cast(asked.schema["vector"].dataType).alias("__last"))
        some = asked.where(F.col("id") >= low).crossJoin(F.broadcast(edge)).where((F.col("id") > low) | (F.col("vector") > F.col("__last"))).drop("__last")
    schema = "query_id bigint, rank int, id bigint, score bigint"
    answers = spark.read.schema(schema).parquet(at) if found else spark.createDataFrame([], schema)
    return answers.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(key), "score")


def _search(spark, rows: DataFrame, held, longest: float, k: int, scale: float, bins: int) -> DataFrame:
    """q (a query's number), query_id, rank, id, score: the best k of one bounded block of queries."""
    ids, matrix = held.value
    n = len(ids)
    # All scores lie in [-reach, reach]: Cauchy-Schwarz, and at most what a long holds.
    reach = int(min(np.sqrt((matrix**2).sum(axis=1)).max(initial=0.0) * longest * 1.001 + 2, 2.0**61))
    lows, above = np.full(n, -reach, np.int64), np.zeros(n, np.int64)
    width = 2 * reach + 1
    everything = np.zeros(n, bool)
    while width > 1:
        step = -(-width // bins)

        def count(batches: Iterator[pa.RecordBatch], lows=lows, above=above, width=width, step=step) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            n_bins = -(-width // step)
            total = np.zeros((len(ids), n_bins), np.int32)
            base = np.arange(len(ids))[:, None] * n_bins
            for part, names in _candidates(batches, scale, len(ids)):
                scores = _scores(matrix, part)
                # Bin 0 is the uppermost.
                place = (lows[:, None] + (width - 1) - scores) // step
                inside = (scores >= lows[:, None]) & (place >= 0)
                inside[_own(names, ids)] = False
                found = (place + base)[inside]
                # Whichever is less: a pass over the scores, or over all bins.
                if 4 * len(found) < total.size:
                    np.add.at(total.reshape(-1), found, 1)
                else:
                    total += np.bincount(found, minlength=total.size).reshape(total.shape).astype(np.int32)
            q, b = np.nonzero(_top_bins(total, k))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(total[q, b].astype(np.int64))], ["q", "bin", "n"])

        seen = rows.mapInArrow(count, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("bin"))
        need = seen.withColumn("upto", upto).join(F.broadcast(spark.createDataFrame(pa.table({"q": np.arange(n), "above": above}))), "q")
        # The bin in which the k-th score lies; queries with fewer scores keep all.
        hit = need.where(F.col("above") + F.col("upto") >= k).groupBy("q").agg(F.min(F.struct("bin", "upto", "n")).alias("x")).select("q", "x.bin", "x.upto", "x.n").toArrow()
        q, b = hit.column("q").to_numpy(), hit.column("bin").to_numpy()
        missing = np.ones(n, bool)
        missing[q] = False
        everything |= missing
        tops = lows + (width - 1)
        lows, above = lows.copy(), above.copy()
        lows[q] = tops[q] - (b + 1) * step + 1
        above[q] += hit.column("upto").to_numpy() - hit.column("n").to_numpy()
        width = step
    floor = np.where(everything, -(2**62), lows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = held.value
        best: list[tuple] = []
        waiting = 0

        def shrink() -> tuple:
            q, v, s = (np.concatenate(x) for x in zip(*best))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            return q[rank < k], v[rank < k], s[rank < k]

        for part, names in _candidates(batches, scale, len(ids)):
            scores = _scores(matrix, part)
            inside = scores >= floor[:, None]
            inside[_own(names, ids)] = False
            q, c = np.nonzero(inside)
            if len(q):
                best.append((q, names[c], scores[q, c]))
                waiting += len(q)
            if waiting > CELLS:
                best = [shrink()]
                waiting = len(best[0][0])
        if best:
            q, v, s = shrink()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[q]), pa.array(v), pa.array(s)], ["q", "query_id", "id", "score"])

    kept = rows.mapInArrow(keep, "q bigint, query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
