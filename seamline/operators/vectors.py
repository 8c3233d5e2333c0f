"""Vector search: bounded blocks of queries against all rows, by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Queries that are broadcast at a time.
QUERY_BLOCK = 4096
#: Scores held at once in a worker.
CELLS = 1 << 19
#: Rows found that wait for being ranked, at least.
WAITING = 1 << 18
DIGITS = 9


#: Stands for a null among the values of ``by``.
NONE = np.iinfo(np.int64).min


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NONE).to_numpy(zero_copy_only=False)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows of length 1, and which rows of the column those are (no nulls, not zero)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    kept = np.flatnonzero((sizes == width) & (width > 0))
    # A null within becomes a NaN, which has no finite length.
    rows = pc.fill_null(column.take(pa.array(kept)).flatten().cast(pa.float64()), np.nan).to_numpy().reshape(len(kept), width)
    length = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return rows[good] / length[good, None], kept[good]


def nearest(rows: DataFrame, queries: DataFrame, k: int, least: float = -2.0, by: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank[, by]: of each query (id, vector) the k rows (id, vector[, by]) of the best cosine, ``least`` at least.

    Scores are rounded to DIGITS; ties go to the smaller id. With ``by`` (an integer column of rows) the
    best k of each of its values. Ids are integers; vectors that are null, hold a null or have no length
    take no part. Queries go in blocks of ``block``, each broadcast; each partition
    holds and reports its own best k, what can't be among these is not held.
    """
    spark = rows.sparkSession
    kept = ["id", *([by] if by else [])]
    schema = "query_id bigint, id bigint, score double" + (f", {by} bigint" if by else "")
    rows = rows.select(F.col("id").cast("bigint").alias("id"), "vector", *([F.col(by).cast("bigint").alias(by)] if by else []))
    asked = queries.select(F.col("id").cast("bigint").alias("id"), "vector").where("id is not null")
    found, low = None, None
    while True:
        some = (asked if low is None else asked.where(F.col("id") > low)).orderBy("id").limit(block).toArrow()
        if some.num_rows == 0:
            break
        matrix, good = _units(some.column("vector").combine_chunks())
        held = spark.sparkContext.broadcast((some.column("id").to_numpy()[good], matrix))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            most = max(1, CELLS // max(1, len(ids)))
            best = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]]
            waiting = 0
            # What a query's k-th has so far, for each value of ``by``.
            reached: dict[int, np.ndarray] = {}

            def shrink() -> list[np.ndarray]:
                q, v, s, g = (np.concatenate(x) for x in zip(*best))
                order = np.lexsort((v, -s, g, q))
                q, v, s, g = q[order], v[order], s[order], g[order]
                fresh = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (g[1:] != g[:-1]))) if len(q) else np.zeros(0, np.int64)
                rank = np.arange(len(q)) - np.repeat(fresh, np.diff(np.append(fresh, len(q))))
                for x in np.unique(g[rank == k - 1]):
                    kth = (rank == k - 1) & (g == x)
                    reached[int(x)][q[kth]] = s[kth]
                return [x[rank < k] for x in (q, v, s, g)]

            for batch in batches:
                for at in range(0, batch.num_rows, most):
                    part = batch.slice(at, most)
                    units, own = _units(part.column("vector"))
                    if len(own) == 0 or len(ids) == 0 or units.shape[1] != matrix.shape[1]:
                        continue
                    scores = np.round(matrix @ units.T, DIGITS)
                    names = part.column("id").to_numpy(zero_copy_only=False)[own]
                    group = _numbers(part.column(by))[own] if by else np.zeros(len(own), np.int64)
                    for x in np.unique(group):
                        mine = np.flatnonzero(group == x)
                        low = reached.setdefault(int(x), np.full(len(ids), least))
                        near = scores[:, mine] if by else scores
                        at_least = low if len(mine) <= 2 * k else np.maximum(low, np.partition(near, -k, axis=1)[:, -k])
                        q, r = np.nonzero(near >= at_least[:, None])
                        best.append([q, names[mine[r]], near[q, r], np.full(len(q), x)])
                        waiting += len(q)
                        if waiting > max(WAITING, len(best[0][0])):
                            best, waiting = [shrink()], 0
            q, v, s, g = shrink()
            for i in range(0, len(q), 1 << 16):
                j = slice(i, i + (1 << 16))
                group = pa.array(g[j], mask=g[j] == NONE)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids[q[j]], v[j], s[j])), *([group] if by else [])], ["query_id", "id", "score", *([by] if by else [])])

        own = written(rows.where("id is not null").mapInArrow(work, schema), "nearest")
        held.destroy()
        found = own if found is None else found.unionByName(own)
        if some.num_rows < block:
            break
        low = some.column("id")[-1].as_py()
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("query_id", *kept, "score", "rank")
