"""Product codes by the filtering form of Lloyd's algorithm, over integers.

Vectors are cut into parts; each part position has a codebook of its own. Once, each partition builds
a kd-tree over each part of each of its blocks: the points in the order of the leaves are written, and
boxes, sums and counts of all nodes follow from them in one pass from the leaves up. In each round
candidate entries go down a tree: a node's candidate nearest to the middle of its box drives out all
that no point of the box can be nearer to, and where one is left, the whole subtree is its own by the
node's sum and count. Only sums and counts by entry leave a partition; the codebooks that go back to
it are as large as the parameters say, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import dropped, written
from .topk import integers

SCALE = 1024.0
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors whose trees are built together, and points in a leaf.
BLOCK = 4096
LEAF = 16


class Tree(NamedTuple):
    """A kd-tree over points: level by level, from the root, nodes' boxes, sums and counts; the leaves' points."""

    points: np.ndarray  # leaves x LEAF x width
    weights: np.ndarray  # leaves x LEAF: 0 for those that only fill up
    lows: list[np.ndarray]
    highs: list[np.ndarray]
    sums: list[np.ndarray]
    counts: list[np.ndarray]


def leaf_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Which point stands where, leaf by leaf; halves are parted along the widest side of each node's box. -1 fills up."""
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    order = np.arange(leaf << depth)
    own = order < n
    order[~own] = 0
    for level in range(depth):
        nodes = order.reshape(1 << level, -1)
        inside = points[nodes]
        widest = np.ptp(inside, axis=1).argmax(axis=1)
        by = np.argsort(np.take_along_axis(inside, widest[:, None, None], 2)[:, :, 0], axis=1, kind="stable")
        order = np.take_along_axis(nodes, by, 1).ravel()
        own = np.take_along_axis(own.reshape(1 << level, -1), by, 1).ravel()
    return np.where(own, order, -1)


def grown(points: np.ndarray, order: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over points in their leaves' order; what fills up repeats the first point and weighs nothing."""
    own = order >= 0
    inside = points[np.where(own, order, 0)].reshape(-1, leaf, points.shape[1])
    weights = own.reshape(-1, leaf)
    lows, highs = [inside.min(axis=1)], [inside.max(axis=1)]
    sums, counts = [(inside * weights[:, :, None]).sum(axis=1)], [weights.sum(axis=1)]
    while len(lows[0]) > 1:
        pair = lambda x: x.reshape(len(x) // 2, 2, *x.shape[1:])
        lows.insert(0, pair(lows[0]).min(axis=1))
        highs.insert(0, pair(highs[0]).max(axis=1))
        sums.insert(0, pair(sums[0]).sum(axis=1))
        counts.insert(0, pair(counts[0]).sum(axis=1))
    return Tree(inside, weights, lows, highs, sums, counts)


def _survivors(low: np.ndarray, high: np.ndarray, alive: np.ndarray, book: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Of the candidates of each box those that may be the nearest entry (of equally near ones the first) of a point in it.

    With z the candidate nearest to the middle, an entry y goes if |x - y|² - |x - z|², which is linear in x, is
    above 0 at the corner of the box where it is least, or is 0 there and y comes behind z.
    """
    middle = squares[None] - (low + high) @ book.T
    z = np.where(alive, middle, np.inf).argmin(axis=1)
    left = np.empty_like(alive)
    numbers = np.arange(len(book))
    for k in np.unique(z):
        at = z == k
        away = book - book[k]
        least = squares - squares[k] - 2 * (high[at] @ np.maximum(away, 0).T + low[at] @ np.minimum(away, 0).T)
        left[at] = (least < 0) | ((least == 0) & (numbers <= k))
    return left & alive


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the points nearest to each entry, and each point's entry, leaf by leaf."""
    squares = (book * book).sum(axis=1)
    sums, counts = np.zeros(book.shape), np.zeros(len(book), np.int64)
    leaves, leaf = tree.weights.shape
    codes = np.empty((leaves, leaf), np.int64)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    for level in range(len(tree.lows)):
        alive = _survivors(tree.lows[level][nodes], tree.highs[level][nodes], alive, book, squares)
        alone = alive.sum(axis=1) == 1
        taken, entry = nodes[alone], alive[alone].argmax(axis=1)
        np.add.at(sums, entry, tree.sums[level][taken])
        np.add.at(counts, entry, tree.counts[level][taken])
        below = len(tree.lows) - 1 - level
        codes.reshape(1 << level, -1)[taken] = entry[:, None]
        nodes, alive = nodes[~alone], alive[~alone]
        if below:
            nodes, alive = (nodes[:, None] * 2 + [0, 1]).ravel(), np.repeat(alive, 2, axis=0)
    for node, mask in zip(nodes, alive):
        some = np.flatnonzero(mask)
        points = tree.points[node]
        own = some[(squares[some] - 2 * (points @ book[some].T)).argmin(axis=1)]
        codes[node] = own
        np.add.at(sums, own, points * tree.weights[node][:, None])
        np.add.at(counts, own, tree.weights[node])
    return sums, counts, codes


def _trees(row: pa.RecordBatch, width: int, parts: int, leaf: int) -> Iterator[tuple[int, Tree, np.ndarray]]:
    """Part position, tree and the order of its leaves, of each part of a written block, which is one row."""
    values, orders = (np.frombuffer(row.column(c)[0].as_buffer(), np.int32) for c in ("points", "orders"))
    values, orders = values.astype(np.float64).reshape(-1, width), orders.reshape(parts, -1)
    step = width // parts
    for p in range(parts):
        yield p, grown(values[:, p * step : (p + 1) * step], orders[p], leaf), orders[p]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, list[np.ndarray]]:
    """<key>, label, codes (list of int, by part), error (squared distances to the entries, summed over the parts) of each row; and the final codebooks.

    Components become floor(scale * x). A codebook starts as that part of the ``entries`` smallest keys (equal
    ones by their vectors, null ones last); in each round it becomes the floored means of the parts nearest to
    its entries, ties to the lower index; entries without parts stay. Then all parts are assigned once more.

    Rows with a null vector or a null or non-finite component are dropped; repeated keys and rows are rows of
    their own. Vectors of different lengths, or of lengths that don't divide into the parts, count as filled up with zeros.
    With fewer rows than entries a codebook has as many as there are rows; an empty table gives no rows and
    empty codebooks. Where distances could exceed 2^53 (16 components of 11 million and more, scaled) it raises, as
    they aren't exact in doubles. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null")
    rows = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    longest, far = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()
    width = -(-max(longest or 0, 1) // parts) * parts
    step, far = width // parts, (far or 0.0) * scale + 1
    if step * (2 * far) ** 2 > 2**53:
        raise ValueError(f"distances over {step} components of up to {far:.0f} aren't exact in doubles")
    kind = vectors.schema[label].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                values, _ = integers(part.column("vector"), scale, width)
                orders = np.stack([leaf_order(values[:, p * step : (p + 1) * step], leaf) for p in range(parts)])
                ids, labels = (pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([values.astype(np.int32).tobytes()]), pa.array([orders.astype(np.int32).tobytes()])], ["ids", "labels", "points", "orders"])

    trees = written(rows.mapInArrow(build, f"ids array<bigint>, labels array<{kind}>, points binary, orders binary"), "trees")
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.transform("vector", lambda x: F.floor(x * scale))).limit(entries).toArrow()
    start = integers(first.column("vector").combine_chunks(), scale, width)[0] if first.num_rows else np.zeros((0, width))
    books = [start[:, p * step : (p + 1) * step] for p in range(parts)]

    for _ in range(rounds if len(start) else 0):
        held = spark.sparkContext.broadcast(books)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            books = held.value
            sums, counts = np.zeros((parts, len(books[0]), step), np.int64), np.zeros((parts, len(books[0])), np.int64)
            for batch in batches:
                for at in range(batch.num_rows):
                    for p, tree, _ in _trees(batch.slice(at, 1), width, parts, leaf):
                        s, n, _ = assigned(tree, books[p])
                        sums[p] += s.astype(np.int64)
                        counts[p] += n
            p, e = np.nonzero(counts)
            if len(p):
                total = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * step + 1, step), pa.int32()), pa.array(sums[p, e].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), total], ["part", "entry", "n", "total"])

        seen = trees.mapInArrow(count, "part int, entry int, n bigint, total array<bigint>")
        means = seen.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(step))).toArrow()
        held.destroy()
        p, e, n = (means.column(c).to_numpy() for c in ("part", "entry", "n"))
        totals = np.stack([means.column(f"t{i}").to_numpy() for i in range(step)], axis=1)
        books = [b.copy() for b in books]
        for q in range(parts):
            books[q][e[p == q]] = totals[p == q] // n[p == q][:, None]

    held = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                size = len(row.column("ids")[0])
                codes, error = np.zeros((size, parts), np.int32), np.zeros(size, np.int64)
                for p, tree, order in _trees(row, width, parts, leaf):
                    own = order >= 0
                    entry = assigned(tree, books[p])[2].ravel()[own]
                    away = tree.points.reshape(len(order), step)[own] - books[p][entry]
                    codes[order[own], p] = entry
                    error[order[own]] += (away * away).sum(axis=1).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * parts + 1, parts), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), lists, pa.array(error)], ["id", "label", "codes", "error"])

    found = written(trees.mapInArrow(encode, f"id bigint, label {kind}, codes array<int>, error bigint"), "codes")
    dropped(trees)
    return found.select(F.col("id").cast(vectors.schema[key].dataType).alias(key), "label", "codes", "error"), books


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal integers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def coded(found: DataFrame, books: list[np.ndarray], key: str = "vec_id") -> DataFrame:
    """<key>, code (two hex digits a part), error, label_error (error summed over equal labels, nulls together), codebooks_sha256.

    Sums by label are made in each partition first; only they are joined back.
    """
    by = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    met = found.alias("f").join(by.alias("b"), F.expr("f.label <=> b.label"))
    return met.select(F.col(f"f.{key}"), code.alias("code"), "f.error", "b.label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
