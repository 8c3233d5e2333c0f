"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns documents into index segments: one row holds a few megabytes of text
as its distinct terms, each with the ascending list of its positions (delta coded), and the
documents' bounds among these positions. A document lies wholly in one segment, so matching
needs no shuffle. The index is stored in the shared folder once; test sets are asked in
blocks of a bounded size, each broadcast, against every segment: for each window of a test
item the position lists of its terms, shifted by their offset in the window, are intersected
from the rarest term of the segment on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .frames import written

WINDOW = 10
#: Further words among which a window's words may stand to be near.
SLOP = 5
#: A block of test items has at most so many bytes of text; only such a block is broadcast.
TEST_BYTES = 4 << 20

INDEX_SCHEMA = "segment bigint, keys array<{key}>, bounds binary, terms binary, starts binary, gaps binary"


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values with their first bytes together, then their second ones: compresses well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Index segments of all rows of ``docs``; a null text has no words."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in blocks.blocks(batches, "text"):
            words = blocks.coded(blocks.raw(block.column("text")), blocks.ALNUM)
            at = np.sort((words.codes.astype(np.uint64) << np.uint64(32)) | np.arange(len(words.codes), dtype=np.uint64))
            places = (at & np.uint64(0xFFFFFFFF)).astype(np.int64)
            starts = np.searchsorted(at, np.arange(len(words.vocab) + 1, dtype=np.uint64) << np.uint64(32))
            gaps = np.diff(places, prepend=0)
            gaps[starts[:-1]] = places[starts[:-1]]
            keys = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column("key"))
            cells = [b" ".join(blocks.listed(words.vocab)), _planes(np.diff(starts)), _planes(gaps)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), keys, pa.array([words.bounds.astype("<i8").tobytes()], pa.binary()), *(pa.array([c], pa.binary()) for c in cells)], ["segment", "keys", "bounds", "terms", "starts", "gaps"])
            number += 1

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, INDEX_SCHEMA.format(key=kind))


class Segment:
    """One row of the index; positions() gives a term's ascending list."""

    def __init__(self, row: dict):
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.terms = pa.array(row["terms"].split(b" ") if row["terms"] else [], pa.binary())
        self.starts = np.concatenate([[0], np.cumsum(_unplanes(row["starts"]).astype(np.int64))])
        self.gaps = _unplanes(row["gaps"])
        self._lists: dict[int, np.ndarray] = {}

    def find(self, terms: pa.Array) -> np.ndarray:
        """The segment's number for each term, -1 where it has none."""
        if len(terms) == 0 or len(self.terms) == 0:
            return np.full(len(terms), -1, np.int64)
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        return self.starts[numbers + 1] - self.starts[numbers]

    def positions(self, number: int) -> np.ndarray:
        if number not in self._lists:
            self._lists[number] = np.cumsum(self.gaps[self.starts[number] : self.starts[number + 1]], dtype=np.int64)
        return self._lists[number]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand one after another within one document: offset-adjusted lists, rarest first."""
        order = np.argsort(self.counts(terms), kind="stable")
        found = self.positions(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            own = self.positions(terms[k])
            at = np.searchsorted(own, found + k)
            at[at == len(own)] = 0
            found = found[own[at] == found + k]
        doc = np.searchsorted(self.bounds, found, "right") - 1
        return found[(found >= 0) & (found + len(terms) <= self.bounds[doc + 1])]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Starts of the shortest spans of at most len(terms) + slop words in one document that hold all terms, in any order."""
        terms, needed = np.unique(terms, return_counts=True)
        order = np.argsort(self.counts(terms), kind="stable")
        terms, needed = terms[order], needed[order]
        lists = [self.positions(t) for t in terms]
        width = int(needed.sum()) + slop
        # Places of the rarest term around which all others occur, rarest first.
        anchors = lists[0]
        for p in lists[1:]:
            if not len(anchors):
                return anchors
            anchors = anchors[np.searchsorted(p, anchors + width) > np.searchsorted(p, anchors - width, "right")]
        near = []
        for p in lists:
            a, b = np.searchsorted(p, anchors - width, "right"), np.searchsorted(p, anchors, "right")
            n = np.maximum(b - a, 0)
            near.append(p[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        starts = np.unique(np.concatenate(near))
        doc = np.searchsorted(self.bounds, starts, "right") - 1
        ends = np.minimum(starts + width, self.bounds[doc + 1])
        good = np.ones(len(starts), bool)
        for p, n in zip(lists, needed):
            good &= np.searchsorted(p, ends) - np.searchsorted(p, starts) >= n
        return starts[good]


class Tests:
    """A bounded block of test items: their windows as rows of numbers into ``terms``."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        rank = {name: i for i, name in enumerate(self.names)}
        words = blocks.coded(blocks.raw(pa.array([t for _, t in items], pa.string())), blocks.ALNUM)
        self.terms = words.vocab.cast(pa.binary())
        seen: dict[bytes, list] = {}
        for (name, _), a, b in zip(items, words.bounds[:-1], words.bounds[1:]):
            size = min(window, b - a)
            for at in range(a, b - size + 1) if size else ():
                own = words.codes[at : at + size]
                seen.setdefault(own.tobytes(), [own, set()])[1].add(rank[name])
        self.windows = [own for own, _ in seen.values()]
        self.items = [sorted(names) for _, names in seen.values()]
        #: One row a window, filled up with its first term.
        self.grid = np.array([np.concatenate([w, np.repeat(w[:1], window - len(w))]) for w in self.windows], np.int64).reshape(len(self.windows), window)


def _match(segment: Segment, tests: Tests, slop: int | None) -> Iterator[tuple[int, np.ndarray, int]]:
    """Windows that occur in the segment: number, positions, length."""
    numbers = segment.find(tests.terms)
    if len(tests.windows):
        for w in np.flatnonzero((numbers[tests.grid] >= 0).all(axis=1)):
            terms = numbers[tests.windows[w]]
            found = segment.phrase(terms) if slop is None else segment.near(terms, slop)
            if len(found):
                yield int(w), found, len(terms)


def _blocks_of(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The test items in blocks of about ``most`` bytes (a longer item stands alone in its hash bucket)."""
    tests = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // most + 1
    for k in range(buckets):
        yield [(r.item, r.text) for r in tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(buckets)) == k).collect()]


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, item: str = "item_id", text: str = "text", most: int = TEST_BYTES) -> DataFrame:
    """key, segment, document (its number in the segment), item_id, start, length: where windows of the test items occur.

    slop None: exact phrases; else spans of at most the window and slop words that hold its words in any order.
    """
    kind = index.schema["keys"].dataType.elementType.simpleString()
    found, passes = None, 0
    for items in _blocks_of(benchmark, item, text, most):
        tests = index.sparkSession.sparkContext.broadcast(Tests(items, window))

        def work(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    segment, out = Segment(row), []
                    for w, at, n in _match(segment, tests.value, slop):
                        doc = np.searchsorted(segment.bounds, at, "right") - 1
                        for d, p in zip(doc.tolist(), (at - segment.bounds[doc]).tolist()):
                            out += [(row["keys"][d], row["segment"], d, tests.value.names[i], p, n) for i in tests.value.items[w]]
                    if out:
                        columns = list(zip(*out))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("keys").type.value_type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())))], ["key", "segment", "document", "item_id", "start", "length"])

        own = index.mapInArrow(work, f"key {kind}, segment bigint, document bigint, item_id string, start bigint, length bigint")
        found, passes = (own if found is None else found.unionByName(own)), passes + 1
    # Rows with one id are one item, and may lie in several blocks.
    return found if passes == 1 else found.distinct()


def _judge(index: DataFrame, tests, kind: str, slop: int | None) -> DataFrame:
    """For every document: its words, a bit for each word that is hit, the items that occur, and those near enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                bounds = segment.bounds
                change = np.zeros(int(bounds[-1]) + 1, np.int64)
                pairs, loose = [], []
                for w, at, n in _match(segment, tests.value, None):
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n, -1)
                    doc = np.unique(np.searchsorted(bounds, at, "right") - 1)
                    pairs += [(d, i) for d in doc.tolist() for i in tests.value.items[w]]
                for w, at, _ in () if slop is None else _match(segment, tests.value, slop):
                    doc = np.unique(np.searchsorted(bounds, at, "right") - 1)
                    loose += [(d, i) for d in doc.tolist() for i in tests.value.items[w]]
                hit = np.cumsum(change[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                items: list[list[str]] = [[] for _ in row["keys"]]
                near: list[list[str]] = [[] for _ in row["keys"]]
                for into, found in ((items, pairs), (near, loose)):
                    for d, i in sorted(set(found)):
                        into[d].append(tests.value.names[i])
                n_hit = total[bounds[1:]] - total[bounds[:-1]]
                bits = [np.packbits(hit[a:b]).tobytes() if n else b"" for n, a, b in zip(n_hit, bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["keys"], batch.schema.field("keys").type.value_type), pa.array([row["segment"]] * len(items), pa.int64()), pa.array(range(len(items)), pa.int64()),
                    pa.array(np.diff(bounds)), pa.array(n_hit), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string())),
                ], ["key", "segment", "document", "n_words", "n_hit", "bits", "items", "near"])

    return index.mapInArrow(work, f"key {kind}, segment bigint, document bigint, n_words bigint, n_hit bigint, bits binary, items array<string>, near array<string>")


def _union_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = []
        for parts in batch.column("parts").to_pylist():
            parts = [np.frombuffer(p, np.uint8) for p in parts if p]
            hit.append(int(np.bitwise_count(np.bitwise_or.reduce(parts)).sum()) if parts else 0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n_words", "items", "near")), pa.array(hit, pa.int64())], ["key", "n_words", "items", "near", "n_hit"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = TEST_BYTES, slop: int | None = SLOP) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items: one row for each row of ``docs``.

    n_near counts the items of which a window's words stand, in any order, within the window and ``slop`` words (0 with slop None).

    A null text has no words; a null key stays null; repeated rows are judged alike; empty
    ``docs`` give no rows. Test items with a null text have no words, those with a null id are
    left out, and rows with one id are one item; very long texts are segments of their own and taken
    whole. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    index = written(build_index(docs, key, text), "postings")
    found, passes = None, 0
    for items in _blocks_of(benchmark, item, item_text, most):
        own = _judge(index, docs.sparkSession.sparkContext.broadcast(Tests(items, window)), kind, slop)
        found, passes = (own if found is None else found.unionByName(own)), passes + 1
    if passes > 1:
        # At most one row for each document and block of tests meets here.
        found = found.groupBy("segment", "document").agg(F.max("key").alias("key"), F.max("n_words").alias("n_words"), *(F.array_distinct(F.flatten(F.collect_list(x))).alias(x) for x in ("items", "near")), F.collect_list("bits").alias("parts"))
        found = found.select("key", "n_words", "items", "near", "parts").mapInArrow(_union_bits, f"key {kind}, n_words bigint, items array<string>, near array<string>, n_hit bigint")
    items = F.array_sort("items")
    return found.select(F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("bigint").alias("n_near"), items.alias("items"))
