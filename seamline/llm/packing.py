"""Hierarchical multi-length packing of documents into token sequences.

Documents are routed to context tiers (2048, 1024, 512, 256 tokens): each full window of a long
document is a sequence of its own, and what is left waits in the smallest tier that holds it. A window
opens with the longest piece of the highest tier that waits; its gap is filled from its own and then
from shorter tiers, the largest piece that fits first, and at last with a piece cut to the gap's size, so
windows are full. Sequences of one size are gathered into step groups of equal token numbers.

Packing is done within each partition: at most POOL_TOKENS ids wait in a worker. What does not fill a
window or a step group at a partition's end is carried on: the leftovers of CARRIED partitions meet in
one task and are packed in the same way, theirs again, until one task is left. Only its last
window is short, and is cut at powers of two; only its last step groups are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .frames import written
from .token_counts import encoder

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Ids that wait for a window in one worker.
POOL_TOKENS = 1 << 20
#: Tokens in a step group.
STEP_TOKENS = 16 * 2048
#: Sequence and step numbers of a partition start at its number times this, those of a round of leftovers at its number times ROUND_ROOM.
ROOM = 1 << 36
ROUND_ROOM = 1 << 58
#: Partitions whose leftovers meet in one task: of each at most a step group for each tier and a window.
CARRIED = 32

FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id")


class Packer:
    """Packs documents; pieces of full step groups gather in ``rows``: key, FIELDS, ids."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, base: int = 0, pool: int = POOL_TOKENS, step: int = STEP_TOKENS):
        self.tiers = sorted(tiers)
        self.most = self.tiers[-1]
        self.next_sequence = self.next_step = base
        self.pool_tokens, self.step_tokens = pool, step
        #: For each tier, the waiting pieces by length: (length, arrival, key, ids, start, document's ids).
        self.waiting: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.held = self.arrivals = 0
        #: For each size, the sequences of its unfinished step group.
        self.open: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        """A document, or with ``start`` a piece of one of ``total`` ids."""
        n = len(ids)
        total = n if total is None else total
        whole = n - n % self.most
        for at in range(0, whole, self.most):
            self._emit([(key, ids[at : at + self.most], start + at, total)], self.most)
        if whole < n:
            self._wait(key, ids[whole:], start + whole, total)
        if self.held > self.pool_tokens:
            while self.held > self.pool_tokens // 2:
                self._window()

    def leave(self) -> list[tuple]:
        """Packs what fills windows; pieces of unfinished step groups and windows: key, ids, start, document's ids."""
        left = []
        while any(self.waiting.values()):
            left += self._window()
        for sequences in self.open.values():
            left += [piece for sequence in sequences for piece in sequence]
        self.open = {}
        return left

    def finish(self) -> None:
        """Packs everything."""
        while any(self.waiting.values()):
            left = self._window()
            filled = sum(len(ids) for _, ids, _, _ in left)
            while filled:
                size = 1 << (filled.bit_length() - 1)
                now, gap = [], size
                while gap:
                    key, ids, start, total = left.pop(0)
                    if len(ids) > gap:
                        left.insert(0, (key, ids[gap:], start + gap, total))
                        ids = ids[:gap]
                    now.append((key, ids, start, total))
                    gap -= len(ids)
                self._emit(now, size)
                filled -= size
        for size in list(self.open):
            self._close(size)

    def _wait(self, key, ids, start, total) -> None:
        self.arrivals += 1
        tier = self.tiers[bisect_left(self.tiers, len(ids))]
        insort(self.waiting[tier], (len(ids), self.arrivals, key, ids, start, total), key=lambda x: x[:2])
        self.held += len(ids)

    def _take(self, tier: int, at: int) -> tuple:
        length, _, key, ids, start, total = self.waiting[tier].pop(at)
        self.held -= length
        return key, ids, start, total

    def _fitting(self, size: int, gap: int) -> tuple | None:
        """The largest waiting piece of the window's tier or a shorter one that fits the gap."""
        for tier in reversed(self.tiers[: self.tiers.index(size) + 1]):
            if at := bisect_right(self.waiting[tier], gap, key=lambda x: x[0]):
                return self._take(tier, at - 1)
        return None

    def _window(self) -> list[tuple]:
        """Fills one window, from the longest waiting piece on; its pieces where nothing is left to fill it."""
        size = next(t for t in reversed(self.tiers) if self.waiting[t])
        inside = [self._take(size, -1)]
        filled = len(inside[0][1])
        while filled < size:
            gap = size - filled
            piece = self._fitting(size, gap)
            if piece is None:
                # All that waits is longer than the gap: the shortest one is cut.
                tier = next((t for t in self.tiers if self.waiting[t]), None)
                if tier is None:
                    return inside
                key, ids, start, total = self._take(tier, 0)
                piece = (key, ids[:gap], start, total)
                self._wait(key, ids[gap:], start + gap, total)
            inside.append(piece)
            filled += len(piece[1])
        self._emit(inside, size)
        return []

    def _emit(self, inside: list[tuple], size: int) -> None:
        group = self.open.setdefault(size, [])
        group.append(inside)
        if (len(group) + 1) * size > self.step_tokens:
            self._close(size)

    def _close(self, size: int) -> None:
        for inside in self.open.pop(size):
            offset = 0
            for key, ids, start, total in inside:
                self.rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_sequence, offset, size, self.next_step, ids.tobytes()))
                offset += len(ids)
            self.next_sequence += 1
        self.next_step += 1


_NAMES = [f"c{i}" for i in range(9)] + ["ids", "part"]


def _batch(rows: list[tuple], kind: pa.DataType, part: int | None, ids: bool) -> pa.RecordBatch:
    """Rows of a packer, or with ``part`` its leftovers."""
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:9]), pa.array(columns[9] if ids else [None] * len(rows), pa.binary()), pa.array([part] * len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _left(pieces: list[tuple]) -> list[tuple]:
    return [(key, start, len(ids), None, total, i, None, None, None, ids.tobytes()) for i, (key, ids, start, total) in enumerate(pieces)]


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False, step: int = STEP_TOKENS, carried: int = CARRIED) -> DataFrame:
    """One row for each piece: key and FIELDS (with_ids: and its ids).

    A null text is empty: its document is the end id alone. A null key stays null; repeated rows
    are packed as documents of their own; very long texts are cut into windows; an empty table gives no
    rows; columns besides key and text are not read. Every id of every document lies in exactly one piece.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"c0 {kind}", *(f"c{i} bigint" for i in range(1, 9)), "ids binary", "part bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        part = TaskContext.get().partitionId()
        packer = Packer(tiers, part * ROOM, step=step)
        names = None
        end = np.array([end_id], "<u4")
        for block in blocks.blocks(batches, "text"):
            names = block.column("key").type
            ids, bounds = own.encode(blocks.raw(block.column("text")))
            ids = ids.astype("<u4", copy=False)
            for name, a, b in zip(block.column("key").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                packer.add(name, np.concatenate([ids[a:b], end]))
            if packer.rows:
                yield _batch(packer.rows, names, None, with_ids)
                packer.rows = []
        left = _left(packer.leave())
        if packer.rows:
            yield _batch(packer.rows, names, None, with_ids)
        if left:
            yield _batch(left, names, part, True)

    def carrier(number: int, final: bool):
        def carry(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("part", "ascending"), ("c5", "ascending")])
            group = rows.column("part")[0].as_py() // carried
            packer = Packer(tiers, number * ROUND_ROOM + group * ROOM, step=step)
            for name, start, total, ids in zip(*(rows.column(c).to_pylist() for c in ("c0", "c1", "c4", "ids"))):
                packer.add(name, np.frombuffer(ids, "<u4"), start, total)
            left = [] if final else _left(packer.leave())
            if final:
                packer.finish()
            names = rows.schema.field("c0").type
            parts = [_batch(r, names, p, i) for r, p, i in ((packer.rows, None, with_ids), (left, group, True)) if r]
            return pa.Table.from_batches(parts, rows.select(_NAMES).schema)

        return carry

    packed = written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, schema), "packed")
    found = packed.where("part is null")
    number = 0
    while (last := packed.agg(F.max("part")).first()[0]) is not None:
        number += 1
        waiting = packed.where("part is not null").groupBy(F.expr(f"part div {carried}"))
        packed = written(waiting.applyInArrow(carrier(number, last < carried), schema), "packed")
        found = found.unionByName(packed.where("part is null"))
    found = found.drop("part")
    if not with_ids:
        return found.drop("ids").toDF(key, *FIELDS)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES[:9]), pa.array(ids, pa.list_(pa.int64()))], _NAMES[:10])

    return found.mapInArrow(numbers, schema.replace("ids binary, part bigint", "ids array<bigint>")).toDF(key, *FIELDS, "ids")
