"""Vectorised word splitting over Arrow text columns.

Text arrives in Arrow batches; each is cut into blocks of a few megabytes, so a
Python worker's memory is bounded by the block (or by the longest single text).
Splitting works on the UTF-8 bytes of a whole block at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_libc = ctypes.CDLL(None)
#: Bytes of text handled at once.
BLOCK_BYTES = 6 << 20


def _table(separators: set[int]) -> bytes:
    """A 256-entry translation: A-Z to lower case, separators to one blank."""
    return bytes(32 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Words are runs of anything but blank and \t..\r.
SPACED = _table({0x20, *range(0x09, 0x0E)})
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: As SPACED, but letters keep their case.
SPACED_CASED = bytes(32 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


class Raw(NamedTuple):
    """The UTF-8 bytes of a text column; text i is data[bounds[i]:bounds[i + 1]]."""

    data: bytes
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of a block: codes[k] indexes vocab; text i has codes[bounds[i]:bounds[i + 1]]."""

    codes: np.ndarray
    vocab: pa.Array
    bounds: np.ndarray


def raw(column: pa.Array) -> Raw:
    """Bytes and bounds of a string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return Raw(b"", np.zeros(1, np.int64))
    data = column.buffers()[2]
    # A slice's buffer is that of the whole batch; only its own bytes are copied.
    data = b"" if data is None else data.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes()
    return Raw(data, bounds - bounds[0])


def _trim() -> None:
    """Gives memory that is free back to the system, as workers stay and others need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes in ``column`` (a longer text stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto
    _trim()


#: Punctuation between which and an ASCII letter a word may be cut (see pieces()).
_MARKS = np.zeros(256, np.uint8)
_MARKS[[*b".,!#$%&*;:?()"]] = 1
_MARKS[[*range(65, 91), *range(97, 123)]] = 2


def pieces(text: Raw) -> Words:
    """Words cut further between ASCII letters and plain punctuation, A-Z in lower case.

    A letter before a non-ASCII byte keeps its case, as a combining mark may follow. Only for
    tokenizers that ignore case and part letters from punctuation (see token_counts).
    """
    cased = np.frombuffer(text.data, np.uint8)
    kinds = _MARKS[cased]
    data = np.frombuffer(text.data.translate(SPACED), np.uint8)
    if text.data.isascii():
        pass
    elif len(data) > 1:
        odd = np.flatnonzero((cased[1:] >= 128) & (cased[:-1] >= 65) & (cased[:-1] <= 90))
        if len(odd):
            data = data.copy()
            data[odd] = cased[odd]
    inside = data != 32
    first = inside.copy()
    if len(data):
        opens = np.empty(len(data), bool)
        opens[0] = True
        opens[1:] = ~inside[:-1] | ((kinds[1:] ^ kinds[:-1]) == 3)
        starts = text.bounds[:-1]
        opens[starts[starts < len(data)]] = True
        first &= opens
    starts = np.flatnonzero(first)
    words = _words(data, inside, starts)
    bounds = np.searchsorted(starts, text.bounds)
    if len(words) == 0:
        return Words(np.zeros(0, np.int32), pa.array([], pa.binary()), bounds)
    encoded = words.dictionary_encode()
    return Words(encoded.indices.to_numpy(), encoded.dictionary, bounds)


def spans(text: Raw, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The translated bytes, which of them are in words, where words start, and each text's first word."""
    data = np.frombuffer(text.data.translate(table), np.uint8)
    inside = data != 32
    first = inside.copy()
    if len(data):
        opens = np.empty(len(data), bool)
        opens[0] = True
        np.logical_not(inside[:-1], out=opens[1:])
        starts = text.bounds[:-1]
        opens[starts[starts < len(data)]] = True
        first &= opens
    starts = np.flatnonzero(first)
    return data, inside, starts, np.searchsorted(starts, text.bounds)


def split(text: Raw, table: bytes) -> pa.Array:
    """All words in order, as one binary array."""
    data, inside, starts, _ = spans(text, table)
    return _words(data, inside, starts)


def _words(data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> pa.Array:
    packed = data[inside]
    # Offsets among the kept bytes: kept bytes before each start.
    gaps = np.flatnonzero(~inside)
    offsets = np.empty(len(starts) + 1, np.int32)
    offsets[:-1] = starts - np.searchsorted(gaps, starts)
    offsets[-1] = len(packed)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])


def listed(vocab: pa.Array) -> list[bytes]:
    """The words of a vocabulary as bytes; none holds a blank, so joining and splitting is quickest."""
    if len(vocab) == 0:
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(vocab)], pa.int32()), vocab), b" ")[0].as_py().split(b" ")


def coded(text: Raw, table: bytes) -> Words:
    """Words of a block as codes into its distinct words (in order of first use)."""
    data, inside, starts, bounds = spans(text, table)
    words = _words(data, inside, starts)
    if len(words) == 0:
        return Words(np.zeros(0, np.int32), pa.array([], pa.binary()), bounds)
    encoded = words.dictionary_encode()
    return Words(encoded.indices.to_numpy(), encoded.dictionary, bounds)


def normal(text: Raw, table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with one blank after each word: bytes, word starts, word ends, each text's first word."""
    data, inside, starts, bounds = spans(text, table)
    ends = np.empty(len(data), bool)
    if len(data):
        ends[:-1] = inside[:-1] & ~inside[1:]
        ends[-1] = inside[-1]
        last = text.bounds[1:] - 1
        last = last[(last >= 0) & (np.diff(text.bounds) > 0)]
        ends[last] |= inside[last]
    stops = np.flatnonzero(ends) + 1
    lengths = stops - starts
    out_starts = np.zeros(len(starts), np.int64)
    if len(starts):
        np.cumsum(lengths[:-1] + 1, out=out_starts[1:])
    out = np.full(int(lengths.sum() + len(lengths)), 32, np.uint8)
    if len(starts):
        keep = np.ones(len(out), bool)
        keep[out_starts + lengths] = False
        out[keep] = data[inside]
    return out.tobytes(), out_starts, out_starts + lengths, bounds
