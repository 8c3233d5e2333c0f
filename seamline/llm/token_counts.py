"""Token counts and token ids by a public tokenizer, computed once per distinct word.

A text is split at safe boundaries: ASCII white space (blank, \\t..\\r). The vocabulary's
normaliser maps white space to one blank, its pre-tokenizer drops blanks, no added
token holds or strips white space, and no canonical composition crosses a blank. So
the ids of a text are the ids of its white-space separated pieces, one after another,
and a piece can be encoded once and used wherever it occurs. Very long texts split the
same way. As this vocabulary ignores case and its pre-tokenizer parts letters from other
signs, pieces are cut between ASCII letters and plain punctuation too. Distinct pieces are
encoded in batches balanced by bytes. ``safe_to_split`` checks these properties of a
tokenizer file; for one that lacks them whole texts are encoded in such batches.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Distinct pieces that a worker remembers; beyond that it starts anew (a cache, not a cap).
CACHE_WORDS = 800_000
#: Characters that are encoded at a time.
BATCH_BYTES = 1 << 18
#: How added tokens begin; texts are cut at white space only where this occurs.
MARK = "<|"


def safe_to_split(path: str) -> bool:
    """Whether white space always separates tokens and never changes their neighbours."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = all(a["content"].startswith(MARK) and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or any(c.isspace() for c in a["content"])) for a in spec["added_tokens"])
    norm = spec["normalizer"] or {}
    steps = [s["type"] for s in norm.get("normalizers", [norm] if norm else [])]
    pre = spec["pre_tokenizer"] or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "")
    byte = next((p for p in pre.get("pretokenizers", []) if p["type"] == "ByteLevel"), {"add_prefix_space": False})
    plain = "Lowercase" in steps and spec["model"].get("dropout") is None and not spec["post_processor"]
    return added and set(steps) <= {"NFC", "Replace", "Lowercase"} and bool(drops) and not byte["add_prefix_space"] and plain


class Encoder:
    """Ids of pieces, kept in one flat array; a worker holds one per tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = safe_to_split(path)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        found = list(chain.from_iterable(self._batches(map(bytes.decode, words))))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])

    def _pieces(self, text: blocks.Raw) -> blocks.Words:
        """Added tokens are found in texts as they are, so nothing is cut or changed where one may start."""
        return blocks.coded(text, blocks.SPACED_CASED) if MARK.encode() in text.data else blocks.pieces(text)

    def rows(self, vocab: pa.Array) -> np.ndarray:
        """The row of each word in ``starts``."""
        words = blocks.listed(vocab)
        if len(self.known) > CACHE_WORDS:
            self._reset()
        rows = np.array([self.known.get(w, -1) for w in words], np.int64)
        if len(new := np.flatnonzero(rows < 0)):
            rows[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([words[i] for i in new])
        return rows

    def _batches(self, texts: Iterable[str]) -> Iterator[list[list[int]]]:
        """Ids of texts, encoded in batches of about BATCH_BYTES."""
        parts, size = [], 0
        for text in texts:
            parts.append(text)
            size += len(text)
            if size >= BATCH_BYTES:
                yield [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
                parts, size = [], 0
        if parts:
            yield [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _whole(self, text: blocks.Raw) -> Iterator[np.ndarray]:
        texts = (text.data[a:b].decode("utf-8") for a, b in zip(text.bounds[:-1], text.bounds[1:]))
        return (np.array(ids, np.uint32) for part in self._batches(texts) for ids in part)

    def lengths(self, text: blocks.Raw) -> np.ndarray:
        """Tokens of each text."""
        if not self.split:
            return np.array([len(x) for x in self._whole(text)], np.int64)
        words = self._pieces(text)
        rows = self.rows(words.vocab)
        each = (self.starts[rows + 1] - self.starts[rows])[words.codes]
        total = np.concatenate([[0], np.cumsum(each)])
        return total[words.bounds[1:]] - total[words.bounds[:-1]]

    def encode(self, text: blocks.Raw) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and each text's bounds in them."""
        if not self.split:
            each = list(self._whole(text))
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        words = self._pieces(text)
        rows = self.rows(words.vocab)
        lengths = self.starts[rows + 1] - self.starts[rows]
        each = lengths[words.codes]
        ends = np.cumsum(each)
        total = np.concatenate([[0], ends])
        at = np.repeat(self.starts[rows][words.codes] - (ends - each), each) + np.arange(total[-1])
        return self.ids[at], total[words.bounds]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit: one row for each row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); a null key stays null; repeated rows give
    repeated rows; an empty table gives none; columns besides key and text are not read, so their
    names can't clash. Every text is counted whole, of whatever length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for block in blocks.blocks(batches, "text"):
            data = blocks.raw(block.column("text"))
            n = own.lengths(data)
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(np.diff(data.bounds)), pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return found.withColumnRenamed("key", key)
