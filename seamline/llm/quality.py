"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A pair says that a document labelled 1 is preferred to one labelled 0; the score is a linear
function of text features, fitted by logistic loss on feature differences. The threshold is
the quantile of the training scores that parts the labels best, and scores are mapped to
0..1 so that this quantile lies at CUT.

The fit uses a bounded, documented sample of labelled rows (SAMPLE for each label, those with
the smallest hash of their key); scoring covers every whole text. Features come from the text
alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Labelled rows of each label that are learned from, at most.
SAMPLE = 8192
PAIRS = 100_000
#: Scores from here on are label 1.
CUT = 0.3
FOLDS = 5
SEED = 20240229

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#$%&*", b"@^~_=+<>\\/`", b"\"'()[]{}", b":;-", bytes(range(128, 256)))
_CLASS = np.zeros(256, np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[[*_c]] = _i + 1
_N = len(_CLASSES) + 1


def _shares(total: np.ndarray, of: np.ndarray) -> np.ndarray:
    return total / np.maximum(of, 1)


def _distinct(keys: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each document; keys of one document are less than 2**31."""
    unique = np.unique((docs.astype(np.int64) << 31) | keys)
    return np.bincount(unique >> 31, minlength=n)


def features(text: blocks.Raw) -> np.ndarray:
    """One row of features for each text of a block; an empty text has zeros."""
    n = len(text.bounds) - 1
    sizes = np.diff(text.bounds)
    doc = np.repeat(np.arange(n), sizes)
    data = np.frombuffer(text.data, np.uint8)
    share = _shares(np.bincount(doc * _N + _CLASS[data], minlength=n * _N).reshape(n, _N), sizes[:, None])
    words = blocks.coded(text, blocks.SPACED_CASED)
    count = np.diff(words.bounds)
    of = np.repeat(np.arange(n), count)
    codes = words.codes.astype(np.int64)
    distinct = _shares(_distinct(codes, of, n), count)
    same = of[1:] == of[:-1] if len(of) else np.zeros(0, bool)
    mixed = (codes[:-1] * 1_000_003 + codes[1:])[same] % ((1 << 31) - 1) if len(codes) else codes
    pairs = _shares(_distinct(mixed, of[1:][same] if len(of) else of, n), np.maximum(count - 1, 0))
    length = _shares(sizes - share[:, 4] * sizes, count)
    lead = np.zeros(n)
    if len(codes):
        width = len(words.vocab)
        top = np.unique(of * np.int64(width) + codes, return_counts=True)
        np.maximum.at(lead, top[0] // width, top[1])
    columns = [np.sqrt(share), share, np.log1p(count)[:, None], np.log1p(sizes)[:, None], distinct[:, None], pairs[:, None], (1 - distinct)[:, None] * np.log1p(count)[:, None], (1 - pairs)[:, None] * (count > 1)[:, None], np.minimum(length, 40)[:, None], _shares(lead, count)[:, None]]
    out = np.hstack(columns)
    out[sizes == 0] = 0.0
    return out


class Model(NamedTuple):
    """score = sigmoid(slope * (weights . (x - mean) / deviation - threshold) + logit(CUT))."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    quantile: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.deviation) @ self.weights
        # Exactly CUT at the threshold, so that both ways to decide agree.
        odds = CUT / (1 - CUT) * np.exp(np.clip(self.slope * (raw - self.threshold), -40, 40))
        return np.where(raw >= self.threshold, np.maximum(odds / (1 + odds), CUT), np.minimum(odds / (1 + odds), np.nextafter(CUT, 0)))


def bradley_terry(x: np.ndarray, liked: np.ndarray, weight: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """Fits the scores; ``weight`` gives how many rows each stands for when the threshold is chosen."""
    width = x.shape[1]
    good, bad = np.flatnonzero(liked), np.flatnonzero(~liked)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, 0.0)
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    deviation[deviation < 1e-9] = 1.0
    z = np.clip((x - mean) / deviation, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + 1e-4 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-4 * np.eye(width)
        w -= np.linalg.solve(hessian, gradient)
    raw = ((x - mean) / deviation) @ w
    order = np.argsort(raw, kind="stable")
    ranked, mass = raw[order], weight[order]
    # Rows below a threshold are label 0; each place between two scores is a quantile of the scores.
    wrong = np.concatenate([[0], np.cumsum(mass * liked[order])]) + np.concatenate([[0], np.cumsum((mass * ~liked[order])[::-1])])[::-1]
    best = np.flatnonzero(wrong == wrong.min())
    at = int(best[len(best) // 2])
    threshold = ranked[0] - 1 if at == 0 else ranked[-1] + 1 if at == len(ranked) else (ranked[at - 1] + ranked[at]) / 2
    spread = max(1e-6, float(np.average(np.abs(raw - threshold), weights=weight)))
    return Model(mean, deviation, w, float(threshold), 3 / spread, float(mass[:at].sum() / mass.sum()))


def held_out(key: str, folds: int = FOLDS) -> Column:
    """Whether crc32 of the key as text leaves 0; a null key counts as an empty text and is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) == 0


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from labelled rows that aren't held out; without both labels all scores are equal and label 1."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("liked")).where("key is not null and liked in (0, 1)").where(~held_out("key", folds)).distinct()
    totals = {r.liked: r.n for r in known.groupBy("liked").agg(F.count("*").alias("n")).collect()}
    # At most 2 * sample ids, whatever the tables' size: small enough to broadcast.
    chosen = known.where("liked = 1").orderBy(F.xxhash64("key"), "key").limit(sample).unionByName(known.where("liked = 0").orderBy(F.xxhash64("key"), "key").limit(sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.blocks(batches, "text"):
            x = features(blocks.raw(block.column("text")))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("liked"), rows], ["key", "liked", "x"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("key", "liked", "text")
    found = found.mapInArrow(work, f"key {kind}, liked int, x array<double>")
    # Repeated rows can't make it more than 2 * sample.
    found = found.orderBy(F.xxhash64("key"), "key", "liked", "x").limit(2 * sample).toArrow()
    liked = found.column("liked").to_numpy() == 1
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(found.num_rows, features(blocks.Raw(b"", np.zeros(2, np.int64))).shape[1])
    n = np.bincount(liked, minlength=2)
    weight = np.where(liked, totals.get(1, 0) / max(1, n[1]), totals.get(0, 0) / max(1, n[0]))
    return bradley_terry(x, liked, weight)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with each text's score in a column ``score`` (which replaces one of that name)."""
    columns = [c for c in docs.columns if c != score]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text)
        for block in blocks.blocks(batches, f"c{at}"):
            found = model.score(features(blocks.raw(block.column(at))))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found)], [*block.schema.names, "score"])

    # Columns go by place, so names that differ by case only or hold dots don't clash.
    plain = docs.select(columns).toDF(*(f"c{i}" for i in range(len(columns))))
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    return plain.mapInArrow(work, f"{schema}, score double").toDF(*columns, score)


def quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted: one row for each row of ``docs``.

    A null text is an empty one and has a score like others; a null key is held out; repeated rows
    score alike; empty ``docs`` give no rows; empty labels, or labels of one kind, give equal scores
    and label 1; other columns are not read.
    """
    model = fit(docs, labels, folds, sample, key, text)
    found = scored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model)
    return found.select(F.col("key").alias(key), held_out("key", folds).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
