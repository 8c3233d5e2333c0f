"""Language-model scoring: a two-level log-bilinear model with noise-contrastive estimation.

Tokens are coded by a vocabulary that grows with the corpus (see sizes()): the end of a text, the
most frequent words (top), the next ones (words), and all others by class, that is by their last
two bytes. A unit is the end, a top word or a class:

    p(token | a, b) = p(unit | a, b) * p(word | class, a) * p(token | rest of the class)

where a and b are the units of the token before and of the one before that. The first two factors
are log-bilinear, (first[a] + second[b]) . target + bias and before[a] . word + bias, the second one
over a class's own words and its rest; the third is the smoothed share of a word in that rest. So
probabilities are normalised over all words seen in training and one unseen word for each class.

1. Word counts over all training texts: counted per block, then in Spark.
2. Training texts become rows of codes, dealt to shards by a digest of their text. A shard is passed
   in order of digest, so what is learned does not depend on how the table is partitioned; repeated
   texts are one row with a weight. In each of ROUNDS rounds every shard trains on its part of that
   round from common values, and parameters are averaged by tokens, level by level. All steps are
   matrix products with drawn noise; every training token is seen once.
3. Scoring: normalisers of all pairs of units are one matrix product, as exp(x + y) = exp(x) exp(y);
   tokens then look theirs up. Counts of the most frequent words are broadcast (a bounded set); for
   all others the counts come by a join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .frames import dropped, written
from .quality import held_out

FOLDS = 10
WIDTH = 24
#: Noise units a batch of tokens, and noise words a token.
NOISE = 25
NOISE_WORDS = 5
#: Noise words drawn beforehand for each class.
NOISE_TABLE = 1024
BATCH = 1024
RATE = 0.07
INIT = 1e-8
ROUNDS = 2
#: Counts of so many words are broadcast for scoring; with a larger vocabulary, of the whole vocabulary.
HOT_WORDS = 262_144
SMOOTHING = 0.1
SEED = 7
#: Parameter rows averaged at once.
FAN_IN = 16
#: Tokens that are coded or scored at once.
CHUNK = 1 << 16
#: Digests of texts that a worker remembers to count repeated ones (a cache; beyond it they are rows again).
REMEMBERED = 200_000


class Sizes(NamedTuple):
    """How many top words, classes, words and shards there are: they grow with the training tokens."""

    top: int
    classes: int
    words: int
    shards: int

    @property
    def units(self) -> int:
        return 1 + self.top + self.classes

    @property
    def rows(self) -> int:
        """Rows of the second level: words, then the rest of each class."""
        return self.words + self.classes


def sizes(tokens: int, known: int) -> Sizes:
    """For so many training tokens, of which ``known`` words may be in the vocabulary.

    With N tokens 32 N^(1/6) top words, half as many classes, 32 N^(1/3) words and N^(2/3) / 8192 shards:
    at 10^13 tokens 4,700, 2,300, 690,000 (70 MB of parameters) and 57,000.
    """
    top = min(known, int(32 * tokens ** (1 / 6)))
    return Sizes(top, int(16 * tokens ** (1 / 6)) | 1, min(known - top, int(32 * tokens ** (1 / 3))), int(tokens ** (2 / 3) / 8192) + 1)


class Parameters(NamedTuple):
    """first and second by units before (the last row: before a text), target and bias by unit; before by unit, word and word_bias by second-level row."""

    first: np.ndarray
    second: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    before: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray

    def flat(self) -> bytes:
        return np.concatenate([x.ravel() for x in self]).astype("<f4").tobytes()

    @staticmethod
    def of(flat: np.ndarray, size: Sizes) -> Parameters:
        u, v = size.units, size.rows
        shapes = ((u + 1, WIDTH), (u + 1, WIDTH), (u, WIDTH), (u,), (u + 1, WIDTH), (v, WIDTH), (v,))
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return Parameters(*(x.reshape(s).astype(np.float32) for x, s in zip(np.split(np.asarray(flat), ends[:-1]), shapes)))


class Codes:
    """The vocabulary: what a word's code, unit and class are, and how much of the training text they make."""

    def __init__(self, size: Sizes, vocab: pa.Array, counts: np.ndarray, texts: int, class_n: np.ndarray, class_v: np.ndarray):
        """vocab: size.top + size.words words by descending count; class_n and class_v: occurrences and words of each class, of all words."""
        self.size, self.vocab = size, vocab
        self.end, self.rest = 0, 1 + size.top + size.words
        own = tails(vocab) % size.classes
        in_words = own[size.top :]
        self.class_of_row = np.concatenate([in_words, np.arange(size.classes)]).astype(np.int64)
        self.unit_of = np.concatenate([np.arange(1 + size.top), 1 + size.top + self.class_of_row]).astype(np.int64)
        weigh = lambda at, values: np.bincount(at, weights=values, minlength=size.classes)
        smooth = counts + SMOOTHING
        left = class_n + SMOOTHING * class_v + SMOOTHING - weigh(own[: size.top], smooth[: size.top])
        #: Smoothed occurrences of each class's rest, with one unseen word.
        self.rest_mass = np.maximum(left - weigh(in_words, smooth[size.top :]), SMOOTHING)
        row_mass = np.concatenate([smooth[size.top :], self.rest_mass])
        class_mass = weigh(self.class_of_row, row_mass)
        unit_mass = np.concatenate([[texts + SMOOTHING], smooth[: size.top], class_mass])
        self.unit_share = unit_mass / unit_mass.sum()
        self.row_share = row_mass / class_mass[self.class_of_row]

    def codes(self, words: pa.Array) -> np.ndarray:
        """The code of each word."""
        found = self.rest + tails(words) % self.size.classes
        if len(words) and len(self.vocab):
            at = pc.index_in(words, value_set=self.vocab).fill_null(-1).to_numpy(zero_copy_only=False)
            found = np.where(at >= 0, at + 1, found)
        return found

    def start(self) -> Parameters:
        rng = np.random.default_rng(SEED)
        u, v = self.size.units, self.size.rows
        draw = lambda n: rng.normal(0, 0.05, (n, WIDTH)).astype(np.float32)
        return Parameters(draw(u + 1), draw(u + 1), draw(u), np.log(self.unit_share).astype(np.float32), draw(u + 1), draw(v), np.log(self.row_share).astype(np.float32))


def tails(words: pa.Array) -> np.ndarray:
    """A number for the last two bytes of each word."""
    words = words.cast(pa.binary())
    if len(words) == 0:
        return np.zeros(0, np.int64)
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last = data[bounds[1:] - 1].astype(np.int64)
    before = np.where(np.diff(bounds) > 1, data[np.maximum(bounds[1:] - 2, 0)], 0).astype(np.int64)
    return last * 31 + before * 7


def _stream(codes: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another with an end each: tokens, and where each text starts."""
    n = len(bounds) - 1
    out = np.full(len(codes) + n, end, np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(codes)) + doc] = codes
    return out, bounds + np.arange(n + 1)


def _contexts(units: np.ndarray, starts: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The units before and two before; ``none`` before a text."""
    first, second = np.empty_like(units), np.empty_like(units)
    first[1:], second[2:] = units[:-1], units[:-2]
    first[starts[:-1]] = none
    second[starts[:-1]] = none
    follow = starts[:-1] + 1
    second[follow[follow < starts[1:]]] = none
    return first, second


def _step(rows: np.ndarray, most: int, *changes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """AdaGrad on the given rows, all below ``most``, of each (values, sums of squares, gradient); repeated rows are added up."""
    # Short integers are sorted by radix.
    rows = rows.astype(np.uint16 if most <= 1 << 16 else np.uint32)
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    fresh = np.empty(len(rows), bool)
    fresh[0] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=fresh[1:])
    starts = np.flatnonzero(fresh)
    at = sorted_[starts].astype(np.int64)
    for x, sums, gradient in changes:
        g = np.add.reduceat(gradient.take(order, axis=0), starts, axis=0)
        s = sums.take(at, axis=0)
        s += g * g
        sums[at] = s
        g *= RATE
        g /= np.sqrt(s, out=s)
        x[at] -= g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(-x, 60)))


def train(p: Parameters, vocabulary: Codes, stream: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> tuple[Parameters, float]:
    """Noise-contrastive estimation by AdaGrad over chunks of whole texts (codes with ends, starts, a weight for each token); tokens seen."""
    size = vocabulary.size
    p = Parameters(*(x.copy() for x in p))
    sums = [np.full_like(x, INIT) for x in p]
    rng = np.random.default_rng(seed)
    units_drawn = np.searchsorted(np.cumsum(vocabulary.unit_share), rng.random(1 << 16)).clip(0, size.units - 1)
    by_class = np.argsort(vocabulary.class_of_row, kind="stable")
    upto = np.cumsum(vocabulary.row_share[by_class])
    # Shares add up to one in each class, so class c's words lie between c and c + 1.
    words_drawn = by_class[np.searchsorted(upto, np.arange(size.classes)[:, None] + rng.random((size.classes, NOISE_TABLE)), "right").clip(0, size.rows - 1)]
    shift = np.log(NOISE * vocabulary.unit_share).astype(np.float32)
    word_shift = np.log(NOISE_WORDS * vocabulary.row_share).astype(np.float32)
    seen = 0.0
    for codes, starts, weight in stream:
        units = vocabulary.unit_of[codes]
        first, second = _contexts(units, starts, size.units)
        for at in range(0, len(codes), BATCH):
            here = slice(at, at + BATCH)
            w, a, b, weigh = units[here], first[here], second[here], weight[here].astype(np.float32)
            n = weigh.sum()
            seen += float(n)
            weigh = weigh / n
            k = units_drawn[rng.integers(0, len(units_drawn), NOISE)]
            h = p.first.take(a, axis=0) + p.second.take(b, axis=0)
            own = p.target.take(w, axis=0)
            good = (_sigmoid(np.einsum("ij,ij->i", h, own) + p.bias[w] - shift[w]) - 1) * weigh
            bad = _sigmoid(h @ p.target[k].T + (p.bias[k] - shift[k])) * weigh[:, None]
            gh = good[:, None] * own + bad @ p.target[k]
            both = np.concatenate([w, k])
            gt, gb = np.concatenate([good[:, None] * h, bad.T @ h]), np.concatenate([good, bad.sum(axis=0)])
            _step(a, size.units + 1, (p.first, sums[0], gh))
            _step(b, size.units + 1, (p.second, sums[1], gh))
            _step(both, size.units, (p.target, sums[2], gt), (p.bias, sums[3], gb))
            inside = np.flatnonzero(w > size.top)
            if len(inside) == 0:
                continue
            row, c, a, weigh = codes[here][inside] - 1 - size.top, w[inside] - 1 - size.top, a[inside], weigh[inside]
            k = words_drawn[c[:, None], rng.integers(0, NOISE_TABLE, (len(inside), NOISE_WORDS))]
            both = np.concatenate([row[:, None], k], axis=1)
            h, t = p.before.take(a, axis=0), p.word.take(both, axis=0)
            # The first column is the word itself, the others are noise.
            away = _sigmoid(np.einsum("ij,ikj->ik", h, t) + p.word_bias[both] - word_shift[both])
            away[:, 0] -= 1
            away *= weigh[:, None]
            _step(a, size.units + 1, (p.before, sums[4], np.einsum("ik,ikj->ij", away, t)))
            _step(both.ravel(), size.rows, (p.word, sums[5], (away[:, :, None] * h[:, None, :]).reshape(-1, WIDTH)), (p.word_bias, sums[6], away.ravel()))
    return p, seen


class Scorer:
    """Normalised log10 probabilities of tokens in context."""

    def __init__(self, p: Parameters, vocabulary: Codes):
        self.p, self.vocabulary = p, vocabulary
        size = vocabulary.size
        first, second, target, before, word = (x.astype(np.float64) for x in (p.first, p.second, p.target, p.before, p.word))
        x, y = first @ target.T + p.bias, second @ target.T
        tops = x.max(axis=1), y.max(axis=1)
        #: By unit before and two before.
        self.unit_norm = np.log(np.exp(x - tops[0][:, None]) @ np.exp(y - tops[1][:, None]).T) + tops[0][:, None] + tops[1]
        order = np.argsort(vocabulary.class_of_row, kind="stable")
        starts = np.searchsorted(vocabulary.class_of_row[order], np.arange(size.classes))
        #: By unit before and class.
        self.word_norm = np.empty((size.units + 1, size.classes))
        step = max(1, (1 << 24) // max(1, size.rows))
        for at in range(0, size.units + 1, step):
            z = before[at : at + step] @ word[order].T + p.word_bias[order]
            top = z.max(axis=1, keepdims=True)
            self.word_norm[at : at + step] = np.log(np.add.reduceat(np.exp(z - top), starts, axis=1)) + top

    def __call__(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each token of whole texts (with ends) down to the word, or to the rest of its class."""
        p, size = self.p, self.vocabulary.size
        units = self.vocabulary.unit_of[codes]
        first, second = _contexts(units, starts, size.units)
        out = np.empty(len(codes))
        for at in range(0, len(codes), CHUNK):
            here = slice(at, at + CHUNK)
            w, a, b = units[here], first[here], second[here]
            own = np.einsum("ij,ij->i", p.first[a] + p.second[b], p.target[w]) + p.bias[w] - self.unit_norm[a, b]
            inside = np.flatnonzero(w > size.top)
            row, a = codes[here][inside] - 1 - size.top, a[inside]
            own[inside] += np.einsum("ij,ij->i", p.before[a], p.word[row]) + p.word_bias[row] - self.word_norm[a, w[inside] - 1 - size.top]
            out[here] = own
        return out / np.log(10)


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, p: Parameters, vocabulary: Codes) -> Scorer:
    """One for each worker and model, as its tables take a while."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(p, vocabulary)
    return _scorers[name]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, tail, n over all rows of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.blocks(batches, "text"):
            words = blocks.coded(blocks.raw(block.column("text")), blocks.SPACED)
            n = np.bincount(words.codes, minlength=len(words.vocab)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words.vocab.cast(pa.string()), pa.array(tails(words.vocab)), pa.array(n)], ["word", "tail", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(work, "word string, tail bigint, n bigint")
    return found.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """At most ``most`` words, all of those from some count on, by descending count: a bounded set.

    The count is found in a histogram of eight bins for each doubling, so no task gathers every partition's best.
    """
    level = F.floor(F.log2("n") * 8)
    bins = sorted(((r.level, r.words) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for at, words in bins:
        held += words
        if held > most:
            break
        least = at
    found = counts.where(level >= F.lit(least)) if least is not None else counts.limit(0)
    return found.select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])


def _coded(training: DataFrame, vocabulary, shards: int) -> DataFrame:
    """shard, part, digest, codes, weight: training texts as codes, 32 bits each; a text that a worker saw before is counted without its codes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        more: dict[bytes, int] = {}

        def out(digests: list[bytes], codes: list[bytes | None], weights: list[int]) -> pa.RecordBatch:
            where = np.array([int.from_bytes(d[:7], "little") for d in digests], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(where % shards), pa.array((where // shards % ROUNDS).astype(np.int32)), pa.array(digests, pa.binary()), pa.array(codes, pa.binary()), pa.array(weights, pa.int64())], ["shard", "part", "digest", "codes", "weight"])

        for block in blocks.blocks(batches, "text"):
            words = blocks.coded(blocks.raw(block.column("text")), blocks.SPACED)
            codes = known.codes(words.vocab)[words.codes].astype("<u4")
            rows: list[tuple[bytes, bytes]] = []
            for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                data = codes[a:b].tobytes()
                digest = blake2b(data, digest_size=16).digest()
                if digest in more:
                    more[digest] += 1
                    continue
                if len(more) < REMEMBERED:
                    more[digest] = 0
                rows.append((digest, data))
            if rows:
                yield out([d for d, _ in rows], [c for _, c in rows], [1] * len(rows))
        if again := [(d, n) for d, n in more.items() if n]:
            yield out([d for d, _ in again], [None] * len(again), [n for _, n in again])

    return training.select("text").mapInArrow(work, "shard bigint, part int, digest binary, codes binary, weight bigint")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """shard, codes and weight of each text, from rows in order of shard and digest, those with codes first."""
    held = None
    for batch in batches:
        for shard, digest, codes, weight in zip(*(batch.column(c).to_pylist() for c in ("shard", "digest", "codes", "weight"))):
            if held is not None and held[1] == digest and held[0] == shard:
                held[3] += weight
                continue
            if held is not None:
                yield held[0], np.frombuffer(held[2], "<u4").astype(np.int64), held[3]
            held = [shard, digest, codes, weight]
    if held is not None:
        yield held[0], np.frombuffer(held[2], "<u4").astype(np.int64), held[3]


def chunks(texts: Iterator[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts with their ends, gathered up to CHUNK tokens (a longer text stands alone): codes, starts, weights."""
    parts: list[np.ndarray] = []
    weights: list[int] = []
    held = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        codes, starts = _stream(np.concatenate(parts), bounds, 0)
        return codes, starts, np.repeat(np.array(weights, np.float64), np.diff(starts))

    for codes, weight in texts:
        if parts and held + len(codes) + 1 > CHUNK:
            yield out()
            parts, weights, held = [], [], 0
        parts.append(codes)
        weights.append(weight)
        held += len(codes) + 1
    if parts:
        yield out()


def _learned(coded: DataFrame, part: int, vocabulary, start, partitions: int) -> DataFrame:
    """shard, seen, flat: the parameters that each shard learns from its texts of this part."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        for shard, texts in groupby(_texts(batches), lambda x: x[0]):
            own, seen = train(start.value, vocabulary.value, chunks((codes, weight) for _, codes, weight in texts), SEED + part * 1_000_003 + shard)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seen], pa.float64()), pa.array([own.flat()], pa.binary())], ["id", "seen", "flat"])

    rows = coded.where(F.col("part") == part).select("shard", "digest", "codes", "weight")
    # More partitions than shards, so that few shards share one.
    rows = rows.repartition(4 * partitions, "shard").sortWithinPartitions("shard", "digest", F.col("codes").asc_nulls_last())
    return written(rows.mapInArrow(learn, "id bigint, seen double, flat binary"), "parameters")


def _mean(part: pa.Table) -> tuple[np.ndarray, float]:
    part = part.sort_by("id")
    seen = part.column("seen").to_numpy()
    total = None
    for flat, s in zip(part.column("flat"), seen):
        own = np.frombuffer(flat.as_buffer(), "<f4") * np.float64(s)
        total = own if total is None else total + own
    return total / max(1.0, seen.sum()), float(seen.sum())


def _averaged(rows: DataFrame, n: int) -> np.ndarray | None:
    """Mean parameters by tokens; FAN_IN rows at a time meet in one task or at the driver."""

    def mean(part: pa.Table) -> pa.Table:
        flat, seen = _mean(part)
        return pa.table({"id": [part.column("id")[0].as_py() // FAN_IN], "seen": [seen], "flat": [flat.astype("<f4").tobytes()]}, pa.schema([("id", pa.int64()), ("seen", pa.float64()), ("flat", pa.binary())]))

    while n > FAN_IN:
        following = written(rows.groupBy(F.expr(f"id div {FAN_IN}")).applyInArrow(mean, "id bigint, seen double, flat binary"), "parameters")
        dropped(rows)
        rows, n = following, -(-n // FAN_IN)
    found = rows.toArrow()
    dropped(rows)
    return None if found.num_rows == 0 else _mean(found)[0]


def fit(training: DataFrame, vocabulary: Codes) -> Parameters:
    """Parameters learned from all rows of ``training`` (column text)."""
    sc = training.sparkSession.sparkContext
    size, p = vocabulary.size, vocabulary.start()
    held = sc.broadcast(vocabulary)
    coded = written(_coded(training, held, size.shards), "codes")
    for part in range(ROUNDS):
        start = sc.broadcast(p)
        mean = _averaged(_learned(coded, part, held, start, size.shards), size.shards)
        p = p if mean is None else Parameters.of(mean, size)
        start.destroy()
    dropped(coded)
    return p


def lm_scores(docs: DataFrame, folds: int = FOLDS, key: str = "doc_id", text: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    A null text is empty (its one token is the end); a null key counts as an empty one, so it is held
    out; repeated rows count and train as often as they occur and are scored alike, whatever the table's
    partitions; very long texts are taken whole; words of equal counts go by their bytes; empty ``docs``
    give no rows; with no training texts N and V are 0 and every token is unseen. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    training = docs.where(~held_out("key", folds))
    counts = written(word_counts(training), "words")
    texts = training.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_types = total.n + texts, total.v + (texts > 0)
    want = sizes(n_all, n_types)
    hot = _most_frequent(counts, max(hot_words, want.top + want.words))
    hot_list = hot.column("word").combine_chunks().cast(pa.binary()) if hot.num_rows else pa.array([], pa.binary())
    hot_n = hot.column("n").to_numpy().astype(np.float64)
    size = sizes(n_all, hot.num_rows)
    class_n, class_v = np.zeros(size.classes), np.zeros(size.classes)
    for r in counts.groupBy((F.col("tail") % size.classes).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r.c], class_v[r.c] = r.n, r.v
    inside = size.top + size.words
    vocabulary = Codes(size, hot_list.slice(0, inside), hot_n[:inside], texts, class_n, class_v)
    model = fit(training, vocabulary)
    denominator = np.log10(n_all + SMOOTHING * (n_types + 1))
    held = spark.sparkContext.broadcast((f"{id(model)}-{n_all}-{np.random.default_rng().integers(1 << 62)}", vocabulary, hot_list, hot_n, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, vocabulary, hot_list, hot_n, model = held.value
        scorer = _scorer(name, model, vocabulary)
        number = TaskContext.get().partitionId() << 36
        for block in blocks.blocks(batches, "text"):
            words = blocks.coded(blocks.raw(block.column("text")), blocks.SPACED)
            n = block.num_rows
            end = len(words.vocab)
            at = pc.index_in(words.vocab, value_set=hot_list).fill_null(-1).to_numpy(zero_copy_only=False) if end and len(hot_list) else np.full(end, -1)
            c = np.append(np.where(at >= 0, hot_n[np.maximum(at, 0)] if len(hot_n) else 0, 0), texts)
            rare = np.append(at < 0, False)
            log_c = np.where(rare, 0.0, np.log10(c + SMOOTHING))
            # Log share in the rest of the class; of rare words what is known of it.
            codes = np.append(vocabulary.codes(words.vocab), 0)
            within = np.where(codes < vocabulary.rest, 0.0, log_c - np.log10(vocabulary.rest_mass)[np.maximum(codes - vocabulary.rest, 0)])
            tokens, starts = _stream(words.codes, words.bounds, end)
            each = scorer(codes[tokens], starts) + within[tokens]

            def summed(x: np.ndarray) -> pa.Array:
                # Every text has its end at least, so no part is empty.
                return pa.array(np.add.reduceat(x, starts[:-1]))

            doc = np.repeat(np.arange(n), np.diff(starts))
            odd = np.flatnonzero(rare[tokens])
            pairs, times = np.unique((doc[odd] << 32) | tokens[odd], return_counts=True)
            bounds = pa.array(np.searchsorted(pairs >> 32, np.arange(n + 1)), pa.int32())
            names = words.vocab.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + n)), block.column("key"), pa.array(np.diff(starts)), summed(((c > 0) & ~rare)[tokens].astype(np.int64)),
                summed((log_c - denominator)[tokens]), summed(each), pa.ListArray.from_arrays(bounds, names), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64))),
            ], ["id", "key", "n_tokens", "n_known", "base_score", "score", "words", "times"])
            number += n

    parts = written(docs.mapInArrow(score, f"id bigint, key {kind}, n_tokens bigint, n_known bigint, base_score double, score double, words array<string>, times array<bigint>"), "parts")
    odd = parts.select("id", F.explode(F.arrays_zip("words", "times")).alias("x")).select("id", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    odd = odd.join(counts.select("word", "n"), "word", "left")
    log_n = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)
    more = odd.select("id", F.lit(None).cast(kind).alias("key"), F.lit(0).cast("bigint").alias("n_tokens"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"), log_n.alias("base_score"), log_n.alias("score"))
    sums = parts.drop("words", "times").unionByName(more).groupBy("id").agg(F.max("key").alias("key"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select(F.col("key").alias(key), held_out("key", folds).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")
