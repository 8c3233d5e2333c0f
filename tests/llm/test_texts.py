"""Decontamination, token counts, packing, SimHash, language model and quality on small tables, against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from seamline.llm import blocks, components, decontaminate, lm, packing, quality, simhash, token_counts
from seamline.llm.queries import vocabulary

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LONG = " ".join(f"word{i % 977} of the long text{i}" for i in range(4000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it now", "a"), (2, None, None), (3, "", "b"), (4, "  \t\n ", "c"), (5, LONG, None), (None, "no id here, but words", "d"),
    (6, "The quick brown fox jumps over the lazy dog and runs away from it now", "e"), (6, "The quick brown fox jumps over the lazy dog and runs away from it now", "e"), (7, "Ünïcödé Émile J̌ <|endoftext|> it's 12,5 <|ENDOFTEXT|> a.b!!c", "f"), (8, "one", "g"),
    (9, LONG + " tail", "h"), (10, "x" * 5000, "i"), (11, "zwei wörter", "j"),
]
SCHEMA = "doc_id bigint, text string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words1(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def words9(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().translate(LOWER)) if w]


def test_splitting_agrees_with_regular_expressions():
    import pyarrow as pa

    texts = [r[1] for r in ROWS]
    for table, plain in ((blocks.ALNUM, words1), (blocks.SPACED, words9)):
        found = blocks.coded(blocks.raw(pa.array(texts, pa.string())), table)
        own = [found.vocab[int(c)].as_py() for c in found.codes]
        assert [own[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:])] == [plain(t) for t in texts]
        data, starts, ends, bounds = blocks.normal(blocks.raw(pa.array(texts, pa.string())), table)
        assert [[data[s:e] for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(bounds[:-1], bounds[1:])] == [plain(t) for t in texts]


def plain_contamination(docs, items, window):
    grams = {}
    for name, text in items:
        w = words1(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n and name is not None else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = []
    for key, text, *_ in docs:
        w = words1(text)
        hit, found = [0] * len(w), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if names := grams.get(tuple(w[k : k + n])):
                    found |= names
                    hit[k : k + n] = [1] * n
        out.append((key, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=repr)


def plain_near(docs, items, window, slop):
    """How many items have a window whose words stand within ``slop`` more."""
    out = []
    for key, text, *_ in docs:
        w, found = words1(text), set()
        for name, item in items:
            own = words1(item)
            n = min(window, len(own))
            for k in range(len(own) - n + 1) if n and name is not None else ():
                need = collections.Counter(own[k : k + n])
                if all(x in w for x in need) and any(not need - collections.Counter(w[i : i + n + slop]) for i in range(len(w))):
                    found.add(name)
        out.append((key, len(found)))
    return sorted(out, key=repr)


ITEMS = [(10, "quick brown fox jumps over the lazy dog and runs away"), (9, "ZWEI wörter"), (9, "one"), (9, "one"), (11, "dog lazy fox the over jumps runs"), (12, "text1 long word2"), (13, "brown brown fox"), (3, None), (4, "!!"), (None, "no id here"), (5, "word1 of the long text1 word2 of the long text2 word3 of the"), (6, "not anywhere to be seen")]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_decontamination(spark, docs, empty, most):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.decontaminate(docs, bench, most=most)
    assert rows(found.drop("items", "n_near")) == plain_contamination(ROWS, ITEMS, 10)
    assert rows(found.select("doc_id", "n_near")) == plain_near(ROWS, ITEMS, 10, decontaminate.SLOP)
    assert rows(decontaminate.decontaminate(empty, bench)) == []
    clean = decontaminate.decontaminate(docs, bench.limit(0)).drop("items", "n_near")
    assert rows(clean) == plain_contamination(ROWS, [], 10)


def test_phrases_and_proximity(spark, docs):
    index = decontaminate.build_index(docs)
    bench = spark.createDataFrame([(1, "lazy dog and runs"), (2, "dog lazy the over")], "item_id bigint, text string")
    exact = decontaminate.matches(index, bench).where("item_id = '1'").select("key", "start").collect()
    assert sorted(map(tuple, exact)) == [(1, 7), (6, 7), (6, 7)]
    assert decontaminate.matches(index, bench).where("item_id = '2'").count() == 0
    near = decontaminate.matches(index, bench, slop=1).where("item_id = '2'").select("key").distinct().collect()
    assert {r.key for r in near} == {1, 6}


def plain_ids(text):
    t = token_counts.encoder(vocabulary()).tokenizer
    return t.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, empty):
    expected = sorted(((k, len((t or "").encode()), len(plain_ids(t)), len(plain_ids(t)) > 2048) for k, t, _ in ROWS), key=repr)
    assert rows(token_counts.token_counts(docs, vocabulary())) == expected
    assert rows(token_counts.token_counts(empty, vocabulary())) == []


def test_token_ids_of_odd_texts():
    import random

    import pyarrow as pa

    random.seed(3)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "J̌", "İ", "é,", "—", "́", "≠", " ", "\n", "\x0b", "\x1c", "\xa0", "Ab", "zz!", "x,y", "a.b'll", "12", "٣", "ΑΣ", "中文", "👍🏽", "!!'s", "K", "ﬁ", "|", "<|", "|>", "\x00"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    own = token_counts.encoder(vocabulary())
    for at in range(0, len(texts), 50):
        ids, bounds = own.encode(blocks.raw(pa.array(texts[at : at + 50])))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain_ids(t) for t in texts[at : at + 50]]
    slow = token_counts.Encoder(vocabulary())
    slow.split = False
    assert slow.lengths(blocks.raw(pa.array(texts[:200]))).tolist() == [len(plain_ids(t)) for t in texts[:200]]


def test_packing(docs, empty):
    pieces = packing.pack(docs, vocabulary(), with_ids=True).collect()
    want = collections.Counter(tuple([k, *plain_ids(t), 1]) for k, t, _ in ROWS)
    by_doc = collections.defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_doc[p.doc_id].append(p)
    got = collections.Counter()
    for key, own in by_doc.items():
        n = own[0].doc_tokens
        own.sort(key=lambda p: (p.start, p.sequence_id, p.offset))
        for _ in range(sum(p.length for p in own) // n):  # one chain of pieces for each of equal rows
            ids = []
            while len(ids) < n:
                p = next(x for x in own if x.start == len(ids))
                own.remove(p)
                ids += p.ids
            got[tuple([key, *ids])] += 1
    assert got == want
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert total <= 2048 and total & (total - 1) == 0 and {p.sequence_length for p in own} == {total}
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
    steps = collections.defaultdict(set)
    for p in pieces:
        steps[p.step_id].add((p.sequence_id, p.sequence_length))
    assert all(sum(n for _, n in s) <= packing.STEP_TOKENS and len({n for _, n in s}) == 1 for s in steps.values())
    assert rows(packing.pack(empty, vocabulary())) == []


def test_packer_pool_and_cuts():
    rng = np.random.default_rng(5)
    p = packing.Packer(pool=5000)
    docs = {i: rng.integers(0, 1000, int(rng.integers(1, 6000))).astype("<u4") for i in range(80)}
    for k, ids in docs.items():
        p.add(k, ids)
    p.finish()
    for k, ids in docs.items():
        own = sorted((r for r in p.rows if r[0] == k), key=lambda r: r[1])
        assert [x for r in own for x in np.frombuffer(r[9], "<u4")] == ids.tolist() and {r[4] for r in own} == {len(ids)}


def test_leftovers_are_carried_over_partitions(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, int(rng.integers(0, 700)))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(9)
    pieces = packing.pack(df, vocabulary(), step=4096, carried=2, with_ids=True).collect()
    for k, t in enumerate(texts):
        own = sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start)
        assert [i for p in own for i in p.ids] == [*plain_ids(t), 1]
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids) and p.doc_tokens == len(plain_ids(t)) + 1 for p in own)
    sequences = {p.sequence_id: p.sequence_length for p in pieces}
    steps = {}
    for p in pieces:
        steps.setdefault((p.step_id, p.sequence_length), set()).add(p.sequence_id)
    # One remainder of the whole table, and at most one unfinished group of each tier.
    assert sum(n not in packing.TIERS for n in sequences.values()) <= 8
    assert sum(len(s) * n != 4096 for (_, n), s in steps.items() if n in packing.TIERS) <= len(packing.TIERS)
    assert len({k for k, _ in steps}) == len(steps)


def plain_simhash(text):
    import xxhash

    w = words9(text)
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def plain_groups(prints):
    keys = list(prints)
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for k in keys:
        least[find(k)] = min([least.get(find(k), 1 << 70), *[d for d in prints[k] if d is not None]])
    return {k: least[find(k)] for k in keys}


def test_simhash(docs, empty):
    prints = collections.defaultdict(list)
    for k, t, _ in ROWS:
        prints[plain_simhash(t)].append(k)
    groups = plain_groups(prints)
    want = sorted(((k, "%016x" % plain_simhash(t), groups[plain_simhash(t)] if groups[plain_simhash(t)] < 1 << 70 else None) for k, t, _ in ROWS), key=repr)
    assert rows(simhash.near_duplicates(docs)) == want
    assert rows(simhash.near_duplicates(empty)) == []


@pytest.mark.parametrize("hot", [1, 3, 16])
def test_links_keep_components_in_crowded_buckets(spark, hot):
    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for i, j, k in rng.integers(0, 63, (70, 3))} | {int(x) for x in rng.integers(0, 1 << 62, 20)} | {0, 1, 3, 7, 15, -1, -2}
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    edges = simhash.links(df, hot).collect()
    assert all((e.u ^ e.v) & ((1 << 64) - 1) and ((e.u ^ e.v) & ((1 << 64) - 1)).bit_count() <= 2 for e in edges)
    named = {r.u: r.component for r in components.components(simhash.links(df, hot)).collect()}
    want = plain_groups({x & ((1 << 64) - 1): [x] for x in prints})
    for a in prints:
        for b in prints:
            assert (named.get(a, a) == named.get(b, b)) == (want[a & ((1 << 64) - 1)] == want[b & ((1 << 64) - 1)])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 201), (201, 200), (200, 201), (None, 7)]
    found = {r.u: r.component for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_language_model(docs, empty):
    found = lm.lm_scores(docs, hot_words=20).collect()
    assert len(found) == len(ROWS)
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    n, total = collections.Counter(), 0
    for k, t, _ in ROWS:
        if not held(k):
            own = [*words9(t), None]
            n.update(own)
            total += len(own)
    want = []
    for k, t, _ in ROWS:
        own = [*words9(t), None]
        want.append((k, held(k), len(own), sum(n[w] > 0 for w in own), total, sum(math.log10((n[w] + 0.1) / (total + 0.1 * (len(n) + 1))) for w in own)))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=repr)
    for a, b in zip(sorted(got, key=lambda r: repr(r[:5])), sorted(want, key=lambda r: repr(r[:5]))):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert rows(lm.lm_scores(empty)) == []


def drawn_vocabulary(rng, size, words):
    """A vocabulary of some words and counts, and all words by class with their counts."""
    import pyarrow as pa

    counts = np.sort(rng.integers(1, 400, len(words)))[::-1].astype(np.float64)
    own = lm.tails(pa.array(words, pa.binary())) % size.classes
    class_n, class_v = np.bincount(own, counts, size.classes), np.bincount(own, minlength=size.classes)
    inside = size.top + size.words
    return lm.Codes(size, pa.array(words[:inside], pa.binary()), counts[:inside], 17, class_n, class_v), counts, own


def drawn_parameters(rng, size):
    u, v = size.units, size.rows
    return lm.Parameters(*(rng.normal(0, 0.5, s).astype(np.float32) for s in ((u + 1, lm.WIDTH), (u + 1, lm.WIDTH), (u, lm.WIDTH), (u,), (u + 1, lm.WIDTH), (v, lm.WIDTH), (v,))))


def test_scores_equal_plain_sums_and_shares_add_up_to_one():
    rng = np.random.default_rng(2)
    size = lm.Sizes(top=6, classes=5, words=20, shards=1)
    words = sorted({bytes(rng.choice(list(b"abcdefg"), int(rng.integers(1, 5))).tolist()) for _ in range(60)})
    vocabulary, counts, own = drawn_vocabulary(rng, size, words)
    p = drawn_parameters(rng, size)
    scorer = lm.Scorer(p, vocabulary)

    def softmax(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    def plain(a, b):
        """Probability of the end, of every word, and of an unseen one of each class."""
        units = softmax((p.first[a] + p.second[b]).astype(float) @ p.target.T.astype(float) + p.bias)
        out = {"end": units[0]}
        for i in range(size.top):
            out[words[i]] = units[1 + i]
        for c in range(size.classes):
            mine = [i for i in range(size.top, size.top + size.words) if own[i] == c]
            rest = [i for i in range(size.top + size.words, len(words)) if own[i] == c]
            at = [i - size.top for i in mine] + [size.words + c]
            shares = units[1 + size.top + c] * softmax(p.before[a].astype(float) @ p.word[at].T.astype(float) + p.word_bias[at])
            out.update({words[i]: s for i, s in zip(mine, shares)})
            mass = sum(counts[i] + 0.1 for i in rest) + 0.1
            out.update({words[i]: shares[-1] * (counts[i] + 0.1) / mass for i in rest})
            out["unseen", c] = shares[-1] * 0.1 / mass
        return out

    import pyarrow as pa

    codes = vocabulary.codes(pa.array(words, pa.binary()))
    text = rng.integers(0, len(words), 40)
    tokens, starts = lm._stream(codes[text], np.array([0, 25, 25, 40]), 0)
    got = scorer(tokens, starts)
    names = []
    for part in (text[:25], text[25:25], text[25:]):
        names += [*(words[i] for i in part), "end"]
    unit = vocabulary.unit_of[tokens]
    for i, name in enumerate(names):
        j = i - starts[np.searchsorted(starts, i, "right") - 1]
        a, b = unit[i - 1] if j >= 1 else size.units, unit[i - 2] if j >= 2 else size.units
        shares = plain(a, b)
        assert sum(shares.values()) == pytest.approx(1, abs=1e-6)
        want = np.log10(shares[name])
        if tokens[i] >= vocabulary.rest:
            at = words.index(name)
            want -= np.log10((counts[at] + 0.1) / vocabulary.rest_mass[own[at]])
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_training_learns_what_follows_what():
    rng = np.random.default_rng(3)
    words = [f"w{i:02d}".encode() for i in range(40)]
    size = lm.Sizes(top=10, classes=3, words=25, shards=1)
    vocabulary, _, _ = drawn_vocabulary(rng, size, words)
    codes = rng.integers(1, 36, 60000)
    codes[1::2] = (codes[::2] * 7) % 35 + 1  # every second word follows from the one before
    texts = [(codes[i : i + 200], 1) for i in range(0, 60000, 200)]
    start = vocabulary.start()
    model, seen = lm.train(start, vocabulary, lm.chunks(iter(texts * 3)), 1)
    assert seen == 3 * (60000 + 300)
    tokens, starts, _ = next(lm.chunks(iter(texts[:100])))
    assert lm.Scorer(model, vocabulary)(tokens, starts).mean() > lm.Scorer(start, vocabulary)(tokens, starts).mean() + 0.25
    # A weight counts as repetitions do.
    assert lm.train(start, vocabulary, lm.chunks(iter([(codes[:50], 3)])), 1)[1] == 3 * 51


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(1, 80))) % 300) for _ in range(120)]
    rows_ = [(i, texts[i % 100]) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string")
    found = []
    for n in (1, 5):
        found.append({r.doc_id: r for r in lm.lm_scores(df.repartition(n), hot_words=50).collect()})
    for i in found[0]:
        assert found[0][i].score == pytest.approx(found[1][i].score, rel=1e-9) and found[0][i].base_score == pytest.approx(found[1][i].base_score, rel=1e-9)
        assert found[0][i].n_tokens == found[1][i].n_tokens and found[0][i].n_known == found[1][i].n_known
    assert found[0][3].score == pytest.approx(found[0][103].score, rel=1e-9)


def test_vocabulary_grows_with_the_corpus():
    grown = [lm.sizes(n, 10**9) for n in (0, 10**4, 10**6, 10**8, 10**10)]
    assert all(a.top < b.top and a.words < b.words and a.classes < b.classes and a.shards <= b.shards for a, b in zip(grown, grown[1:]))
    assert lm.sizes(10**6, 100)[::2] == (100, 0)


def _prose(rng, junk):
    words = ["alpha", "beta", "gamma", "delta", "stone", "river", "green", "quiet", "sun", "moon"]
    w = [str(rng.choice(words)) for _ in range(int(rng.integers(20, 80)))]
    return " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w).capitalize() + "."


def test_quality(spark, empty):
    rng = np.random.default_rng(2)
    data = [(i, _prose(rng, i % 4 == 0), "x", 0.5) for i in range(300)] + [(None, "null id", "x", None), (400, None, None, None), (401, "", None, None), (7, "REPEATED!! ROW!!", "x", 1.0)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 300, 2)] + [(3, None, 1), (None, 1, 0), (1000, 0, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.quality(docs, labels).collect()
    assert len(found) == len(data)
    own = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id < 300 and r.doc_id != 7}
    assert sum(r.predicted == int(k % 4 != 0) for k, r in own.items()) >= 0.98 * len(own)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in found)
    assert rows(quality.quality(empty, labels)) == []
    assert all(abs(r.score - 0.3) < 1e-9 and r.predicted == 1 for r in quality.quality(docs, labels.limit(0)).collect())


def test_quality_threshold_is_a_quantile_of_scores():
    x = np.arange(100.0)[:, None]
    liked = np.arange(100) >= 25
    model = quality.bradley_terry(x, liked, np.ones(100), pairs=2000)
    assert model.quantile == 0.25 and ((model.score(x) >= quality.CUT) == liked).all()
