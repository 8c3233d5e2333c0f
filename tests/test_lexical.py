"""The inverted index against plain sums over all documents."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamline.operators.lexical import LexicalIndex


def plain(docs, queries, k):
    words = {i: Counter((t or "").split()) for i, t in docs}
    sizes = {i: sum(w.values()) for i, w in words.items()}
    mean = sum(sizes.values()) / len(docs)
    df = Counter(w for x in words.values() for w in x)
    found = {}
    for q, asked in queries:
        scores = Counter()
        for w in set(x for x in asked if x is not None):
            for i, x in words.items():
                if x[w]:
                    scores[i] += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * sizes[i] / mean))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
        found.update({(q, r): (i, pytest.approx(-s, abs=2e-6)) for r, (s, i) in enumerate(best, 1)})
    return found


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)
    names = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choices(names, [1 / (i + 1) for i in range(60)], k=n))
    rows = [(i * 7 % 400, text(rnd.randint(1, 40))) for i in range(400)]
    rows += [(1000 + i, "w0 w1 hot hot copy") for i in range(150)] + [(2000, None), (2001, ""), (2002, "w3 " * 5000), (2003, "only")]
    return rows


QUERIES = [(1, ["w0", "w1", "w2"]), (2, ["w50", "w0"]), (3, ["hot", "w1"]), (4, ["only"]), (5, []), (6, None), (7, ["absent"]), (8, ["absent", "w59", None, "w59"]), (9, ["w2", "w1", "w0"]), (10, [f"w{i}" for i in range(0, 60, 3)]), (11, ["w3"])]


def tables(spark, docs):
    return spark.createDataFrame(docs, "id int, text string").repartition(5), spark.createDataFrame(QUERIES, "query_id bigint, words array<string>")


@pytest.mark.parametrize("k", [1, 6, 1000])
def test_best_documents_equal_plain_sums(spark, docs, k):
    rows, queries = tables(spark, docs)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in LexicalIndex(spark).add(rows, run=16, block=4).best(queries, k).collect()}
    assert got == plain(docs, [(q, w or []) for q, w in QUERIES], k)


def test_added_documents_give_what_one_build_gives(spark, docs):
    rows, queries = tables(spark, docs)
    index = LexicalIndex(spark).add(rows.where("id % 3 = 0"), run=16, block=4)
    files = len(index._rows().inputFiles())
    index.add(rows.where("id % 3 < 2"), run=32, block=8).add(rows).add(rows)
    assert len(index._rows().inputFiles()) > files
    assert index.totals() == LexicalIndex(spark).add(rows).totals() == (len(docs), pytest.approx(sum(len((t or "").split()) for _, t in docs) / len(docs)))
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in index.best(queries, 6).collect()} == plain(docs, [(q, w or []) for q, w in QUERIES], 6)


def test_documents_that_hold_all_words(spark, docs):
    rows, queries = tables(spark, docs)
    got = sorted((r.query_id, r.asked, r.id) for r in LexicalIndex(spark).add(rows, run=16, block=4).holding(queries).collect())
    sets = {}
    for q, w in QUERIES:
        if w:
            sets.setdefault(frozenset(x for x in w if x), []).append(q)
    assert got == sorted((min(q), len(q), i) for w, q in sets.items() for i, t in docs if w <= set((t or "").split()))


def test_an_empty_index_and_clashing_columns(spark, docs):
    rows, queries = tables(spark, docs)
    empty = LexicalIndex(spark).add(rows.limit(0))
    assert empty.totals() == (0, 0.0) and empty.best(queries, 3).count() == 0 and empty.holding(queries).count() == 0
    clashing = rows.select("*", *(F.lit(0).alias(x) for x in ("words", "term", "run", "bucket", "ids", "n")))
    asked = queries.withColumns({x: F.lit(0) for x in ("q", "terms", "id", "score")})
    assert LexicalIndex(spark).add(clashing).best(asked, 3).columns == ["query_id", "id", "score", "rank"]


def test_blocks_that_cannot_reach_the_best_are_not_opened(spark):
    """The telling word decides; only the blocks of its short documents are read whole, the frequent one is looked up."""
    rows = [(i, "common " * (1 + i % 3) + ("rare" if i % 100 == 0 else "filler")) for i in range(4000)]
    index = LexicalIndex(spark).add(spark.createDataFrame(rows, "id bigint, text string"), run=64, block=16)
    asked = [(1, ["common", "rare"])]
    queries = spark.createDataFrame(asked, "query_id bigint, words array<string>")
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in index.best(queries, 3).collect()} == plain(rows, asked, 3)
    assert [tuple(r) for r in index.cost(queries, 3).collect()] == [(1, 4040, 14)]
