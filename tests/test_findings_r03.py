"""Faults found by a review of the third round."""

import numpy as np
import pytest

from seamline.catalog import QUERIES
from seamline.lens import Tables
from seamline.operators.lexical import LexicalIndex
from seamline.operators import similarity
from seamline.operators.similarity import overlaps
from seamline.operators.vectors import nearest
from seamline.plans import retrieval, text, validation


def test_sliding_window_words_end_as_in_the_sql(spark, tmp_path):
    rows = [(1, "with that " + "wordé " * 28 + "this"), (2, "with that this"), (2, "with that from"), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in retrieval.win_slide_tok(Tables(spark, str(tmp_path))).collect()] == [2]


def test_best_documents_are_kept_run_by_run(spark):
    """No candidate is written: a partition of runs holds k documents a query, ties included, however many there are."""
    rows = [(i, "common other" if i % 2 else "common " * 3) for i in range(3000)]
    index = LexicalIndex(spark).add(spark.createDataFrame(rows, "id bigint, text string").repartition(3), run=64, block=16)
    queries = spark.createDataFrame([(1, ["common"]), (2, ["other", "common"])], "query_id bigint, words array<string>")
    found = index.best(queries, 4)
    assert [(r.query_id, r.id) for r in found.orderBy("query_id", "rank").collect()] == [(1, 0), (1, 2), (1, 4), (1, 6), (2, 1), (2, 3), (2, 5), (2, 7)]
    written = [x for x in found.inputFiles() if "/scanned-" in x]
    assert written and spark.read.parquet(*written).count() <= 2 * 4 * index._parts()


def test_nearest_holds_no_more_than_the_best_and_takes_null_groups(spark):
    """``by`` may be null, which failed; what is held beyond the best of many rows changes nothing."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)] if i % 97 else [1.0, None, 0.0, 0.0], None if i % 5 == 0 else i % 3) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>, label int").repartition(2)
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if None not in v and any(v)}
    want = {}
    for q in (x for x in (50, 100, 150) if x in units):
        for label in (None, 0, 1, 2):
            best = sorted((-round(float(units[q] @ units[i]), 9), i) for i, _, g in rows if g == label and i in units)[:7]
            want.update({(q, label, r): i for r, (_, i) in enumerate(best, 1)})
    found = nearest(frame, frame.where("id in (50, 100, 150)").select("id", "vector"), 7, by="label")
    assert {(r.query_id, r.label, r["rank"]): r.id for r in found.collect()} == want


def test_overlaps_take_the_words_of_all_rows_of_an_id(spark):
    """No words are gathered for an id beforehand; rows of one id counted apart before."""
    left = spark.createDataFrame([("x", ["a", "b"]), ("x", ["b", "c"]), ("y", ["a"])], "id string, words array<string>")
    right = spark.createDataFrame([(1, ["a", "c", "c"]), (2, ["a", "z"]), (3, None)], "id bigint, words array<string>")
    assert [tuple(r) for r in overlaps(left, right, 2).collect()] == [("x", 1, 2)]


def test_vectors_meet_by_two_terms_and_lose_no_pair(spark, monkeypatch):
    """Rows meet where they share two rare terms, in cells of few rows; copies are decided once (dd_tfidf, cl_claims)."""
    monkeypatch.setattr(similarity, "CELL", 8)
    monkeypatch.setattr(similarity, "PAIRS", 64)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(1, 9))) % 25) for _ in range(150)]
    texts += texts[:30] + ["single", "single single", ""]
    weights = similarity.tfidf(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), 40).cache()
    vectors: dict = {}
    for r in weights.collect():
        vectors.setdefault(r.id, {})[r.term] = r.weight
    dots = {(a, b): sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items()) for a in vectors for b in vectors if a < b}
    rank = {i: int(r) for i, r in enumerate(rng.permutation(len(texts)))}
    rows = spark.createDataFrame(list(rank.items()), "id bigint, rank bigint")
    for t in (0.82, 0.6):
        got = {(r.a, r.b): r.similarity for r in similarity.cosine_pairs(weights, t).collect()}
        assert len(got) > 30 and got == pytest.approx({k: v for k, v in dots.items() if v >= t - 1e-9})
    led = {r.id: (r.leader0, r.leader1) for r in similarity.cosine_leaders(rows, weights, 0.7, 0.6).collect()}
    alike = lambda a, b, t: dots.get((min(a, b), max(a, b)), 0.0) >= t - 1e-9

    def loop(ids, t):
        found: dict = {}
        for i in sorted(ids, key=rank.get):
            found[i] = next((j for j in sorted(set(found.values()), key=rank.get) if alike(i, j, t)), i)
        return found

    fine = loop(range(len(texts)), 0.7)
    coarse = loop(set(fine.values()), 0.6)
    assert led == {i: (fine[i], coarse[fine[i]]) for i in fine}


def test_texts_are_scored_once_for_an_audit(spark, tmp_path):
    """The parts of cq_audit read written scores, not the documents three times."""
    rows = [(i, "A plain sentence of words about many rivers. " * i, "src0") for i in range(1, 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = text.cq_audit(Tables(spark, str(tmp_path)))
    assert not [x for x in found.inputFiles() if "documents.parquet" in x]
    assert sorted({r.kind for r in found.collect()}) == ["avg", "best", "infected_pct", "worst"]


def test_conflicts_are_summed_from_counts_of_values(spark):
    """jn_theta_conflict needs no row for each number: the totals equal those of conflicts(), under several keys too."""
    rng = np.random.default_rng(9)
    pick = lambda names: [x for x in names if rng.random() < 0.5]
    rows = [(i, pick(["a", "b", "general"]), pick(["2020", "2021"]), "kg" if i % 3 else None, float(rng.integers(0, 30))) for i in range(120)]
    numbers = spark.createDataFrame(rows, "id bigint, categories array<string>, years array<string>, unit string, value double")
    want = validation.conflicts(numbers).groupBy().sum("n", "n_high").first()
    assert tuple(validation.conflict_totals(numbers).first()) == tuple(want) and want[0] > want[1] > 0


def test_pipeline_sets_move_once_and_met_pairs_are_not_met_again(spark, monkeypatch):
    """Sets go to their first bucket without a join, and a bucket all of whose classes were compared there isn't dealt again."""
    from seamline.llm import minhash

    seen = {}

    def kept(df, name, keep=minhash.written):
        if name == "links":
            seen["plan"] = df._jdf.queryExecution().executedPlan().toString()
        out = keep(df, name)
        if name == "dealt":
            seen["dealt"] = out.count()
        return out

    monkeypatch.setattr(minhash, "written", kept)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join([*base[:30], *(f"y{i}" for i in range(10))]), "something else altogether is said here"]
    docs = spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "key bigint, order bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [r.key for r in minhash.repeats(docs, "key", "order").collect()] == [1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" not in seen["plan"]
    assert seen["dealt"] == 0


def test_f3_rows_meet_in_their_group_only(spark, monkeypatch):
    """Blocks are decided group by group, as one loop over all rows groups them."""
    from pyspark.sql import functions as F

    from seamline.operators import leaders

    groups = []
    plain = leaders.similarities
    monkeypatch.setattr(leaders, "similarities", lambda rows, heads, kind: groups.append((set(rows.groups.tolist()), set(heads.groups.tolist()))) or plain(rows, heads, kind))
    data = [(i, f"g{i % 3}", [f"w{(i * 7 + j * j) % 11}" for j in range(1 + i % 4)]) for i in range(60)]
    data = [(i, g, sorted(set(w))) for i, g, w in data] + [(60, "g0", []), (61, None, ["w1"]), (62, None, ["w1"])]
    rows = spark.createDataFrame(data, "id bigint, group string, terms array<string>").withColumn("weights", F.transform("terms", lambda _: F.lit(1.0)))
    got = {r.id: r.leader for r in leaders.lead_by_blocks(rows, [F.col("id")], 0.5, "jaccard", block=7).collect()}
    want, heads = {}, []
    for i, g, w in data:
        alike = [h for h, hg, hw in heads if hg == g and w and hw and len(set(w) & set(hw)) / len(set(w) | set(hw)) >= 0.5]
        want[i] = alike[0] if alike else i
        if not alike:
            heads.append((i, g, w))
    assert got == want
    assert groups and all(len(x) == 1 and x == y for x, y in groups)


def test_f8_equal_sets_are_compared_once(spark, monkeypatch):
    """Copies make pairs at the end only; what is compared are distinct sets of a block."""
    kept, keep = {}, similarity.written

    def counted(df, name):
        out = keep(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "written", counted)
    rng = np.random.default_rng(8)
    sets = [sorted({f"t{x}" for x in rng.integers(0, 40, int(rng.integers(1, 30)))}) for _ in range(60)]
    sets += [[*s, "more"] for s in sets[:20]]
    rows = [(i, None if i % 41 == 40 else f"m{i % 3}", sets[i % len(sets)]) for i in range(240)] + [(240, "m0", []), (241, "m0", None)]
    got = {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "id bigint, m string, tokens array<string>"), 0.6, "m").collect()}
    here = [(i, m, set(s)) for i, m, s in rows if m and s]
    want = {(a, b): len(x & y) / len(x | y) for a, m, x in here for b, k, y in here if a < b and m == k and len(x & y) >= 0.6 * len(x | y)}
    assert got == pytest.approx(want)
    different = {(m, frozenset(s)) for _, m, s in here}
    assert kept["distinct"] == len(different)
    assert kept["near"] < len(different) ** 2 / 6


def test_f22_f28_passages_do_not_move(spark, monkeypatch):
    """Neither runs of words nor passages are dealt out; results are those of plain Python, in one block of claims and in several."""
    import re

    from seamline.operators import retrieval as R

    rng = np.random.default_rng(22)
    text = lambda n: " ".join(f"{x}" for x in rng.choice(["revenue", "growth", "solar", "wind", "panel", "storage", "cheap", "with", "annual", "quick", "market", "share"], n))
    claims = [(i, text(int(rng.integers(0, 7)))) for i in range(40)] + [(40, None), (41, ""), (42, "annual revenue growth solar today")]
    passages = [(i, (text(3) + " " + " filler" * int(rng.integers(0, 31)) + " ").join(["", text(1), text(2)])) for i in range(6)] + [(6, None), (7, ""), (8, "the annual revenue growth solar")]
    plain = spark.createDataFrame(claims, "id bigint, text string")
    from seamline.functions import extract as X

    phrases = {r.id: {x for x in r.p or () if len(x) >= 8} for r in plain.select("id", X.phrases(plain["text"]).alias("p")).collect()}
    runs = {" ".join(w[i : i + n]) for _, t in passages if t for w in [t.split()] for n in (3, 4) for i in range(len(w) - n + 1)}

    def mode(i, claim):
        if phrases[i] & runs:
            return "strict", len(phrases[i] & runs)
        wanted = set(re.findall(r"\b[a-zA-Z]{4,}\b", claim or "")) - set(X.CITATION_STOP)
        ways = [re.findall(r"\b[a-zA-Z]{4,}\b", t or "") for _, t in passages]
        return ("proximity" if any(len(set(w[k : k + 30]) & wanted) >= 3 for w in ways for k in range(len(w))) else "none"), 0

    want = {i: mode(i, x) for i, x in claims}
    assert len({m for m, _ in want.values()}) == 3
    for most in (50_000, 9):
        monkeypatch.setattr(R, "CLAIMS", most, raising=False)
        out = R.verify(plain, spark.createDataFrame(passages, "doc bigint, text string"))
        assert {r.id: (r.mode, r.found) for r in out.collect()} == want
    assert "doc" not in "".join(line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line)


def test_f17_f18_f19_f21_partitions_follow_the_lines(spark, monkeypatch):
    """Entities are dealt out by mission over as many tasks as their rows fill, and co-occurrence deals them no further."""
    from seamline import lens
    from seamline.plans import graph, relational

    at = "/root/testdata/sf0.001"
    before = {name: sorted(map(tuple, QUERIES[name](spark, at).collect())) for name in ("jn_self_cooc", "kg_cooccur", "kg_stats", "kg_network")}
    lines = spark.read.parquet(f"{at}/lineitem.parquet").count()
    monkeypatch.setattr(lens, "TASK_ROWS", 150)
    many = -(-lines // 150)
    for query in (relational.jn_self_cooc, graph.kg_cooccur, graph.kg_stats, graph.kg_network):
        out = query(Tables(spark, at))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert f"{many}), REPARTITION_BY_NUM" in plan
        assert not any("mission_id" in line or "group" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)
        assert sorted(map(tuple, out.collect())) == before[query.__name__]
