"""Top-k, URL filters, tool calls, WARC audit and the pipeline on small tables, against plain Python."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import toolcalls, topk, urls, warc
from seamline.llm.queries import URL_RULES


def plain_top(rows, k, every):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, e in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, w)), i) for i, w in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, bins", [(16384, 1024), (2, 3)])
def test_top_k(spark, block, bins):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(60)] + [(i, [0.25] * 8) for i in range(100, 140)]
    rows += [(150, None), (151, [float("nan")] * 8), (152, [None, 1.0]), (200, [float("inf")]), (None, [1.0] * 8), (160, []), (10, [0.5] * 8), (10, [0.5] * 8), (20, [0.125] * 8), (161, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], "vec_id bigint, embedding array<double>, score string, rank int").repartition(5)
    found = sorted(tuple(r) for r in topk.top_k(df, 5, 10, query_block=block, bins=bins).collect())
    assert found == plain_top(rows, 5, 10)
    assert topk.top_k(df.limit(0), 5, 10).collect() == []
    few = spark.createDataFrame([(10, [1.0]), (20, [2.0]), (21, [-1.0])], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(few, 5, 10).collect()) == plain_top([(10, [1.0]), (20, [2.0]), (21, [-1.0])], 5, 10)


def test_scores_beyond_doubles_are_exact():
    a = np.array([[float(1 << 30), 1.0]])
    b = np.array([[float(1 << 30), 1.0], [float(1 << 30), 2.0]])
    assert topk._scores(a, b).tolist() == [[(1 << 60) + 1, (1 << 60) + 2]]


def test_url_filters(spark):
    pages = [
        (1, "http://a.xyz/p", "<link rel=canonical href='https://x.example.org/es/1'>"), (2, "http://b.xyz/q#f", '<META http-equiv="Refresh" content="0; url=/r">'), (3, "http://b.xyz/r", '<link href="//a.xyz/p" rel="canonical">'), (4, "nope", None), (5, None, "x"), (6, "HTTP://A.B/Q?x#y", None),
        (7, "https://sub.example.com/en/71", ""), (8, "https://example.com/en/8", ""), (9, "https://notcom/en/8", ""), (10, "ftp://example.net/de/8", None), (10, "ftp://example.net/de/8", None), (11, "http://example.net/de/7?z", None), (12, "http://com/en/", None), (13, "x://?q", ""), (None, "http://q.org/es/", ""),
        (14, "http://c.xyz/1", "<link rel='canonical' href='http://example.com/en/7'>"), (15, "http://example.org/es/2", "<link rel='canonical' href='http://c.xyz/1'>"),
    ]
    df = spark.createDataFrame([(*p, "host", "clash") for p in pages], "page_id bigint, url string, html string, host string, verdict string")
    found = sorted((tuple(r) for r in urls.judge(df, URL_RULES).drop("alias_of").collect()), key=repr)
    block, allow = "block", "allow"
    assert found == sorted(
        [
            (1, "a.xyz", "/p", None, block), (2, "b.xyz", "/q", None, block), (3, "b.xyz", "/r", None, block), (4, "", "", None, allow), (5, "", "", None, allow), (6, "a.b", "/Q", None, allow), (7, "sub.example.com", "/en/71", "example.com/en/7", allow), (8, "example.com", "/en/8", "com/en/", block),
            (9, "notcom", "/en/8", None, allow), (10, "example.net", "/de/8", "example.net/de/8", block), (10, "example.net", "/de/8", "example.net/de/8", block), (11, "example.net", "/de/7", "net/de/", allow), (12, "com", "/en/", "com/en/", block), (13, "", "", None, allow), (None, "q.org", "/es/", "org/es/", block),
            (14, "c.xyz", "/1", None, allow), (15, "example.org", "/es/2", "org/es/", block),
        ], key=repr,
    )
    assert urls.judge(df.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}
    more = spark.createDataFrame([("a.b/Q?x", "example.com/en/8")], "u string, v string")
    assert {r.page_id: r.verdict for r in urls.judge(df, URL_RULES, more).collect()}[6] == "block"
    named = {r.page_id: r.alias_of for r in urls.judge(df, URL_RULES).collect()}
    assert named[1] == named[2] == named[3] == "a.xyz/p" and named[4] is None and named[5] is None and named[14] == named[15] == "c.xyz/1" and named[8] == "example.com/en/8"
    # Rules as a table decide alike.
    rules = spark.createDataFrame([*URL_RULES, ("block", None, "/"), ("allow", "q.org", "/es"), ("block", "org", "/es/1234567890")], "action string, host string, path string")
    listed = [*URL_RULES, urls.Rule("allow", "q.org", "/es"), urls.Rule("block", "org", "/es/1234567890")]
    assert sorted(map(tuple, urls.judge(df, rules).collect()), key=repr) == sorted(map(tuple, urls.judge(df, listed).collect()), key=repr)


def test_links_of_a_page(spark):
    from urllib.parse import urljoin

    bases = ["http://d.xyz/a/b/c.html?q=1#f", "https://d.xyz", "http://d.xyz/a/"]
    links = ["/x", "x", "./x", "../x", "../../../x", "?page=2", "//e.org/p?q", "https://e.org/z#g", "/go?u=http://example.com/en/8", "go?u=a://b", "x/./y/../z", "..", ".", "a/..", "x?y=../z", "/a/b/../../c/./d/"]
    df = spark.createDataFrame([(b, k) for b in bases for k in links], "b string, k string")
    for r in df.select("b", "k", urls.absolute(F.col("b"), F.col("k")).alias("x")).collect():
        want = urljoin(r.b, r.k).split("#")[0]
        assert (r.x or "").removesuffix("/") == want.removesuffix("/") or (r.b, r.k) == ("https://d.xyz", "?page=2"), (r, want)
    odd = df.limit(1).select(*(urls.absolute(F.lit("http://a.b/c"), F.lit(k)).alias(f"x{i}") for i, k in enumerate(["mailto:a@b.c", "javascript:void(0)", "", "#top", "ftp://x/y"]))).first()
    assert set(odd) == {None}
    page = "<base href='/deep/'><link rel='canonical' href='one'><link rel='canonical' href='http://e.org/two'><meta http-equiv=refresh content='1;url=../three'>"
    edges = urls.alias_edges(spark.createDataFrame([("http://d.xyz/p", page), ("http://d.xyz/go", "<link rel=canonical href='/go?u=http://example.com/en/8'>")], "url string, html string"))
    assert {tuple(r) for r in edges.collect()} == {("d.xyz/p", "d.xyz/deep/one"), ("d.xyz/p", "e.org/two"), ("d.xyz/p", "d.xyz/three"), ("d.xyz/go", "d.xyz/go?u=http://example.com/en/8")}
    # A bare top-level name is no alias of every host below it.
    bare = spark.createDataFrame([("m.com/a",), ("www.com/a.b",), ("m.www.com/a",), ("www.a.com/a/",)], "n string").select(urls.plain(F.col("n")).alias("x")).collect()
    assert [r.x for r in bare] == ["m.com/a", "www.com/a.b", "www.com/a", "a.com/a"]
    got = spark.createDataFrame([("www.m.a.b/x.html?utm_source=f&p=1&ref=x",), ("a.b/?ref=y",), ("a.b/x?p=1",)], "n string").select(urls.plain(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == ["a.b/x?p=1", "a.b", "a.b/x?p=1"]


CALLS = "conv_id bigint, call_id string, turn bigint, position int, name string, arguments string, after array<string>, status string"
SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}, "t": {"type": "array", "items": {"type": "string", "maxLength": 3}}}, "required": ["a"], "additionalProperties": False}}


def test_tool_calls(spark):
    calls = [
        (1, "x", 0, 0, "add", '{"b":2.0,"a":1}', None, "s"), (1, "y", 2, 0, "add", '{"a":3}', ["x", "lost"], "s"), (1, "z", 2, 1, "add", '{"a":-1,"q":1,"t":["long one"]}', ["y"], "s"), (1, "w", 4, 0, "add", "{", ["y", "z", "x"], "s"), (1, "v", 6, 0, "none", None, ["w"], "s"),
        (2, "x", 0, 0, "add", '{"a":1}', ["y"], "s"), (2, "y", 1, 0, "add", '{"a":1}', ["x"], "s"), (2, "k", 2, 0, "add", '{"a":1}', ["y"], "s"), (2, "m", 3, 0, "add", '{"a":1}', ["y", "z0"], "s"), (3, None, 0, 0, "add", '{"a":1}', None, "s"), (3, "d", 0, 0, "add", '{"a":1}', [None], "s"), (3, "d", 1, 0, "add", '{"a":2}', [], "s"), (None, "n", 0, 0, "add", '{"a":1}', None, None),
    ]
    results = [(1, "x", 1, "r1"), (1, "x", 9, "late"), (1, "y", 3, None), (1, "gone", 3, "o"), (3, "d", 2, "é"), (None, "n", 1, "null")]
    c = spark.createDataFrame(calls, CALLS)
    r = spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string")
    got = {(x.conv_id, x.call_id, x.turn): (x.level, x.result_turn, x.status, x.errors) for x in toolcalls.link(c, r, SCHEMAS).collect()}
    assert got[1, "x", 0] == (0, 1, "ok", "") and got[1, "y", 2] == (1, 3, "ok", "")
    assert got[1, "z", 2] == (2, None, "invalid", "$.q: unknown; $.a: below minimum; $.t[0]: too long")
    assert got[1, "w", 4] == (3, None, "invalid", "$: not JSON") and got[1, "v", 6] == (4, None, "invalid", "unknown tool")
    assert [got[2, k, t][0] for k, t in (("x", 0), ("y", 1), ("k", 2), ("m", 3))] == [None] * 4 and got[2, "k", 2][2] == "cyclic"
    assert got[3, None, 0][2] == "unanswered" and got[3, "d", 0][:3] == (0, 2, "ok") and got[3, "d", 1][2] == "repeated" and got[None, "n", 0][2] == "unanswered"
    assert got[1, "gone", None][1:3] == (3, "orphan")
    texts = {(x.conv_id, x.call_id, x.turn): x.json for x in toolcalls.link(c, r, SCHEMAS).collect()}
    assert texts[1, "x", 0] == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","result":"r1"}' and json.loads(texts[3, "d", 0])["result"] == "é"
    assert {x.status for x in toolcalls.link(c.limit(0), r, SCHEMAS).collect()} == {"orphan"}
    assert toolcalls.link(c.limit(0), r.limit(0), SCHEMAS).collect() == []


def test_no_string_fails_a_job(spark):
    odd = ['{"a":"\\ud800"}', '{"\\udc00":1}', '{"a":1,"a":2}', '{"a":NaN}', "[" * 100_000, '{"a":' + "9" * 5000 + "}", "", "null", '"\\u0000"', '{"a":1e999}', "{'a':1}"]
    rows = [(i, f"{i}", 0, 0, "any", x, None) for i, x in enumerate(odd)] + [(100, "n", None, None, None, None, None), (1, "2:x", 0, 0, "any", "{}", None), (12, ":x", 0, 0, "any", "{}", None), (None, "x", 1, 1, "any", "{}", ["x", None])]
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, turn bigint, position int, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(i, f"{i}", 1, "r") for i in range(11)] + [(1, "2:x", 1, "one"), (12, ":x", 1, "two"), (None, None, None, None)], "conv_id bigint, call_id string, turn bigint, content string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(calls, results, {"any": {}}).collect()}
    assert [got[i, f"{i}"].status for i in range(11)] == ["invalid"] * 7 + ["ok", "ok", "invalid", "invalid"]
    assert "surrogate" in got[0, "0"].errors and "repeated key" in got[2, "2"].errors
    assert json.loads(got[1, "2:x"].json)["result"] == "one" and json.loads(got[12, ":x"].json)["result"] == "two"
    assert got[100, "n"].errors == "unknown tool" and got[None, "x"].status == "unanswered" and got[None, None].status == "orphan"


def test_schemas_and_canonical_json():
    for schema in ({"oneOf": []}, {"type": "text"}, {"properties": {"a": {"$ref": "#"}}}, {"items": {"format": "date"}}, {"additionalProperties": {}}, 3):
        with pytest.raises(ValueError):
            toolcalls.known_schema(schema)
    check = toolcalls.check
    assert check(True, {"enum": [1]}) and not check(1.0, {"enum": [1]}) and check("ab", {"const": "b"}) and not check([1], {"const": [1.0]})
    assert check("ab", {"pattern": "^b"}) and not check("ab", {"pattern": "b"}) and check(3, {"exclusiveMaximum": 3}) and check([1, 2], {"maxItems": 1}) and check([], {"minItems": 1}) and check(1, {"exclusiveMinimum": 1})
    # U+FB33 comes after the surrogates of U+1F600 as UTF-16 units, before it as a code point.
    assert toolcalls.canonical({"\ufb33": 1, "\U0001f600": 2, "a": [1e-7, 1e21, 100.0, 0.1, -0.0, True, None]}) == '{"a":[1e-7,1e+21,100,0.1,0,true,null],"\U0001f600":2,"\ufb33":1}'


def test_levels_of_a_long_chain_and_a_lattice(spark):
    chain = [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(200)]
    lattice = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a"), ("f", "e"), ("s", "s"), ("t", "s"), ("t", "a")]
    edges = spark.createDataFrame([(n, b) for n, b in chain + lattice] + [(n, None) for n in {x for x, _ in chain + lattice}], "node string, before string")
    got = {r.node: r.level for r in toolcalls.levels(edges).collect()}
    assert all(got[f"c{i:03}"] == i for i in range(200))
    assert [got[x] for x in "abcdefst"] == [0, 1, 1, 2, 3, 4, None, None]


def test_warc_audit(spark):
    pages = [(i, f"http://h/{i}", "<p>" + "x" * (i % 7) + "</p>") for i in range(0, 2300, 3)] + [(None, None, None), (None, "u", "v"), (6, "http://h/6", "<p>again</p>"), (2300, None, ""), (2301, "http://h/big", "y" * 100_000)]
    a = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, status string")
    other = [(i, u, ("<q>" + h[3:]) if i in (9, 999, 1500) else h) for i, u, h in pages if i != 2100]
    b = spark.createDataFrame(other, "page_id bigint, url string, html string")
    got = warc.audit(a, b).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r.status, set()).add(r.page_id)
    assert by["corrupt"] == {9, 999, 1500} and by["missing"] == {2100} and by["moved"] == {p[0] for p in pages if p[0] and 2100 < p[0] < 3000}
    assert {r.status for r in warc.audit(a, a).collect()} == {"ok"} and {r.status for r in warc.audit(a, b.limit(0)).collect()} == {"missing"}
    assert {r.status for r in warc.audit(a.limit(0), b).collect()} == {"extra"} and warc.audit(a.limit(0), b.limit(0)).collect() == []
    offsets = {}
    for r in sorted(got, key=lambda r: (r.archive, r.offset)):
        assert r.offset == offsets.get(r.archive, 0)
        offsets[r.archive] = r.offset + r.length
    text = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: http://h/3\r\nWARC-Record-ID: <urn:page:3>\r\nContent-Length: 10\r\n\r\n<p>xxx</p>\r\n\r\n"
    assert next(r for r in got if r.page_id == 3).digest == hashlib.sha256(text.encode()).hexdigest()


def plain_audit(pages, replica):
    """Status by id and bytes, without places: how many records of each are ok or moved, corrupt, missing, extra."""
    import collections

    count = lambda rows: collections.Counter((i if i is not None else ("null", u, h), u or "", h or "") for i, u, h in rows)
    a, b = count(pages), count(replica)
    lost, more = a - b, b - a
    out = collections.Counter()
    for k, n in a.items():
        out[k, "sound"] += n - lost[k]
        out[k, "corrupt" if any(m[0] == k[0] for m in more) else "missing"] += lost[k]
    for k, n in more.items():
        if not any(m[0] == k[0] for m in lost):
            out[k, "extra"] += n
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("shelf", [8192, 4])
def test_warc_audit_of_repeated_null_negative_and_added_records(spark, shelf, monkeypatch):
    import collections

    monkeypatch.setattr(warc, "SHELF_RUNS", shelf)
    rng = np.random.default_rng(12)
    draw = lambda: [(None if rng.random() < 0.2 else int(rng.integers(-1500, 1500)) // 300 * 300, f"u{rng.integers(0, 3)}", f"h{rng.integers(0, 4)}") for _ in range(150)] + [(7, "hot", "same")] * 60
    pages = draw()
    replica = [r for r in pages if rng.random() < 0.9] + [(-5, "new", "x"), (None, "new", "y"), (7, "hot", "same")] + [(r[0], r[1], "rotten") for r in pages[:12]]
    schema = "page_id bigint, url string, html string"
    got = warc.audit(spark.createDataFrame(pages, schema), spark.createDataFrame(replica, schema)).collect()
    names = {warc_digest(i, u, h): (i if i is not None else ("null", u, h), u or "", h or "") for i, u, h in pages + replica}
    found = collections.Counter((names[r.digest], "sound" if r.status in ("ok", "moved") else r.status) for r in got)
    assert found == plain_audit(pages, replica)
    assert {r.status for r in warc.audit(spark.createDataFrame(pages, schema), spark.createDataFrame(pages[::-1], schema)).collect()} == {"ok"}


def warc_digest(i, u, h):
    name = "null" if i is None else i
    return hashlib.sha256(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {u or ''}\r\nWARC-Record-ID: <urn:page:{name}>\r\nContent-Length: {len((h or '').encode())}\r\n\r\n{h or ''}\r\n\r\n".encode()).hexdigest()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = ["alpha", "beta", "gamma", "delta", "stone", "river", "green", "quiet", "sun", "moon", "hill", "lake"]
    prose = lambda n=60: " ".join(rng.choice(words, n)) + "."
    leak = "one passage of the benchmark that nobody should ever train on at all"
    docs = [(i, prose() if i % 3 else " ".join(w.upper() + "!!" for w in rng.choice(words, 50)), "en", "s", 1) for i in range(240)]
    docs[100] = (100, docs[1][1], "en", "s", 1)
    docs[101] = (101, prose() + " " + leak, "en", "s", 1)
    docs += [docs[200], (None, prose(), None, None, None), (500, prose(20_000), "en", None, None)]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    now = spark.read.parquet(f"{at}/documents.parquet")
    columns = now.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, at).write.parquet(f"{at}/{k}")
        now = spark.read.parquet(f"{at}/{k}")
        if k < 3:
            assert now.columns == columns
        kept.append(sorted((r.doc_id for r in now.select("doc_id").collect()), key=repr))
    good = {i for i in range(240) if i % 3} | {500}
    assert set(kept[0]) == good | {None} and len(kept[0]) == len(good) + 2
    assert set(kept[1]) == good - {100} | {None} and len(kept[1]) == len(good)
    assert set(kept[2]) == good - {100, 101} | {None}
    assert set(kept[3]) == set(kept[2])
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).select("doc_id").collect()} == set(kept[3])


@pytest.mark.parametrize("bucket, hashes", [(256, 1 << 21), (4, 1 << 21), (256, 500)])
def test_near_duplicates_at_eight_tenths(spark, tmp_path, monkeypatch, bucket, hashes):
    import corpus_pipeline
    from seamline.llm import minhash

    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "BUCKET_HASHES", hashes)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = [base]
    for changed in (1, 2, 3, 4, 6, 8, 12, 30):
        for _ in range(6):
            own = list(texts[rng.integers(0, len(texts))])
            for at in rng.integers(0, len(own), changed):
                own[at] = f"n{rng.integers(0, 10**9)}"
            texts.append(own)
    texts += [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (1, 3, 5, 40, 9000)] + [[], base, ["a", "b"], ["A", "b"], []]
    docs = [(i, " ".join(x)) for i, x in enumerate(texts)] + [(900, None)]
    sets = {i: {tuple((x or "").lower().split()[k : k + 5]) for k in range(max(1, len((x or "").split()) - 4))} for i, x in docs}
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    want = sorted(i for i in sets if find(i) == i)
    assert 20 < len(want) < len(docs) - 20
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    frame.write.parquet(f"{tmp_path}/docs")
    for given in (spark.read.parquet(f"{tmp_path}/docs"), frame):
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, given, "").collect()) == want


def test_stages_judge_rows_without_ids_and_with_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))
    leak = "one passage of the benchmark that nobody should ever train on at all"
    a, b, c, d, e, f = (prose() for _ in range(6))
    docs = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (3, a), (3, e), (4, f), (4, f"{prose()} {leak}"), (None, f"{prose()} {leak}")]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    rows = lambda x: sorted((tuple(r) for r in x.collect()), key=repr)
    assert rows(kept) == sorted([(1, a), (None, b), (2, c), (2, d), (3, e), (4, f), docs[9], docs[10]], key=repr)
    kept.write.parquet(f"{tmp_path}/kept")
    kept = corpus_pipeline.decontamination_stage(spark, spark.read.parquet(f"{tmp_path}/kept"), str(tmp_path))
    assert rows(kept) == sorted([(1, a), (None, b), (2, c), (2, d), (3, e), (4, f)], key=repr)
