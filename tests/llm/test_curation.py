"""Vector codes, quality rules and golden records on small tables, against plain Python."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import golden, kdtrees, line_rules


def plain_codes(rows, parts, entries, rounds, scale):
    """Codes, errors, sums by label and codebooks, by trying every entry."""
    good = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in good), default=0) // parts) * parts
    step = width // parts
    ints = [[math.floor(scale * x) for x in v] + [0] * (width - len(v)) for _, v, _ in good]
    cut = [[v[p * step : (p + 1) * step] for v in ints] for p in range(parts)]
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, ints[k]))[:entries]
    books = [[cut[p][k] for k in order] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda k: (away(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(x, books[p]) for x in cut[p]]
            books[p] = [[sum(c) // own.count(k) for c in zip(*(x for x, o in zip(cut[p], own) if o == k))] if k in own else e for k, e in enumerate(books[p])]
    codes = [[near(cut[p][k], books[p]) for p in range(parts)] for k in range(len(good))]
    errors = [sum(away(cut[p][k], books[p][c]) for p, c in enumerate(code)) for k, code in enumerate(codes)]
    by = {}
    for (_, _, g), e in zip(good, errors):
        by[g] = by.get(g, 0) + e
    return sorted(((i, c, e, by[g]) for (i, _, g), c, e in zip(good, codes, errors)), key=repr), books


@pytest.mark.parametrize("entries, block, leaf", [(5, 4096, 16), (9, 7, 2), (200, 50, 4)])
def test_vector_codes(spark, entries, block, leaf):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (6, 10))
    rows = [(k, [float(x) for x in centres[k % 6] + rng.normal(0, 0.2, 10)], k % 3 if k % 7 else None) for k in map(int, rng.permutation(120))]
    rows += [(500 + k, [0.25] * 10, 1) for k in range(40)] + [(3, [1.0] * 10, None), (3, [1.0] * 10, 2), (None, [0.5] * 10, 2), (700, None, 1), (701, [None] * 10, 1), (702, [float("nan")] * 10, 1), (703, [float("-inf")] * 10, 1), (704, [0.5], 0), (705, [], 0)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, label int, error int, code string, id string").repartition(3)
    found, books = kdtrees.compress(df, 2, entries, 4, 64.0, block=block, leaf=leaf)
    want, plain = plain_codes(rows, 2, entries, 4, 64.0)
    assert [b.astype(int).tolist() for b in books] == plain
    by = found.groupBy("label").agg(F.sum("error").alias("s")).collect()
    got = sorted(((r["vec_id"], list(r["codes"]), r["error"], next(b["s"] for b in by if b["label"] == r["label"])) for r in found.collect()), key=repr)
    assert got == want
    digests = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in kdtrees.coded(found, books).collect()), key=repr)
    assert digests == sorted(((i, "".join(f"{x:02x}" for x in c), e, s) for i, c, e, s in want), key=repr)


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    found, books = kdtrees.compress(none)
    assert kdtrees.coded(found, books).collect() == [] and all(len(b) == 0 for b in books)
    with pytest.raises(ValueError):
        kdtrees.compress(spark.createDataFrame([(1, [1e30], 1)], "vec_id bigint, embedding array<double>, label int"))


def test_trees_assign_whole_subtrees():
    """Equal points are assigned at the root; of equally near entries the first takes them."""
    points = np.full((100, 3), 5.0)
    tree = kdtrees.grown(points, kdtrees.leaf_order(points, 4), 4)
    book = np.array([[9.0, 9, 9], [5, 6, 5], [5, 4, 5], [5, 6, 5]])
    squares = (book * book).sum(axis=1)
    assert kdtrees._survivors(tree.lows[0], tree.highs[0], np.ones((1, 4), bool), book, squares).tolist() == [[False, True, False, False]]
    sums, counts, _ = kdtrees.assigned(tree, book)
    assert counts.tolist() == [0, 100, 0, 0] and sums[1].tolist() == [500.0] * 3


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lines(text, r=line_rules.LineRules()):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    repeated = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(8)}
    removed, kept, gone, lines = [], [], 0, []
    for line in text.split("\n"):
        w = WORD.findall(line)
        n = len(w)
        letters = [x for x in line if x.isalpha()]
        ends = re.search(r"[.!?…。！？:;][\"'”’»)\]]*[\x20\x09-\x0D]*$", line)
        why = None
        if n:
            lines.append(line)
            if 100 * len(re.findall(r"[#*$%&|<>]+", line)) > n * r.most_signs:
                why = "navigation"
            elif n >= 2 and 100 * sum(x.isupper() for x in letters) > len(letters) * r.most_capitals:
                why = "shouting"
            elif (n < r.short and not ends) or 100 * len(re.findall("[!?]+", line)) > n * r.most_calls:
                why = "punctuation"
            elif n >= r.short and 100 * len(set(w)) < n * r.least_distinct:
                why = "repetition"
            elif re.search('|'.join(r.boilerplate), line, re.I):
                why = "boilerplate"
        if why:
            removed.append(why)
            gone += n
        else:
            kept.append(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(repeated), len(removed), gone, removed, "\n".join(kept), failed, not failed and 100 * gone <= 40 * len(words))


def test_quality_rules(spark):
    rng = random.Random(12)
    vocab = ["wort", "Haus", "été", "niño", "data", "x", "über", "the", "of", "and"]
    sentence = lambda n: " ".join(rng.choice(vocab) + str(rng.randrange(90)) for _ in range(n)) + "."
    clean = "\n".join(sentence(12) for _ in range(6))
    texts = [
        None, "", " \n\t", "one", clean, clean + "\nHome | About | Contact\n", f"{clean}\n\n{clean}", "\n".join(["Home | About", "READ ALL OF IT NOW.", "no end here", "what! is! this!", "a a a a a a a a b.", "All Rights Reserved by us.", sentence(14)]),
        "Menu > Sub > Sub\n" * 9 + clean, " ".join(["gleich"] * 500), " ".join(f"w{i}" for i in range(8)) + " x " + " ".join(f"w{i}" for i in range(8)), "LAUT\x0bUND\x0cLAUT.\r\n" + clean, "\u017fubscribe to all of these and more of them today.\nImpressum und Datenschutz stehen hier am Ende von allem.\n" + clean,
        " ".join(f"w{i % 5000}" for i in range(12000)), "    nbsp is part of words " * 5, "\U0001f600 " * 25, "Tous DROITS RÉSERVÉS par nous et par tous les autres ici.\n" + clean,
    ] + ["\n".join(rng.choice(["A | B | C", sentence(rng.randrange(1, 12)), sentence(9)[:-1], "", "DAS IST LAUT!!", "so so so so so so so so so."]) for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    df = spark.createDataFrame([(i // 2, x, 7, "c", [1]) for i, x in enumerate(texts)] + [(None, clean, 7, "c", [1])], "doc_id bigint, text string, n_words int, kept string, line array<int>")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "words_removed", "removed", "cleaned", "base_failed", "kept"]
    found = sorted(((r["doc_id"], tuple(r[n] for n in names)) for r in line_rules.clean_lines(df).collect()), key=repr)
    assert found == sorted([*((i // 2, plain_lines(x)) for i, x in enumerate(texts)), (None, plain_lines(clean))], key=repr)
    assert {w for _, r in found for w in r[7]} == {"navigation", "shouting", "punctuation", "repetition", "boilerplate"}
    assert line_rules.clean_lines(df.limit(0)).collect() == []


def test_quality_rules_keep_labelled_documents(spark):
    """Of documents that labels call good and that pass the base rules nearly all stay; of the others hardly one."""
    folder = "/root/testdata/sf0.01"
    found = line_rules.clean_lines(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    shares = {r[0]: r[1] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert shares[1] >= 0.99 and shares[0] <= 0.05


TRUST = {"crm": 1, "web": 2, "store": 3, "partner": 4}


def plain_golden(rows):
    blank = lambda x: None if x is None or re.fullmatch(r"[\x20\x09-\x0D]*", x) else x
    clusters = {}
    for r in rows:
        i, m, source, at, name, email, city, nation, segment, balance = r
        balance = None if balance is None or not math.isfinite(balance) else balance
        clusters.setdefault(m if m is not None else i, []).append({"id": i, "rank": TRUST.get(source, 5), "at": at, "name": blank(name), "email": blank(email), "city": blank(city), "nation": nation, "segment": blank(segment), "balance": balance})
    out = []
    epoch = dt.datetime(1970, 1, 1)
    for k, own in clusters.items():
        latest = max((r["at"] for r in own if r["at"]), default=None)
        for r in own:
            r["stale"] = r["at"] is None or latest - r["at"] > dt.timedelta(hours=1440)
            r["recent"] = (r["at"] is None, epoch - r["at"] if r["at"] else dt.timedelta(0), r["rank"], (r["id"] is not None, r["id"] or 0))
            r["trusted"] = (r["stale"], r["rank"], *r["recent"])

        def first(field, order, own=own):
            some = sorted((r for r in own if r[field] is not None), key=lambda r: (order(r), r[field]))
            return (some[0][field], some[0]["id"]) if some else (None, None)

        segment = first("segment", lambda r: r["recent"])
        name = first("name", lambda r: (-len(r["name"]), r["trusted"]))
        email = first("email", lambda r: r["trusted"])
        balance = first("balance", lambda r: (r["segment"] != segment[0], r["recent"]))
        home = min(own, key=lambda r: ((r["city"] is None) + (r["nation"] is None), r["recent"], (r["city"] is not None, r["city"] or ""), (r["nation"] is not None, r["nation"] or 0)))
        cents = None if balance[0] is None else math.floor(100 * balance[0] + 0.5)
        by = None if home["city"] is None and home["nation"] is None else home["id"]
        out.append((k, len(own), sum(r["stale"] for r in own), name[0], email[0], segment[0], home["city"], home["nation"], cents, name[1], email[1], segment[1], balance[1], by))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 64])
def test_golden_records(spark, salts):
    rng = random.Random(13)
    start = dt.datetime(2024, 1, 1)
    pick = lambda *x: rng.choice(x)
    rows = []
    for i in range(300):
        at = pick(None, start + dt.timedelta(days=rng.randrange(130)), start + dt.timedelta(days=60, microseconds=rng.randrange(-1, 2)), start)
        rows.append((i, pick(None, 7, 7, 12, i % 40), pick("crm", "web", "store", "partner", "CRM", None), at, pick(None, "", " \t\x0b", "Ann", "Änne", " Ann ", "\U0001f600" * 4), pick(None, "", "a@x", "b@y"), pick(None, " ", "Oslo", "Rom"), pick(None, 1, 2), pick(None, "", "retail", "public"), pick(None, -0.005, 12.345, 1e6, float("nan"), float("inf"), -7.005)))
    rows += rows[:20] * 2 + [(None, None, "crm", start, "n", None, None, None, None, 1.0)] * 2 + [(999, None, None, None, None, None, None, None, None, None)]
    rows += [(5, 5, "crm", start, x, x, x, None, x, 2.0) for x in ("bb", "aa")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "client_id bigint, master_id bigint, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, cluster_id int, salt int, latest string").repartition(5)
    found = golden.golden_records(df, salts=salts)
    assert found.columns == ["cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance_cents", "name_from", "email_from", "segment_from", "balance_from", "address_from"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_golden(rows)
    assert golden.golden_records(df.limit(0)).collect() == []
    zoned = df.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert sorted((tuple(r) for r in golden.golden_records(zoned, salts=salts).collect()), key=repr) == plain_golden(rows)


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    """Names that the stages use themselves, in any case, and names with dots."""
    import corpus_pipeline

    rng = random.Random(14)
    folder = "/root/testdata/sf0.001"
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(50)) for _ in range(40)) + "." for _ in range(30)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts + texts[:5])], "doc_id bigint, text string")
    for extra in ("score", "__score", "ROW", "__row", "row_", "file", "At", "start", "__file", "__at", "__from", "key", "order", "a.b", "contaminated"):
        docs = docs.withColumn(extra, F.concat(F.lit(f"{extra}-"), "doc_id"))
    docs.write.parquet(f"{tmp_path}/docs")
    for given in (spark.read.parquet(f"{tmp_path}/docs"), docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, given, folder)
            assert found.columns == docs.columns
            assert all(r[c] == f"{c}-{r['doc_id']}" for r in found.collect() for c in docs.columns[2:])
        assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, given, folder).collect()} == set(range(30))
        assert corpus_pipeline.packing_stage(spark, given, folder).select("doc_id").distinct().count() == 35
