"""Scans, filters, joins, aggregations, windows, top-k, set operations, functions and DML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..lens import AS_OF, Tables, host
from ..operators import relational as R
from ..sources.tables import Store, place

c = F.col


def stored(t: Tables, rows: DataFrame, change) -> DataFrame:
    """``rows`` as a stored table, changed in a transaction and read back."""
    table = Store(t.spark, place(t.spark, "store"))
    table.commit(rows)
    table.transaction(change)
    return table.read()


def now():
    return F.lit(AS_OF).cast("timestamp")


def r6(x):
    return F.round(x, 6)


# Scans and sinks.


@query("src_table", "SELECT id, claim, confidence FROM claims WHERE mission_id = 'src3'", "claims")
def src_table(t: Tables) -> DataFrame:
    return t.claims.where(c("mission_id") == "src3").select("id", "claim", "confidence")


@query("src_duckdb", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def src_duckdb(t: Tables) -> DataFrame:
    return t.orders.where(c("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("src_catalog", "SELECT column_name AS col_name FROM information_schema.columns WHERE table_name = 'documents'")
def src_catalog(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in t.documents.columns], "col_name string")


@query("snk_ignore", "SELECT id, status FROM missions UNION ALL SELECT DISTINCT 'src' || (p_partkey % 40), 'new' FROM part WHERE 'src' || (p_partkey % 40) NOT IN (SELECT id FROM missions)", "missions")
def snk_ignore(t: Tables) -> DataFrame:
    new = t.part.select(F.concat(F.lit("src"), (c("p_partkey") % 40).cast("string")).alias("id"), F.lit("new").alias("status"))
    return stored(t, t.missions.select("id", "status"), lambda table: R.insert_ignore(table, new, ["id"], [c("status")]))


_UPSERT = "SELECT id, n FROM (SELECT id, sources_found AS n, 0 AS k FROM missions UNION ALL SELECT 'src' || (p_partkey % 40), p_partkey, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1"


@query("snk_upsert", _UPSERT, "missions")
def snk_upsert(t: Tables) -> DataFrame:
    new = t.part.select(F.concat(F.lit("src"), (c("p_partkey") % 40).cast("string")).alias("id"), c("p_partkey").alias("n"))
    return stored(t, t.missions.select("id", c("sources_found").alias("n")), lambda table: R.upsert(table, new, ["id"], [c("n").desc()]))


@query("snk_chunk", "SELECT id, CASE WHEN score_total > 20 THEN 'done' ELSE 'failed' END AS status, (row_number() OVER (ORDER BY id) - 1) // 50 AS chunk FROM sources", "sources")
def snk_chunk(t: Tables) -> DataFrame:
    # Ids are dense from 0, so a row's chunk needs no global order.
    return t.sources.select("id", F.when(c("score_total") > 20, "done").otherwise("failed").alias("status"), F.floor(c("id") / 50).alias("chunk"))


@query("snk_graph", "SELECT (SELECT count(DISTINCT value) FROM entities) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT value, mission_id FROM entities)) AS edges", "entities")
def snk_graph(t: Tables) -> DataFrame:
    return t.entities.select("value", "mission_id").distinct().agg(F.count_distinct("value").alias("nodes"), F.count("*").alias("edges"))


@query("snk_report", "SELECT mission_id, '# ' || mission_id || chr(10) || string_agg('- ' || claim, chr(10) ORDER BY confidence DESC, id) AS report FROM (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY mission_id ORDER BY confidence DESC, id) <= 5) GROUP BY mission_id", "claims")
def snk_report(t: Tables) -> DataFrame:
    best = R.top_per_group(t.claims, ["mission_id"], [c("confidence").desc(), c("id")], 5)
    lines = F.array_sort(F.collect_list(F.struct((-c("confidence")).alias("k"), "id", "claim")))
    return best.groupBy("mission_id").agg(lines.alias("x")).select("mission_id", F.concat(F.lit("# "), "mission_id", F.lit("\n"), F.array_join(F.transform("x", lambda x: F.concat(F.lit("- "), x["claim"])), "\n")).alias("report"))


# Filters and projections.


@query("flt_garbage", "SELECT id, claim FROM claims WHERE is_garbage = false OR is_garbage IS NULL", "claims")
def flt_garbage(t: Tables) -> DataFrame:
    return t.claims.where(R.not_garbage(c("is_garbage"))).select("id", "claim")


@query("flt_ilike", "SELECT id, claim, quality_score FROM claims WHERE claim ILIKE '%with%' AND (is_garbage = false OR is_garbage IS NULL) ORDER BY quality_score DESC, id LIMIT 50", "claims")
def flt_ilike(t: Tables) -> DataFrame:
    return t.claims.where(R.contains_ci(c("claim"), "with") & R.not_garbage(c("is_garbage"))).orderBy(c("quality_score").desc(), "id").limit(50).select("id", "claim", "quality_score")


@query("flt_biilike", "SELECT n_name, r_name FROM nation, region WHERE n_name ILIKE '%' || left(r_name, 2) || '%' OR left(r_name, 2) ILIKE '%' || n_name || '%'")
def flt_biilike(t: Tables) -> DataFrame:
    r = t.region.withColumn("short", F.substring("r_name", 1, 2))
    return t.nation.join(r, R.contains_either_way(c("n_name"), c("short"))).select("n_name", "r_name")


@query("flt_or_like", "SELECT id FROM claims WHERE lower(claim) LIKE '%ing%' OR lower(claim) LIKE '%ble%' OR lower(claim) LIKE '%tion%'", "claims")
def flt_or_like(t: Tables) -> DataFrame:
    return t.claims.where(reduce(lambda a, b: a | b, (R.contains_ci(c("claim"), w) for w in ("ing", "ble", "tion")))).select("id")


@query("flt_len", "SELECT id, claim_type FROM claims WHERE length(claim) > 60 AND claim_type <> 'FALSIFICATION'", "claims")
def flt_len(t: Tables) -> DataFrame:
    return t.claims.where((F.length("claim") > 60) & (c("claim_type") != "FALSIFICATION")).select("id", "claim_type")


@query("flt_notin", "SELECT id, status FROM sources WHERE status NOT IN ('failed', 'pending')", "sources")
def flt_notin(t: Tables) -> DataFrame:
    return t.sources.where(~c("status").isin("failed", "pending")).select("id", "status")


@query("flt_like_neg", "SELECT id FROM claims WHERE evidence_flags IS NULL OR evidence_flags NOT LIKE '%cross_validated%'", "claims")
def flt_like_neg(t: Tables) -> DataFrame:
    return t.claims.where(c("evidence_flags").isNull() | ~F.contains(c("evidence_flags"), F.lit("cross_validated"))).select("id")


@query("flt_cte_any", "SELECT id, mission_id FROM claims WHERE mission_id IN (SELECT id FROM missions WHERE status = 'done')", "claims missions")
def flt_cte_any(t: Tables) -> DataFrame:
    return t.claims.join(t.missions.where("status = 'done'").select(c("id").alias("mission_id")), "mission_id", "left_semi").select("id", "mission_id")


@query("flt_unnest_notin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT unnest(list(doc_id)) FROM labels)")
def flt_unnest_notin(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("flt_array_any", "SELECT p_partkey FROM part WHERE 'TIN' = ANY(string_split(p_type, ' ')) OR list_contains(string_split(p_type, ' '), 'STEEL')")
def flt_array_any(t: Tables) -> DataFrame:
    tags = F.split("p_type", " ")
    return t.part.where(F.array_contains(tags, "TIN") | F.array_contains(tags, "STEEL")).select("p_partkey")


@query("flt_age", f"SELECT id FROM claims WHERE extracted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY AND extracted_at < TIMESTAMP '{AS_OF}' - INTERVAL 3 HOUR", "claims")
def flt_age(t: Tables) -> DataFrame:
    return t.claims.where((c("extracted_at") >= now() - F.expr("INTERVAL 45 DAYS")) & (c("extracted_at") < now() - F.expr("INTERVAL 3 HOURS"))).select("id")


@query("flt_relax", "SELECT id, score_total FROM (SELECT *, score_relevance >= 2 AND score_total >= 15 AS strict FROM sources) WHERE strict OR NOT (SELECT bool_or(score_relevance >= 2 AND score_total >= 15) FROM sources) ORDER BY score_total DESC, id LIMIT 300", "sources")
def flt_relax(t: Tables) -> DataFrame:
    return R.relaxing(t.sources.select("id", "score_total", "score_relevance"), (c("score_relevance") >= 2) & (c("score_total") >= 15), [c("score_total").desc(), c("id")], 300, 100).select("id", "score_total")


@query("flt_relax_empty", "SELECT id, score_total FROM sources ORDER BY score_total DESC, id LIMIT 100", "sources")
def flt_relax_empty(t: Tables) -> DataFrame:
    return R.relaxing(t.sources.select("id", "score_total", "score_relevance"), c("score_relevance") >= 2000, [c("score_total").desc(), c("id")], 300, 100).select("id", "score_total")


@query("prj_case", "SELECT id, CASE WHEN quality_score >= .75 THEN 'EXCELLENT' WHEN quality_score >= .6 THEN 'GOOD' WHEN quality_score >= .45 THEN 'FAIR' ELSE 'LOW' END AS label FROM claims", "claims")
def prj_case(t: Tables) -> DataFrame:
    q = c("quality_score")
    return t.claims.select("id", F.when(q >= 0.75, "EXCELLENT").when(q >= 0.6, "GOOD").when(q >= 0.45, "FAIR").otherwise("LOW").alias("label"))


@query("prj_coalesce", "SELECT id, coalesce(evidence_flags, '') AS flags, coalesce(is_garbage, false) AS garbage FROM claims", "claims")
def prj_coalesce(t: Tables) -> DataFrame:
    return t.claims.select("id", F.coalesce("evidence_flags", F.lit("")).alias("flags"), F.coalesce("is_garbage", F.lit(False)).alias("garbage"))


@query("prj_json", "SELECT id, (data->>'$.k')::BIGINT AS k FROM logs", "logs")
def prj_json(t: Tables) -> DataFrame:
    return t.logs.select("id", F.from_json("data", "k bigint")["k"].alias("k"))


@query("prj_cast", "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS p, TRY_CAST(o_orderpriority AS DOUBLE) AS bad, o_totalprice::BIGINT::VARCHAR AS s FROM (SELECT o_orderkey, o_orderpriority, floor(o_totalprice) AS o_totalprice FROM orders)")
def prj_cast(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.split("o_orderpriority", "-")[0].try_cast("int").alias("p"), c("o_orderpriority").try_cast("double").alias("bad"), F.floor("o_totalprice").cast("string").alias("s"))


# Joins.


@query("jn_left_agg", "SELECT m.id, coalesce(n, 0) AS n, coalesce(q, 0) AS q FROM missions m LEFT JOIN (SELECT mission_id, count(*) AS n, round(avg(quality_score), 6) AS q FROM claims GROUP BY mission_id) ON m.id = mission_id", "missions claims")
def jn_left_agg(t: Tables) -> DataFrame:
    a = t.claims.groupBy(c("mission_id").alias("id")).agg(F.count("*").alias("n"), r6(F.avg("quality_score")).alias("q"))
    return t.missions.select("id").join(a, "id", "left").fillna(0, ["n", "q"])


@query("jn_left_2key", "SELECT k.id, c.language FROM claims k LEFT JOIN content c ON k.source_url = c.url AND k.mission_id = c.mission_id", "claims content")
def jn_left_2key(t: Tables) -> DataFrame:
    return t.claims.select("id", c("source_url").alias("url"), "mission_id").join(t.content.select("url", "mission_id", "language"), ["url", "mission_id"], "left").select("id", "language")


@query("jn_left_cast", "SELECT d.title, q.quality FROM content d LEFT JOIN labels q ON TRY_CAST(split_part(d.title, ' ', 2) AS BIGINT) = q.doc_id", "content")
def jn_left_cast(t: Tables) -> DataFrame:
    return t.content.select("title", F.split("title", " ")[1].try_cast("bigint").alias("doc_id")).join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("title", "quality")


@query("jn_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def jn_inner(t: Tables) -> DataFrame:
    k = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")
    return t.orders.join(k, c("o_custkey") == c("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("jn_anti_seen", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn_anti_seen(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("jn_semi_any", "SELECT DISTINCT mission_id FROM entities WHERE mission_id IN (SELECT mission_id FROM entities WHERE value = 'Brand#1')", "entities")
def jn_semi_any(t: Tables) -> DataFrame:
    return t.entities.select("mission_id").distinct().join(t.entities.where("value = 'Brand#1'"), "mission_id", "left_semi")


_COOC = "SELECT a.value AS a, b.value AS b, count(DISTINCT a.mission_id) AS n FROM entities a JOIN entities b ON a.mission_id = b.mission_id AND a.value < b.value GROUP BY ALL"


@query("jn_self_cooc", _COOC, "entities")
def jn_self_cooc(t: Tables) -> DataFrame:
    e = t.entities.select("mission_id", "value").distinct()
    return e.withColumnRenamed("value", "a").join(e.withColumnRenamed("value", "b"), "mission_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("jn_prefix", "SELECT a.p_partkey AS a, b.s_suppkey AS b FROM part a JOIN supplier b ON starts_with(a.p_partkey::VARCHAR, b.s_suppkey::VARCHAR) OR starts_with(b.s_suppkey::VARCHAR, a.p_partkey::VARCHAR)")
def jn_prefix(t: Tables) -> DataFrame:
    """Ids of which one starts with the other: joined on the prefixes of the longer one."""
    a = t.part.select(c("p_partkey").alias("a"), c("p_partkey").cast("string").alias("x"))
    b = t.supplier.select(c("s_suppkey").alias("b"), c("s_suppkey").cast("string").alias("x"))
    shorter = a.join(R.proper_prefixes(b, "x"), "x").select("a", "b")
    return R.proper_prefixes(a, "x").join(b, "x").select("a", "b").unionByName(shorter).unionByName(a.join(b, "x").select("a", "b"))


@query("jn_lookup", "SELECT o_orderkey, coalesce(m.canon, o_orderpriority) AS priority FROM orders LEFT JOIN (VALUES ('1-URGENT', 'top'), ('5-LOW', 'rest')) m(name, canon) ON o_orderpriority = name")
def jn_lookup(t: Tables) -> DataFrame:
    alias = F.create_map(*map(F.lit, ("1-URGENT", "top", "5-LOW", "rest")))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(alias, c("o_orderpriority")), c("o_orderpriority")).alias("priority"))


@query("jn_derived", "SELECT domain, n FROM (SELECT domain, count(*) AS n FROM sources GROUP BY domain) WHERE n >= 3", "sources")
def jn_derived(t: Tables) -> DataFrame:
    return t.sources.groupBy("domain").agg(F.count("*").alias("n")).where("n >= 3")


# Aggregations.


@query("agg_basic", "SELECT mission_id, count(*) AS n, round(avg(confidence), 6) AS avg_c, round(sum(quality_score), 4) AS sum_q, min(confidence) AS lo, max(confidence) AS hi FROM claims GROUP BY mission_id", "claims")
def agg_basic(t: Tables) -> DataFrame:
    return t.claims.groupBy("mission_id").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("avg_c"), F.round(F.sum("quality_score"), 4).alias("sum_q"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))


@query("agg_cntd", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")
def agg_cntd(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@query("agg_distinct", "SELECT DISTINCT entity_type, value FROM entities", "entities")
def agg_distinct(t: Tables) -> DataFrame:
    return t.entities.select("entity_type", "value").distinct()


@query("agg_filter", "SELECT count(*) FILTER (quality_score >= .8) AS high, count(*) FILTER (quality_score >= .5 AND quality_score < .8) AS mid, count(*) FILTER (quality_score < .5) AS low FROM claims", "claims")
def agg_filter(t: Tables) -> DataFrame:
    q = c("quality_score")
    return t.claims.agg(F.count_if(q >= 0.8).alias("high"), F.count_if((q >= 0.5) & (q < 0.8)).alias("mid"), F.count_if(q < 0.5).alias("low"))


@query("agg_filter_ratio", "SELECT source_operation, count(*) FILTER (rating = 1) / count(*)::DOUBLE AS fitness, count(*) AS n FROM feedback GROUP BY source_operation HAVING count(*) >= 5", "feedback")
def agg_filter_ratio(t: Tables) -> DataFrame:
    return t.feedback.groupBy("source_operation").agg((F.count_if(c("rating") == 1) / F.count("*")).alias("fitness"), F.count("*").alias("n")).where("n >= 5")


@query("agg_having", "SELECT domain, count(*) AS cnt, avg(score_total)::DOUBLE AS avg_score FROM sources GROUP BY domain HAVING count(*) >= 2 AND avg(score_total) > 45", "sources")
def agg_having(t: Tables) -> DataFrame:
    return t.sources.groupBy("domain").agg(F.count("*").alias("cnt"), F.avg("score_total").alias("avg_score")).where("cnt >= 2 AND avg_score > 45")


@query("agg_case_sum", "SELECT source_tier, sum(CASE WHEN rating = 1 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS accuracy FROM feedback GROUP BY source_tier", "feedback")
def agg_case_sum(t: Tables) -> DataFrame:
    return t.feedback.groupBy("source_tier").agg(F.avg(F.when(c("rating") == 1, 1.0).otherwise(0.0)).alias("accuracy"))


@query("agg_case_avg", r"SELECT regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '[/?#].*$', '') AS h, round(avg(CASE WHEN length(html) > 3000 THEN 1.0 ELSE 0.2 END), 6) AS s FROM pages GROUP BY h")
def agg_case_avg(t: Tables) -> DataFrame:
    h = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.)?", ""), r"[/?#].*$", "")
    return t.pages.groupBy(h.alias("h")).agg(r6(F.avg(F.when(F.length("html") > 3000, 1.0).otherwise(0.2))).alias("s"))


@query("agg_median", "SELECT mission_id, quantile_cont(word_count, 0.5)::DOUBLE AS med FROM content GROUP BY mission_id", "content")
def agg_median(t: Tables) -> DataFrame:
    return t.content.groupBy("mission_id").agg(F.percentile("word_count", 0.5).alias("med"))


@query("agg_ratio_null", "SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0 THEN l_tax / l_discount END), 6) AS ratio FROM lineitem GROUP BY l_returnflag")
def agg_ratio_null(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.avg(F.when(c("l_discount") > 0, F.try_divide("l_tax", "l_discount")))).alias("ratio"))


@query("agg_stdev", "SELECT unit, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM facts GROUP BY unit", "facts")
def agg_stdev(t: Tables) -> DataFrame:
    return t.facts.groupBy("unit").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"))


@query("agg_mode", "SELECT value, arg_min(entity_type, (-n, entity_type)) AS kind FROM (SELECT value, entity_type, count(*) AS n FROM entities GROUP BY ALL) GROUP BY value", "entities")
def agg_mode(t: Tables) -> DataFrame:
    n = t.entities.groupBy("value", "entity_type").agg(F.count("*").alias("n"))
    return n.groupBy("value").agg(F.min_by("entity_type", F.struct(-c("n"), "entity_type")).alias("kind"))


@query("agg_topfreq", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(claim, '[A-Z][a-z]+')) AS word FROM claims) GROUP BY word ORDER BY n DESC, word LIMIT 20", "claims")
def agg_topfreq(t: Tables) -> DataFrame:
    return t.claims.select(F.explode(F.regexp_extract_all("claim", F.lit("[A-Z][a-z]+"), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "word").limit(20)


@query("agg_unnest", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY tag")
def agg_unnest(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_type", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("agg_collect", "SELECT value, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS kinds FROM entities GROUP BY value", "entities")
def agg_collect(t: Tables) -> DataFrame:
    # Types are few, so a value's set of them stays small.
    return t.entities.groupBy("value").agg(F.concat_ws(",", F.array_sort(F.collect_set("entity_type"))).alias("kinds"))


@query("agg_counter", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def agg_counter(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count().fillna(0).toDF("o_orderstatus", "urgent", "low")


@query("agg_dashboard", "SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM claims) AS claims, (SELECT count(*) FROM missions WHERE status = 'done') AS done, (SELECT count(*) FROM labels WHERE quality = 0) AS bad", "claims missions")
def agg_dashboard(t: Tables) -> DataFrame:
    parts = [("docs", t.documents), ("pages", t.pages), ("events", t.events), ("claims", t.claims), ("done", t.missions.where("status = 'done'")), ("bad", t.labels.where("quality = 0"))]
    tall = reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, d in parts))
    return tall.agg(*(F.max(F.when(c("k") == k, c("n"))).alias(k) for k, _ in parts))


@query("agg_scalar_subq", "SELECT md5((SELECT count(*) FROM claims) || '|' || (SELECT max(id) FROM claims) || '|' || (SELECT count(*) FROM entities)) AS state", "claims entities")
def agg_scalar_subq(t: Tables) -> DataFrame:
    a, b = t.claims.agg(F.count("*").alias("n"), F.max("id").alias("m")), t.entities.agg(F.count("*").alias("e"))
    return a.crossJoin(b).select(F.md5(F.concat_ws("|", *(c(x).cast("string") for x in "nme")).cast("binary")).alias("state"))


@query("agg_latest", "SELECT mission_id, arg_max(value, id) AS value, arg_max(phase, id) AS phase FROM logs WHERE value IS NOT NULL GROUP BY mission_id", "logs")
def agg_latest(t: Tables) -> DataFrame:
    return t.logs.where("value is not null").groupBy("mission_id").agg(F.max_by("value", "id").alias("value"), F.max_by("phase", "id").alias("phase"))


# Windows.


@query("win_rank", "SELECT id, mission_id, row_number() OVER (PARTITION BY mission_id ORDER BY score_total DESC, id) AS rank FROM sources", "sources")
def win_rank(t: Tables) -> DataFrame:
    return t.sources.select("id", "mission_id", F.row_number().over(Window.partitionBy("mission_id").orderBy(c("score_total").desc(), "id")).cast("bigint").alias("rank"))


@query("win_topk_grp", "SELECT source_tier, id, confidence FROM claims QUALIFY row_number() OVER (PARTITION BY source_tier ORDER BY confidence DESC, id) <= 5", "claims")
def win_topk_grp(t: Tables) -> DataFrame:
    return R.top_per_group(t.claims.select("source_tier", "id", "confidence"), ["source_tier"], [c("confidence").desc(), c("id")], 5)


@query("win_outlier", "SELECT id, coalesce(n >= 3 AND sd > 0 AND abs(value - m) > 2 * sd, false) AS is_outlier FROM (SELECT id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM facts WINDOW w AS (PARTITION BY unit))", "facts")
def win_outlier(t: Tables) -> DataFrame:
    return R.outlier(t.facts.select("id", "unit", "value"), "unit", "value").select("id", "is_outlier")


_STREAK = "SELECT id, mission_id, sum(1 - good) OVER (PARTITION BY mission_id, run ORDER BY id)::BIGINT AS streak FROM (SELECT *, sum(good) OVER (PARTITION BY mission_id ORDER BY id) AS run FROM (SELECT id, mission_id, (value >= 20)::INTEGER AS good FROM logs))"


@query("win_streak", _STREAK, "logs")
def win_streak(t: Tables) -> DataFrame:
    return R.bad_streak(t.logs.select("id", "mission_id", "value"), ["mission_id"], [c("id")], c("value") >= 20).select("id", "mission_id", "streak")


@query("win_dedup_first", "SELECT id FROM claims QUALIFY row_number() OVER (PARTITION BY lower(substr(claim, 1, 100)) ORDER BY confidence DESC, id) = 1", "claims")
def win_dedup_first(t: Tables) -> DataFrame:
    return R.first_per_key(t.claims.select("id", "confidence", F.lower(F.substring("claim", 1, 100)).alias("k")), ["k"], [c("confidence").desc(), c("id")]).select("id")


@query("win_first_seen", "SELECT domain, max(score_total) AS best FROM sources GROUP BY domain ORDER BY best DESC, domain LIMIT 50", "sources")
def win_first_seen(t: Tables) -> DataFrame:
    return t.sources.groupBy("domain").agg(F.max("score_total").alias("best")).orderBy(c("best").desc(), "domain").limit(50)


# Sort, limit, top-k.


@query("top_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_order_limit(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(25)


@query("top_offset", "SELECT id, created_at FROM missions ORDER BY created_at DESC, id LIMIT 5 OFFSET 5", "missions")
def top_offset(t: Tables) -> DataFrame:
    return t.missions.select("id", "created_at").orderBy(c("created_at").desc(), "id").offset(5).limit(5)


@query("top_nulls", "SELECT id, score_accessibility FROM sources ORDER BY score_accessibility DESC NULLS LAST, id LIMIT 40", "sources")
def top_nulls(t: Tables) -> DataFrame:
    return t.sources.select("id", "score_accessibility").orderBy(c("score_accessibility").desc_nulls_last(), "id").limit(40)


@query("top_multi", "SELECT value, count(*) AS cnt, round(max(confidence), 6) AS conf FROM entities GROUP BY value ORDER BY cnt DESC, conf DESC, value LIMIT 20", "entities")
def top_multi(t: Tables) -> DataFrame:
    return t.entities.groupBy("value").agg(F.count("*").alias("cnt"), r6(F.max("confidence")).alias("conf")).orderBy(c("cnt").desc(), c("conf").desc(), "value").limit(20)


@query("top_enum", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 30")
def top_enum(t: Tables) -> DataFrame:
    rank = F.when(c("o_orderpriority") == "1-URGENT", 0).when(c("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return t.orders.orderBy(rank, c("o_totalprice").desc(), "o_orderkey").limit(30).select("o_orderkey", "o_orderpriority")


@query("top_cap", "SELECT id, word_count FROM content ORDER BY word_count DESC, id LIMIT 500", "content")
def top_cap(t: Tables) -> DataFrame:
    return t.content.select("id", "word_count").orderBy(c("word_count").desc(), "id").limit(500)


# Sets.

_WORDS = "list_sort(list_distinct(string_split(lower({}), ' ')))"


def _pairs(t: Tables) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("p_type"), " "))
    a = t.part.select(c("p_partkey").alias("a"), "p_size", words.alias("x"))
    b = t.part.select((c("p_partkey") - 1).alias("a"), words.alias("y"))
    return a.join(b, "a")


_PAIRS = "FROM (SELECT p_partkey AS a, list_distinct(string_split(lower(p_type), ' ')) AS x FROM part) JOIN (SELECT p_partkey - 1 AS a, list_distinct(string_split(lower(p_type), ' ')) AS y FROM part) USING (a)"


@query("set_jaccard", f"SELECT a, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS j {_PAIRS}")
def set_jaccard(t: Tables) -> DataFrame:
    return _pairs(t).select("a", r6(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("j"))


@query("set_overlap", f"SELECT a, len(list_intersect(x, y)) AS n {_PAIRS}")
def set_overlap(t: Tables) -> DataFrame:
    return _pairs(t).select("a", F.size(F.array_intersect("x", "y")).cast("bigint").alias("n"))


@query("set_union_dedup", "SELECT id, max(s) AS score FROM (SELECT id, score_total AS s FROM sources WHERE score_relevance > 10 UNION ALL SELECT id, score_relevance * 4 FROM sources WHERE score_total > 50) GROUP BY id ORDER BY score DESC, id LIMIT 15", "sources")
def set_union_dedup(t: Tables) -> DataFrame:
    s = t.sources
    both = s.where("score_relevance > 10").select("id", c("score_total").alias("s")).unionByName(s.where("score_total > 50").select("id", (c("score_relevance") * 4).alias("s")))
    return both.groupBy("id").agg(F.max("s").alias("score")).orderBy(c("score").desc(), "id").limit(15)


@query("set_diff_lift", f"SELECT a, round(len(list_filter(x, lambda v: NOT list_contains(y, v))) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS lift {_PAIRS}")
def set_diff_lift(t: Tables) -> DataFrame:
    return _pairs(t).select("a", r6(F.size(F.array_except("x", "y")) / F.size(F.array_union("x", "y"))).alias("lift"))


@query("set_concat_stage", "SELECT id, 'auto' AS stage FROM sources WHERE score_total >= 60 UNION ALL SELECT id, 'passed' FROM sources WHERE score_total < 60 AND score_relevance >= 5", "sources")
def set_concat_stage(t: Tables) -> DataFrame:
    return t.sources.select("id", F.when(c("score_total") >= 60, "auto").when(c("score_relevance") >= 5, "passed").alias("stage")).where("stage is not null")


# Scalar functions.


@query("fn_str", "SELECT id, lower(claim) AS lo, length(claim) AS n, coalesce(evidence_flags || ',', '') || 'seen' AS flags FROM claims WHERE claim ILIKE 'th%'", "claims")
def fn_str(t: Tables) -> DataFrame:
    return t.claims.where(c("claim").ilike("th%")).select("id", F.lower("claim").alias("lo"), F.length("claim").cast("bigint").alias("n"), F.concat_ws(",", "evidence_flags", F.lit("seen")).alias("flags"))


@query("fn_regex", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[0-9]+', '#', 'g') AS shape FROM pages")
def fn_regex(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[0-9]+", "#").alias("shape"))


@query("fn_math", "SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, l_discount * 20 - 0.3)), 4) AS v FROM lineitem")
def fn_math(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("l_discount") * 20 - 0.3)), 4).alias("v"))


@query("fn_date", f"SELECT id, strftime(extracted_at, '%Y-%m-%d') AS day, date_diff('day', extracted_at, TIMESTAMP '{AS_OF}') AS age FROM claims", "claims")
def fn_date(t: Tables) -> DataFrame:
    return t.claims.select("id", F.date_format("extracted_at", "yyyy-MM-dd").alias("day"), F.datediff(now(), "extracted_at").cast("bigint").alias("age"))


@query("fn_array", "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'TIN') AS tin, array_to_string(list_append(string_split(p_type, ' '), p_brand), '|') AS tags FROM part")
def fn_array(t: Tables) -> DataFrame:
    tags = F.split("p_type", " ")
    return t.part.select("p_partkey", F.array_contains(tags, "TIN").alias("tin"), F.array_join(F.array_append(tags, c("p_brand")), "|").alias("tags"))


@query("fn_hash", "SELECT doc_id, md5(text) AS m, left(sha256(text), 32) AS s FROM documents")
def fn_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(c("text").cast("binary")).alias("m"), F.substring(F.sha2(c("text").cast("binary"), 256), 1, 32).alias("s"))


@query("fn_json", """SELECT id, '{"id":' || id || ',"phase":"' || phase || '"}' AS j FROM logs""", "logs")
def fn_json(t: Tables) -> DataFrame:
    return t.logs.select("id", F.to_json(F.struct("id", "phase")).alias("j"))


# DML.


@query("dml_update", "SELECT m.id, coalesce(CASE WHEN n > 100 THEN 'big' END, status) AS status FROM missions m LEFT JOIN (SELECT mission_id, count(*) AS n FROM claims GROUP BY mission_id) ON id = mission_id", "missions claims")
def dml_update(t: Tables) -> DataFrame:
    new = t.claims.groupBy(c("mission_id").alias("id")).agg(F.when(F.count("*") > 100, "big").alias("status"))
    return stored(t, t.missions.select("id", "status"), lambda table: R.keyed_update(table, new, "id", ["status"]))


@query("dml_insert_ret", "SELECT left(sha256(event_type || ':' || event_id), 16) AS id, event_type FROM events")
def dml_insert_ret(t: Tables) -> DataFrame:
    """Ids are computed from the rows, so they can be returned without a look at the store; what is stored is what is returned."""
    rows = t.events.select(F.substring(F.sha2(F.concat_ws(":", "event_type", c("event_id").cast("string")), 256), 1, 16).alias("id"), "event_type")
    return stored(t, rows.limit(0), lambda table: table.unionByName(rows))


@query("dml_delete_ins", "SELECT id, status FROM missions WHERE status <> 'error' UNION ALL SELECT 'fresh', 'error'", "missions")
def dml_delete_ins(t: Tables) -> DataFrame:
    new = t.spark.createDataFrame([("fresh", "error")], "id string, status string")
    return stored(t, t.missions.select("id", "status"), lambda table: table.join(new.select("status").distinct(), "status", "left_anti").select("id", "status").unionByName(new))


@query("dml_alter", "SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation")
def dml_alter(t: Tables) -> DataFrame:
    return stored(t, t.nation.select("n_nationkey", "n_name"), lambda table: R.with_columns_if_missing(table, {"note": "string", "n_name": "string"}))


@query("host", "SELECT id, domain FROM sources", "sources")
def host_(t: Tables) -> DataFrame:
    return t.pages.select(c("page_id").alias("id"), host(c("url")).alias("domain"))
