"""Learning and memory tables, mission bookkeeping and the remaining reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..lens import AS_OF, Tables
from ..operators import relational as R
from ..operators.similarity import overlaps

c = F.col


_TOK = "list_distinct(regexp_extract_all(lower(claim), '[a-z]{5,}'))"
_PRED = "SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS k FROM benchmark"
_CLAIM = f"SELECT id AS cid, mission_id AS m, {_TOK} AS k FROM claims WHERE confidence >= .6"


def _shared(t: Tables, least: int) -> DataFrame:
    """a, b, n: pending predictions (the items of benchmark) and strong claims that share so many words."""
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z]{5,}"), 0).alias("words")
    return overlaps(t.benchmark.select(c("item_id").alias("id"), words("text")), t.claims.where("confidence >= 0.6").select("id", words("claim")), least)


@query("fb_validate", f"SELECT id, count(*) AS relevant, CASE WHEN count(*) < 2 THEN 'unresolved' ELSE 'ready' END AS state FROM (SELECT p.id, q.cid FROM ({_PRED}) p, ({_CLAIM}) q WHERE len(list_intersect(p.k, q.k)) >= 2) GROUP BY id", "claims")
def fb_validate(t: Tables) -> DataFrame:
    """How many claims share two words with a prediction."""
    return _shared(t, 2).groupBy(c("a").alias("id")).agg(F.count("*").alias("relevant")).withColumn("state", F.when(c("relevant") < 2, "unresolved").otherwise("ready"))


@query("fb_persist", "SELECT claim_id, CASE WHEN rating = 1 THEN 'prior' ELSE 'graveyard' END AS target FROM feedback", "feedback")
def fb_persist(t: Tables) -> DataFrame:
    return t.feedback.select("claim_id", F.when(c("rating") == 1, "prior").otherwise("graveyard").alias("target"))


@query("fb_load", "SELECT s.mission_id, n, done, blocked FROM (SELECT mission_id, count(*) AS n, count(*) FILTER (status = 'done') AS done, count(*) FILTER (score_accessibility IS NOT NULL AND score_accessibility < 30) AS blocked FROM sources GROUP BY mission_id) s", "sources")
def fb_load(t: Tables) -> DataFrame:
    return t.sources.groupBy("mission_id").agg(F.count("*").alias("n"), F.count_if(c("status") == "done").alias("done"), F.count_if(c("score_accessibility") < 30).alias("blocked"))


_LESSON = "SELECT domain, CASE WHEN avg(score_total) > 70 THEN 'INSIGHT' WHEN avg(score_total) > 50 AND count(*) >= 2 THEN 'SUCCESS' WHEN avg(score_total) < 20 THEN 'FAILURE' END AS lesson FROM sources GROUP BY domain"


def _lessons(t: Tables) -> DataFrame:
    a = t.sources.groupBy("domain").agg(F.avg("score_total").alias("s"), F.count("*").alias("n"))
    return a.select("domain", F.when(c("s") > 70, "INSIGHT").when((c("s") > 50) & (c("n") >= 2), "SUCCESS").when(c("s") < 20, "FAILURE").alias("lesson")).where("lesson is not null")


@query("fb_lessons", f"SELECT * FROM ({_LESSON}) WHERE lesson IS NOT NULL", "sources")
def fb_lessons(t: Tables) -> DataFrame:
    return _lessons(t)


@query("fb_save", f"SELECT domain, lesson FROM ({_LESSON}) WHERE lesson IS NOT NULL AND lesson <> 'FAILURE'", "sources")
def fb_save(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("FAILURE",)], "lesson string")
    return _lessons(t).join(known, "lesson", "left_anti").select("domain", "lesson")


@query("fb_priors", f"SELECT cid AS id, max(n) AS overlap, CASE WHEN max(n) >= 4 THEN 'confirmed' ELSE 'new' END AS outcome FROM (SELECT q.cid, len(list_intersect(p.k, q.k)) AS n FROM ({_PRED}) p, ({_CLAIM}) q) WHERE n >= 3 GROUP BY cid", "claims")
def fb_priors(t: Tables) -> DataFrame:
    """The best overlap of each strong claim with the priors."""
    return _shared(t, 3).groupBy(c("b").alias("id")).agg(F.max("n").alias("overlap")).withColumn("outcome", F.when(c("overlap") >= 4, "confirmed").otherwise("new"))


@query("fb_summary", "SELECT source_tier, count(*) AS total, count(*) FILTER (rating = 1) AS good, count(*) FILTER (rating = -1) AS contradicted FROM feedback GROUP BY source_tier", "feedback")
def fb_summary(t: Tables) -> DataFrame:
    return t.feedback.groupBy("source_tier").agg(F.count("*").alias("total"), F.count_if(c("rating") == 1).alias("good"), F.count_if(c("rating") == -1).alias("contradicted"))


@query("fb_pending", "SELECT id, extracted_at FROM claims WHERE is_garbage IS NULL ORDER BY extracted_at, id LIMIT 50", "claims")
def fb_pending(t: Tables) -> DataFrame:
    return t.claims.where("is_garbage is null").orderBy("extracted_at", "id").limit(50).select("id", "extracted_at")


@query("fb_close", "SELECT m.id, count(k.id) AS claims FROM (SELECT id, created_at FROM missions WHERE status = 'done' ORDER BY created_at DESC, id LIMIT 20) m LEFT JOIN claims k ON k.mission_id = m.id GROUP BY m.id", "missions claims")
def fb_close(t: Tables) -> DataFrame:
    m = t.missions.where("status = 'done'").orderBy(c("created_at").desc(), "id").limit(20).select("id")
    return m.join(t.claims.groupBy(c("mission_id").alias("id")).agg(F.count("*").alias("claims")), "id", "left").fillna(0, ["claims"])


_PROFILE = "SELECT source_operation, round(avg(CASE WHEN rating = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, count(*) AS n FROM feedback GROUP BY source_operation"


def _profile(t: Tables) -> DataFrame:
    return t.feedback.groupBy("source_operation").agg(F.round(F.avg(F.when(c("rating") == 1, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count("*").alias("n"))


@query("cal_profile", _PROFILE, "feedback")
def cal_profile(t: Tables) -> DataFrame:
    return _profile(t)


@query("cal_reco", "SELECT id, CASE WHEN source_type = 'arxiv' THEN 'always use' WHEN score_total >= 45 THEN 'use' WHEN score_total >= 25 THEN 'use with care' ELSE 'avoid' END AS advice FROM sources", "sources")
def cal_reco(t: Tables) -> DataFrame:
    fixed = F.try_element_at(F.create_map(F.lit("arxiv"), F.lit("always use")), c("source_type"))
    return t.sources.select("id", F.coalesce(fixed, F.when(c("score_total") >= 45, "use").when(c("score_total") >= 25, "use with care").otherwise("avoid")).alias("advice"))


@query("cal_render", f"SELECT string_agg(source_operation || ': ' || n, chr(10) ORDER BY source_operation) AS block FROM ({_PROFILE})", "feedback")
def cal_render(t: Tables) -> DataFrame:
    line = F.concat_ws(": ", "source_operation", c("n").cast("string"))
    return _profile(t).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_operation", line.alias("x")))), lambda x: x["x"]), "\n").alias("block"))


@query("pr_depth", "SELECT id, CASE WHEN quality_confidence >= .8 THEN .85 WHEN quality_confidence >= .5 THEN 1.0 WHEN quality_confidence >= .3 THEN 1.15 ELSE 1.3 END::DOUBLE AS depth FROM missions", "missions")
def pr_depth(t: Tables) -> DataFrame:
    q = c("quality_confidence")
    return t.missions.select("id", F.when(q >= 0.8, 0.85).when(q >= 0.5, 1.0).when(q >= 0.3, 1.15).otherwise(1.3).alias("depth"))


@query("pr_match", "SELECT p_brand, round(max(j), 6) AS best FROM (SELECT p_brand, len(list_intersect(k, ['small', 'steel', 'tin']))::DOUBLE / len(list_distinct(list_concat(k, ['small', 'steel', 'tin']))) AS j FROM (SELECT p_brand, list_distinct(string_split(lower(p_type), ' ')) AS k FROM part)) WHERE j > .25 GROUP BY p_brand")
def pr_match(t: Tables) -> DataFrame:
    k, q = F.array_distinct(F.split(F.lower("p_type"), " ")), F.array(*map(F.lit, ("small", "steel", "tin")))
    return t.part.select("p_brand", (F.size(F.array_intersect(k, q)) / F.size(F.array_union(k, q))).alias("j")).where("j > 0.25").groupBy("p_brand").agg(F.round(F.max("j"), 6).alias("best"))


@query("pr_build", "SELECT mission_id, string_agg(domain, ',' ORDER BY s DESC, domain) AS top_domains FROM (SELECT mission_id, domain, max(score_total) AS s FROM sources GROUP BY mission_id, domain QUALIFY row_number() OVER (PARTITION BY mission_id ORDER BY max(score_total) DESC, domain) <= 5) GROUP BY mission_id", "sources")
def pr_build(t: Tables) -> DataFrame:
    best = R.top_per_group(t.sources.groupBy("mission_id", "domain").agg(F.max("score_total").alias("s")), ["mission_id"], [c("s").desc(), c("domain")], 5)
    return best.groupBy("mission_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("s")).alias("k"), "domain"))), lambda x: x["domain"]), ",").alias("top_domains"))


@query("pr_gaps", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' AND o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 20")
def pr_gaps(t: Tables) -> DataFrame:
    return t.orders.where("o_orderpriority <> '4-NOT SPECIFIED' and o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("pr_entities", "SELECT value, count(*) AS n FROM entities WHERE entity_type IN ('SMALL', 'LARGE', 'ECONOMY', 'PROMO', 'STANDARD') GROUP BY value ORDER BY n DESC, value LIMIT 10", "entities")
def pr_entities(t: Tables) -> DataFrame:
    return t.entities.where(c("entity_type").isin("SMALL", "LARGE", "ECONOMY", "PROMO", "STANDARD")).groupBy("value").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "value").limit(10)


@query("gap_context", "SELECT * FROM ((SELECT 'entity' AS kind, value AS what, count(*)::DOUBLE AS score FROM entities GROUP BY value ORDER BY score DESC, what LIMIT 20) UNION ALL (SELECT 'claim', id::VARCHAR, confidence FROM claims WHERE confidence >= .7 ORDER BY confidence DESC, id LIMIT 10))", "entities claims")
def gap_context(t: Tables) -> DataFrame:
    e = t.entities.groupBy(c("value").alias("what")).agg(F.count("*").cast("double").alias("score")).orderBy(c("score").desc(), "what").limit(20).select(F.lit("entity").alias("kind"), "what", "score")
    k = t.claims.where("confidence >= 0.7").orderBy(c("confidence").desc(), "id").limit(10).select(F.lit("claim").alias("kind"), c("id").cast("string").alias("what"), c("confidence").alias("score"))
    return e.unionByName(k)


@query("gap_open", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 25")
def gap_open(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderkey").limit(25).select("o_orderkey")


@query("is_topclaims", "SELECT id, confidence FROM claims WHERE confidence >= .55 ORDER BY confidence DESC, id LIMIT 30", "claims")
def is_topclaims(t: Tables) -> DataFrame:
    return t.claims.where("confidence >= 0.55").orderBy(c("confidence").desc(), "id").limit(30).select("id", "confidence")


@query("is_recent", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 10")
def is_recent(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").orderBy(c("ts").desc(), "event_id").limit(10).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("is_latest", "SELECT id, created_at FROM missions ORDER BY created_at DESC, id LIMIT 1", "missions")
def is_latest(t: Tables) -> DataFrame:
    return t.missions.orderBy(c("created_at").desc(), "id").limit(1).select("id", "created_at")


@query("is_topics", "SELECT mission_id, count(*) AS n FROM claims GROUP BY mission_id ORDER BY n DESC, mission_id LIMIT 10", "claims")
def is_topics(t: Tables) -> DataFrame:
    return t.claims.groupBy("mission_id").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "mission_id").limit(10)


@query("bee_summary", "SELECT source_tier, id FROM (SELECT * FROM claims ORDER BY confidence DESC, id LIMIT 60) QUALIFY row_number() OVER (PARTITION BY source_tier ORDER BY confidence DESC, id) <= 5", "claims")
def bee_summary(t: Tables) -> DataFrame:
    top = t.claims.orderBy(c("confidence").desc(), "id").limit(60).select("source_tier", "id", "confidence")
    return R.top_per_group(top, ["source_tier"], [c("confidence").desc(), c("id")], 5).select("source_tier", "id")


@query("honey", "SELECT * FROM ((SELECT 'claims' AS section, id::VARCHAR AS item FROM claims WHERE confidence >= .6 ORDER BY confidence DESC, id LIMIT 40) UNION ALL (SELECT 'entities', value FROM entities GROUP BY value ORDER BY count(*) DESC, value LIMIT 30) UNION ALL (SELECT 'sources', url FROM sources ORDER BY score_total DESC, id LIMIT 20) UNION ALL (SELECT 'facts', id::VARCHAR FROM facts ORDER BY value DESC, id LIMIT 20))", "claims entities sources facts")
def honey(t: Tables) -> DataFrame:
    """Evidence sections, each a top-k of its own."""
    part = lambda name, d, col, *order, n: d.orderBy(*order).limit(n).select(F.lit(name).alias("section"), c(col).cast("string").alias("item"))
    e = t.entities.groupBy("value").agg(F.count("*").alias("n"))
    parts = [part("claims", t.claims.where("confidence >= 0.6"), "id", c("confidence").desc(), "id", n=40), part("entities", e, "value", c("n").desc(), "value", n=30), part("sources", t.sources, "url", c("score_total").desc(), "id", n=20), part("facts", t.facts, "id", c("value").desc(), "id", n=20)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("mem_stats", "SELECT event_type AS agent, count(*) AS n, count(DISTINCT user_id) AS missions, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY event_type")
def mem_stats(t: Tables) -> DataFrame:
    return t.events.groupBy(c("event_type").alias("agent")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("missions"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query("mem_format", "SELECT string_agg(r || '. ' || claim, chr(10) ORDER BY r) AS block FROM (SELECT claim, row_number() OVER (ORDER BY confidence DESC, id) AS r FROM claims QUALIFY r <= 10)", "claims")
def mem_format(t: Tables) -> DataFrame:
    top = t.claims.orderBy(c("confidence").desc(), "id").limit(10).agg(F.array_sort(F.collect_list(F.struct((-c("confidence")).alias("k"), "id", "claim"))).alias("x"))
    return top.select(F.array_join(F.transform("x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["claim"])), "\n").alias("block"))


_STUCK = f"SELECT id, CASE WHEN status IN ('scout', 'harvest', 'process', 'synth') AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR THEN 'error' ELSE status END AS status FROM missions"


@query("ms_lookup", "SELECT id, topic, CASE WHEN status = 'error' THEN 'synth' ELSE 'done' END AS resume FROM missions WHERE id = 'src5' OR id = 'src12'", "missions")
def ms_lookup(t: Tables) -> DataFrame:
    return t.missions.where(c("id").isin("src5", "src12")).select("id", "topic", F.when(c("status") == "error", "synth").otherwise("done").alias("resume"))


@query("st_stuck", _STUCK, "missions")
def st_stuck(t: Tables) -> DataFrame:
    late = c("created_at") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 2 HOURS")
    return t.missions.select("id", F.when(c("status").isin("scout", "harvest", "process", "synth") & late, "error").otherwise(c("status")).alias("status"))


@query("mcp_views", "SELECT m.id, m.status || ' (' || coalesce(n, 0) || ' claims)' AS line FROM missions m LEFT JOIN (SELECT mission_id, count(*) AS n FROM claims GROUP BY mission_id) k ON k.mission_id = m.id", "missions claims")
def mcp_views(t: Tables) -> DataFrame:
    n = t.claims.groupBy(c("mission_id").alias("id")).agg(F.count("*").alias("n"))
    return t.missions.join(n, "id", "left").select("id", F.concat("status", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" claims)")).alias("line"))


@query("db_health", "SELECT name, n FROM (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem) ORDER BY n DESC, name LIMIT 10")
def db_health(t: Tables) -> DataFrame:
    out = None
    for name in ("documents", "pages", "events", "orders", "lineitem"):
        one = t.base(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(c("n").desc(), "name").limit(10)
