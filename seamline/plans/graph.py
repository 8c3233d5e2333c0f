"""Knowledge-graph queries: entities of orders as a graph of brands, types and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..lens import Tables
from ..operators import graph as G
from ..operators import relational as R
from ..storage import written
from .similarity import CONTAINS_SQL, mentions

c = F.col

#: Sources of betweenness, as many as the reference samples.
SOURCES = 150


_NODES = "SELECT 'mission' AS kind, id::VARCHAR AS id FROM missions UNION ALL SELECT DISTINCT 'entity', value FROM entities WHERE confidence >= .65 UNION ALL SELECT 'claim', id::VARCHAR FROM claims WHERE confidence >= .6"


def _nodes(t: Tables) -> DataFrame:
    e = t.entities.where("confidence >= 0.65").select(F.lit("entity").alias("kind"), c("value").alias("id")).distinct()
    k = t.claims.where("confidence >= 0.6").select(F.lit("claim").alias("kind"), c("id").cast("string").alias("id"))
    return t.missions.select(F.lit("mission").alias("kind"), "id").unionByName(e).unionByName(k)


@query("kg_vertices", _NODES, "missions entities claims")
def kg_vertices(t: Tables) -> DataFrame:
    return _nodes(t)


@query("kg_belongs", "SELECT id AS src, mission_id AS dst FROM claims WHERE confidence >= .6", "claims")
def kg_belongs(t: Tables) -> DataFrame:
    return t.claims.where("confidence >= 0.6").select(c("id").alias("src"), c("mission_id").alias("dst"))


@query("kg_mentions", f"SELECT name AS src, id AS dst FROM ({CONTAINS_SQL.format(8)})", "claims")
def kg_mentions(t: Tables) -> DataFrame:
    return mentions(t, 8).toDF("src", "dst")


_CO = "SELECT a, b, n, least(n / 10.0, 3.0)::DOUBLE AS weight FROM (SELECT x.value AS a, y.value AS b, count(DISTINCT x.mission_id) AS n FROM entities x JOIN entities y ON x.mission_id = y.mission_id AND x.value < y.value GROUP BY ALL) WHERE n >= 3"


def _co(t: Tables) -> DataFrame:
    return G.cooccurrence(t.entities.select(c("mission_id").alias("group"), "value"))


@query("kg_cooccur", f"SELECT a AS src, b AS dst, weight FROM ({_CO}) UNION ALL SELECT b, a, weight FROM ({_CO})", "entities")
def kg_cooccur(t: Tables) -> DataFrame:
    e = _co(t)
    return e.select(c("a").alias("src"), c("b").alias("dst"), "weight").unionByName(e.select(c("b").alias("src"), c("a").alias("dst"), "weight"))


@query("kg_appears", "SELECT value AS src, entity_type AS dst, count(*) AS n FROM entities GROUP BY ALL HAVING count(*) >= 5", "entities")
def kg_appears(t: Tables) -> DataFrame:
    return t.entities.groupBy(c("value").alias("src"), c("entity_type").alias("dst")).agg(F.count("*").alias("n")).where("n >= 5")


_EDGES = "SELECT p_brand AS src, p_type AS dst, count(*)::DOUBLE AS weight FROM part GROUP BY ALL UNION ALL SELECT p_type, 'size ' || p_size, count(*)::DOUBLE FROM part GROUP BY ALL"


def _edges(t: Tables) -> DataFrame:
    """Brands to types to sizes; sizes are dangling."""
    one = lambda d, a, b: d.groupBy(a.alias("src"), b.alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return one(t.part, c("p_brand"), c("p_type")).unionByName(one(t.part, c("p_type"), F.concat(F.lit("size "), c("p_size").cast("string"))))


def _pagerank(rounds: int, edges: str = _EDGES) -> str:
    """Rounds spelled out one after another."""
    steps = ", ".join(
        f"r{k + 1} AS (SELECT v.id, .15 / (SELECT count(*) FROM v) + .85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM v)) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM s JOIN r{k} ON r{k}.id = s.src GROUP BY dst) g ON g.dst = v.id)"
        for k in range(rounds)
    )
    return f"WITH e AS ({edges}), s AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v), {steps} SELECT id, round(rank, 6)::DOUBLE AS rank FROM r{rounds}"


@query("kg_pagerank", _pagerank(20))
def kg_pagerank(t: Tables) -> DataFrame:
    return G.pagerank(_edges(t), 20).select("id", F.round("rank", 6).alias("rank"))


@query("kg_betweenness")
def kg_betweenness(t: Tables) -> DataFrame:
    """Shortest paths from SOURCES vertices of the whole graph, those with the smallest hash; from all where there are no more."""
    edges = written(_edges(t), "edges")
    ids = edges.select(c("src").alias("id")).unionByName(edges.select(c("dst").alias("id"))).where("id is not null").distinct()
    sources = [r.id for r in ids.orderBy(F.xxhash64("id"), "id").limit(SOURCES).collect()]
    return G.betweenness(edges, sources).select("id", F.round("score", 6).alias("score"))


_PATH = f"WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})), p(id, hops) AS (SELECT 'Brand#1', 0 UNION SELECT dst, hops + 1 FROM p JOIN e ON e.src = p.id WHERE hops < (SELECT count(DISTINCT src) FROM e)) SELECT id, min(hops) AS hops FROM p GROUP BY id"


@query("kg_path", _PATH)
def kg_path(t: Tables) -> DataFrame:
    return G.distances(_edges(t), "Brand#1")


@query("kg_query", "SELECT kind, id FROM (" + _NODES + ") WHERE contains(lower(id), 'brand#1') ORDER BY kind, id LIMIT 20", "missions entities claims")
def kg_query(t: Tables) -> DataFrame:
    return _nodes(t).where(R.contains_ci(c("id"), "brand#1")).orderBy("kind", "id").limit(20)


@query("kg_comm", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 5")
def kg_comm(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "label").limit(5)


@query("kg_comm_info", "SELECT mission_id, n, string_agg(id, ',' ORDER BY confidence DESC, id) AS top FROM (SELECT *, count(*) OVER (PARTITION BY mission_id) AS n, row_number() OVER (PARTITION BY mission_id ORDER BY confidence DESC, id) AS r FROM claims) WHERE r <= 8 AND n >= 3 GROUP BY mission_id, n", "claims")
def kg_comm_info(t: Tables) -> DataFrame:
    k = t.claims.select("mission_id", "id", "confidence")
    n = k.groupBy("mission_id").agg(F.count("*").alias("n")).where("n >= 3")
    best = R.top_per_group(k, ["mission_id"], [c("confidence").desc(), c("id")], 8)
    top = best.groupBy("mission_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("confidence")).alias("x"), "id"))), lambda x: x["id"].cast("string")), ",").alias("top"))
    return n.join(top, "mission_id")


@query("kg_context", "SELECT id, confidence FROM claims WHERE mission_id = 'src1' ORDER BY confidence DESC, id LIMIT 10", "claims")
def kg_context(t: Tables) -> DataFrame:
    return t.claims.where("mission_id = 'src1'").orderBy(c("confidence").desc(), "id").limit(10).select("id", "confidence")


_BOTH = f"SELECT a AS src, b AS dst, weight FROM ({_CO}) UNION ALL SELECT b, a, weight FROM ({_CO})"
_RELATIONS = f"SELECT 'belongs_to' AS label, count(*) AS n FROM claims WHERE confidence >= .6 UNION ALL SELECT 'mentions', count(*) FROM ({CONTAINS_SQL.format(8)}) UNION ALL SELECT 'co_occurs_with', 2 * count(*) FROM ({_CO}) UNION ALL SELECT 'appears_in', count(*) FROM (SELECT value, entity_type FROM entities GROUP BY ALL HAVING count(*) >= 5)"
_TOP = f"SELECT 'top' AS kind, id, row_number() OVER (ORDER BY rank DESC, id) AS place, rank FROM ({_pagerank(20, _BOTH)}) QUALIFY place <= 5"


@query("kg_stats", f"SELECT * FROM (WITH nodes AS (SELECT kind AS label, count(*) AS n FROM ({_NODES}) GROUP BY kind), relations AS ({_RELATIONS}) SELECT 'node' AS kind, label, n, NULL::DOUBLE AS rank FROM nodes UNION ALL SELECT 'edge', label, n, NULL FROM relations UNION ALL SELECT 'total', 'nodes', coalesce(sum(n), 0)::BIGINT, NULL FROM nodes UNION ALL SELECT 'total', 'edges', sum(n)::BIGINT, NULL FROM relations UNION ALL SELECT * FROM ({_TOP}))", "missions entities claims")
def kg_stats(t: Tables) -> DataFrame:
    """kind, label, n, rank: vertices by label, edges by relation, totals of both, and the five entities of the highest PageRank, n being their place.

    Only co-occurrence leads to entities, so ranks are those of its edges; equal ones come by name.
    """
    co = written(_co(t), "cooccurrence")
    both = co.select(c("a").alias("src"), c("b").alias("dst"), "weight").unionByName(co.select(c("b").alias("src"), c("a").alias("dst"), "weight"))
    rank = G.pagerank(both, 20).select(F.lit("top").alias("kind"), "id", F.round("rank", 6).alias("rank"))
    top = R.top_per_group(rank, ["kind"], [c("rank").desc(), c("id")], 5, "n")
    # One pass over the entities: how many vertices a value makes, and in how many types it appears often.
    values = t.entities.groupBy("value", "entity_type").agg(F.count("*").alias("n"), F.max("confidence").alias("best")).groupBy("value").agg(F.max("best").alias("best"), F.count_if(c("n") >= 5).alias("often"))
    values = values.agg(F.count_if(c("best") >= 0.65).alias("entity"), F.coalesce(F.sum("often"), F.lit(0)).alias("appears_in"))
    claims = t.claims.where("confidence >= 0.6").agg(F.count("*").alias("claim"))
    one = values.crossJoin(claims).crossJoin(t.missions.agg(F.count("*").alias("mission"))).crossJoin(co.agg((2 * F.count("*")).alias("co_occurs_with"))).crossJoin(written(mentions(t, 8).agg(F.count("*").alias("mentions")), "mentions"))
    # Each claim belongs to one mission.
    one = one.withColumn("belongs_to", c("claim"))
    counted = {"node": ("mission", "entity", "claim"), "edge": ("belongs_to", "mentions", "co_occurs_with", "appears_in")}
    row = lambda kind, label, n: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), n.alias("n"))
    rows = [row(kind, x, c(x)) for kind, names in counted.items() for x in names] + [row("total", f"{kind}s", sum(map(c, names[1:]), c(names[0]))) for kind, names in counted.items()]
    rows = one.select(F.inline(F.array(*rows))).where("kind <> 'node' or n > 0").withColumn("rank", F.lit(None).cast("double"))
    return rows.unionByName(top.select("kind", c("id").alias("label"), c("n").cast("bigint").alias("n"), "rank"))


@query("kg_incr", "SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS fresh, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) > .25 * count(*) AS rebuild FROM documents")
def kg_incr(t: Tables) -> DataFrame:
    known = t.labels.select("doc_id").distinct().withColumn("known", F.lit(True))
    d = t.documents.select("doc_id").join(known, "doc_id", "left")
    return d.agg(F.count_if(c("known").isNull()).alias("fresh"), (F.count_if(c("known").isNull()) > 0.25 * F.count("*")).alias("rebuild"))


_HOP1 = "SELECT b.value AS name, count(DISTINCT b.mission_id) AS n FROM entities a JOIN entities b ON a.mission_id = b.mission_id AND a.value <> b.value WHERE a.value = 'Brand#1' GROUP BY b.value ORDER BY n DESC, name LIMIT 20"


def _around(t: Tables, names: DataFrame) -> DataFrame:
    """Values that share missions with the given ones (name, few), with the number of shared missions."""
    e = t.entities.select("mission_id", "value").distinct()
    own = e.join(F.broadcast(names.select(c("name").alias("value"))), "value").select(c("value").alias("of"), "mission_id")
    return own.join(e, "mission_id").where("value <> of").groupBy("of", c("value").alias("name")).agg(F.count("*").alias("n"))


def _one(t: Tables, name: str) -> DataFrame:
    return t.spark.createDataFrame([(name,)], "name string")


@query("kg_entity", f"SELECT * FROM ({_HOP1})", "entities")
def kg_entity(t: Tables) -> DataFrame:
    return _around(t, _one(t, "Brand#1")).orderBy(c("n").desc(), "name").limit(20).select("name", "n")


@query("kg_network", f"SELECT * FROM (WITH h AS ({_HOP1}), f AS (SELECT name AS of FROM h ORDER BY n DESC, name LIMIT 8), t AS (SELECT f.of, b.value AS name, count(DISTINCT b.mission_id) AS n FROM f JOIN entities a ON a.value = f.of JOIN entities b ON a.mission_id = b.mission_id AND b.value <> f.of GROUP BY ALL) SELECT 'Brand#1' AS of, name, n, 1 AS hop FROM h UNION ALL SELECT of, name, n, 2 FROM (SELECT *, row_number() OVER (PARTITION BY of ORDER BY n DESC, name) AS r FROM t) WHERE r <= 5)", "entities")
def kg_network(t: Tables) -> DataFrame:
    """Both hops in one plan each: the second for the eight strongest neighbours at once."""
    one = R.top_per_group(_around(t, _one(t, "Brand#1")), ["of"], [c("n").desc(), c("name")], 20)
    two = R.top_per_group(_around(t, one.orderBy(c("n").desc(), "name").limit(8).select("name")), ["of"], [c("n").desc(), c("name")], 5)
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))


@query("kg_nhop", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_EDGES})), p(src, dst, k) AS (SELECT src, dst, 1 FROM e WHERE src = 'Brand#1' UNION SELECT e.src, e.dst, k + 1 FROM p JOIN e ON e.src = p.dst WHERE k < 3) SELECT DISTINCT src, dst FROM p ORDER BY src, dst LIMIT 200")
def kg_nhop(t: Tables) -> DataFrame:
    return G.expand(_edges(t), "Brand#1", 3)


@query("kg_ingest", "SELECT value AS name, count(*) AS mention_count, count(DISTINCT mission_id) AS missions FROM entities WHERE confidence >= .95 GROUP BY value", "entities")
def kg_ingest(t: Tables) -> DataFrame:
    return t.entities.where("confidence >= 0.95").groupBy(c("value").alias("name")).agg(F.count("*").alias("mention_count"), F.count_distinct("mission_id").alias("missions"))


@query("kg_full")
def kg_full(t: Tables) -> DataFrame:
    """Vertices, edges and ranks of one build as counts."""
    edges = _edges(t)
    rank = G.pagerank(edges, 5)
    return rank.agg(F.count("*").alias("vertices"), F.round(F.sum("rank"), 6).alias("mass")).crossJoin(edges.agg(F.count("*").alias("edges")))
