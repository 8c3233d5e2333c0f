"""De-duplication, similarity joins and clustering over claims, entities and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..lens import Tables
from ..operators import relational as R
from ..operators import similarity as S
from ..operators.leaders import lead_by_blocks
from ..operators.vectors import nearest

c = F.col


@query("dd_exact", "SELECT min(id) AS id, count(*) AS n FROM content GROUP BY md5(lower(raw_text))", "content")
def dd_exact(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5(F.lower("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).select("id", "n")


@query("dd_prefix", "SELECT id, confidence FROM claims QUALIFY row_number() OVER (PARTITION BY lower(left(claim, 100)) ORDER BY confidence DESC, id) = 1", "claims")
def dd_prefix(t: Tables) -> DataFrame:
    best = t.claims.groupBy(F.lower(F.substring("claim", 1, 100)).alias("k")).agg(F.min(F.struct((-c("confidence")).alias("c"), "id")).alias("x"))
    return best.select("x.id", (-c("x.c")).alias("confidence"))


@query("sim_cos", "SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS s FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def sim_cos(t: Tables) -> DataFrame:
    """Each vector with the next one."""
    x = t.embeddings.select(c("vec_id").alias("a"), c("embedding").alias("x"))
    y = t.embeddings.select((c("vec_id") - 1).alias("a"), c("vec_id").alias("b"), c("embedding").alias("y"))
    return x.join(y, "a").select("a", "b", F.round(S.cosine(c("x"), c("y")), 6).alias("s"))


#: Queries are all rows whose id is divisible by 50.
COS_SQL = "SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0"


def vector_rows(t: Tables) -> DataFrame:
    return t.embeddings.select(c("vec_id").alias("id"), c("embedding").alias("vector"), "label")


def vector_queries(t: Tables) -> DataFrame:
    return vector_rows(t).where("id % 50 = 0").select("id", "vector")


def knn_sql(k: int, where: str = "true") -> str:
    return f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({COS_SQL}) WHERE {where} QUALIFY rank <= {k}"


@query("fn_vec", knn_sql(20, "score > 0"))
def fn_vec(t: Tables) -> DataFrame:
    return nearest(vector_rows(t), vector_queries(t), 20, 1e-9)


@query("top_knn", knn_sql(40))
def top_knn(t: Tables) -> DataFrame:
    return nearest(vector_rows(t), vector_queries(t), 40)


_TOK = "list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]{3,}'))"


@query("jn_theta_sim", f"SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(list_concat(a.k, b.k))), 6) AS s FROM (SELECT id, mission_id, {_TOK} AS k FROM claims) a JOIN (SELECT id, mission_id, {_TOK} AS k FROM claims) b ON a.mission_id = b.mission_id AND a.id < b.id AND len(a.k) >= .6 * len(b.k) AND len(b.k) >= .6 * len(a.k) WHERE len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(list_concat(a.k, b.k))) >= .6", "claims")
def jn_theta_sim(t: Tables) -> DataFrame:
    sets = t.claims.select("id", "mission_id", F.regexp_extract_all(F.lower("claim"), F.lit("[a-z0-9]{3,}"), 0).alias("tokens"))
    return S.jaccard_pairs(sets, 0.6, "mission_id").select("a", "b", F.round("similarity", 6).alias("s"))


@query("jn_overlap", "WITH k AS (SELECT p_partkey AS id, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part), b AS (SELECT DISTINCT lower(p_brand) AS brand, unnest(string_split(lower(p_name), ' ')) AS w FROM part) SELECT brand, id, count(*) AS n FROM b JOIN k USING (w) GROUP BY ALL HAVING count(*) >= 2")
def jn_overlap(t: Tables) -> DataFrame:
    words = F.split(F.lower("p_name"), " ")
    return S.overlaps(t.part.select(F.lower("p_brand").alias("id"), words.alias("words")), t.part.select(c("p_partkey").alias("id"), words.alias("words")), 2).select(c("a").alias("brand"), c("b").alias("id"), "n")


#: Names of a mission: capitalised words of nine letters and more, in lower case.
NAMES_SQL = "(SELECT DISTINCT mission_id, lower(w) AS name FROM (SELECT mission_id, unnest(regexp_extract_all(claim, '[A-Z][a-z]{{{0},}}')) AS w FROM claims))"
CONTAINS_SQL = f"SELECT name, id FROM {NAMES_SQL} n JOIN claims c ON n.mission_id = c.mission_id AND contains(lower(claim), name) QUALIFY row_number() OVER (PARTITION BY n.mission_id, name ORDER BY id) <= 200"


def mentions(t: Tables, letters: int) -> DataFrame:
    """name, id: the first 200 claims of a mission that contain a name of it, also inside a longer word."""
    names = t.claims.select("mission_id", F.explode(F.regexp_extract_all("claim", F.lit(f"[A-Z][a-z]{{{letters},}}"), 0)).alias("w")).select("mission_id", F.lower("w").alias("name")).distinct()
    hit = S.containing(names, t.claims.select("mission_id", "id", F.lower("claim").alias("text")), "mission_id", letters + 1)
    return R.top_per_group(hit, ["mission_id", "name"], [c("id")], 200).select("name", "id")


@query("jn_theta_contains", CONTAINS_SQL.format(7), "claims")
def jn_theta_contains(t: Tables) -> DataFrame:
    return mentions(t, 7)


def _ranked(t: Tables) -> DataFrame:
    return t.claims.select("id", F.struct((-c("confidence")).alias("c"), "id").alias("rank"))


@query("dd_tfidf")
def dd_tfidf(t: Tables) -> DataFrame:
    """Leaders with the sites of their near-equal claims (cosine of .82 and more, by all terms)."""
    led = S.cosine_leaders(_ranked(t), S.tfidf_vectors(t.claims.select("id", c("claim").alias("text"))), 0.82).toDF("id", "leader")
    urls = F.array_sort(F.collect_set("source_url"))
    sites = led.join(t.claims.select("id", "source_url"), "id").groupBy("leader").agg(F.count("*").alias("duplicate_count"), urls.alias("source_urls"))
    return sites.select(c("leader").alias("claim_id"), "duplicate_count", F.size("source_urls").cast("bigint").alias("n_urls"), "source_urls")


def topical(claims: DataFrame, order: list) -> DataFrame:
    """id, leader: claims (id, claim, further columns of ``order``) in greedy groups of one topic: a cosine of .35 with the first, in ``order``."""
    terms = S.tfidf(claims.select("id", c("claim").alias("text"))).groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("v"))
    rows = claims.drop("claim").join(terms, "id", "left")
    none = lambda name, kind: F.coalesce(F.transform("v", lambda x: x[name]), F.array().cast(f"array<{kind}>"))
    return lead_by_blocks(rows.withColumns({"terms": none("term", "string"), "weights": none("weight", "double")}), order, 0.35)


@query("cl_tfidf")
def cl_tfidf(t: Tables) -> DataFrame:
    """All claims, the most confident first."""
    return topical(t.claims.select("id", "claim", "confidence"), [-c("confidence"), c("id")])


@query("cl_jaccard")
def cl_jaccard(t: Tables) -> DataFrame:
    """Claims of a mission that share a quarter of their words with the first."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("claim"), F.lit("[a-z0-9]+"), 0))
    rows = t.claims.select("id", c("mission_id").alias("group"), "confidence", words.alias("terms"))
    return lead_by_blocks(rows.withColumn("weights", F.transform("terms", lambda _: F.lit(1.0))), [-c("confidence"), c("id")], 0.25, "jaccard")


def _fuzzy(t: Tables, least: float) -> DataFrame:
    """Distinct values of a type with a ratio of ``least`` or more."""
    return S.fuzzy_pairs(t.part.select(F.split("p_type", " ")[0].alias("entity_type"), c("p_name").alias("value")), least, "entity_type")


@query("dd_fuzzy_ent")
def dd_fuzzy_ent(t: Tables) -> DataFrame:
    """Each value's canonical form: the first of its type that it is 85 percent like."""
    near = _fuzzy(t, 85)
    name = lambda x: F.concat_ws("|", "entity_type", x)
    rows = t.part.select(F.split("p_type", " ")[0].alias("entity_type"), c("p_name").alias("v")).distinct().select(name("v").alias("id"))
    return S.greedy_leaders(rows.select("id", c("id").alias("rank")), near.select(name("a").alias("a"), name("b").alias("b")))


@query("cl_ent_hdbscan")
def cl_ent_hdbscan(t: Tables) -> DataFrame:
    """Substitute for density clustering of names: greedy groups at 82 percent, with their mean confidence."""
    near = _fuzzy(t, 82).where("ratio > 82").groupBy("a", "b").agg(F.max("ratio").alias("ratio"))
    led = S.greedy_leaders(t.part.select(c("p_name").alias("id"), c("p_name").alias("rank")).distinct(), near)
    return led.groupBy("leader").agg(F.count("*").alias("aliases"))


@query("cl_claims")
def cl_claims(t: Tables) -> DataFrame:
    """Substitute for two-level density clustering: greedy cosine groups at .6 of those at .7."""
    led = S.cosine_leaders(_ranked(t), S.tfidf(t.claims.select("id", c("claim").alias("text"))), 0.7, 0.6)
    return led.select("id", c("leader1").alias("c0"), c("leader0").alias("c1"))


@query("cl_topics")
def cl_topics(t: Tables) -> DataFrame:
    """The 20 newest claims of the best confidence, grouped by shared words that grow as members join."""
    top = t.claims.orderBy(c("confidence").desc(), "id").limit(20).select("id", F.regexp_extract_all(F.lower("claim"), F.lit("[a-z]{4,}"), 0).alias("words"), F.lit(1).alias("k"))
    ordered = lambda rows: S.grow_topics(rows.sort_values("id"))
    return top.groupBy("k").applyInPandas(ordered, "id bigint, topic bigint, label string")
