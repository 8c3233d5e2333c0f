"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .frames import table
from .golden import golden_records
from .kdtrees import coded, compress
from .line_rules import BOILERPLATE, clean_lines
from .lm import lm_scores
from .packing import pack
from .quality import quality
from .simhash import near_duplicates
from .token_counts import token_counts
from .toolcalls import REPLY_SCHEMA, conversation_calls, link
from .topk import top_k
from .urls import Rule, judge, variant_edges
from .warc import audit


def vocabulary() -> str:
    """Where word_bpe_49k.json is; the path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


URL_RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' pages hold no canonical links or refreshes, so usual redirects between spellings of a url are known edges."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, URL_RULES, variant_edges(pages))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*conversation_calls(table(spark, sf_dir, "conversations")), {"reply": REPLY_SCHEMA})


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds the archives of all pages against a replica in which some records are damaged, lost or added."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotten = F.when(F.pmod("page_id", F.lit(211)) == 5, F.overlay("html", F.lit("?"), F.lit(1))).otherwise(F.col("html"))
    replica = pages.where(F.coalesce(F.pmod("page_id", F.lit(997)) != 7, F.lit(True))).withColumn("html", rotten)
    added = pages.where(F.pmod("page_id", F.lit(503)) == 3).withColumn("page_id", -F.col("page_id"))
    return audit(pages, replica.unionByName(added))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(*compress(table(spark, sf_dir, "embeddings")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("removed", "cleaned")


def op13_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records(table(spark, sf_dir, "clients"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_token_counts, op3_top_k, op4_lm_scoring, op5_url_filters, op6_packing, op7_tool_calls, op8_warc_fixity, op9_simhash, op10_quality,
        op11_vector_codes, op12_quality_rules, op13_golden_record,
    )
}

#: Exact: floors and products of integers, ties by the smaller id.
OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: The tables' pages hold no canonical links or refreshes (these are tested on small fixtures); redirects between spellings form stars around the plain one.
OP5_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*[^?#]*([^#]*)', 1) AS query FROM p
), n AS (
  SELECT page_id, host, path, host || path || query AS name,
    regexp_replace(regexp_replace(host || path, '^(?:(?:www|m)\.)+([^./]+\.[^/])', '\1'), '(/|\.html)+$', '') || regexp_replace(regexp_replace(query, '[?&](utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '?') AS plain FROM h
), r(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), members AS (
  SELECT DISTINCT plain, name FROM n WHERE name IS NOT NULL UNION SELECT plain, plain FROM n WHERE name <> plain
), ruled AS (
  SELECT plain, name, arg_max(action, length(rhost || rpath)) AS action FROM members LEFT JOIN r
  ON (regexp_extract(name, '^[^/?]*', 0) = rhost OR ends_with(regexp_extract(name, '^[^/?]*', 0), '.' || rhost)) AND starts_with(regexp_extract(name, '^[^/?]*([^?]*)', 1), rpath)
  GROUP BY plain, name
), g AS (
  SELECT plain, min(name) AS alias_of, bool_or(action = 'block') AS block, coalesce(bool_or(action = 'allow'), false) AS allow FROM ruled GROUP BY plain
), own AS (
  SELECT page_id, any_value(host) AS host, any_value(path) AS path, any_value(plain) AS plain, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM n LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN block AND NOT allow THEN 'block' END, 'allow') AS verdict, alias_of FROM own LEFT JOIN g USING (plain)
"""

OP7_SQL = """
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn - 1)::VARCHAR AS call_id, u.turn, CASE WHEN u.turn IS NOT NULL THEN 0 END AS position,
  u.level, a.turn AS result_turn,
  CASE WHEN u.turn IS NULL THEN 'orphan' WHEN length(u.text) < 1 THEN 'invalid' WHEN a.turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
  CASE WHEN length(u.text) < 1 THEN '$.text: too short' ELSE '' END AS errors,
  CASE WHEN u.turn IS NOT NULL THEN '{"arguments":{"role":"user","text":' || to_json(u.text)::VARCHAR || ',"turn":' || u.turn || '},"id":"' || u.turn || '","name":"reply","result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' END AS json
FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS level
  FROM (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM conversations WHERE role = 'user')
) u FULL JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn
"""

_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) ||
    'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"""
OP8_SQL = f"""
WITH r AS (
  SELECT page_id, page_id // 1000 AS archive, {_RECORD} AS record FROM pages
), x AS (
  SELECT page_id, floor(page_id / 1000)::BIGINT AS archive, {_RECORD} AS record FROM (SELECT -page_id AS page_id, url, html FROM pages WHERE page_id % 503 = 3)
)
SELECT page_id, archive, (sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(record))::BIGINT AS "offset", strlen(record)::BIGINT AS length, sha256(record) AS digest,
  CASE WHEN page_id % 997 = 7 THEN 'missing' WHEN page_id % 211 = 5 THEN 'corrupt' WHEN page_id > page_id // 1000 * 1000 AND EXISTS (FROM pages q WHERE q.page_id // 1000 = archive AND q.page_id < r.page_id AND q.page_id % 997 = 7) THEN 'moved' ELSE 'ok' END AS status
FROM r
UNION ALL
SELECT page_id, archive, (sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(record))::BIGINT, strlen(record)::BIGINT, sha256(record), 'extra' FROM x
"""

_ASSIGN = "SELECT r, part, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x))::BIGINT * 256 + i) AS best FROM p JOIN b{0} b USING (part) GROUP BY r, part"
_MEANS = "SELECT part, i, list(m ORDER BY d) AS x FROM (SELECT part, best % 256 AS i, d, floor(sum(x[d]) / count(*)) AS m FROM a{0} JOIN p USING (r, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS d) GROUP BY ALL) GROUP BY part, i"
_ROUNDS = ", ".join(f"a{k} AS MATERIALIZED ({_ASSIGN.format(k)}), b{k + 1} AS MATERIALIZED (SELECT part, i, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN ({_MEANS.format(k)}) m USING (part, i))" for k in range(4))
#: Distances and indexes meet in one integer, whose minimum is the nearest entry of the lowest index.
OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, part, e[part * (len(e) // 4) + 1:(part + 1) * (len(e) // 4)] AS x FROM (SELECT r, e, unnest(range(4)) AS part FROM v)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS i, x FROM p WHERE r <= 256), {_ROUNDS}, a4 AS MATERIALIZED ({_ASSIGN.format(4)}
), c AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, i)) FROM b4) AS codebooks_sha256 FROM c JOIN v USING (r)
"""

#: Lines are judged by the first rule that they fail; windows of eight words are compared as texts.
OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
), j AS (
  SELECT r, line, n, 100 * len(regexp_extract_all(line, '[#*$%&|<>]+')) > 20 * n
    OR (n >= 2 AND 100 * length(regexp_replace(line, '\P{{Lu}}+', '', 'g')) > 50 * length(regexp_replace(line, '\P{{L}}+', '', 'g')))
    OR (n < 8 AND NOT regexp_matches(line, '[.!?…。！？:;]["\''”’»)\]]*[\x20\x09-\x0D]*$')) OR 100 * len(regexp_extract_all(line, '[!?]+')) > 50 * n
    OR (n >= 8 AND 100 * len(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) < 50 * n)
    OR regexp_matches(line, '(?i){'|'.join(BOILERPLATE)}') AS fails
  FROM l WHERE n > 0
), k AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_removed, coalesce(sum(n) FILTER (fails), 0)::BIGINT AS words_removed FROM j GROUP BY r
), x AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS cut FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), y AS (
  SELECT r, sum(least(8, coalesce(after - i, 8)))::BIGINT AS n_repeat_words FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM (SELECT *, count(*) OVER (PARTITION BY r, cut) AS times FROM x) WHERE times > 1
  ) GROUP BY r
), z AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed, coalesce(words_removed, 0) AS words_removed,
    len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
  FROM d LEFT JOIN k USING (r) LEFT JOIN y USING (r)
)
SELECT *, NOT base_failed AND 100 * words_removed <= 40 * n_words AS kept FROM z
"""

OP13_SQL = r"""
WITH r AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id AS id, coalesce(list_position(['crm', 'web', 'store', 'partner'], source), 5) AS rank, updated_at AS upd,
    CASE WHEN NOT regexp_full_match(name, '[\x20\x09-\x0D]*') THEN name END AS name, CASE WHEN NOT regexp_full_match(email, '[\x20\x09-\x0D]*') THEN email END AS email,
    CASE WHEN NOT regexp_full_match(segment, '[\x20\x09-\x0D]*') THEN segment END AS segment, CASE WHEN NOT regexp_full_match(city, '[\x20\x09-\x0D]*') THEN city END AS city,
    nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance
  FROM clients
), l AS (
  SELECT cluster_id, max(upd) AS latest, first(segment ORDER BY upd DESC NULLS LAST, rank, id) FILTER (segment IS NOT NULL) AS chosen FROM r GROUP BY cluster_id
), s AS (
  SELECT r.*, chosen, coalesce(epoch_us(latest) - epoch_us(upd) > 5184000000000, true) AS stale, (city IS NULL)::INTEGER + (nation_id IS NULL)::INTEGER AS missing
  FROM r JOIN l ON r.cluster_id IS NOT DISTINCT FROM l.cluster_id
), w AS (
  SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale,
    first({'v': name, 'i': id} ORDER BY length(name) DESC, stale, rank, upd DESC NULLS LAST, id) FILTER (name IS NOT NULL) AS name,
    first({'v': email, 'i': id} ORDER BY stale, rank, upd DESC NULLS LAST, id) FILTER (email IS NOT NULL) AS email,
    first({'v': segment, 'i': id} ORDER BY upd DESC NULLS LAST, rank, id) FILTER (segment IS NOT NULL) AS segment,
    first({'v': balance, 'i': id} ORDER BY segment IS DISTINCT FROM chosen, upd DESC NULLS LAST, rank, id) FILTER (balance IS NOT NULL) AS balance,
    first({'c': city, 'n': nation_id, 'i': CASE WHEN missing < 2 THEN id END} ORDER BY missing, upd DESC NULLS LAST, rank, id) AS address
  FROM s GROUP BY cluster_id
)
SELECT cluster_id, n_records, n_stale, name.v AS name, email.v AS email, segment.v AS segment, address.c AS city, address.n AS nation_id, floor(100 * balance.v + 0.5)::BIGINT AS balance_cents,
  name.i AS name_from, email.i AS email_from, segment.i AS segment_from, balance.i AS balance_from, address.i AS address_from FROM w
"""

ORACLES: dict[str, str] = {"op11_vector_codes": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_golden_record": OP13_SQL, "op7_tool_calls": OP7_SQL, "op8_warc_fixity": OP8_SQL, "op5_url_filters": OP5_SQL, "op3_top_k": OP3_SQL}
