"""Federated contributions, search, votes and brand scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..lens import Tables
from ..operators import federation as D

c = F.col


_ROWS = r"SELECT doc_id AS id, source AS contributor, .7 + (doc_id % 3) * .1::DOUBLE AS confidence, left(sha256(regexp_replace(trim(lower(text), ' '), '[ \t\n\r]+', ' ', 'g')), 32) AS hash FROM documents WHERE doc_id % 11 <> 0"
_FED = f"SELECT hash, arg_min(contributor, i) AS first_contributor, arg_min(confidence, i) AS confidence, count(*) - 1 AS confirmations, least(1, arg_min(confidence, i) + .05 * (count(*) - 1))::DOUBLE AS network FROM (SELECT hash, contributor, min(id) AS i, arg_min(confidence, id) AS confidence FROM ({_ROWS}) GROUP BY ALL) GROUP BY hash"


def _claims(t: Tables) -> DataFrame:
    d = t.documents
    rows = d.select(c("doc_id").alias("id"), "text", c("source").alias("contributor"), (F.lit(0.7) + (c("doc_id") % 3) * 0.1).alias("confidence"), F.when(c("doc_id") % 11 != 0, "web").alias("source"))
    return D.contribute(rows)


@query("fed_contribute", f"SELECT hash, first_contributor, round(confidence, 6) AS confidence, confirmations, round(network, 6) AS network FROM ({_FED})")
def fed_contribute(t: Tables) -> DataFrame:
    return _claims(t).select("hash", "first_contributor", F.round("confidence", 6).alias("confidence"), "confirmations", F.round("network", 6).alias("network"))


@query("fed_search", "SELECT id, confidence, count(*) OVER () AS total FROM claims WHERE list_contains(regexp_extract_all(lower(claim), '[a-z]+'), 'the') AND source_tier = 'T2' AND confidence >= .5 ORDER BY confidence DESC, id LIMIT 20", "claims")
def fed_search(t: Tables) -> DataFrame:
    w = F.regexp_extract_all(F.lower("claim"), F.lit("[a-z]+"), 0)
    hit = t.claims.where(F.array_contains(w, "the") & (c("source_tier") == "T2") & (c("confidence") >= 0.5)).select("id", "confidence")
    # The total is one row, counted beside the top, not over a window of everything.
    return hit.orderBy(c("confidence").desc(), "id").limit(20).crossJoin(F.broadcast(hit.agg(F.count("*").alias("total"))))


_VOTES = "SELECT claim, voter, max(id) AS id, arg_max(confirm, id) AS confirm FROM (SELECT user_id % 20 AS claim, user_id AS voter, event_id AS id, event_type <> 'error' AS confirm FROM events WHERE event_type IN ('purchase', 'click', 'error') AND user_id <> user_id % 20) GROUP BY ALL"


@query("fed_vote", f"SELECT * FROM (WITH v AS ({_VOTES}), s AS (SELECT claim, count(*) FILTER (confirm) AS k, count(*) FILTER (NOT confirm) AS d, max(id) FILTER (confirm) AS upto FROM v GROUP BY claim) SELECT m.claim, round(greatest(0, CASE WHEN coalesce(k, 0) > 0 THEN least(1, .7 + .03 * k) ELSE .7 END - .1 * (SELECT count(*) FROM v WHERE v.claim = m.claim AND NOT confirm AND (upto IS NULL OR id > upto))), 6)::DOUBLE AS network, coalesce(k, 0) AS confirms, coalesce(d, 0) AS contradicts FROM (SELECT regexp_extract(id, '(\\d+)', 1)::BIGINT AS claim FROM missions) m LEFT JOIN s USING (claim))", "missions")
def fed_vote(t: Tables) -> DataFrame:
    """Votes from events: users on claims user_id % 20, purchases and clicks confirm, errors contradict."""
    claims = t.missions.select(F.regexp_extract("id", r"(\d+)", 1).cast("bigint").alias("claim"), F.regexp_extract("id", r"(\d+)", 1).cast("bigint").alias("owner"), F.lit(0.7).alias("base"))
    votes = t.events.where(c("event_type").isin("purchase", "click", "error")).select((c("user_id") % 20).alias("claim"), c("user_id").alias("voter"), c("event_id").alias("id"), (c("event_type") != "error").alias("confirm"))
    return D.vote(claims, votes)


@query("fed_stats", f"SELECT count(*) AS claims, sum(confirmations)::BIGINT AS confirmations, round(avg(network), 6) AS avg_network, count(DISTINCT first_contributor) AS contributors FROM ({_FED})")
def fed_stats(t: Tables) -> DataFrame:
    return _claims(t).agg(F.count("*").alias("claims"), F.sum("confirmations").alias("confirmations"), F.round(F.avg("network"), 6).alias("avg_network"), F.count_distinct("first_contributor").alias("contributors"))


@query("brand_score", "SELECT s_suppkey, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'good' WHEN score >= 30 THEN 'weak' ELSE 'unknown' END AS verdict FROM (SELECT s_suppkey, round(greatest(0.0, least(100.0, CASE WHEN s_suppkey % 5 > 0 THEN 30 + least(8 * (s_suppkey % 5), 30) + 20 * ((s_suppkey % 10) / 10.0) + 4 * (s_suppkey % 6) ELSE greatest(5.0, 15 * ((s_suppkey % 10) / 10.0)) END)), 4)::DOUBLE AS score FROM supplier)")
def brand_score(t: Tables) -> DataFrame:
    k = c("s_suppkey")
    s = t.supplier.select("s_suppkey", D.brand_score(k % 5, (k % 10) / 10.0, k % 6).alias("score"))
    return s.withColumn("verdict", F.when(c("score") >= 80, "strong").when(c("score") >= 60, "good").when(c("score") >= 30, "weak").otherwise("unknown"))
