"""Source scoring, domain tiers, routing and host reputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..functions import sources as S
from ..lens import Tables
from ..operators import relational as R
from ..operators.reputation import fold
from .text import _any, _hits, _str

c = F.col


TOPIC = ("market", "nation", "data", "the", "with")
_TEXT = "lower(title || ' ' || url)"


def _under(host: str, domains) -> str:
    return "(" + " OR ".join(f"{host} = {_str(d)} OR ends_with({host}, {_str('.' + d)})" for d in domains) + ")"


_REL = f"least(25, ({_hits(_TEXT, TOPIC)} * 25) // {len(TOPIC)})"
_FRESH = f"CASE {' '.join(f'WHEN regexp_matches({_TEXT}, {_str(p)}) THEN {n}' for p, n in S.FRESHNESS)} ELSE 8 END"
_AUTH = f"CASE {' '.join(f'WHEN contains(domain, {_str(d)}) THEN {n}' for d, n in S.AUTHORITY)} WHEN {_any('domain', ('.gov', '.int', '.edu'))} THEN 12 WHEN contains(domain, '.org') THEN 9 WHEN {_any('domain', ('news', 'press', 'media', 'journal', 'report'))} THEN 7 WHEN {_any('domain', ('.co.', '.com', '.io', '.ai'))} THEN 7 ELSE 6 END"
_DEPTH = f"least(15, 3 * ({' + '.join(f'regexp_matches({_TEXT}, {_str(p)})::INT' for p in S.DEPTH)}))"
_BONUS = f"CASE source_type {' '.join(f'WHEN {_str(k)} THEN {v}' for k, v in S.TYPE_BONUS.items())} ELSE 3 END"


def _scored(t: Tables) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", "url"))
    return t.sources.withColumn("s", S.score(text, c("domain"), c("source_type"), TOPIC))


@query("ss_score", f"SELECT id, {_REL} AS relevance, {_FRESH} AS freshness, {_AUTH} AS authority, {_DEPTH} AS depth, least(100, {_REL} + {_FRESH} + {_AUTH} + {_DEPTH} + {_BONUS}) AS total FROM sources", "sources")
def ss_score(t: Tables) -> DataFrame:
    return _scored(t).select("id", "s.relevance", "s.freshness", "s.authority", "s.depth", "s.total")


@query("ss_gate", f"SELECT id FROM sources WHERE NOT {_under('domain', S.BLACKLIST)} AND (CASE WHEN {_under('domain', S.PREMIUM)} THEN 10 ELSE 0 END + CASE WHEN regexp_matches({_TEXT}, '202[4-6]') THEN 5 ELSE 0 END + CASE WHEN {_any(_TEXT, S.RESEARCH)} THEN 2 ELSE 0 END >= 5 OR source_type IN ('rss_gov', 'rss_industry', 'gov_stat') OR {_any(_TEXT, S.RESCUE)})", "sources")
def ss_gate(t: Tables) -> DataFrame:
    return t.sources.where(S.gate(F.lower(F.concat_ws(" ", "title", "url")), c("domain"), c("source_type"))).select("id")


_TIER = f"CASE WHEN {_under('domain', S.HIGH)} THEN 'HIGH' WHEN {_under('domain', S.LOW)} THEN 'LOW' WHEN {_any('domain', ('.gov', '.edu', '.int'))} THEN 'HIGH' ELSE 'MEDIUM' END"
_API = "(" + " OR ".join(f"regexp_matches(lower(url), {_str(p)})" for p in S.API_PATTERNS) + ")"
_SPA = "(" + " OR ".join(f"starts_with(domain, {_str(p)})" for p in S.SPA) + ")"


@query("dc_tier", f"SELECT id, {_TIER} AS tier, {_under('domain', S.PAYWALL)} AS paywall, {_API} AS api, {_SPA} AS spa FROM sources", "sources")
def dc_tier(t: Tables) -> DataFrame:
    return t.sources.select("id", S.domain_class(c("url"), c("domain")).alias("k")).select("id", "k.*")


def _routed(t: Tables) -> DataFrame:
    """Sources with made-up heads: status by id % 7, content type by id % 5, size by id."""
    k = c("id")
    pick = lambda n, *v: F.get(F.array(*(F.lit(x) for x in v)), (k % n).cast("int"))
    rep = _reputation(t).select(c("domain"), "avg_quality", "harvest_count")
    s = t.sources.join(rep, "domain", "left")
    return s.select("id", "status", S.route(c("url"), c("domain"), pick(7, 200, 200, 403, 200, 404, 429, None), pick(5, "text/html", "application/pdf", "text/html", "application/rss+xml", "application/json"), (k * 997) % 40000, F.lit(False), S.domain_class(c("url"), c("domain")), c("score_total"), c("avg_quality"), c("harvest_count")).alias("r"))


_PATH = "lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1))"
_ROUTE = f"""SELECT id, CASE WHEN {_any('domain', S.PORTALS)} THEN 'database_portal|dedicated_connector'
  WHEN st IS NULL AND tier = 'HIGH' THEN 'static_html|standard_drone' WHEN st IS NULL THEN 'unknown|skip' WHEN st = 403 AND tier = 'HIGH' THEN 'static_html|standard_drone' WHEN st = 403 THEN 'thin_content|skip' WHEN st = 429 THEN 'unknown|bee_master_needed' WHEN st >= 400 THEN 'thin_content|skip'
  WHEN {_API} OR ct = 'application/json' THEN 'api_endpoint|api_bee' WHEN ct = 'application/pdf' OR ends_with({_PATH}, '.pdf') THEN 'pdf|pdf_drone' WHEN contains(ct, 'rss') OR regexp_matches({_PATH}, '(\\.xml|/feed|/rss)$') OR contains({_PATH}, '/feed/') THEN 'rss_feed|rss_bee' WHEN sz < 5000 THEN 'thin_content|skip'
  WHEN q < .2 AND n >= 5 THEN 'thin_content|skip' WHEN tier = 'LOW' AND NOT coalesce(q >= .65 AND n >= 3, false) AND score_total < 20 AND coalesce(q, 0) < .5 THEN 'thin_content|skip' WHEN {_SPA} THEN 'spa|heavy_drone' ELSE 'static_html|standard_drone' END AS route
FROM (SELECT s.*, [200, 200, 403, 200, 404, 429, NULL][id % 7 + 1] AS st, ['text/html', 'application/pdf', 'text/html', 'application/rss+xml', 'application/json'][id % 5 + 1] AS ct, (id * 997) % 40000 AS sz, {_TIER} AS tier, r.avg_quality AS q, r.harvest_count AS n FROM sources s LEFT JOIN rep r USING (domain))"""
#: Reputation of hosts from pages in order of id: quality by the id, success with a score of 50 and more.
_REP = """SELECT domain, round(avg_q, 6) AS avg_quality, n AS harvest_count, ok AS success_count, streak AS consecutive_bad, (n >= 4 AND streak >= 3) OR (n >= 6 AND avg_q < .15) AS blacklisted
FROM (SELECT domain, avg(q) AS avg_q, count(*) AS n, count(*) FILTER (good) AS ok, count(*) FILTER (id > last_good) AS streak FROM (SELECT *, coalesce(max(CASE WHEN good AND q >= .3 THEN id END) OVER (PARTITION BY domain), -1) AS last_good FROM (SELECT id, domain, score_relevance / 25.0::DOUBLE AS q, score_total >= 30 AS good FROM sources)) GROUP BY domain)"""


def _reputation(t: Tables) -> DataFrame:
    events = t.sources.select("domain", "id", (c("score_relevance") / 25.0).alias("quality"), (c("score_total") >= 30).alias("success"))
    return fold(events).select("domain", F.round("avg_quality", 6).alias("avg_quality"), "harvest_count", "success_count", "consecutive_bad", "blacklisted")


@query("dr_fold", _REP, "sources")
def dr_fold(t: Tables) -> DataFrame:
    return _reputation(t)


@query("rr_route", f"SELECT * FROM (WITH rep AS ({_REP}) {_ROUTE})", "sources")
def rr_route(t: Tables) -> DataFrame:
    return _routed(t).select("id", F.concat_ws("|", "r.resource", "r.decision").alias("route"))


@query("rr_auto", f"SELECT id, CASE WHEN ends_with(route, '|skip') THEN 'skipped' ELSE 'approved' END AS decision FROM (WITH rep AS ({_REP}) {_ROUTE})", "sources")
def rr_auto(t: Tables) -> DataFrame:
    return _routed(t).select("id", F.when(c("r.decision") == "skip", "skipped").otherwise("approved").alias("decision"))


@query("rr_stats", f"SELECT split_part(route, '|', 2) AS decision, count(*) AS n FROM (WITH rep AS ({_REP}) {_ROUTE}) GROUP BY ALL", "sources")
def rr_stats(t: Tables) -> DataFrame:
    return _routed(t).groupBy(c("r.decision").alias("decision")).agg(F.count("*").alias("n"))


@query("rr_seed", "SELECT DISTINCT url FROM (SELECT url FROM sources UNION ALL SELECT 'http://seed.example.com/' || n_nationkey FROM nation)", "sources")
def rr_seed(t: Tables) -> DataFrame:
    new = t.nation.select(F.concat(F.lit("http://seed.example.com/"), c("n_nationkey").cast("string")).alias("url"))
    return R.insert_ignore(t.sources.select("url").distinct(), new, ["url"], [c("url")])


_BOOST = "CASE WHEN blacklisted THEN 0 WHEN avg_quality IS NULL OR harvest_count < 2 THEN 1 WHEN avg_quality >= .75 THEN 1.35 WHEN avg_quality >= .55 THEN 1.1 WHEN avg_quality >= .35 THEN 1 WHEN avg_quality >= .25 THEN .65 ELSE .35 END::DOUBLE"


@query("dr_boost", f"SELECT s.id, round(score_total * {_BOOST}, 4) AS boosted FROM sources s LEFT JOIN ({_REP}) r USING (domain)", "sources")
def dr_boost(t: Tables) -> DataFrame:
    return t.sources.join(_reputation(t), "domain", "left").select("id", F.round(c("score_total") * S.boost(c("avg_quality"), c("harvest_count"), c("blacklisted")), 4).alias("boosted"))


@query("dr_skip", f"SELECT id FROM sources WHERE domain NOT IN (SELECT domain FROM ({_REP}) WHERE blacklisted)", "sources")
def dr_skip(t: Tables) -> DataFrame:
    return t.sources.join(_reputation(t).where("blacklisted").select("domain"), "domain", "left_anti").select("id")


@query("dr_report", f"SELECT * FROM (WITH r AS ({_REP}) (SELECT 'worst' AS kind, domain, avg_quality FROM r WHERE harvest_count >= 2 ORDER BY avg_quality, domain LIMIT 10) UNION ALL (SELECT 'best', domain, avg_quality FROM r WHERE harvest_count >= 3 ORDER BY avg_quality DESC, domain LIMIT 10))", "sources")
def dr_report(t: Tables) -> DataFrame:
    r = _reputation(t).select("domain", "avg_quality", "harvest_count")
    top = lambda kind, n, order: r.where(c("harvest_count") >= n).orderBy(order, "domain").limit(10).select(F.lit(kind).alias("kind"), "domain", "avg_quality")
    return top("worst", 2, c("avg_quality")).unionByName(top("best", 3, c("avg_quality").desc()))


@query("api_match", "SELECT p_partkey, s FROM (SELECT p_partkey, 5 * contains(lower(p_type), 'steel')::INT + 3 * contains(lower(p_type), 'small')::INT + 1.5 * len(list_intersect(string_split(lower(p_name), ' '), ['part', 'red', 'green', 'name']))::DOUBLE AS s FROM part) WHERE s > 4 ORDER BY s DESC, p_partkey LIMIT 20")
def api_match(t: Tables) -> DataFrame:
    """Registry entries by keywords of type, category and words, the best of those above 4."""
    words = F.array(*map(F.lit, ("part", "red", "green", "name")))
    s = 5 * F.contains(F.lower("p_type"), F.lit("steel")).cast("int") + 3 * F.contains(F.lower("p_type"), F.lit("small")).cast("int") + 1.5 * F.size(F.array_intersect(F.split(F.lower("p_name"), " "), words))
    return t.part.select("p_partkey", s.alias("s")).where("s > 4").orderBy(c("s").desc(), "p_partkey").limit(20)


@query("api_endpoint", "SELECT n_regionkey, arg_max(n_name, (length(n_name), n_name)) AS endpoint FROM nation GROUP BY n_regionkey")
def api_endpoint(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.max_by("n_name", F.struct(F.length("n_name"), "n_name")).alias("endpoint"))


_MAP = "SELECT DISTINCT domain, CASE WHEN length(domain) % 3 = 0 THEN 'SKIP' WHEN length(domain) % 3 = 1 THEN 'DIRECT' ELSE 'FEED' END AS strategy, CASE WHEN length(domain) % 5 = 0 THEN 'cloudflare' END AS block_type FROM sources"


def _map(t: Tables) -> DataFrame:
    n = F.length("domain")
    return t.sources.select("domain").distinct().withColumn("strategy", F.when(n % 3 == 0, "SKIP").when(n % 3 == 1, "DIRECT").otherwise("FEED")).withColumn("block_type", F.when(n % 5 == 0, "cloudflare"))


@query("dm_strategy", f"SELECT id, coalesce(strategy, 'DIRECT') AS strategy FROM sources LEFT JOIN ({_MAP}) USING (domain)", "sources")
def dm_strategy(t: Tables) -> DataFrame:
    return t.sources.join(_map(t), "domain", "left").select("id", F.coalesce("strategy", F.lit("DIRECT")).alias("strategy"))


@query("dm_report", f"SELECT strategy, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ({_MAP})), 4)::DOUBLE AS pct FROM ({_MAP}) GROUP BY strategy", "sources")
def dm_report(t: Tables) -> DataFrame:
    n = _map(t).groupBy("strategy").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("strategy", "n", F.round(100.0 * c("n") / c("all"), 4).alias("pct"))


@query("cal_blocked", f"SELECT string_agg(domain, ',' ORDER BY domain) FILTER (strategy = 'SKIP') AS skipped, count(*) FILTER (block_type = 'cloudflare') AS walls FROM ({_MAP})", "sources")
def cal_blocked(t: Tables) -> DataFrame:
    return _map(t).agg(F.concat_ws(",", F.array_sort(F.collect_list(F.when(c("strategy") == "SKIP", c("domain"))))).alias("skipped"), F.count_if(c("block_type") == "cloudflare").alias("walls"))


@query("ts_priority", "SELECT id, greatest(2.0, (score_total * 100) / 5000.0 * 10)::DOUBLE AS seconds, CASE WHEN score_total >= 70 THEN 9 WHEN score_relevance > 18 THEN 7 WHEN score_total >= 30 THEN 5 ELSE 2 END AS priority FROM sources", "sources")
def ts_priority(t: Tables) -> DataFrame:
    return t.sources.select("id", F.greatest(F.lit(2.0), c("score_total") * 100 / 5000.0 * 10).alias("seconds"), F.when(c("score_total") >= 70, 9).when(c("score_relevance") > 18, 7).when(c("score_total") >= 30, 5).otherwise(2).alias("priority"))


@query("ts_session", "SELECT mission_id, count(*) FILTER (status = 'done') AS approved, count(*) FILTER (status = 'failed') AS skipped, count(*) FILTER (status = 'pending') AS escalated FROM sources GROUP BY mission_id", "sources")
def ts_session(t: Tables) -> DataFrame:
    return t.sources.groupBy("mission_id").agg(*(F.count_if(c("status") == s).alias(n) for n, s in (("approved", "done"), ("skipped", "failed"), ("escalated", "pending"))))


@query("sv_merge", "SELECT url, engine FROM (SELECT url, source_type AS engine, CASE source_type WHEN 'ddg' THEN 0 WHEN 'rss' THEN 1 ELSE 2 END AS k, id FROM sources) QUALIFY row_number() OVER (PARTITION BY url ORDER BY k, id) = 1", "sources")
def sv_merge(t: Tables) -> DataFrame:
    rank = F.when(c("source_type") == "ddg", 0).when(c("source_type") == "rss", 1).otherwise(2)
    return R.first_per_key(t.sources.select("url", c("source_type").alias("engine"), rank.alias("k"), "id"), ["url"], [c("k"), c("id")]).select("url", "engine")


@query("pl_templates", "SELECT r_name || ' ' || suffix AS q, n_name AS region FROM region JOIN nation ON r_regionkey = n_regionkey, (VALUES ('market size'), ('regulation 2024'), ('site:gov')) s(suffix)")
def pl_templates(t: Tables) -> DataFrame:
    suffix = F.explode(F.array(*map(F.lit, ("market size", "regulation 2024", "site:gov"))))
    return t.region.join(t.nation, c("r_regionkey") == c("n_regionkey")).select("r_name", "n_name", suffix.alias("s")).select(F.concat_ws(" ", "r_name", "s").alias("q"), c("n_name").alias("region"))


@query("pl_expand", "SELECT DISTINCT topic || s AS q FROM missions, (VALUES (' report'), (' statistics'), (' market data'), (' 2024'), (' analysis')) v(s)", "missions")
def pl_expand(t: Tables) -> DataFrame:
    return t.missions.select(F.explode(F.array(*(F.concat("topic", F.lit(s)) for s in (" report", " statistics", " market data", " 2024", " analysis")))).alias("q")).distinct()


@query("pl_url", "SELECT n_name, replace(replace('https://api.example.com/{country}?r={region}', '{country}', lower(n_name)), '{region}', n_regionkey::VARCHAR) AS url FROM nation")
def pl_url(t: Tables) -> DataFrame:
    slots = F.map_entries(F.create_map(F.lit("{country}"), F.lower("n_name"), F.lit("{region}"), c("n_regionkey").cast("string")))
    return t.nation.select("n_name", F.aggregate(slots, F.lit("https://api.example.com/{country}?r={region}"), lambda a, x: F.replace(a, x["key"], x["value"])).alias("url"))
