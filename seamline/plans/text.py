"""Text features over documents, pages and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..functions import text as X
from ..lens import Tables, marked
from ..sources.feeds import feed_entries
from ..sources.office import texts_of, written_as_files
from ..storage import written

c = F.col


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_str(w)})" for w in words) + ")"


def _hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, {_str(w)})::INT" for w in words) + ")"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_str(pattern)}))"


#: Runs of word characters that are letters throughout: RE2 knows no boundaries of words beyond ASCII.
_WORDS = rf"list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda v: regexp_full_match(v, {_str(X.WORD.replace(chr(92) + 'b', ''))}))"
#: The text with a letter for each letter of the patterns, an underscore for each other one beyond ASCII.
_SEEN = marked("translate(text, 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'aaaaaaaaaAAAAAAAAA')")
#: Quality of the documents, signal by signal.
CQ_SQL = f"""
SELECT doc_id, source, mean, CASE WHEN short THEN .05 ELSE round(.25 * coh + .25 * div + .35 * fact + .15 * bp, 4) END AS quality FROM (
  SELECT *, CASE WHEN ns = 0 THEN .1 WHEN mean < 4 THEN .15 WHEN mean <= 8 THEN .45 WHEN mean <= 30 THEN .85 + least(.15, (mean - 8) / 150) WHEN mean <= 50 THEN .75 ELSE .4 END::DOUBLE AS coh,
    CASE WHEN nw < 2 THEN .1 WHEN share >= .75 THEN .9 WHEN share >= .55 THEN .7 WHEN share >= .35 THEN .45 ELSE .15 END::DOUBLE AS div,
    CASE WHEN f >= 4 THEN .95 WHEN f >= 2 THEN .8 WHEN f >= .8 THEN .6 WHEN f >= .2 THEN .35 ELSE .1 END::DOUBLE AS fact, 1 - least(hits / 5.0, 1.0)::DOUBLE AS bp
  FROM (
    SELECT doc_id, source, length(trim(text, ' ')) < 100 AS short, len(sent) AS ns, list_sum(list_transform(sent, lambda s: {_n("s", "[^ \\t\\n\\r]+")}))::DOUBLE / greatest(len(sent), 1) AS mean, len(w) AS nw,
      len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) / greatest(len(w) - 1, 1)::DOUBLE AS share,
      ({_n("seen", X.NUMBER)} + {_n("seen", X.DATE)} + .5 * {_n("seen", X.NAME)})::DOUBLE / greatest(len(w), 1) * 100 AS f, {_hits("lower(text)", X.BOILERPLATE)} AS hits
    FROM (SELECT doc_id, source, text, {_SEEN} AS seen, {_WORDS} AS w, list_filter(string_split_regex(trim(text, ' '), '[.!?]+[ \\t\\n\\r]+'), lambda s: length(trim(s, ' ')) > 0) AS sent FROM documents)
  )
)"""
_LABEL = "CASE " + " ".join(f"WHEN quality >= {v} THEN '{n}'" for v, n in X.LABELS) + " ELSE 'INFECTED' END"


def scored(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", X.content_quality(c("text"))["quality"].alias("quality"))


@query("cq_score", f"SELECT source, round(avg(quality), 6) AS avg_quality, count(*) FILTER (quality < .32) AS infected, count(*) AS n FROM ({CQ_SQL}) GROUP BY source")
def cq_score(t: Tables) -> DataFrame:
    return scored(t).groupBy("source").agg(F.round(F.avg("quality"), 6).alias("avg_quality"), F.count_if(c("quality") < X.INFECTED_BELOW).alias("infected"), F.count("*").alias("n"))


@query("cq_label", f"SELECT doc_id, quality, {_LABEL} AS label FROM ({CQ_SQL})")
def cq_label(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", "quality", X.quality_label(c("quality")).alias("label"))


@query("cq_infected", f"SELECT doc_id FROM ({CQ_SQL}) WHERE quality < .32")
def cq_infected(t: Tables) -> DataFrame:
    return scored(t).where(c("quality") < X.INFECTED_BELOW).select("doc_id")


@query("cq_audit", f"WITH q AS ({CQ_SQL}) (SELECT 'worst' AS kind, doc_id, quality FROM q ORDER BY quality, doc_id LIMIT 10) UNION ALL (SELECT 'best', doc_id, quality FROM q ORDER BY quality DESC, doc_id LIMIT 10) UNION ALL SELECT 'infected_pct', NULL, round(100.0 * count(*) FILTER (quality < .32) / count(*), 4)::DOUBLE FROM q UNION ALL SELECT 'avg', NULL, round(avg(quality), 6) FROM q")
def cq_audit(t: Tables) -> DataFrame:
    # Written, as texts would be scored again for each of the parts.
    q = written(scored(t).select("doc_id", "quality"), "audit")
    top = lambda kind, *order: q.orderBy(*order, "doc_id").limit(10).select(F.lit(kind).alias("kind"), "doc_id", "quality")
    one = q.agg(F.round(100.0 * F.count_if(c("quality") < X.INFECTED_BELOW) / F.count("*"), 4).alias("infected_pct"), F.round(F.avg("quality"), 6).alias("avg"))
    rates = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), c(k).alias("quality")) for k in one.columns))).alias("x")).select("x.*")
    return top("worst", c("quality")).unionByName(top("best", c("quality").desc())).unionByName(rates)


@query("hq_score", f"SELECT doc_id, round(least(nw / 500.0, 1.0)::DOUBLE * .4 + CASE WHEN regexp_matches(text, '\\d') THEN .2 ELSE 0 END + CASE WHEN regexp_matches(text, {_str(X.HARVEST_DATE)}) THEN .2 ELSE 0 END + CASE WHEN len(list_distinct(lines)) / greatest(len(lines), 1)::DOUBLE > .7 THEN .2 ELSE 0 END, 4)::DOUBLE AS quality FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS nw, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS lines FROM documents)")
def hq_score(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.harvest_quality(c("text")).alias("quality"))


_LANG = "CASE WHEN word_count < 10 THEN 'unknown' " + " ".join(f"WHEN {_any('lower(raw_text)', m)} THEN '{n}'" for n, m in X.LANGUAGE_MARKS) + " ELSE 'unknown' END"


@query("lang_guess", f"SELECT id, {_LANG} AS language FROM content", "content")
def lang_guess(t: Tables) -> DataFrame:
    return t.documents.select(c("doc_id").alias("id"), X.guess_language(c("text")).alias("language"))


_SNIP = f"round(least(1.0, (2 * {_n('s', X.SNIPPET_NUMBER)} + 3 * {_n('s', X.SNIPPET_DATE)} + 2 * {_n('s', X.SNIPPET_UNIT)} + .5 * {_n('s', X.SNIPPET_PROPER)})::DOUBLE / greatest({_n('s', '[^ \\t\\n\\r]+')}, 1) * 100 / 8), 3)"


@query("snip_density", f"SELECT doc_id, CASE WHEN {_n('s', '[^ \\t\\n\\r]+')} < 2 THEN 0 ELSE {_SNIP} END::DOUBLE AS density FROM (SELECT doc_id, trim({marked('text')}, ' ') AS s FROM documents)")
def snip_density(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.snippet_density(c("text")).alias("density"))


_TOPIC = "Market report with nation onthe data that enener ation"


@query("topic_dq", f"SELECT doc_id, s < .2 AS dq, round(s, 3) AS score FROM (SELECT doc_id, {_hits('lower(text)', ('market', 'report', 'nation', 'onthe', 'data', 'enener', 'ation'))} / 7.0::DOUBLE AS s FROM documents)")
def topic_dq(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.off_topic(c("text"), F.lit(_TOPIC)).alias("x")).select("doc_id", "x.dq", "x.score")


_TOPICS = ("AI", "EU export of steel 2024", "How does Poland market share of cloud software compare versus Germany in 2023", "Turkey sanctions bypass trade and oil bank", "news", "Impact of inflation and GDP growth on energy prices", "NATO weapons in Ukraine last 5 years", 'Pricing of "GreenCell" batteries, revenue 20M')
_TOPIC_ROWS = "(SELECT unnest([" + ", ".join(map(_str, _TOPICS)) + "]) AS topic)"


def topics(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in _TOPICS], "topic string")


_SPEC = "greatest(0, least(1, least(len(regexp_extract_all(topic, '\\S+')) / 8.0, 1.0) * .3 + least((" + " + ".join(f"regexp_matches(topic, {_str(p)})::INT" for p in X.DOMAIN_SIGNALS) + ") * .12, .5) - (" + " + ".join(f"regexp_matches(topic, {_str(p)})::INT" for p in X.VAGUE_SIGNALS) + ") * .15))"


@query("specificity", f"SELECT topic, round({_SPEC}, 6)::DOUBLE AS score, CASE WHEN {_SPEC} < .35 THEN 'clarify' WHEN {_SPEC} < .55 THEN 'warn' ELSE 'ok' END AS gate FROM {_TOPIC_ROWS}")
def specificity(t: Tables) -> DataFrame:
    s = F.round(X.specificity(c("topic")), 6)
    return topics(t).select("topic", s.alias("score"), F.when(s < 0.35, "clarify").when(s < 0.55, "warn").otherwise("ok").alias("gate"))


@query("clarify", f"SELECT topic, concat_ws(',', CASE WHEN NOT regexp_matches(topic, {_str(X.ASKS_PLACE)}) THEN 'place' END, CASE WHEN NOT regexp_matches(topic, {_str(X.ASKS_TIME)}) THEN 'time' END, 'purpose') AS asks FROM {_TOPIC_ROWS}")
def clarify(t: Tables) -> DataFrame:
    return topics(t).select("topic", F.concat_ws(",", X.clarifications(c("topic"))).alias("asks"))


@query("kw_extract", f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')), lambda w: NOT list_contains([{', '.join(map(_str, X.KEYWORD_STOP))}], w))), ',') AS words FROM documents")
def kw_extract(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws(",", F.array_sort(X.keywords(c("text")))).alias("words"))


_ALL = "(lower(title) || ' ' || lower(domain) || ' ' || lower(raw_text))"
_DOC_TYPE = "CASE " + " ".join(f"WHEN {_any('lower(domain)' if w == 'domain' else _ALL, k)} THEN '{n}'" for n, w, k in X.DOC_TYPES) + " ELSE 'general' END"


@query("doc_type", f"SELECT id, {_DOC_TYPE} AS kind FROM content", "content")
def doc_type(t: Tables) -> DataFrame:
    return t.content.select("id", X.document_type(c("title"), c("domain"), c("raw_text")).alias("kind"))


@query("topic_domain", f"SELECT topic, CASE {' '.join(f'WHEN {_any("lower(topic)", k)} THEN {_str(n)}' for n, k in X.TOPIC_DOMAINS)} ELSE 'general' END AS first, coalesce((SELECT name FROM (VALUES {', '.join(f'({i}, {_str(n)}, {_hits("lower(topic)", k)})' for i, (n, k) in enumerate(X.TOPIC_DOMAINS))}) v(i, name, n) WHERE n > 0 ORDER BY n DESC, i LIMIT 1), 'general') AS best FROM {_TOPIC_ROWS}")
def topic_domain(t: Tables) -> DataFrame:
    return topics(t).select("topic", X.first_group(c("topic"), X.TOPIC_DOMAINS, "general").alias("first"), X.best_group(c("topic"), X.TOPIC_DOMAINS, "general").alias("best"))


@query("task_type", f"SELECT topic, coalesce((SELECT name FROM (VALUES {', '.join(f'({i}, {_str(n)}, {_hits("lower(topic)", k)})' for i, (n, k) in enumerate(X.TOPIC_DOMAINS))}) v(i, name, n) WHERE n > 0 ORDER BY n DESC, i LIMIT 1), 'geopolitical_osint') AS kind FROM {_TOPIC_ROWS}")
def task_type(t: Tables) -> DataFrame:
    """The task type by most triggers; the trigger groups are a parameter."""
    return topics(t).select("topic", X.best_group(c("topic"), X.TOPIC_DOMAINS, "geopolitical_osint").alias("kind"))


@query("geo_ctx", f"SELECT topic, concat_ws(',', {', '.join(f'CASE WHEN {_any("lower(topic)", k)} THEN {_str(n)} END' for n, k in X.PLACES)}) AS regions FROM {_TOPIC_ROWS}")
def geo_ctx(t: Tables) -> DataFrame:
    return topics(t).select("topic", F.concat_ws(",", X.place_context(c("topic"))).alias("regions"))


@query("ctx_header", "SELECT id, 'Article: ' || title || ' | ' || domain || ' | 2024-01-05 | by ' || mission_id || ' | tags: ' || language || ', x' || CASE WHEN quality_score >= .7 THEN ' | quality:high' WHEN quality_score < .3 THEN ' | quality:low' ELSE '' END AS header FROM content", "content")
def ctx_header(t: Tables) -> DataFrame:
    signal = F.when(c("quality_score") >= 0.7, "high").when(c("quality_score") < 0.3, "low")
    return t.content.select("id", X.context_header(c("title"), c("domain"), F.lit("2024-01-05T10:00"), c("mission_id"), F.array("language", F.lit("x")), signal).alias("header"))


@query("norm_span", r"SELECT id, trim(regexp_replace(lower(claim), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), ' ') AS span FROM claims", "claims")
def norm_span(t: Tables) -> DataFrame:
    return t.claims.select("id", X.normal_span(c("claim")).alias("span"))


@query("norm_claim", r"SELECT id, left(sha256(regexp_replace(trim(lower(claim), ' '), '[ \t\n\r]+', ' ', 'g')), 32) AS hash FROM claims", "claims")
def norm_claim(t: Tables) -> DataFrame:
    return t.claims.select("id", X.claim_hash(c("claim")).alias("hash"))


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


@query("src_html", f"SELECT page_id, {_STRIP} AS text FROM pages")
def src_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.html_text(c("html")).alias("text"))


@query("src_html_naive", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM pages")
def src_html_naive(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.html_text_plain(c("html")).alias("text"))


@query("src_xml", "SELECT page_id, len(p) AS entries, p[1] AS first FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS p FROM pages)")
def src_xml(t: Tables) -> DataFrame:
    """Entries of a marked-up feed; on the fixtures a page's paragraphs are its entries."""
    p = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1)
    return t.pages.select("page_id", F.size(p).cast("bigint").alias("entries"), F.get(p, F.lit(0)).alias("first"))


@query("src_json", "SELECT event_id, 'k: ' || (props->>'$.k') AS flat FROM events")
def src_json(t: Tables) -> DataFrame:
    """A response object's fields as 'key: value', joined by bars."""
    fields = F.map_entries(F.from_json("props", "map<string,string>"))
    return t.events.select("event_id", F.array_join(F.transform(fields, lambda x: F.concat_ws(": ", x["key"], x["value"])), " | ").alias("flat"))


@query("src_rss", "SELECT page_id, 0 AS pos, url, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ') AS title, left(trim(html, ' '), 512) AS snippet FROM pages WHERE url <> ''")
def src_rss(t: Tables) -> DataFrame:
    """Entries of stored feeds; on the fixtures a page is announced by an RSS feed or, for odd ids, by an Atom feed."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    title, url = escaped(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)), escaped(c("url"))
    rss = F.concat(F.lit("<rss><channel><title>all</title><item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><description>"), escaped(c("html")), F.lit("</description></item><item><title>no link</title></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><title>all</title><entry><title>"), title, F.lit('</title><link rel="alternate" href="'), url, F.lit('"/><summary>'), escaped(c("html")), F.lit("</summary></entry><entry><title>no link</title></entry></feed>"))
    return feed_entries(t.pages.select("page_id", F.when(c("page_id") % 2 == 1, atom).otherwise(rss).alias("xml")))


@query("src_doc", r"SELECT doc_id, 'document' AS method, trim(text, E' \t\n\r') AS text, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS word_count, true AS success, NULL::VARCHAR AS error FROM documents")
def src_doc(t: Tables) -> DataFrame:
    """Texts of stored files; on the fixtures a document is a Word file or, for odd ids, a sheet of lines."""
    return texts_of(written_as_files(t.documents.select("doc_id", "text")))
