"""The model tables (missions, content, sources, claims, ...) as projections of the base tables.

``Tables`` gives each as a DataFrame; ``LENS_SQL`` holds the same projection as SQL, from which
``with_lens`` builds the oracle of a query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import spread

#: "Now" for everything that depends on time.
AS_OF = "2024-02-01 00:00:00"

HOST = r"^[a-zA-Z]+://(?:www\.)?([^/:?#]+)"
#: Runs of characters that are not blank, tab or line end.
TOKEN = r"[^ \t\n\r]+"
#: Tables on whose rows expressions work long, so that they go to all cores.
WORKED = ("documents", "pages", "embeddings")
#: Line items that a task holds of those that are dealt out by order.
TASK_ROWS = 250_000


def host(url: Column) -> Column:
    """Host in lower case, without a literal www. and without port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


class Tables:
    """Base and model tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in WORKED else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.base(name)

    @cached_property
    def missions(self) -> DataFrame:
        d = self.base("documents").groupBy("source").agg(F.count("*").alias("n"))
        k = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
        return d.select(
            F.col("source").alias("id"), F.concat(F.lit("topic "), "source").alias("topic"), F.when(k % 7 == 3, "scout").when(k % 7 == 5, "error").otherwise("done").alias("status"),
            F.timestamp_add("HOUR", (k * 30).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"), F.col("n").alias("sources_found"), ((k * 17) % 100 / 100.0).alias("quality_confidence"),
        )

    @cached_property
    def content(self) -> DataFrame:
        d = self.base("documents")
        domain = F.concat("source", F.lit(".example.com"))
        return d.select(
            F.col("doc_id").alias("id"), F.col("source").alias("mission_id"), F.concat(F.lit("http://"), domain, F.lit("/"), F.col("doc_id").cast("string")).alias("url"), domain.alias("domain"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
            F.col("text").alias("raw_text"), F.col("lang").alias("language"), n_tokens(F.col("text")).alias("word_count"), ((F.col("doc_id") * 13) % 100 / 100.0).alias("quality_score"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        p = self.base("pages")
        k = F.col("page_id")
        return p.select(
            k.alias("id"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("mission_id"), "url", host(F.col("url")).alias("domain"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
            ((k * 37) % 101).alias("score_total"), (k % 26).alias("score_relevance"), F.when(k % 3 != 0, (k * 7) % 100).alias("score_accessibility"), F.element_at(F.array(*map(F.lit, ("pending", "scouted", "done", "failed"))), (k % 4 + 1).cast("int")).alias("status"),
            F.element_at(F.array(*map(F.lit, ("ddg", "rss", "api", "arxiv", "seed"))), (k % 5 + 1).cast("int")).alias("source_type"),
        )

    @cached_property
    def claims(self) -> DataFrame:
        """Sentences of more than 30 characters of all documents, of any language."""
        d = self.base("documents")
        d = d.select("doc_id", "source", F.posexplode(F.split("text", r"[.!?]+[ \t\n\r]+")).alias("pos", "claim")).where(F.length("claim") > 30)
        d = d.join(self.base("labels").select("doc_id", "quality"), "doc_id", "left")
        i, p = F.col("doc_id"), F.col("pos").cast("bigint")
        pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
        return d.select(
            (i * 100000 + p).alias("id"), F.col("source").alias("mission_id"), "claim", F.concat(F.lit("http://"), "source", F.lit(".example.com/"), i.cast("string")).alias("source_url"),
            pick(i + p, "fact", "statistic", "quote", "FALSIFICATION").alias("claim_type"), ((i * 37 + p * 11) % 100 / 100.0).alias("confidence"), ((i * 17 + p * 7) % 100 / 100.0).alias("quality_score"),
            pick(i, "op_a", "op_b", "op_c").alias("source_operation"), pick(i * 3 + p, "T1", "T2", "T3", "T4").alias("source_tier"), F.when((i + p) % 5 == 0, "cross_validated:3domains").when((i + p) % 5 == 1, "flagged").alias("evidence_flags"),
            (F.col("quality") == 0).alias("is_garbage"), F.timestamp_add("DAY", (i % 90).cast("int"), F.lit("2023-12-01 00:00:00").cast("timestamp")).alias("extracted_at"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        """Dealt out by mission, over as many partitions as there are lines: joins and groups by mission stay there, and no task's rows grow with the table."""
        o, l, p = self.base("orders").select("o_orderkey"), self.base("lineitem"), self.base("part").select("p_partkey", "p_brand", "p_type")
        l = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
        n = max(self.spark.sparkContext.defaultParallelism, -(-l.count() // TASK_ROWS))
        if p.count() > TASK_ROWS:
            l, p = l.repartition(n, "l_partkey"), p.repartition(n, "p_partkey")
        d = l.join(p, F.col("l_partkey") == F.col("p_partkey")).repartition(n, "l_orderkey")
        d = o.repartition(n, "o_orderkey").join(d, F.col("o_orderkey") == F.col("l_orderkey"))
        return d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_orderkey").alias("mission_id"), F.col("p_brand").alias("value"), F.split("p_type", " ")[0].alias("entity_type"), (1 - F.col("l_discount")).alias("confidence"))

    @cached_property
    def facts(self) -> DataFrame:
        l = self.base("lineitem")
        return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round("l_quantity", 4).alias("value"), F.col("l_returnflag").alias("unit"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".example.com")).alias("domain"))

    @cached_property
    def logs(self) -> DataFrame:
        e = self.base("events")
        return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("mission_id"), F.col("event_type").alias("phase"), "ts", F.col("props").alias("data"), "value")

    @cached_property
    def feedback(self) -> DataFrame:
        d = self.base("labels").join(self.base("documents").select("doc_id", "source"), "doc_id")
        return d.select(F.col("doc_id").alias("claim_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("rating"), F.col("source").alias("source_operation"), F.concat(F.lit("T"), (F.col("doc_id") % 4 + 1).cast("string")).alias("source_tier"))


_TS = "TIMESTAMP '{}'"

LENS_SQL = {
    "missions": "SELECT source AS id, 'topic ' || source AS topic, CASE WHEN k % 7 = 3 THEN 'scout' WHEN k % 7 = 5 THEN 'error' ELSE 'done' END AS status, TIMESTAMP '2024-01-01 00:00:00' + to_hours((k * 30)::INTEGER) AS created_at, n AS sources_found, ((k * 17) % 100) / 100.0::DOUBLE AS quality_confidence FROM (SELECT source, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS k, count(*) AS n FROM documents GROUP BY source)".replace("\\\\", "\\"),
    "content": r"SELECT doc_id AS id, source AS mission_id, 'http://' || source || '.example.com/' || doc_id AS url, source || '.example.com' AS domain, 'doc ' || doc_id AS title, text AS raw_text, lang AS language, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS word_count, ((doc_id * 13) % 100) / 100.0::DOUBLE AS quality_score FROM documents",
    "sources": r"SELECT page_id AS id, 'src' || (page_id % 20) AS mission_id, url, nullif(lower(regexp_extract(url, '^[a-zA-Z]+://(?:www\.)?([^/:?#]+)', 1)), '') AS domain, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, (page_id * 37) % 101 AS score_total, page_id % 26 AS score_relevance, CASE WHEN page_id % 3 <> 0 THEN (page_id * 7) % 100 END AS score_accessibility, ['pending', 'scouted', 'done', 'failed'][page_id % 4 + 1] AS status, ['ddg', 'rss', 'api', 'arxiv', 'seed'][page_id % 5 + 1] AS source_type FROM pages",
    "claims": r"SELECT doc_id * 100000 + p AS id, source AS mission_id, claim, 'http://' || source || '.example.com/' || doc_id AS source_url, ['fact', 'statistic', 'quote', 'FALSIFICATION'][(doc_id + p) % 4 + 1] AS claim_type, ((doc_id * 37 + p * 11) % 100) / 100.0::DOUBLE AS confidence, ((doc_id * 17 + p * 7) % 100) / 100.0::DOUBLE AS quality_score, ['op_a', 'op_b', 'op_c'][doc_id % 3 + 1] AS source_operation, ['T1', 'T2', 'T3', 'T4'][(doc_id * 3 + p) % 4 + 1] AS source_tier, CASE (doc_id + p) % 5 WHEN 0 THEN 'cross_validated:3domains' WHEN 1 THEN 'flagged' END AS evidence_flags, quality = 0 AS is_garbage, TIMESTAMP '2023-12-01 00:00:00' + to_days((doc_id % 90)::INTEGER) AS extracted_at FROM (SELECT doc_id, source, unnest(parts) AS claim, unnest(range(len(parts))) AS p FROM (SELECT doc_id, source, string_split_regex(text, '[.!?]+[ \t\n\r]+') AS parts FROM documents)) LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id) WHERE length(claim) > 30",
    "entities": "SELECT l_orderkey * 10 + l_linenumber AS id, o_orderkey AS mission_id, p_brand AS value, split_part(p_type, ' ', 1) AS entity_type, 1 - l_discount AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey",
    "facts": "SELECT l_orderkey * 10 + l_linenumber AS id, round(l_quantity, 4) AS value, l_returnflag AS unit, 's' || l_suppkey || '.example.com' AS domain FROM lineitem",
    "logs": "SELECT event_id AS id, user_id AS mission_id, event_type AS phase, ts, props AS data, value FROM events",
    "feedback": "SELECT doc_id AS claim_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS rating, source AS source_operation, 'T' || (doc_id % 4 + 1) AS source_tier FROM labels JOIN documents USING (doc_id)",
}

def with_lens(body: str, *names: str) -> str:
    """``body`` behind the model tables it uses."""
    return (f"WITH {', '.join(f'{n} AS ({LENS_SQL[n]})' for n in names)} " if names else "") + body


def marked(text: str) -> str:
    """SQL: ``text`` with an underscore for each letter beyond ASCII.

    RE2 takes such letters for no part of a word; an underscore is one, and no pattern here matches it as a letter.
    """
    return rf"regexp_replace({text}, '[^\P{{L}}\x00-\x7F]', '_', 'g')"
