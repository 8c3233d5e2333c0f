"""Writers, registries, fall-through reads, and what the reference does around statements."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..lens import Tables
from ..operators import relational as R
from ..sources import tables as S
from ..storage import shared
from ..streaming import events as E
from .validation import _CONF, strongest

c = F.col


@query("snk_insert", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def snk_insert(t: Tables) -> DataFrame:
    at = S.place(t.spark, "insert")
    rows = t.nation.select("n_nationkey", "n_name")
    S.append(rows, at)
    S.append(rows.withColumn("n_nationkey", c("n_nationkey") + 100), at)
    return t.spark.read.schema(rows.schema).parquet(at)


@query("src_registry", "SELECT r_regionkey, r_name FROM region")
def src_registry(t: Tables) -> DataFrame:
    at = S.place(t.spark, "registry")
    t.region.select("r_regionkey", "r_name").write.json(at)
    return S.registry(t.spark, at, "r_regionkey int, r_name string")


@query("src_backend", "SELECT r_name FROM region")
def src_backend(t: Tables) -> DataFrame:
    return S.first_readable(t.spark, [f"{shared(t.spark)}/missing-store", f"{t.sf_dir}/region.parquet"]).select("r_name")


@query("src_search", "SELECT domain, arg_min(url, (CASE source_type WHEN 'api' THEN 0 WHEN 'rss' THEN 1 ELSE 2 END, id)) AS url FROM sources GROUP BY domain", "sources")
def src_search(t: Tables) -> DataFrame:
    """Fall-through over ranked engines: the first one's result for each key; the searches themselves are data."""
    rank = F.when(c("source_type") == "api", 0).when(c("source_type") == "rss", 1).otherwise(2)
    return t.sources.groupBy("domain").agg(F.min_by("url", F.struct(rank, "id")).alias("url"))


@query("ex_ctx_chunks", "SELECT id, url, domain FROM content", "content")
def ex_ctx_chunks(t: Tables) -> DataFrame:
    """Rows read back from '[SOURCE n] url | domain |' lines."""
    block = F.concat(F.lit("intro\n[SOURCE "), c("id").cast("string"), F.lit("] "), "url", F.lit(" | "), "domain", F.lit(" |\ntext"))
    pick = lambda k: F.regexp_extract("b", r"(?m)^\[SOURCE (\d+)\] (\S+) \| (\S+) \|", k)
    return t.content.select(block.alias("b")).select(pick(1).cast("bigint").alias("id"), pick(2).alias("url"), pick(3).alias("domain"))


@query("nc_resolve", f"SELECT a, b, CASE o_orderstatus WHEN 'F' THEN 'REAL_CONFLICT' WHEN 'P' THEN 'DIFFERENT_SCOPE' ELSE 'UNRESOLVED' END AS label FROM ({_CONF}) LEFT JOIN orders ON o_orderkey = a // 10")
def nc_resolve(t: Tables) -> DataFrame:
    """Verdicts come as a table, here an order's status; conflicts without one stay unresolved."""
    status = c("o_orderstatus")
    verdicts = t.orders.select(c("o_orderkey").alias("k"), F.when(status == "F", "REAL_CONFLICT").when(status == "P", "DIFFERENT_SCOPE").alias("label"))
    found = strongest(t).withColumn("k", F.floor(c("a") / 10)).join(verdicts, "k", "left")
    return found.select("a", "b", F.coalesce("label", F.lit("UNRESOLVED")).alias("label"))


@query("dml_txn", "SELECT id, CASE status WHEN 'scout' THEN 'process' ELSE status END AS status FROM missions", "missions")
def dml_txn(t: Tables) -> DataFrame:
    """A dry run that would fail every mission, a change that breaks off, and one that is committed: only the last one shows."""
    table = S.Store(t.spark, S.place(t.spark, "store"))
    table.commit(t.missions.select("id", "status"))

    def failed(rows: DataFrame) -> DataFrame:
        return R.keyed_update(rows, rows.select("id", F.lit("error").alias("status")), "id", ["status"])

    table.transaction(failed, dry_run=True)
    try:
        table.transaction(lambda rows: failed(rows).withColumn("status", F.raise_error(F.lit("broken off")).cast("string")))
    except PySparkException:
        pass
    table.transaction(lambda rows: R.keyed_update(rows, rows.where("status = 'scout'").select("id", F.lit("process").alias("status")), "id", ["status"]))
    return table.read()


@query("st_append", "SELECT event_id FROM events UNION ALL SELECT event_id + 1000000 FROM events WHERE event_id < 100")
def st_append(t: Tables) -> DataFrame:
    """Appended files are seen by a stream over their folder."""
    at = S.place(t.spark, "log")
    e = t.events.select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    S.append(e, at)
    S.append(e.where("event_id < 100").withColumn("event_id", c("event_id") + 1000000), at)
    return E.drain(E.read_events(t.spark, at, "*.parquet").select("event_id"), "appended")


@query("st_fanout", "SELECT s.sink, e.event_type, count(*) AS n FROM events e, (VALUES ('a'), ('b')) s(sink) GROUP BY ALL")
def st_fanout(t: Tables) -> DataFrame:
    """Each micro-batch goes to two subscribers."""
    at = S.place(t.spark, "fanout")

    def both(df: DataFrame, _: int) -> None:
        for sink in ("a", "b"):
            S.append(df.select(F.lit(sink).alias("sink"), "event_type"), f"{at}/out")

    q = E.read_events(t.spark, t.sf_dir).writeStream.foreachBatch(both).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema("sink string, event_type string").parquet(f"{at}/out").groupBy("sink", "event_type").agg(F.count("*").alias("n"))


@query("st_checkpoint", "SELECT event_id, user_id FROM events")
def st_checkpoint(t: Tables) -> DataFrame:
    """Results are flushed batch by batch; the checkpoint says what is flushed."""
    return E.drain(E.read_events(t.spark, t.sf_dir).select("event_id", "user_id"), "flushed")
