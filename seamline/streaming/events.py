"""Event streams with Structured Streaming: tails, latest values, windows, sessions and a rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import place

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """Files as they arrive in a folder; the checkpoint keeps what has been read."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tail(events: DataFrame, since_id: int) -> DataFrame:
    """Events after an id: replay, then follow."""
    return events.where(F.col("event_id") > since_id)


def latest(events: DataFrame) -> DataFrame:
    """Each user's last event with a value (update or complete mode)."""
    return events.where("value is not null").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; what is later than the watermark is left out (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events not further apart than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def allow(times: list[float], accepted: list[float], limit: int, period: float) -> tuple[list[bool], list[float]]:
    """A sliding log: a request passes while fewer than ``limit`` were accepted in the last ``period`` seconds."""
    out = []
    for now in times:
        accepted = [x for x in accepted if x > now - period]
        out.append(len(accepted) < limit)
        if out[-1]:
            accepted.append(now)
    return out, accepted


def rate_limited(events: DataFrame, limit: int, period: float) -> DataFrame:
    """user_id, event_id, allowed over a stream; the state of a user is at most ``limit`` times."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
        ok, accepted = allow(rows["at"].tolist(), accepted, limit, period)
        state.update((accepted,))
        yield pd.DataFrame({"user_id": rows["user_id"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "allowed": ok})

    out = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("allowed", T.BooleanType())])
    kept = T.StructType([T.StructField("accepted", T.ArrayType(T.DoubleType()))])
    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def rate_limited_batch(events: DataFrame, limit: int, period: float) -> DataFrame:
    """rate_limited() over a table: users' events in order of time pass by; no user's are held, but at most ``limit`` times."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, accepted = None, []
        for rows in batches:
            ok = []
            for who, own in rows.groupby("user_id", sort=False, dropna=False):
                passed, accepted = allow(own["at"].tolist(), accepted if who == user else [], limit, period)
                user = who
                ok += passed
            yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "allowed": ok})

    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return timed.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(work, "user_id bigint, event_id bigint, allowed boolean")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote, as a table in the shared folder."""
    spark = stream.sparkSession
    at = place(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    else:
        # A whole state is written anew by each batch; the last one stays.
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
