"""Event streams: batch forms with SQL, and the streams themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..lens import Tables
from ..operators import relational as R
from ..streaming import events as E

c = F.col


def _stream(t: Tables) -> DataFrame:
    return E.read_events(t.spark, t.sf_dir)


@query("st_tail", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def st_tail(t: Tables) -> DataFrame:
    """Read as a stream."""
    return E.drain(E.tail(_stream(t), 500).select("event_id", "event_type"), "tail")


@query("st_latest", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events WHERE value IS NOT NULL GROUP BY user_id")
def st_latest(t: Tables) -> DataFrame:
    """A stream in complete mode."""
    return E.drain(E.latest(_stream(t)), "latest", "complete")


@query("st_ring", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50")
def st_ring(t: Tables) -> DataFrame:
    return R.top_per_group(t.events.select("user_id", "event_id"), ["user_id"], [c("event_id").desc()], 50)


_SESSION = "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"


@query("st_sse", _SESSION)
def st_sse(t: Tables) -> DataFrame:
    """Runs of a user's events that no idle five minutes cut."""
    return t.events.groupBy(F.session_window("ts", "5 minutes"), "user_id").agg(F.count("*").alias("n")).select("user_id", c("session_window.start").alias("start"), "n")


@query("st_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_window(t: Tables) -> DataFrame:
    """Tumbling windows over a stream in complete mode (an extension)."""
    return E.drain(E.tumbling(_stream(t)), "tumbling", "complete").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("st_rate")
def st_rate(t: Tables) -> DataFrame:
    """Five accepted events in a day for each user, over a stream."""
    return E.drain(E.rate_limited(_stream(t), 5, 86400.0), "rate")


@query("win_rate")
def win_rate(t: Tables) -> DataFrame:
    """The same limiter over a batch; accepted events depend on each other, so no window frame expresses it."""
    return E.rate_limited_batch(t.events, 5, 86400.0)


_PHASE = "CASE event_type WHEN 'signup' THEN 'scout' WHEN 'view' THEN 'harvest' WHEN 'click' THEN 'process' WHEN 'purchase' THEN 'synth' END"


@query("st_progress", f"SELECT event_id, last_value({_PHASE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS phase, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events")
def st_progress(t: Tables) -> DataFrame:
    e = c("event_type")
    phase = F.when(e == "signup", "scout").when(e == "view", "harvest").when(e == "click", "process").when(e == "purchase", "synth")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", F.last(phase, ignorenulls=True).over(w).alias("phase"), F.count("*").over(w).alias("seen"))
