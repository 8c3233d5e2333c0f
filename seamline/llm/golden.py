"""Golden records: of each cluster's records one is composed, field by field, in salted rounds.

Every winner is a minimum of structs, first of each (cluster, salt), then of each cluster. A first such
round finds a cluster's latest update and its segment; these go back to the records by (cluster, salt),
and a second round takes the winners. So no cluster, however large, meets in one task, in no join
either; what is shuffled twice are winners, not records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

#: Into how many parts each cluster is dealt.
SALTS = 512
#: By falling trust; others come last.
TRUST = ("crm", "web", "store", "partner")
#: What is over this many hours older than a cluster's latest record is stale.
FRESH_HOURS = 60 * 24
BLANK = r"^[\x20\x09-\x0D]*$"
#: A cluster: an id, or none.
CLUSTER = ("cluster", "none")


def _text(name: str) -> Column:
    """A string field, null where it is empty or blank."""
    return F.when(~F.rlike(F.col(name), F.lit(BLANK)), F.col(name))


def _first(order: Sequence[Column], **values: Column) -> Column:
    """A struct whose minimum is the first in ``order``; equal ones are told apart by the values."""
    return F.struct(*(x.alias(f"o{i}") for i, x in enumerate(order)), *(x.alias(k) for k, x in values.items()))


def _twice(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """Minima, maxima and sums of each (cluster, salt), then of each cluster; salts: those of the cluster."""
    salted = rows.groupBy(*CLUSTER, "salt").agg(*(x.alias(k) for k, x in aggregates.items()))
    fold = {"latest": F.max, "n_records": F.sum, "n_stale": F.sum}
    return salted.groupBy(*CLUSTER).agg(*(fold.get(k, F.min)(k).alias(k) for k in aggregates), F.collect_set("salt").alias("salts"))


def golden_records(clients: DataFrame, trust: Sequence[str] = TRUST, salts: int = SALTS, fresh_hours: int = FRESH_HOURS) -> DataFrame:
    """One record for each cluster_id (master_id, if null client_id), and the client_id that gave each field.

    Strings that are empty or blank count as null, and so do balances that are no finite numbers. A record is
    stale if its updated_at is null or over ``fresh_hours`` before its cluster's latest. RECENT: latest
    updated_at, null last, higher trust (unknown and null sources last), smaller client_id (null first).
    TRUSTED: fresh before stale, higher trust, then RECENT. segment: RECENT; email: TRUSTED; name: most code
    points, then TRUSTED; balance: records with the chosen segment, then RECENT; city and nation_id from one
    record: most non-nulls of both, then RECENT.

    Rows that tie in all of that (a client_id that repeats) are told apart by the value itself, the smaller one
    first, so the result doesn't depend on their order; repeated rows all count in n_records. Rows without both
    ids make one cluster with a null cluster_id. Values of any length are kept whole; an empty table gives no
    rows; other columns are not read. balance_cents ends at the bounds of a long.
    """
    c = F.col
    known = F.coalesce("master_id", "client_id").cast("bigint")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, trust)), c("source")), F.lit(0))
    balance = c("balance").cast("double")
    rows = clients.select(
        F.coalesce(known, F.lit(0)).alias("cluster"), known.isNull().alias("none"), c("client_id").cast("bigint").alias("id"), F.when(rank > 0, rank).otherwise(len(trust) + 1).cast("int").alias("rank"), c("updated_at").alias("at"),
        _text("name").alias("name"), _text("email").alias("email"), _text("segment").alias("segment"), _text("city").alias("city"), "nation_id", F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance).alias("balance"),
    )
    # Dealt one by one, so that copies of one row part too; written, so that each row keeps its salt.
    rows = written(rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")), "clients")
    age = F.lit("1970-01-01").cast(rows.schema["at"].dataType) - c("at")
    recent = [c("at").isNull(), age, c("rank"), c("id")]
    segment = F.min(F.when(c("segment").isNotNull(), _first(recent, value=c("segment"), by=c("id"))))

    heads = _twice(rows, latest=F.max("at"), segment=segment).select(*CLUSTER, "latest", c("segment.value").alias("chosen"), F.explode("salts").alias("salt"))
    met = rows.join(heads, [*CLUSTER, "salt"])
    met = met.withColumn("stale", F.coalesce(c("latest") - c("at") > F.expr(f"INTERVAL '{fresh_hours}' HOUR"), F.lit(True)))
    trusted = [c("stale"), c("rank"), *recent]

    def best(name: str, order: Sequence[Column]) -> Column:
        return F.min(F.when(c(name).isNotNull(), _first(order, value=c(name), by=c("id"))))

    n_null = c("city").isNull().cast("int") + c("nation_id").isNull().cast("int")
    won = _twice(
        met, n_records=F.count("*"), n_stale=F.sum(c("stale").cast("bigint")), segment=segment, name=best("name", [-F.length("name"), *trusted]), email=best("email", trusted), balance=best("balance", [~c("segment").eqNullSafe(c("chosen")), *recent]),
        address=F.min(_first([n_null, *recent], city=c("city"), nation_id=c("nation_id"), by=F.when(n_null < 2, c("id")))),
    )
    return won.select(
        F.when(~c("none"), c("cluster")).alias("cluster_id"), "n_records", "n_stale", c("name.value").alias("name"), c("email.value").alias("email"), c("segment.value").alias("segment"), c("address.city").alias("city"), c("address.nation_id").alias("nation_id"),
        F.floor(100 * c("balance.value") + 0.5).cast("bigint").alias("balance_cents"), *(c(f"{x}.by").alias(f"{x}_from") for x in ("name", "email", "segment", "balance", "address")),
    )
