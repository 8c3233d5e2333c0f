"""Host reputation folded from harvest results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAD_BELOW = 0.3


def fold(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """New reputation of each host.

    events: domain, id (order), quality, success; prior: domain, avg_quality, harvest_count,
    success_count, consecutive_bad, blacklisted. A host without history takes the mean quality; one with
    history moves towards it by min(.4, new / (old + new)). The streak counts bad results since the last
    good one, on top of the old streak where there is none. Hosts are blacklisted with three bad results
    in a row of four and more, or a mean under .15 of six and more, and stay so.
    """
    c = F.col
    good = c("success") & (c("quality") >= BAD_BELOW)
    # Two aggregates, so that no host's rows are ordered in one task.
    last = events.groupBy("domain").agg(F.max(F.when(good, c("id"))).alias("last_good"))
    new = events.join(last, "domain").groupBy("domain").agg(F.count("*").alias("n"), F.avg("quality").alias("mean"), F.count_if("success").alias("ok"), F.count_if(c("last_good").isNull() | (c("id") > c("last_good"))).alias("bad"), F.max("last_good").alias("last_good"))
    if prior is None:
        new = new.select("*", *(F.lit(None).cast(k).alias(n) for n, k in (("avg_quality", "double"), ("harvest_count", "bigint"), ("success_count", "bigint"), ("consecutive_bad", "bigint"), ("blacklisted", "boolean"))))
    else:
        new = new.join(prior, "domain", "full")
    n, base = F.coalesce("n", F.lit(0)), F.coalesce("harvest_count", F.lit(0))
    alpha = F.least(F.lit(0.4), n / F.greatest(base + n, F.lit(1)))
    mean = F.when(n == 0, c("avg_quality")).when(base == 0, c("mean")).otherwise((1 - alpha) * c("avg_quality") + alpha * c("mean"))
    streak = F.when(n == 0, c("consecutive_bad")).when(c("last_good").isNull(), F.coalesce("consecutive_bad", F.lit(0)) + c("bad")).otherwise(c("bad"))
    total = base + n
    found = new.select("domain", mean.alias("avg_quality"), total.alias("harvest_count"), (F.floor(0.7 * base) + F.coalesce("ok", F.lit(0))).cast("bigint").alias("success_count"), streak.cast("bigint").alias("consecutive_bad"), F.coalesce("blacklisted", F.lit(False)).alias("was"))
    flag = c("was") | ((c("harvest_count") >= 4) & (c("consecutive_bad") >= 3)) | ((c("harvest_count") >= 6) & (c("avg_quality") < 0.15))
    return found.withColumn("blacklisted", flag).drop("was")
