"""Federated claims: contributions, votes, standing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import claim_hash

c = F.col


def contribute(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """hash, first_contributor, confidence, confirmations, network: claims by normalised text.

    rows: id (order), text, contributor, confidence, source. Rows below the gate or without a source are
    left out; the first contributor keeps the claim, each other one confirms it once for .05 more, up to 1.
    """
    ok = rows.where((c("confidence") >= least) & c("source").isNotNull()).withColumn("hash", claim_hash(c("text")))
    one = ok.groupBy("hash", "contributor").agg(F.min(F.struct("id", "confidence")).alias("x"))
    all_ = one.groupBy("hash").agg(F.min(F.struct(c("x.id").alias("id"), "contributor", c("x.confidence").alias("confidence"))).alias("f"), (F.count("*") - 1).alias("confirmations"))
    return all_.select("hash", c("f.contributor").alias("first_contributor"), c("f.confidence").alias("confidence"), "confirmations", F.least(F.lit(1.0), c("f.confidence") + 0.05 * c("confirmations")).alias("network"))


def vote(claims: DataFrame, votes: DataFrame) -> DataFrame:
    """claim, network, confirms, contradicts: each voter's latest vote, applied in order of time.

    claims: claim, owner, base; votes: claim, voter, id (order, unique), confirm. A confirmation sets the value
    to at most 1 and base + .03 for each confirmation so far, a contradiction takes .1 off, down to 0; owners
    don't vote. So what counts is how many confirm, and how many contradict after the last of these: two
    counts, and no claim's votes are gathered.
    """
    last = votes.join(claims.select("claim", "owner"), "claim").where("voter <> owner").groupBy("claim", "voter").agg(F.max(F.struct("id", "confirm")).alias("v")).select("claim", "v.id", "v.confirm")
    sums = last.groupBy("claim").agg(F.count_if("confirm").alias("confirms"), F.count_if(~c("confirm")).alias("contradicts"), F.max(F.when(c("confirm"), c("id"))).alias("upto"))
    after = last.where("not confirm").join(sums.select("claim", "upto"), "claim").where("upto is null or id > upto").groupBy("claim").agg(F.count("*").alias("after"))
    all_ = claims.join(sums, "claim", "left").join(after, "claim", "left").fillna(0, ["confirms", "contradicts", "after"])
    top = F.when(c("confirms") > 0, F.least(F.lit(1.0), c("base") + 0.03 * c("confirms"))).otherwise(c("base"))
    return all_.select("claim", F.round(F.greatest(F.lit(0.0), top - 0.1 * c("after")), 6).alias("network"), "confirms", "contradicts")


def brand_score(facts: Column, confidence: Column, signals: Column) -> Column:
    """0..100: with facts 30 and up to 30 for facts, 20 for confidence, 4 for each signal; else 15 for confidence, 5 at least."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(facts > 0, 30 + F.least(8 * facts, F.lit(30)) + 20 * confidence + 4 * signals).otherwise(F.greatest(F.lit(5.0), 15 * confidence)))), 4)


