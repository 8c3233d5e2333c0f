"""Merkle fixity audit of WARC archives.

Pages become WARC resource records, in archives of consecutive ids; each record has a digest
and the offset range it fills. Equal records of one id are a run: they follow each other and are one
row with a number. Leaves hash a run's digest with its range; FAN_OUT ordered ranges are hashed into
their parent, up to one root for each shelf and on over the shelves to one root for the replica. An
audit compares two replicas' roots and descends only below nodes that differ, so a sound replica
costs one comparison and damage is found along its path. A shelf is an archive, or a part of one that
holds many records, as an id may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import dropped, written

#: Ids in an archive; nulls are spread over NULL_ARCHIVES archives, numbered -1 and down.
ARCHIVE_IDS = 1000
NULL_ARCHIVES = 1024
#: An archive of more runs than this is dealt into parts of about so many, by digest, up to PARTS.
SHELF_RUNS = 8192
PARTS = 4096
#: Up to so many archives in parts are broadcast; more are joined.
BROADCAST_ARCHIVES = 100_000
BITS = 6
FAN_OUT = 1 << BITS


def record(key: Column, url: Column, html: Column) -> Column:
    """The text of one WARC record; null url and html are empty, a null key is written as 'null'."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("null")),
        F.lit(">\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def runs(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, archive, length, digest, n: the distinct records of each id and how often each occurs."""
    own = pages.select(F.col(key).cast("bigint").alias("id"), record(F.col(key), F.col(url), F.col(html)).alias("record"))
    spread = -F.pmod(F.xxhash64("record"), F.lit(NULL_ARCHIVES)) - 1
    own = own.select("id", F.coalesce(F.floor(F.col("id") / ARCHIVE_IDS), spread).cast("bigint").alias("archive"), F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    return own.groupBy("id", "archive", "length", "digest").agg(F.count("*").alias("n"))


def parts(found: DataFrame) -> DataFrame:
    """archive, loose (null ids), parts: archives of more than SHELF_RUNS runs, and into how many parts they are dealt."""
    sizes = found.groupBy("archive", F.col("id").isNull().alias("loose")).agg(F.count("*").alias("c")).where(F.col("c") > SHELF_RUNS)
    return written(sizes.select("archive", "loose", F.least(F.ceil(F.col("c") / SHELF_RUNS), F.lit(PARTS)).cast("bigint").alias("parts")), "parts")


def manifest(found: DataFrame, dealt: DataFrame) -> DataFrame:
    """id, archive, shelf, place, offset, length, digest, n: runs on their shelves, in order of id and digest."""
    few = dealt.count() <= BROADCAST_ARCHIVES
    loose = F.col("id").isNull()
    shelved = found.withColumn("loose", loose).join(F.broadcast(dealt) if few else dealt, ["archive", "loose"], "left")
    part = F.pmod(F.xxhash64("digest"), F.coalesce("parts", F.lit(1).cast("bigint")))
    shelved = shelved.withColumn("shelf", (F.col("archive") * PARTS + part) * 2 + F.col("loose").cast("bigint"))
    order = Window.partitionBy("shelf").orderBy("id", "digest")
    size = F.col("length") * F.col("n")
    return shelved.select("id", "archive", "shelf", (F.row_number().over(order) - 1).cast("bigint").alias("place"), (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("offset"), "length", "digest", "n")


def _parents(nodes: DataFrame) -> DataFrame:
    """At most FAN_OUT children, in order, are hashed into one."""
    at = F.shiftright("place", BITS)
    ordered = F.array_sort(F.collect_list(F.struct("place", "hash")))
    return nodes.groupBy("shelf", at.alias("place")).agg(F.sha2(F.concat(F.lit("node:"), F.array_join(F.transform(ordered, lambda x: x["hash"]), ",")), 256).alias("hash"))


def _levels(nodes: DataFrame, size: int) -> list[DataFrame]:
    """``nodes`` and what they are hashed into, up to one for each shelf; places are below ``size``."""
    found = [nodes]
    while size > 1:
        found.append(written(_parents(found[-1]), "tree"))
        size = -(-size // FAN_OUT)
    return found


def trees(ours: DataFrame, theirs: DataFrame) -> tuple[list[list[DataFrame]], list[list[DataFrame]]]:
    """For each manifest, levels of nodes (shelf, place, hash), leaves first: within shelves, and over the shelves' roots.

    Each level is a small table of its own, so that an audit reads what it needs and plans stay short. Both
    manifests have levels of one number.
    """
    ends = ours.unionByName(theirs).agg(F.max("place"), F.min("shelf"), F.max("shelf")).first()
    places, low, high = (ends[0] or 0) + 1, ends[1] or 0, ends[2] or 0
    inner, outer = [], []
    for records in (ours, theirs):
        leaf = F.sha2(F.concat_ws(":", F.lit("leaf"), "digest", "offset", "length", "n"), 256)
        inner.append(_levels(records.select("shelf", "place", leaf.alias("hash")), places))
        roots = inner[-1][-1].select(F.lit(0).cast("bigint").alias("shelf"), (F.col("shelf") - low).alias("place"), "hash")
        outer.append(_levels(roots, high - low + 1))
    return inner, outer


def _differing(ours: DataFrame, theirs: DataFrame, parents: DataFrame | None) -> DataFrame:
    """shelf, place of nodes that differ or that one replica lacks, below ``parents``."""
    if parents is not None:
        above = parents.withColumnRenamed("place", "above")
        ours, theirs = (x.withColumn("above", F.shiftright("place", BITS)).join(above, ["shelf", "above"], "left_semi") for x in (ours, theirs))
    both = ours.alias("a").join(theirs.alias("b"), ["shelf", "place"], "full")
    return written(both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select("shelf", "place"), "differing")


def damaged(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """shelf, place of the runs in which two manifests differ."""
    inner, outer = trees(ours, theirs)
    low = ours.unionByName(theirs).agg(F.min("shelf")).first()[0] or 0
    at = None
    for a, b in zip(reversed(outer[0]), reversed(outer[1])):
        at = _differing(a, b, at)
    # The shelves' roots have been compared as the lowest outer level.
    at = at.select((F.col("place") + low).alias("shelf"), F.lit(0).cast("bigint").alias("place"))
    for a, b in list(zip(reversed(inner[0]), reversed(inner[1])))[1:]:
        at = _differing(a, b, at)
    for levels in (*inner, *outer):
        for level in levels[1:]:
            dropped(level)
    return at


def audit(pages: DataFrame, replica: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, archive, offset, length, digest, status: every record of ``pages``, held against ``replica``.

    status is ok where no differing branch leads to the record, or it lies in its place all the same; else
    moved (the same bytes elsewhere), corrupt (the replica has another record of that id that ``pages``
    lacks), or missing. Records that only the replica has, of ids all of whose records are sound, follow
    with their place there as extra. Of equal records of one id the replica's last ones are missing or
    extra. Null urls and html are empty texts; records with null ids are known by their bytes; repeated rows
    are records of their own; negative ids and records of any length are as others; an empty replica misses
    all; with empty ``pages`` all records of the replica are extra; other columns are not read.
    """
    found = written(runs(pages, key, url, html), "runs")
    dealt = parts(found)
    ours, theirs = written(manifest(found, dealt), "manifest"), written(manifest(runs(replica, key, url, html), dealt), "manifest")
    bad = damaged(ours, theirs)
    # What differs on both sides meets by identifier and digest; a null id has its digest for an identifier.
    who = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), "digest"))
    a = ours.join(bad, ["shelf", "place"], "left_semi").select(who.alias("who"), "digest", F.col("offset").alias("own"), F.col("n").alias("a"))
    b = theirs.join(bad, ["shelf", "place"], "left_semi").select(who.alias("who"), "digest", "id", "archive", "length", F.col("offset").alias("there"), F.col("n").alias("b"))
    both = written(a.join(b, ["who", "digest"], "full").fillna(0, ["a", "b"]), "suspects")
    sums = both.groupBy("who").agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("more"))
    judged = both.join(sums, "who")
    known = judged.where("a > 0").select("who", "digest", F.col("b").alias("held"), F.col("own").eqNullSafe(F.col("there")).alias("same"), (F.col("more") > 0).alias("other"))
    suspect = ours.withColumn("who", who).join(bad.withColumn("differs", F.lit(True)), ["shelf", "place"], "left").join(known, ["who", "digest"], "left")
    each = suspect.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    status = F.when(F.col("differs").isNull(), "ok").when(F.col("k") < F.col("held"), F.when(F.col("same"), "ok").otherwise("moved")).when(F.col("other"), "corrupt").otherwise("missing")
    held = each.select(F.col("id").alias(key), "archive", (F.col("offset") + F.col("k") * F.col("length")).alias("offset"), "length", "digest", status.alias("status"))
    extra = judged.where("b > a and lost = 0").withColumn("k", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    extra = extra.select(F.col("id").alias(key), "archive", (F.col("there") + F.col("k") * F.col("length")).alias("offset"), "length", "digest", F.lit("extra").alias("status"))
    return held.unionByName(extra)
