"""Stored answers of feeds and archive indexes as rows: url, title and snippet of each entry. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities in the order in which they are put back, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def _plain(text: Column) -> Column:
    """Content of an element: CDATA as it stands, else with entities put back."""
    bare = text
    for name, mark in ENTITIES:
        bare = F.replace(bare, F.lit(name), F.lit(mark))
    inside = F.regexp_extract(text, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    return F.trim(F.when(text.rlike(r"^\s*<!\[CDATA\["), inside).otherwise(bare))


def _element(entry: Column, *names: str) -> Column:
    return _plain(F.regexp_extract(entry, rf"(?is)<(?:{'|'.join(names)})(?:\s[^>]*)?>(.*?)</(?:{'|'.join(names)})\s*>", 1))


def feed_entries(feeds: DataFrame, xml: str = "xml", most: int | None = None, snippet: int = 512) -> DataFrame:
    """The columns of ``feeds`` but for xml, with pos (from 0), url, title, snippet of each item (RSS) or entry (Atom).

    Entries without a link are left out, counted in pos; with ``most`` the first so many of a feed are read. Null,
    empty and broken feeds have no rows; feeds need not be well formed, so none fails a job.
    """
    entries = F.regexp_extract_all(xml, F.lit(r"(?is)<(item|entry)(?:\s[^>]*)?>(.*?)</\1\s*>"), 2)
    keep = [c for c in feeds.columns if c != xml]
    rows = feeds.select(*keep, F.posexplode(entries if most is None else F.slice(entries, 1, most)).alias("pos", "__entry"))
    e = F.col("__entry")
    href = _plain(F.regexp_extract(e, r"""(?is)<link\s[^>]*?href\s*=\s*["']([^"']*)["']""", 1))
    url = F.coalesce(F.nullif(_element(e, "link"), F.lit("")), href)
    return rows.select(*keep, "pos", url.alias("url"), _element(e, "title").alias("title"), F.substring(_element(e, "description", "summary"), 1, snippet).alias("snippet")).where("url <> ''")


def archive_entries(answers: DataFrame, json: str = "json", site: str = "site") -> DataFrame:
    """The columns of ``answers`` but for json, with url, title and an empty snippet of each row of an archive index.

    An answer is an array of arrays (url, timestamp, ...) whose first one is the header; others have no rows.
    """
    keep = [c for c in answers.columns if c != json]
    rows = F.from_json(json, "array<array<string>>")
    listed = answers.select(*keep, F.explode(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).alias("__row")).where("get(__row, 0) IS NOT NULL")
    stamp = F.coalesce(F.substring(F.get("__row", F.lit(1)), 1, 8), F.lit(""))
    return listed.select(*keep, F.get("__row", F.lit(0)).alias("url"), F.concat(F.col(site), F.lit(" archive ("), stamp, F.lit(")")).alias("title"), F.lit("").alias("snippet"))
