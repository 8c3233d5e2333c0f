"""URL filters with redirect equivalence, in DataFrame functions only.

A url's own rule decides first: among the rules whose host fits (itself or a subdomain) and
whose path starts the url's path, the longest. Urls without a rule take the decision of their
aliases: urls joined by redirects (meta refresh) and canonical links form components, found by
distributed connected components; an allow rule on any member wins over block rules, a block
rule on any member blocks the rest, and without either a url is allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    action: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first ://; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """A url's name among aliases: without scheme and fragment, host in lower case."""
    return F.concat(host(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1))


def rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, action> of the longest rule that fits, or null. Of equally long ones an allow rule wins."""
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(int(r.action == "allow")).alias("allow"), F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action")),
        )
        for r in rules
    ]
    if not fits:
        return F.lit(None).cast("struct<size int, allow int, rule string, action string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def decisions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, found: rule() for each distinct (host, path), with rules as a table (action, host, path) of any size.

    A host meets rules under each of its suffixes, and there the url's path cut to each length that a rule's
    path has: all by equality, so a url costs as many rows as there are such lengths, not rules.
    """
    rules = rules.select("action", F.col("host").alias("rhost"), F.col("path").alias("rpath")).where("action is not null and rhost is not null and rpath is not null")
    sizes = rules.groupBy("rhost").agg(F.collect_set(F.length("rpath")).alias("sizes"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rhost")).join(sizes, "rhost")
    cut = cut.select("host", "path", "rhost", F.explode(F.filter("sizes", lambda n: n <= F.length(F.col("path")))).alias("n"))
    met = cut.select("host", "path", "rhost", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("rpath")).join(rules, ["rhost", "rpath"])
    name = F.concat("rhost", "rpath")
    return met.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("size"), (F.col("action") == "allow").cast("int").alias("allow"), name.alias("rule"), F.col("action").alias("action"))).alias("found"))


def _ruled(urls: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``urls`` (host, path and more) with found: the rule of each."""
    if isinstance(rules, list):
        return urls.withColumn("found", rule(F.col("host"), F.col("path"), rules))
    return urls.join(decisions(urls, rules), ["host", "path"], "left")


_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""


def _flat(path: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    # A path that ends in . or .. names a folder.
    return F.when(~path.contains("/."), path).otherwise(F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/"))


def absolute(base: Column, link: Column) -> Column:
    """The url that ``link`` stands for on a page ``base`` (RFC 3986); null for other schemes than http and https, and for links that name the page itself."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    own = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    parts = F.struct(
        F.regexp_replace(link, r"#.*$", "").alias("bare"), F.regexp_extract(link, r"^[^?#]*", 0).alias("to"), F.regexp_extract(link, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
        F.regexp_extract(base, r"^[^:/?#]*", 0).alias("scheme"), F.regexp_extract(_rest(base), r"^[^/?#]*", 0).alias("site"), own.alias("own"), F.regexp_replace(own, r"[^/]*$", "").alias("folder"),
    )

    def joined(x: Column) -> Column:
        root = F.concat(x["scheme"], F.lit("://"), x["site"])
        to = F.when(F.startswith(x["to"], F.lit("/")), x["to"]).otherwise(F.concat(x["folder"], x["to"]))
        return (
            F.when(x["bare"] == "", F.lit(None).cast("string"))
            .when(x["bare"].rlike(r"(?i)^https?://"), x["bare"])
            .when(x["bare"].rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit(None).cast("string"))
            .when(F.startswith(x["bare"], F.lit("//")), F.concat(x["scheme"], F.lit(":"), x["bare"]))
            .when(x["to"] == "", F.concat(root, x["own"], x["query"]))
            .otherwise(F.concat(root, _flat(to), x["query"]))
        )

    # A lambda's argument is computed once, however often it is used.
    return F.transform(F.array(parts), joined)[0]


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """u, v: names of urls that the pages' canonical links and meta refreshes join, all of a page, below its <base> if it has one."""
    marked = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    links = F.concat(*(F.regexp_extract_all("html", F.lit(p), 1) for p in (_CANONICAL, _REFRESH)))
    base = F.coalesce(absolute(F.col("url"), F.nullif(F.regexp_extract("html", _BASE, 1), F.lit(""))), F.col("url"))
    found = marked.select("url", base.alias("base"), F.explode(F.array_distinct(links)).alias("link"))
    found = found.select("url", F.explode(F.array(absolute(F.col("base"), F.col("link")))).alias("to"))
    found = found.select(node(F.col("url")).alias("u"), node(F.col("to")).alias("v"))
    return found.where("u <> v")


def plain(name: Column) -> Column:
    """Where a url's name usually redirects to: without www. or m. where two labels remain, a slash or .html at the end of the path, and tracking parameters."""
    at = F.regexp_replace(F.regexp_extract(name, r"^[^?]*", 0), r"^(?:(?:www|m)\.)+([^./]+\.[^/])", "$1")
    query = F.regexp_replace(F.regexp_extract(name, r"\?.*$", 0), r"[?&](utm_[a-z]+|ref)=[^&]*", "")
    return F.concat(F.regexp_replace(at, r"(/|\.html)+$", ""), F.regexp_replace(query, r"^&", "?"))


def variant_edges(pages: DataFrame, url: str = "url") -> DataFrame:
    """u, v: the names of the pages' urls and where they redirect to by plain()."""
    names = pages.select(node(F.col(url)).alias("u")).where("u is not null")
    return names.select("u", plain(F.col("u")).alias("v")).where("u <> v")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, edges: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule, verdict, alias_of: one row for each row of ``pages``.

    rules are a list, which becomes part of the plan, or a table (action, host, path) for many. edges (u, v:
    names by node()) joins further redirects known from elsewhere. alias_of is the smallest name that
    redirects lead to, the url's own where there are none. A null url, or one without ://, has empty host
    and path, no alias_of, and is allowed unless a rule fits the empty host; null html has no links; a null
    key stays null; repeated rows are judged alike; of equally long rules an allow rule wins; pages of any
    length are read whole; empty ``pages`` give no rows; without rules everything is allowed. Other columns
    are not read.
    """
    both = alias_edges(pages, url, html)
    both = both if edges is None else both.unionByName(edges.select("u", "v"))
    named = components(both)
    at = F.concat(F.lit("//://"), F.col("u"))
    judged = _ruled(named.select("u", "component", host(at).alias("host"), path(at).alias("path")), rules).select("u", "component", F.col("found.action").alias("action"))
    decided = judged.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allow"), F.max(F.col("action") == "block").alias("block"))
    blocked = judged.join(decided.select("component", (F.col("block") & ~F.col("allow")).alias("blocked")), "component").select(F.col("u").alias("name"), F.col("component").alias("alias_of"), "blocked")
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    # Urls without a name meet nothing; they are spread over tasks by a name that no url has.
    none = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("key", "host"), F.lit(4096)).cast("string"))
    own = own.select("key", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.when(F.col("url").contains("://"), node(F.col("url"))).alias("own"))
    own = _ruled(own, rules).withColumn("name", F.coalesce("own", none)).join(blocked, "name", "left")
    verdict = F.coalesce(F.col("found.action"), F.when(F.col("blocked"), F.lit("block")), F.lit("allow"))
    return own.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("alias_of", "own").alias("alias_of"))
