"""Scoring, tiers and routing of sources. Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_any

# Fixed values.
AUTHORITY = (
    ("statista.com", 15), ("datareportal.com", 15), ("gsma.com", 15), ("itu.int", 15), ("worldbank.org", 15), ("imf.org", 15), ("reuters.com", 12), ("bloomberg.com", 12), ("ft.com", 12), ("gov.pl", 10), ("europa.eu", 10), ("un.org", 10), ("arxiv.org", 10),
    ("tuik.gov.tr", 15), ("btk.gov.tr", 13), ("sabah.com.tr", 8), ("geostat.ge", 15), ("civil.ge", 10), ("pwc.com", 11), ("mckinsey.com", 11), ("deloitte.com", 11), ("gartner.com", 12), ("idc.com", 12), ("emarketer.com", 12), ("forrester.com", 12),
)
FRESHNESS = ((r"\b202[4-9]\b", 10), (r"\b202[0-3]\b", 7), (r"\b201[5-9]\b", 4))
DEPTH = (r"\bpdf\b", r"\.pdf", r"\breport\b", r"\bstudy\b", r"\banalysis\b", r"\bstatistic", r"\bdata\b", r"\bsurvey\b", r"\bwhitepaper\b", r"\bresearch\b", r"\bfinding", r"\bresult", r"\bmarket")
TYPE_BONUS = {"academic": 10, "report": 8, "pdf": 8, "primary": 7, "news": 5, "rss": 5, "gnews": 5, "wayback": 6, "reddit": 3, "social": 3, "ddg": 4, "perspective": 5, "document": 8}
HIGH = (
    "europa.eu", "ted.europa.eu", "ec.europa.eu", "sam.gov", "contracts.finder.service.gov.uk", "find-tender.service.gov.uk", "uzp.gov.pl", "ezamowienia.gov.pl", "biznes.gov.pl", "reuters.com", "bloomberg.com", "ft.com", "wsj.com", "statista.com", "datareportal.com", "worldbank.org", "imf.org",
    "gartner.com", "forrester.com", "idc.com", "mckinsey.com", "deloitte.com", "pwc.com", "kpmg.com", "ey.com", "arxiv.org", "nature.com", "sciencedirect.com", "pubmed.ncbi.nlm.nih.gov", "semanticscholar.org", "clutch.co", "g2.com", "capterra.com", "trustpilot.com", "getapp.com",
    "techcrunch.com", "wired.com", "venturebeat.com", "hbr.org", "businessinsider.com", "forbes.com", "stat.gov.pl", "nask.pl", "computerworld.pl", "spidersweb.pl", "antyweb.pl", "telepolis.pl", "eb2b.com.pl", "logintrade.net",
)
LOW = ("pinterest.com", "tumblr.com", "quora.com", "reddit.com", "blogspot.com", "wordpress.com", "medium.com", "youtube.com", "tiktok.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "amazon.com", "ebay.com", "etsy.com", "aliexpress.com", "bit.ly", "tinyurl.com", "linktr.ee", "yahoo.com", "answers.com")
PAYWALL = ("jstor.org", "springer.com", "wiley.com", "tandfonline.com", "elsevier.com", "ieee.org", "acm.org")
PORTALS = ("ted.europa.eu", "sam.gov", "contracts.finder.service.gov.uk", "find-tender.service.gov.uk", "ezamowienia.gov.pl", "eb2b.com.pl", "logintrade.net")
API_PATTERNS = (r"/api/v\d+/", r"/api/public/", r"\.json$", r"\.xml$", r"/rest/", r"/v\d+/[a-z]", r"/feed\.xml", r"/rss\.xml", r"\?format=json", r"\?output=json")
SPA = ("app.", "dashboard.", "console.", "portal.", "platform.", "admin.")
BLACKLIST = (
    "wikipedia.org", "wiktionary.org", "wikimedia.org", "wikisource.org", "britannica.com", "encyclopedia.com", "wikihow.com", "outlook.com", "office.com", "microsoft.com", "pinterest.com", "pinterest.design", "tumblr.com", "reddit.com", "quora.com", "facebook.com", "instagram.com", "twitter.com", "x.com",
    "amazon.com", "ebay.com", "etsy.com", "aliexpress.com", "allegro.pl", "the-qrcode-generator.com", "qr-code-generator.com", "nibiru.net", "shz.de", "iso.org.tr", "roblox.com", "twitch.tv", "youtube.com", "tiktok.com", "spotify.com", "netflix.com", "imdb.com", "feedburner.com", "bit.ly", "tinyurl.com", "linktr.ee", "indeed.com", "glassdoor.com", "pracuj.pl", "linkedin.com/jobs",
)
PREMIUM = (
    "statista.com", "datareportal.com", "gsma.com", "itu.int", "worldbank.org", "imf.org", "reuters.com", "bloomberg.com", "ft.com", "mckinsey.com", "gartner.com", "forrester.com", "emarketer.com", "idc.com", "pwc.com", "deloitte.com", "hbr.org", "techcrunch.com", "wired.com", "venturebeat.com",
    "businessinsider.com", "forbes.com", "wsj.com", "gov.pl", "stat.gov.pl", "nask.pl", "computerworld.pl", "spidersweb.pl", "antyweb.pl", "telepolis.pl",
)
RESEARCH = ("report", "study", "data", "statistics", "survey", "research", "market", "analysis", "trend", "benchmark", "raport")
RESCUE = ("saas", "tiktok", "social media", "marketing", "b2b", "consulting", "poland", "polska", "turkey", "georgia", "linkedin", "roi")


def under(host: Column, domains) -> Column:
    """Whether the host is one of the domains or below one."""
    return F.coalesce(F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))


def _first(rules, otherwise) -> Column:
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def score(text: Column, host: Column, kind: Column, topic_words) -> Column:
    """struct<relevance, freshness, authority, depth, total>; text is title, snippet and url in lower case."""
    relevance = F.least(F.lit(25), F.floor(F.size(F.filter(F.array(*map(F.lit, topic_words)), lambda w: F.contains(text, w))) / max(1, len(topic_words)) * 25)).cast("int")
    freshness = _first([(text.rlike(p), n) for p, n in FRESHNESS], 8)
    authority = _first(
        [(F.contains(host, F.lit(d)), n) for d, n in AUTHORITY] + [(has_any(host, (".gov", ".int", ".edu")), 12), (has_any(host, (".org",)), 9), (has_any(host, ("news", "press", "media", "journal", "report")), 7), (has_any(host, (".co.", ".com", ".io", ".ai")), 7)], 6
    )
    depth = F.least(F.lit(15), 3 * reduce(lambda a, b: a + b, (F.when(text.rlike(p), 1).otherwise(0) for p in DEPTH)))
    bonus = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in TYPE_BONUS.items() for x in (F.lit(k), F.lit(v)))), F.lower(kind)), F.lit(3))
    return F.struct(relevance.alias("relevance"), freshness.alias("freshness"), authority.alias("authority"), depth.alias("depth"), F.least(F.lit(100), relevance + freshness + authority + depth + bonus).alias("total"))


def gate(text: Column, host: Column, kind: Column) -> Column:
    """Whether a source is worth saving: not blacklisted, and a first score of 5, or a rescuing word or feed."""
    first = F.when(under(host, PREMIUM), 10).otherwise(0) + F.when(text.rlike("202[4-6]"), 5).otherwise(0) + F.when(has_any(text, RESEARCH), 2).otherwise(0)
    return ~under(host, BLACKLIST) & ((first >= 5) | kind.isin("rss_gov", "rss_industry", "gov_stat") | has_any(text, RESCUE))


def domain_class(url: Column, host: Column) -> Column:
    """struct<tier, paywall, api, spa>."""
    tier = F.when(under(host, HIGH), "HIGH").when(under(host, LOW), "LOW").when(has_any(host, (".gov", ".edu", ".int")), "HIGH").otherwise("MEDIUM")
    api = reduce(lambda a, b: a | b, (F.lower(url).rlike(p) for p in API_PATTERNS))
    spa = reduce(lambda a, b: a | b, (F.startswith(host, F.lit(p)) for p in SPA))
    return F.struct(tier.alias("tier"), under(host, PAYWALL).alias("paywall"), api.alias("api"), F.coalesce(spa, F.lit(False)).alias("spa"))


def route(url: Column, host: Column, status: Column, content_type: Column, size: Column, failed: Column, kind: Column, points: Column, quality: Column, harvests: Column) -> Column:
    """struct<resource, decision, flag>: what a source is and how to fetch it; the first rule that fits counts.

    kind is domain_class(); quality and harvests are the host's reputation (null where unknown), which
    promotes a low tier of good history and skips hosts of bad history.
    """
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    out = lambda resource, decision, flag: F.struct(F.lit(resource).alias("resource"), F.lit(decision).alias("decision"), (flag if isinstance(flag, Column) else F.lit(flag)).alias("flag"))
    high = kind["tier"] == "HIGH"
    known = quality.isNotNull()
    promoted = F.coalesce((quality >= 0.65) & (harvests >= 3), F.lit(False))
    poor = F.coalesce(known & (quality < 0.2) & (harvests >= 5), F.lit(False))
    low = (kind["tier"] == "LOW") & ~promoted & (F.coalesce(points, F.lit(0)) < 20) & (F.coalesce(quality, F.lit(0.0)) < 0.5)
    lost = F.coalesce(failed, F.lit(False)) | status.isNull()
    pdf = F.contains(ct, F.lit("pdf")) | F.endswith(path, F.lit(".pdf"))
    feed = has_any(ct, ("rss", "atom")) | has_any(path, ("/feed/",)) | path.rlike(r"(\.xml|/feed|/rss)$")
    return (
        F.when(F.coalesce(has_any(host, PORTALS), F.lit(False)), out("database_portal", "dedicated_connector", "procurement_portal"))
        .when(lost & high, out("static_html", "standard_drone", "high_tier_head_fail")).when(lost, out("unknown", "skip", "head_failed"))
        .when(status == 401, out("paywall", "bee_master_needed", "auth_required"))
        .when((status == 403) & kind["paywall"], out("paywall", "bee_master_needed", "paywall_known")).when((status == 403) & high, out("static_html", "standard_drone", "high_tier_403_head_may_get")).when(status == 403, out("thin_content", "skip", "blocked_403"))
        .when(status == 429, out("unknown", "bee_master_needed", "rate_limited")).when(status >= 400, out("thin_content", "skip", F.concat(F.lit("http_"), status.cast("string"))))
        .when(kind["api"] | ct.isin("application/json", "application/xml", "text/xml", "application/atom+xml"), out("api_endpoint", "api_bee", "api_available"))
        .when(pdf & (size > 5_000_000), out("pdf", "skip", "pdf_too_large")).when(pdf, out("pdf", "pdf_drone", F.when(size < 200_000, "pdf_small").otherwise("")))
        .when(feed, out("rss_feed", "rss_bee", "")).when(size < 5_000, out("thin_content", "skip", "thin_content"))
        .when(poor, out("thin_content", "skip", "rep_low_quality")).when(low, out("thin_content", "skip", "low_tier_low_score"))
        .when(kind["spa"], out("spa", "heavy_drone", "js_heavy")).otherwise(out("static_html", "standard_drone", F.when((kind["tier"] == "LOW") & promoted, "rep_promoted_to_medium").otherwise("")))
    )


def boost(quality: Column, harvests: Column, blacklisted: Column) -> Column:
    """Factor for a host's scores by its reputation."""
    return (
        F.when(F.coalesce(blacklisted, F.lit(False)), 0.0).when(quality.isNull() | (harvests < 2), 1.0).when(quality >= 0.75, 1.35).when(quality >= 0.55, 1.10).when(quality >= 0.35, 1.0).when(quality >= 0.25, 0.65).otherwise(0.35)
    )
