"""Entities, facts, numbers, years, categories and phrases out of text. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PERSON = r"\b([A-Z][a-z]+ (?:[A-Z][a-z]+ )?[A-Z][a-z]+)\b"
ORG = r"\b([A-Z][A-Za-z&\s]{2,30}(?:Inc\.|Corp\.|Ltd\.|LLC|GmbH|SA|AG|plc|Group))\b"
MONEY = r"(?i)((?:\$|€|£|USD|EUR|GBP)\s*\d[\d,\.]*\s*(?:million|billion|mln|bn)?)"
PERCENT = r"(?i)\b(\d+(?:\.\d+)?\s*(?:%|percent\b))"
FACT = r"(?i)(\d+[.,]?\d*)\s*(%|percent|million|billion|mln|mld|tys\.?|thousand|k\b|M\b|bn\b)"
GROUPED = r"\b(\d{1,3}(?:[.,]\d{3})+)\b"
USERS = r"(?i)\b(\d+)\s*(users|subscribers|downloads|installs|DAU|MAU)\b"
YEAR = r"\b(20[12]\d|199\d)\b"
NUMBER = (
    r"(?i)(?:^|[\s\(«\"'])(-?\d{1,3}(?:[,\s]\d{3})*(?:[.,]\d+)?)\s*"
    r"(%|proc\.?|percent|pct|mld\.?|billions?|bn|mln\.?|millions?|mn|tys\.?|thousands?|USD|EUR|PLN|TRY|GBP|pp|pkt|pts|points|[xX×]|razy|times|M(?![a-zA-Z])|B(?![a-zA-Z])|K(?![a-zA-Z]))"
    r"(?=[\s\.,;:)\]»\"'!?]|$)"
)
UNITS = {
    "%": ("%", "proc", "percent", "pct", "procent"), "M": ("mln", "million", "millions", "m", "mn"), "M$": ("million$",), "B": ("mld", "billion", "billions", "bn", "b"), "B$": ("billion$", "mld$"),
    "K": ("tys", "tys.", "thousand", "thousands", "k"), "USD": ("usd",), "EUR": ("eur",), "PLN": ("pln",), "TRY": ("try",), "GBP": ("gbp",), "x": ("x", "×", "times", "razy"), "pp": ("pp", "pkt", "pts", "points"),
}
CATEGORIES = (
    ("growth", r"wzrósł?|wzrost|grew?|growth|increased?|increase|surge[d]?|skoczył?"), ("decline", r"spadł?|spadek|fell?|fall|declined?|decline|decreased?|decrease"), ("market_share", r"udział|market\s+share|penetracj|penetration|rynek|market"),
    ("budget", r"budżet|budget|wydatk|spending|expenditure|nakład"), ("trade", r"eksport|export|import|handel|trade|wymian"), ("gdp", r"PKB|GDP|gospodark|economy|ekonom"), ("defence", r"obron|defenc|militar|wojsk|armia|army"),
    ("sanctions", r"sankcj|sanction|embargo|BIS|Entity\s+List"), ("users", r"użytkown|users?|audience|widzowie|viewers?|subscribers?"), ("revenue", r"przychód|przychody|revenue|profit|zysk|income|obrót|turnover"),
)
CLAIM_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:Inc|Corp|Ltd|LLC|AG|SA|GmbH|Co|plc)\.?)?\b|\b[A-Z]{2,}(?:\s+[A-Z]{2,})*\b|\$[\d,.]+\s*(?:billion|million|trillion|B|M|T)\b"
CLAIM_STOP = ("The", "This", "That", "These", "Those", "However", "Although", "According", "Furthermore", "Additionally", "Meanwhile", "Moreover", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ACRONYMS = ("AI", "EU", "US", "UK", "UN", "AWS", "GCP", "IBM", "MIT", "GDP", "CEO", "CTO", "API", "LLM", "GPU", "CPU", "RAM", "SQL", "IoT")
KG_ORG = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?:\s+(?:Inc|Corp|Ltd|LLC|AG|SA|GmbH|Co|plc)\.?)?\b"
KG_ACRONYM = r"\b[A-Z]{2,6}\b"
KG_AMOUNT = r"\$[\d,.]+\s*(?:billion|million|trillion|B|M|T)\b"
CITATION_STOP = ("the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "but", "is", "are", "was", "were", "has", "have", "had", "be", "been", "that", "this", "it", "its", "from", "by", "with", "as", "not", "no", "also", "both", "which", "who", "how", "what", "when", "where")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), group)


def entities(text: Column, most: int | None = None) -> Column:
    """Distinct struct<entity_type, value>, values of 2 to 200 characters; with ``most`` of the first so many characters only."""
    sample = text if most is None else F.substring(text, 1, most)
    one = lambda kind, p, g: F.transform(_all(sample, p, g), lambda v: F.struct(F.lit(kind).alias("entity_type"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value")))
    found = F.concat(one("PERSON", PERSON, 1), one("ORG", ORG, 1), one("MONEY", MONEY, 1), one("PERCENT", PERCENT, 1))
    return F.array_distinct(F.filter(found, lambda x: F.length(x["value"]).between(2, 200)))


def facts(text: Column, most: int | None = None) -> Column:
    """Distinct struct<value, unit>: amounts with units, grouped numbers (unit count), user metrics; ``most`` as in entities()."""
    sample = text if most is None else F.substring(text, 1, most)
    number = lambda v: F.regexp_replace(v, "[, ]", "").try_cast("double")
    pair = lambda p: F.zip_with(_all(sample, p, 1), _all(sample, p, 2), lambda v, u: F.struct(number(v).alias("value"), F.trim(F.lower(u)).alias("unit")))
    counts = F.transform(_all(sample, GROUPED, 1), lambda v: F.struct(number(v).alias("value"), F.lit("count").alias("unit")))
    return F.array_distinct(F.filter(F.concat(pair(FACT), counts, pair(USERS)), lambda x: x["value"].isNotNull()))


def canonical_unit(unit: Column) -> Column:
    bare = F.regexp_replace(F.lower(unit), r"\.$", "")
    out = F
    for name, forms in UNITS.items():
        out = out.when(bare.isin(*forms), name)
    return out.otherwise(F.upper(unit))


def numbers(text: Column) -> Column:
    """struct<value, unit_raw, unit> of numbers with units, in order."""
    number = lambda v: F.regexp_replace(v, r"[,\s ]", "").try_cast("double")
    found = F.zip_with(_all(text, NUMBER, 1), _all(text, NUMBER, 2), lambda v, u: F.struct(number(v).alias("value"), F.trim(u).alias("unit_raw"), canonical_unit(F.trim(u)).alias("unit")))
    return F.filter(found, lambda x: x["value"].isNotNull())


def years(text: Column) -> Column:
    return _all(text, YEAR, 1)


def categories(text: Column) -> Column:
    """What a text's numbers are about; general where nothing is said."""
    found = F.array_compact(F.array(*(F.when(text.rlike("(?iu)" + p), name) for name, p in CATEGORIES)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def claim_names(text: Column) -> Column:
    """Sorted distinct names; acronyms of up to three letters only if they are well known."""
    ok = lambda v: (F.length(v) > 1) & ~v.isin(*CLAIM_STOP) & ~((F.upper(v) == v) & (F.length(v) <= 3) & ~v.isin(*ACRONYMS))
    return F.array_sort(F.array_distinct(F.filter(F.transform(_all(text, CLAIM_NAME), F.trim), ok)))


def graph_names(text: Column) -> Column:
    """struct<name, kind>: organisations, acronyms and amounts."""
    one = lambda p, kind: F.transform(_all(text, p), lambda v: F.struct(v.alias("name"), F.lit(kind).alias("kind")))
    return F.concat(F.filter(one(KG_ORG, "Organization"), lambda x: F.length(x["name"]) > 3), one(KG_ACRONYM, "Organization"), one(KG_AMOUNT, "Amount"))


def phrases(claim: Column, most: int | None = None) -> Column:
    """Distinct runs of four, then of three words that hold two or more telling ones, in order; with ``most`` the first so many."""
    from .text import let

    def grams(words: Column, n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(at, lambda i: F.slice(words, i, n)), lambda g: F.size(F.filter(g, lambda w: ~w.isin(*CITATION_STOP))) >= 2)

    joined = lambda w: F.transform(F.concat(grams(w, 4), grams(w, 3)), lambda g: F.array_join(g, " "))
    found = F.array_distinct(let(_all(F.lower(claim), r"\b[a-zA-Z]{3,}\b"), joined))
    return found if most is None else F.slice(found, 1, most)


def digest(text: Column) -> Column:
    """The first two amounts of a text."""
    return F.slice(_all(text, FACT), 1, 2)


def llm_json(text: Column) -> Column:
    """JSON in a model's answer: the text itself, a fenced block, the first array, or the first object; else null."""
    good = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    some = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.coalesce(good(bare(text)), good(bare(some(r"(?s)```(?:json)?\s*(.*?)```", 1))), good(some(r"(?s)\[.*\]", 0)), good(some(r"(?s)\{.*\}", 0)))
