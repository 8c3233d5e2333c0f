"""Scanning text for content injection: known patterns, structure, encodings. Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Pattern, threat, reason; the first that matches counts.
PATTERNS = (
    (r"ignore\s+(all\s+)?(previous|prior|above|the)?\s*(instructions?|prompts?|context|system)", "instruction_hijack", "ignore previous instructions"),
    (r"disregard\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|context)", "instruction_hijack", "disregard previous instructions"),
    (r"forget\s+(everything|all)\s+(you|i|we)\s+(said|wrote|told)", "instruction_hijack", "forget everything said"),
    (r"new\s+(instruction|directive|command|task|order)\s*:", "prompt_injection", "new instruction directive"),
    (r"\[SYSTEM\]|\[INST\]|\[\/INST\]|<\|system\|>|<\|user\|>|<\|assistant\|>", "system_override", "LLM special tokens in content"),
    (r"<<<\s*SYSTEM\s*>>>|###\s*SYSTEM\s*###|\*\*\*SYSTEM\*\*\*", "system_override", "system marker injection"),
    (r"you\s+are\s+now\s+(operating|running|functioning)\s+in\s+(a\s+)?different\s+mode", "system_override", "mode switch attempt"),
    (r"\bDAN\b.*?\bjailbreak\b|\bjailbreak\b.*?\bDAN\b", "jailbreak", "DAN jailbreak pattern"),
    (r"pretend\s+(that\s+)?(you\s+)?(are|have\s+no)\s+(no\s+)?(restrictions?|limits?|guidelines?|ethics)", "jailbreak", "pretend no restrictions"),
    (r"act\s+as\s+(if\s+you\s+were\s+)?(an?\s+)?(evil|malicious|unrestricted|unfiltered)(\s+(AI|assistant|model))?", "role_confusion", "act as evil AI"),
    (r"you\s+are\s+now\s+(an?\s+)?(AI\s+)?(without|with\s+no)\s+(restrictions?|limits?|filters?|censorship)", "role_confusion", "AI without restrictions"),
    (r"print\s+(the\s+)?(following|this)\s+(text|message|content)\s+verbatim", "prompt_injection", "verbatim print injection"),
    (r"respond\s+only\s+with\s*[\"'`].*[\"'`]", "prompt_injection", "respond only with specific text"),
    (r"your\s+(new\s+)?(secret\s+)?password\s+(is|=)\s*['\"]?\w+", "prompt_injection", "password injection attempt"),
    (r"execute\s+(the\s+)?(following|this)\s+(code|script|command|instruction)", "prompt_injection", "execute instruction injection"),
    (r"zignoruj\s+(wszystkie\s+)?(poprzednie|wcześniejsze)\s+(instrukcje|polecenia|zasady)", "instruction_hijack", "PL: ignore previous instructions"),
    (r"udawaj\s+(że\s+)?(jesteś|nie\s+masz)\s+(ograniczeń|limitów|zasad)", "jailbreak", "PL: pretend no restrictions"),
    (r"nowe\s+(polecenie|instrukcja|zadanie)\s*:", "prompt_injection", "PL: new instruction"),
)
#: For each pattern literals of which a text that matches holds one, in lower case: others are not searched.
NEEDS = (
    ("ignore",), ("disregard",), ("forget",), ("instruction", "directive", "command", "task", "order"), ("[system]", "[inst]", "[/inst]", "<|"), ("system",), ("different",), ("jailbreak",), ("pretend",),
    ("evil", "malicious", "unrestricted", "unfiltered"), ("restriction", "limit", "filter", "censorship"), ("verbatim",), ("respond",), ("password",), ("execute",), ("zignoruj",), ("udawaj",), ("nowe",),
)
#: Letters that match an ASCII one where case is ignored, beyond its capital, and those.
ALIKE = ("ıſ\u212aİ", "iski")
CONTROL = r"(?i)\b(?:instruction|command|directive|override|bypass|ignore|forget|disregard|pretend|roleplay|jailbreak|unrestricted|unfiltered|without.restrictions)\b"
TEMPLATE = r"(?i)(?:\[INST\]|\[\/INST\]|\[SYSTEM\]|\[\/SYSTEM\]|<\|im_start\|>|<\|im_end\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|<<SYS>>|<</SYS>>)"
ROT13 = r"(?i)\b(?:vafgehpgvba|vtzaber|cerivbhf|erfrg|cnffjbeq|flfgrz)\b"
BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"

_SCHEMA = "struct<threat:string,score:double,reason:string,snippet:string>"


def _found(threat: str, score, reason: str, snippet: Column | None = None) -> Column:
    score = score if isinstance(score, Column) else F.lit(score)
    return F.struct(F.lit(threat).alias("threat"), score.cast("double").alias("score"), F.lit(reason).alias("reason"), (F.lit("") if snippet is None else snippet).alias("snippet"))


def known_pattern(text: Column) -> Column:
    """Layer 1: the first known pattern that matches, with what it matched (80 characters)."""

    def first(low: Column) -> Column:
        found = []
        for (pattern, threat, reason), needs in zip(PATTERNS, NEEDS, strict=True):
            full = "(?isU)" + pattern
            what = F.translate(F.substring(F.regexp_extract(text, full, 0), 1, 80), "\n", " ")
            may = reduce(or_, (F.contains(low, F.lit(x)) for x in needs))
            found.append(F.when(may & text.rlike(full), _found(threat, 0.95, reason, what)))
        return F.coalesce(*found, F.lit(None).cast(_SCHEMA))

    return let(F.lower(F.translate(text, *ALIKE)), first)


def structure(text: Column) -> Column:
    """Layer 2: control words, template tokens, capitals."""
    # Words of capitals hold no a-z: few are left to look at.
    counted = F.struct(F.regexp_count(text, F.lit(r"(?U)\S+")).alias("n"), F.regexp_extract_all(text, F.lit(r"(?U)(?<!\S)[^\sa-z]{4,}+(?!\S)"), 0).alias("words"))

    def judged(x: Column) -> Column:
        n = x["n"]
        control = F.regexp_count(text, F.lit("(?U)" + CONTROL)) / F.greatest(n, F.lit(1))
        loud = F.size(F.filter(x["words"], lambda w: (F.upper(w) == w) & (F.lower(w) != w))) / F.greatest(n, F.lit(1))
        return (
            F.when(n == 0, F.lit(None).cast(_SCHEMA))
            .when((n >= 20) & (control > 0.12), _found("prompt_injection", F.least(0.5 + control * 2, F.lit(0.9)), "control words"))
            .when(F.regexp_count(text, F.lit(TEMPLATE)) >= 3, _found("system_override", 0.85, "template tokens"))
            .when((n >= 15) & (loud > 0.35), _found("prompt_injection", 0.7, "capitals"))
        )

    return let(counted, judged)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda x: F.length(x) > 0)

    def bits(x: Column) -> Column:
        n = F.size(x)
        share = lambda ch: F.size(F.filter(x, lambda y: y == ch)) / n
        return F.aggregate(F.transform(F.array_distinct(x), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.length(text) > 0, let(chars, bits)).otherwise(0.0)


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def mixed_scripts(text: Column) -> Column:
    """Ten or more suspicious letters: phonetic ones, and Cyrillic ones among Latin ones."""
    cyrillic, latin, phonetic = _without(text, r"[Ѐ-ӿ]"), _without(text, "[A-Za-z]"), _without(text, r"[ᴀ-ᵿ]")
    ratio = cyrillic / F.greatest(cyrillic + latin, F.lit(1))
    mixed = (cyrillic >= 5) & (latin >= 3) & (ratio > 0.05) & (ratio < 0.85)
    return phonetic + F.when(mixed, cyrillic).otherwise(0) >= 10


def encoded_threat(text: Column) -> Column:
    """A base64 block that hides a known pattern; blocks are padded, and bytes that are no UTF-8 don't count."""
    blocks = F.regexp_extract_all(text, F.lit(BASE64), 0)
    bare = lambda b: F.regexp_replace(b, "=+$", "")
    whole = lambda b: F.substring(bare(b), F.lit(1), F.length(bare(b)) - F.when(F.length(bare(b)) % 4 == 1, 1).otherwise(0))
    padded = lambda b: F.concat(whole(b), F.when(F.length(whole(b)) % 4 == 2, "==").when(F.length(whole(b)) % 4 == 3, "=").otherwise(""))
    plain = lambda b: F.coalesce(F.try_validate_utf8(F.try_to_binary(padded(b), F.lit("base64")).cast("string")), F.lit(""))
    return F.exists(blocks, lambda b: known_pattern(plain(b)).isNotNull())


def scan(text: Column, fast: bool = False) -> Column:
    """struct<threat, score, reason, snippet> of the first layer that finds something, else null.

    Texts of less than 10 characters, trimmed, and null ones are clean; fast stops after layer 1.
    """
    first = known_pattern(text)
    if not fast:
        third = (
            F.when(F.when(text.rlike(BASE64), encoded_threat(text)).otherwise(False), _found("encoded_attack", 0.98, "base64"))
            .when(text.rlike("(?U)" + ROT13), _found("encoded_attack", 0.88, "rot13"))
            .when(mixed_scripts(text), _found("encoded_attack", 0.8, "mixed scripts"))
            .when(F.when(F.length(text) < 300, entropy(text)).otherwise(0.0) > 5.2, _found("encoded_attack", 0.65, "entropy"))
        )
        first = F.coalesce(first, structure(text), third)
    return F.when(F.length(F.trim(text)) >= 10, first)
