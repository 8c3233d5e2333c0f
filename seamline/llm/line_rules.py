"""Line-first cleaning with column functions only: rules judge lines, then documents by what is left.

Every line that holds a word is held against five rules in order; those that fail one are
removed, and a document that loses more than a share of its words is rejected. All is
expressed for a row, so nothing moves between tasks; arrays that lambdas look into are
columns of a projection of their own, so that they are computed once a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blank and \t..\r: what stands between words.
SPACE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 8
#: Ends of sentences, and quotes and brackets that may follow.
ENDING = r"[.!?…。！？:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"
BOILERPLATE = (
    "all rights reserved", "copyright", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "click here", "read more", "sign up", "log in", "subscribe", "share this",
    "alle rechte vorbehalten", "impressum", "datenschutz", "tous droits réservés", "mentions légales", "politique de confidentialité", "todos los derechos reservados", "aviso legal", "política de privacidad",
)


@dataclass(frozen=True)
class LineRules:
    """Shares are in percent, of the words of a line where not said otherwise."""

    most_signs: int = 20  #: navigation: runs of the signs, as between entries of menus and tables
    most_capitals: int = 50  #: shouting: capitals among the letters of a line of two words or more
    short: int = 8  #: punctuation: shorter lines must end a sentence; repetition: longer ones are judged
    most_calls: int = 50  #: punctuation: runs of ! and ?
    least_distinct: int = 50  #: repetition: distinct words
    boilerplate: tuple[str, ...] = BOILERPLATE  #: boilerplate: any of these phrases (lower case), in any case
    most_lost: int = 40  #: a document's words that removed lines hold


def words(text: Column) -> Column:
    """The words of a text; of a null one too: none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def _shouted(line: Column, r: LineRules) -> Column:
    """Whether capitals exceed their share of the letters; these are counted only where there are more capitals than that share of the runs of letters."""
    capitals, letters = F.regexp_count(line, F.lit(r"\p{Lu}")), F.length(F.regexp_replace(line, r"\P{L}+", ""))
    return (capitals * 100 > F.regexp_count(line, F.lit(r"\p{L}+")) * r.most_capitals) & (capitals * 100 > letters * r.most_capitals)


def _judged(row: Column, r: LineRules, suspect: bool) -> Column:
    """A line and its words (line, n) with the first rule that it fails; none for a line without words. suspect: whether its text holds boilerplate at all."""
    line, n = row["line"], row["n"]
    fails = (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(F.regexp_count(line, F.lit(f"[{SIGNS}]+")) * 100 > n * r.most_signs, "navigation")
        .when((n >= 2) & _shouted(line, r), "shouting")
        .when(((n < r.short) & ~F.rlike(line, F.lit(ENDING))) | (F.regexp_count(line, F.lit("[!?]+")) * 100 > n * r.most_calls), "punctuation")
        .when((n >= r.short) & (F.size(F.array_distinct(words(line))) * 100 < n * r.least_distinct), "repetition")
    )
    if suspect:
        fails = fails.when(F.rlike(line, F.lit(f"(?iu){'|'.join(map(re.escape, r.boilerplate))}")), "boilerplate")
    return F.struct(line.alias("line"), n.alias("n"), fails.alias("fails"))


def _repeated(rows: DataFrame) -> DataFrame:
    """``rows`` with __repeated: words in windows of WINDOW words that their __words hold twice or more.

    Windows meet by their hashes, sorted within the row; those that meet are compared word by word.
    """
    n = F.size("__words")
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("__hashes", F.when(n > WINDOW, hashes))
    start = F.sequence(F.lit(0), n - WINDOW)
    rows = rows.withColumn("__windows", F.when(n > WINDOW, F.transform(start, lambda i: F.xxhash64(*(F.get("__hashes", i + k) for k in range(WINDOW))))))
    # Most texts repeat nothing, and need no sorting.
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    rows = rows.withColumn("__sorted", F.when(some, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # Word by word, as slice() copies the whole array each time.
    alike = lambda x, y: reduce(and_, (F.get("__words", x["i"] + k) == F.get("__words", y["i"] + k) for k in range(WINDOW)))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & alike(x, y), F.lit(False))
    twice = F.filter("__sorted", lambda x, k: same(x, F.get("__sorted", k - 1)) | same(x, F.get("__sorted", k + 1)))
    rows = rows.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    own = F.transform("__starts", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - i, F.lit(WINDOW))))
    return rows.withColumn("__repeated", F.coalesce(F.aggregate(own, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0)).cast("bigint"))


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """<key>, counts of the text, base_failed, kept, removed lines and their words, the rule each of these failed, and the cleaned text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier
    one) and n_repeat_words (in windows of eight words found twice or more) are of the whole text. base_failed:
    fewer than 20 words, or more than 30 percent of them repeated. kept: not base_failed, and lines that fail
    a rule hold no more than rules.most_lost percent of the words. removed maps each rule to its number of
    lines; cleaned is the text without them, lines without words as they were.

    One row for each row of ``docs``, repeated keys and null ones too. A null or empty text has no words, so it
    is base_failed and its cleaned text is empty; texts of any length are judged whole; equal lines fail
    alike; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # Letters that lower() leaves and a pattern takes for others in any case.
    low = F.translate(F.lower("__text"), "ſıİ", "sii")
    rows = rows.withColumns({"__words": words(F.col("__text")), "__low": F.when(F.rlike("__text", F.lit("[ſıİ]")), low).otherwise(F.lower("__text"))})
    suspect = reduce(or_, (F.contains("__low", F.lit(x)) for x in rules.boilerplate), F.lit(False))
    # Words are counted first, as a lambda evaluates what it names each time anew.
    counted = F.transform(F.split("__text", "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    judged = lambda held: F.transform(counted, lambda x: _judged(x, rules, held))
    rows = rows.withColumn("__lines", F.when(suspect, judged(True)).otherwise(judged(False)))
    # A generator: a filter on the result isn't taken below it, where it would repeat all that for every word.
    rows = _repeated(rows).select(F.inline(F.array(F.struct("__key", "__text", "__words", "__lines", "__repeated"))))
    some = F.filter("__lines", lambda x: x["n"] > 0)
    gone = F.filter("__lines", lambda x: x["fails"].isNotNull())
    rows = rows.withColumns({"__some": F.transform(some, lambda x: x["line"]), "__gone": gone})
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    times = lambda pattern: F.regexp_count("__text", F.lit(pattern)).cast("bigint")
    rows = rows.select(
        F.col("__key").alias(key),
        F.size("__words").cast("bigint").alias("n_words"),
        (F.length("__text") - times(GAP[:-1])).alias("word_chars"),
        times(f"[{SIGNS}]").alias("n_symbols"),
        (F.size("__some") - F.size(F.array_distinct("__some"))).cast("bigint").alias("n_dup_lines"),
        F.col("__repeated").alias("n_repeat_words"),
        F.size("__gone").cast("bigint").alias("n_removed"),
        total(F.col("__gone")).alias("words_removed"),
        F.transform("__gone", lambda x: x["fails"]).alias("removed"),
        F.array_join(F.transform(F.filter("__lines", lambda x: x["fails"].isNull()), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("words_removed") <= rules.most_lost * F.col("n_words")))
