"""Extraction over claims and documents, and from JSON that models return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..functions import extract as X
from ..lens import Tables, marked
from .text import _str

c = F.col

#: Written rows beside the fixtures' prose, which holds few names and numbers.
_ROWS = (
    "John Smith of Acme Corp. paid $42 million, up 12% in 2023. Apple Group grew 8 percent to 1,250,000 users.", "GDP growth was 5 percent in 2024 economy", "GDP growth was 8 percent in 2024 economy", "Exports fell to EUR 3.5 bn and 40 thousand subscribers left in 1999",
    "The EU budget rose to 12,500 downloads, 3 million and 77% of NVIDIA and IBM staff. Mary Ann Jones of Delta LLC", "Market share 33 pct, revenue 2.4 mld, profit 90 mln PLN", "no figures here at all", "",
)
_PLAIN = "(SELECT id, claim AS text FROM claims UNION ALL SELECT -1 - i, t FROM (SELECT unnest(range(%d)) AS i, unnest([%s]) AS t))" % (len(_ROWS), ", ".join(map(_str, _ROWS)))
_TEXTS = f"(SELECT id, {marked('text')} AS text FROM {_PLAIN})"


def texts(t: Tables) -> DataFrame:
    own = t.spark.createDataFrame([(-1 - i, x) for i, x in enumerate(_ROWS)], "id bigint, text string")
    return t.claims.select("id", c("claim").alias("text")).unionByName(own)


def _all(kind: str, pattern: str, group: int) -> str:
    return f"SELECT id, {_str(kind)} AS entity_type, trim(unnest(regexp_extract_all(text, {_str(pattern)}, {group})), ' ' || chr(9) || chr(10) || chr(13)) AS value FROM t"


_ENTITIES = " UNION ALL ".join((_all("PERSON", X.PERSON, 1), _all("ORG", X.ORG, 1), _all("MONEY", X.MONEY, 1), _all("PERCENT", X.PERCENT, 1)))


@query("ex_entities", f"SELECT * FROM (WITH t AS {_TEXTS} SELECT DISTINCT * FROM ({_ENTITIES}) WHERE length(value) BETWEEN 2 AND 200)", "claims")
def ex_entities(t: Tables) -> DataFrame:
    return texts(t).select("id", F.explode(X.entities(c("text"))).alias("x")).select("id", "x.entity_type", "x.value")


def _pairs(pattern: str) -> str:
    return f"SELECT id, unnest(regexp_extract_all(text, {_str(pattern)}, 1)) AS v, lower(unnest(regexp_extract_all(text, {_str(pattern)}, 2))) AS unit FROM t"


_FACTS = f"SELECT DISTINCT id, TRY_CAST(replace(replace(v, ',', ''), ' ', '') AS DOUBLE) AS value, trim(unit) AS unit FROM ({_pairs(X.FACT)} UNION ALL SELECT id, unnest(regexp_extract_all(text, {_str(X.GROUPED)}, 1)), 'count' FROM t UNION ALL {_pairs(X.USERS)}) WHERE TRY_CAST(replace(replace(v, ',', ''), ' ', '') AS DOUBLE) IS NOT NULL"


@query("ex_facts", f"SELECT * FROM (WITH t AS {_TEXTS} {_FACTS})", "claims")
def ex_facts(t: Tables) -> DataFrame:
    return texts(t).select("id", F.explode(X.facts(c("text"))).alias("x")).select("id", "x.value", "x.unit")


@query("ex_numbers")
def ex_numbers(t: Tables) -> DataFrame:
    return texts(t).select("id", F.posexplode(X.numbers(c("text"))).alias("pos", "x")).select("id", "pos", "x.value", "x.unit_raw", "x.unit")


@query("ex_categories", f"SELECT id, coalesce(nullif(concat_ws(',', {', '.join(f'CASE WHEN regexp_matches(text, {_str("(?i)" + p)}) THEN {_str(n)} END' for n, p in X.CATEGORIES)}), ''), 'general') AS about FROM {_PLAIN}", "claims")
def ex_categories(t: Tables) -> DataFrame:
    return texts(t).select("id", F.concat_ws(",", X.categories(c("text"))).alias("about"))


@query("ex_years", f"SELECT id, array_to_string(regexp_extract_all(text, {_str(X.YEAR)}), ',') AS years FROM {_TEXTS}", "claims")
def ex_years(t: Tables) -> DataFrame:
    return texts(t).select("id", F.concat_ws(",", X.years(c("text"))).alias("years"))


_NAME_OK = f"length(v) > 1 AND NOT list_contains([{', '.join(map(_str, X.CLAIM_STOP))}], v) AND NOT (upper(v) = v AND length(v) <= 3 AND NOT list_contains([{', '.join(map(_str, X.ACRONYMS))}], v))"


@query("ex_claim_entities", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, {_str(X.CLAIM_NAME)}), lambda v: trim(v, ' ')), lambda v: {_NAME_OK}))), '|') AS names FROM {_TEXTS}", "claims")
def ex_claim_entities(t: Tables) -> DataFrame:
    return texts(t).select("id", F.array_join(X.claim_names(c("text")), "|").alias("names"))


@query("ex_kg_names", f"SELECT * FROM (WITH t AS {_TEXTS} SELECT id, name, 'Organization' AS kind FROM (SELECT id, unnest(regexp_extract_all(text, {_str(X.KG_ORG)})) AS name FROM t) WHERE length(name) > 3 UNION ALL SELECT id, unnest(regexp_extract_all(text, {_str(X.KG_ACRONYM)})), 'Organization' FROM t UNION ALL SELECT id, unnest(regexp_extract_all(text, {_str(X.KG_AMOUNT)})), 'Amount' FROM t)", "claims")
def ex_kg_names(t: Tables) -> DataFrame:
    return texts(t).select("id", F.explode(X.graph_names(c("text"))).alias("x")).select("id", "x.name", "x.kind")


_STOP = f"[{', '.join(map(_str, X.CITATION_STOP))}]"
_GRAM = "list_filter(list_transform(range(1, len(w) - {m} + 1), lambda i: w[i:i + {k}]), lambda g: len(list_filter(g, lambda x: NOT list_contains(" + _STOP + ", x))) >= 2)"


def _grams(n: int) -> str:
    return _GRAM.format(m=n - 1, k=n - 1)


PHRASES_SQL = f"SELECT id, pos - 1 AS pos, phrase FROM (SELECT id, phrase, row_number() OVER (PARTITION BY id ORDER BY min(p)) AS pos FROM (SELECT id, unnest(g) AS gram, array_to_string(gram, ' ') AS phrase, unnest(range(len(g))) AS p FROM (SELECT id, list_concat({_grams(4)}, {_grams(3)}) AS g FROM (SELECT id, regexp_extract_all(lower(text), '\\b[a-zA-Z]{{3,}}\\b') AS w FROM {{src}}))) GROUP BY id, phrase) WHERE pos <= 20"


@query("ex_phrases", PHRASES_SQL.replace("{src}", _TEXTS), "claims")
def ex_phrases(t: Tables) -> DataFrame:
    return texts(t).select("id", F.posexplode(X.phrases(c("text"), 20)).alias("pos", "phrase")).withColumn("pos", c("pos").cast("bigint"))


@query("ex_digest", f"SELECT DISTINCT figure FROM (SELECT unnest(regexp_extract_all(text, {_str(X.FACT)})[1:2]) AS figure FROM {_TEXTS} ) ORDER BY figure LIMIT 25", "claims")
def ex_digest(t: Tables) -> DataFrame:
    return texts(t).select(F.explode(X.digest(c("text"))).alias("figure")).distinct().orderBy("figure").limit(25)


_ANSWER = "CASE id % 5 WHEN 0 THEN '{{\"claims\":[{{\"text\":\"t' || id || '\"}}]}}' WHEN 1 THEN 'Sure: ```json' || chr(10) || '[' || id || ']' || chr(10) || '``` done' WHEN 2 THEN 'list [' || id || ', 2] end' WHEN 3 THEN 'see {{\"k\":' || id || '}} ok' ELSE 'nothing ' || id END".replace("{{", "{").replace("}}", "}")


@query("ex_json", "SELECT id, CASE id % 5 WHEN 0 THEN '{\"claims\":[{\"text\":\"t' || id || '\"}]}' WHEN 1 THEN '[' || id || ']' WHEN 2 THEN '[' || id || ', 2]' WHEN 3 THEN '{\"k\":' || id || '}' END AS json FROM logs", "logs")
def ex_json(t: Tables) -> DataFrame:
    return t.logs.select("id", F.trim(X.llm_json(F.expr(_ANSWER.replace("chr(10)", "char(10)"))), F.lit("\n")).alias("json"))


@query("ex_json_claims", "SELECT event_id AS id, 'event ' || event_type || ' was seen with k ' || (props->>'$.k') AS claim, .7::DOUBLE AS confidence FROM events WHERE (props->>'$.k')::INT >= 0")
def ex_json_claims(t: Tables) -> DataFrame:
    """Claims of an answer's list; those under 15 characters are left out."""
    answer = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("event "), "event_type", F.lit(" was seen with k "), F.get_json_object("props", "$.k")).alias("claim"), F.lit(0.7).alias("confidence")), F.struct(F.lit("too short").alias("claim"), F.lit(0.9).alias("confidence"))).alias("claims")))
    found = t.events.select(c("event_id").alias("id"), F.explode(F.from_json(answer, "claims array<struct<claim string, confidence double>>")["claims"]).alias("x"))
    return found.select("id", "x.claim", "x.confidence").where(F.length("claim") >= 15)


@query("ex_json_entities", "SELECT event_id AS id, event_type AS value, CASE WHEN event_type IN ('click', 'view') THEN 'PRODUCT' ELSE 'ORG' END AS entity_type FROM events")
def ex_json_entities(t: Tables) -> DataFrame:
    """Entities of an answer's list, their types by an alias map."""
    alias = F.create_map(*map(F.lit, ("item", "PRODUCT", "company", "ORG")))
    answer = F.to_json(F.struct(F.array(F.struct(c("event_type").alias("name"), F.when(c("event_type").isin("click", "view"), "item").otherwise("company").alias("type"))).alias("entities")))
    found = t.events.select(c("event_id").alias("id"), F.explode(F.from_json(answer, "entities array<struct<name string, type string>>")["entities"]).alias("x"))
    return found.select("id", c("x.name").alias("value"), F.coalesce(F.try_element_at(alias, c("x.type")), F.upper("x.type")).alias("entity_type"))


@query("ex_json_facts", "SELECT event_id AS id, (props->>'$.k')::DOUBLE AS value, CASE WHEN v >= 80 THEN 'HIGH' WHEN v >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM (SELECT event_id, props, (event_id * 7) % 100 AS v FROM events)")
def ex_json_facts(t: Tables) -> DataFrame:
    conf = (c("event_id") * 7) % 100 / 100.0
    answer = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("double").alias("value"), conf.alias("confidence")))
    x = F.from_json(answer, "value double, confidence double")
    return t.events.select(c("event_id").alias("id"), x["value"].alias("value"), F.when(x["confidence"] >= 0.8, "HIGH").when(x["confidence"] >= 0.6, "MEDIUM").otherwise("LOW").alias("label"))


@query("ex_hypotheses", "SELECT id, CASE id % 3 WHEN 0 THEN 'h' || id WHEN 1 THEN 'r' || id ELSE 'k' || id END AS hypothesis FROM logs", "logs")
def ex_hypotheses(t: Tables) -> DataFrame:
    """The first of three shapes that an answer may have."""
    text = F.expr("""CASE id % 3 WHEN 0 THEN '{"hypotheses":["h' || id || '"]}' WHEN 1 THEN '{"resonances":["r' || id || '"]}' ELSE '{"key_finding":"k' || id || '"}' END""")
    return t.logs.select("id", text.alias("j")).select("id", F.coalesce(F.get_json_object("j", "$.hypotheses[0]"), F.get_json_object("j", "$.resonances[0]"), F.get_json_object("j", "$.key_finding")).alias("hypothesis"))


@query("ex_fuir", "SELECT id, phase AS kind, (id % 3) + 1 AS priority FROM logs", "logs")
def ex_fuir(t: Tables) -> DataFrame:
    """Entries that stand on lines of their own: [kind] P<n> text."""
    block = F.concat(F.lit("intro\n["), "phase", F.lit("] P"), ((c("id") % 3) + 1).cast("string"), F.lit(" do it\nend"))
    pattern = r"(?m)^\[(\w+)\] P(\d) .+$"
    pairs = F.arrays_zip(F.regexp_extract_all("b", F.lit(pattern), 1).alias("k"), F.regexp_extract_all("b", F.lit(pattern), 2).alias("p"))
    return t.logs.select("id", block.alias("b")).select("id", F.explode(pairs).alias("x")).select("id", c("x.k").alias("kind"), c("x.p").cast("bigint").alias("priority"))
