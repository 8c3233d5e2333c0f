"""Tool-call linking: calls meet their results by identifier, are ordered, checked and serialised.

Calls and results are hash-joined on (conversation, call id). A call's level is the length of
the longest chain of dependencies before it, so (level, turn, position) is a topological order.
Chains of single dependencies, however long, are followed by pointer doubling (rounds grow with
the logarithm of a chain); calls with several dependencies are settled round by round among
themselves. No conversation is gathered in one task. Arguments are checked against schemas, and
each call is written with its result as canonical JSON (keys by UTF-16 units, no blanks, shortest numbers).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import dropped, written

_KINDS = {
    "string": lambda x: isinstance(x, str), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(), "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool), "null": lambda x: x is None, "array": lambda x: isinstance(x, list), "object": lambda x: isinstance(x, dict),
}
#: Keywords that check() tests, and those that say nothing about a value.
_TESTED = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "items", "minItems", "maxItems", "properties", "required", "additionalProperties"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$comment"}


def canonical(value) -> str:
    """Canonical JSON: keys by their UTF-16 units, no blanks, shortest numbers; integers of any size as they are.

    ValueError for what canonical JSON can't hold: lone surrogates, numbers that are not finite.
    """
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number is not finite")
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
        return re.sub(r"e([+-])0+", r"e\1", repr(value))
    if isinstance(value, str):
        try:
            value.encode()
        except UnicodeEncodeError:
            raise ValueError("a lone surrogate") from None
    return json.dumps(value, ensure_ascii=False)


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a repeated key")
    return found


def _not_finite(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed(text: str):
    """JSON; ValueError for anything else, for repeated keys too."""
    return json.loads(text, object_pairs_hook=_once, parse_constant=_not_finite)


def known_schema(schema, at: str = "$") -> None:
    """ValueError where a schema says something that check() doesn't test."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema must be an object")
    if odd := sorted(set(schema) - _TESTED - _NOTES):
        raise ValueError(f"{at}: unknown keywords {', '.join(odd)}")
    kinds = schema.get("type", [])
    if odd := sorted({kinds} - set(_KINDS) if isinstance(kinds, str) else set(kinds) - set(_KINDS)):
        raise ValueError(f"{at}: unknown types {', '.join(odd)}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties must be true or false")
    re.compile(schema.get("pattern", ""))
    if "items" in schema:
        known_schema(schema["items"], f"{at}[]")
    for k, v in schema.get("properties", {}).items():
        known_schema(v, f"{at}.{k}")


def check(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` the schema (see known_schema) rules out."""
    kinds = schema.get("type")
    if kinds is not None and not any(_KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds if isinstance(kinds, str) else '/'.join(kinds)}"]
    tests = []
    # Values are compared as JSON, where true is not 1 and 1.0 is.
    own = canonical(value) if "enum" in schema or "const" in schema else ""
    if "enum" in schema:
        tests.append(("not in enum", own not in map(canonical, schema["enum"])))
    if "const" in schema:
        tests.append(("not the constant", own != canonical(schema["const"])))
    if _KINDS["number"](value):
        tests += [("below minimum", value < schema.get("minimum", value)), ("above maximum", value > schema.get("maximum", value))]
        tests += [("not above exclusive minimum", "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]), ("not below exclusive maximum", "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"])]
    if isinstance(value, str):
        tests += [("too short", len(value) < schema.get("minLength", 0)), ("too long", len(value) > schema.get("maxLength", len(value))), ("does not match", "pattern" in schema and not re.search(schema["pattern"], value))]
    if isinstance(value, list):
        tests += [("too few items", len(value) < schema.get("minItems", 0)), ("too many items", len(value) > schema.get("maxItems", len(value)))]
    out = [f"{at}: {what}" for what, bad in tests if bad]
    if isinstance(value, list) and "items" in schema:
        out += [e for i, x in enumerate(value) for e in check(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        inner = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in inner]
        out += [e for k in sorted(value) if k in inner for e in check(value[k], inner[k], f"{at}.{k}")]
    return out


def levels(edges: DataFrame) -> DataFrame:
    """node, level from edges (node, before; each node once with a null before too): null level on and behind cycles.

    Edges to unknown nodes are to be left out; repeated edges count once.
    """
    edges = written(edges.select("node", "before").distinct(), "deps")
    degree = edges.groupBy("node").agg(F.count("before").alias("n"), F.max("before").alias("before"))
    # Calls with one dependency point to it; all others are anchors and point to themselves.
    single = F.col("n") == 1
    at = written(degree.select("node", F.when(single, F.col("before")).otherwise(F.col("node")).alias("to"), F.when(single, 1).otherwise(0).cast("bigint").alias("far"), F.when(single, F.lit(False)).otherwise(True).alias("done")), "pointers")
    for _ in range(math.ceil(math.log2(max(2, at.count()))) + 1):
        if at.where("not done").isEmpty():
            break
        hop = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        step = at.where("not done").join(hop, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.coalesce("done2", F.lit(False)).alias("done"))
        following = written(at.where("done").unionByName(step), "pointers")
        dropped(at)
        at = following
    # Pointers that still end at no anchor lie on or behind a cycle of single dependencies.
    ends = at.where("done")
    multi = degree.where("n > 1").select("node")
    needs = edges.where("before is not null").join(multi, "node").join(at.select(F.col("node").alias("before"), F.when(F.col("done"), F.col("to")).alias("anchor"), "far"), "before", "left").select("node", "anchor", "far", F.lit(None).cast("bigint").alias("level"))
    new = written(degree.where("n = 0").select("node", F.lit(0).cast("bigint").alias("level")), "levels")
    needs = written(needs, "needs")
    known = [new]
    # Each round settles the calls all of whose anchors are settled; what waits gets shorter, and so do its tables.
    while not needs.isEmpty():
        met = needs.join(new.select(F.col("node").alias("anchor"), F.col("level").alias("own")), "anchor", "left").select("node", "anchor", "far", F.coalesce("level", F.col("own") + F.col("far") + 1).alias("level"))
        met = written(met, "needs")
        dropped(needs)
        new = written(met.groupBy("node").agg(F.max("level").alias("level"), F.min(F.col("level").isNotNull()).alias("all")).where("all").select("node", "level"), "levels")
        if new.isEmpty():
            break
        known.append(new)
        needs = written(met.join(new.select("node"), "node", "left_anti"), "needs")
        dropped(met)
    levelled = reduce(DataFrame.unionByName, known)
    settled = ends.join(levelled.withColumnRenamed("node", "to"), "to").select("node", (F.col("far") + F.col("level")).alias("level"))
    found = written(degree.select("node").join(settled, "node", "left"), "depth")
    for x in (edges, at, *known):
        dropped(x)
    return found


def _name(conv: Column, call: Column) -> Column:
    """One identifier for both; no two pairs share one. Null where either is."""
    conv = conv.cast("string")
    return F.concat(F.length(conv).cast("string"), F.lit(":"), conv, call.cast("string"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call and for each result without one: conv_id, call_id, turn, position, level, result_turn, status, errors, json.

    calls: conv_id, call_id, turn, position, name, arguments (JSON), after (array of call ids);
    results: conv_id, call_id, turn, content. status is ok, invalid (arguments are no JSON, hold a repeated
    key or a lone surrogate, break their schema, or name no known tool), unanswered, repeated (an id that an
    earlier call has), cyclic, or orphan (a result without a call); errors says why. Of several results for
    a call the first counts, of equal turns the one with the smallest content. A null id can't be linked:
    such calls are unanswered, such results orphans. Null arguments are an empty object, null ``after`` and
    unknown ids in it no dependencies; repeated rows are rows; empty calls leave only orphans; texts are
    taken whole. Schemas with keywords that are not tested raise a ValueError. Other columns are not read.
    """
    for name, schema in schemas.items():
        known_schema(schema, name)
    kinds = {f.name: f.dataType.simpleString() for f in calls.select("conv_id", "call_id", "turn", "position").schema}
    # Calls without an id are spread over tasks under names that no other row has.
    nameless = F.concat(F.lit("?"), F.pmod(F.xxhash64("turn", "position", "arguments"), F.lit(65536)).cast("string"))
    calls = calls.select(_name(F.col("conv_id"), F.col("call_id")).alias("own"), "conv_id", "call_id", "turn", "position", "name", "arguments", "after")
    results = results.select(_name(F.col("conv_id"), F.col("call_id")).alias("node"), "conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    nodes = calls.where("own is not null").groupBy(F.col("own").alias("node")).agg(F.min(F.struct("turn", "position")).alias("first"))
    wanted = calls.where("own is not null").select(F.col("own").alias("node"), "conv_id", F.explode("after").alias("b")).select("node", _name(F.col("conv_id"), F.col("b")).alias("before")).where("before is not null")
    wanted = wanted.join(nodes.select(F.col("node").alias("before")), "before", "left_semi").select("node", "before")
    depth = levels(wanted.unionByName(nodes.select("node", F.lit(None).cast("string").alias("before"))))
    # All joins are on one key, so each side moves once.
    answer = results.where("node is not null").groupBy("node").agg(F.min(F.struct("result_turn", "content")).alias("answer"))
    rows = calls.withColumn("node", F.coalesce("own", nameless)).join(nodes.join(depth, "node", "left"), "node", "left").join(answer, "node", "left")
    rows = rows.select(
        "conv_id", "call_id", "turn", "position", "name", "arguments", "level", F.col("answer.result_turn").alias("result_turn"), F.col("answer.content").alias("content"), F.col("answer").isNotNull().alias("answered"),
        (F.col("own").isNotNull() & ~F.struct("turn", "position").eqNullSafe(F.col("first"))).alias("repeated"), (F.col("own").isNotNull() & F.col("level").isNull()).alias("cyclic"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["call_id", "name", "arguments", "content", "answered", "repeated", "cyclic"]).to_pylist():
                text, errors = None, []
                try:
                    value = parsed(r["arguments"] if r["arguments"] is not None else "{}")
                    text = canonical({"arguments": value, "id": r["call_id"], "name": r["name"], "result": r["content"]})
                    errors = check(value, schemas[r["name"]]) if r["name"] in schemas else ["unknown tool"]
                except json.JSONDecodeError:
                    errors = ["$: not JSON"]
                except (ValueError, RecursionError) as e:
                    errors = [f"$: {e}" if isinstance(e, ValueError) else "$: nested too deeply"]
                    text = None
                status = "repeated" if r["repeated"] else "cyclic" if r["cyclic"] else "invalid" if errors else "ok" if r["answered"] else "unanswered"
                out.append((status, "; ".join(errors), text))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "call_id", "turn", "position", "level", "result_turn")), *(pa.array(c, pa.string()) for c in columns)], ["conv_id", "call_id", "turn", "position", "level", "result_turn", "status", "errors", "json"])

    schema = f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, turn {kinds['turn']}, position {kinds['position']}, level bigint, result_turn {results.schema['result_turn'].dataType.simpleString()}, status string, errors string, json string"
    linked = rows.mapInArrow(work, schema)
    empty = F.lit(None)
    lost = results.select("node", "conv_id", "call_id", "result_turn").join(nodes.select("node"), "node", "left_anti")
    lost = lost.select("conv_id", "call_id", empty.cast(kinds["turn"]).alias("turn"), empty.cast(kinds["position"]).alias("position"), empty.cast("bigint").alias("level"), "result_turn", F.lit("orphan").alias("status"), F.lit("").alias("errors"), empty.cast("string").alias("json"))
    return linked.unionByName(lost)


#: What a user's turn asks for when a conversation is read as calls.
REPLY_SCHEMA = {"type": "object", "properties": {"role": {"type": "string", "enum": ["user"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["role", "text", "turn"], "additionalProperties": False}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results: each user turn is a call of ``reply`` that waits for the one two turns before, each assistant turn the result of the call of the turn before it."""
    said = lambda role: turns.where(F.col("role") == role)
    number = lambda back: (F.col("turn") - back).cast("string")
    arguments = F.to_json(F.struct("role", "text", "turn"))
    calls = said("user").select("conv_id", number(0).alias("call_id"), "turn", F.lit(0).alias("position"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(number(2)).alias("after"))
    results = said("assistant").select("conv_id", number(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
