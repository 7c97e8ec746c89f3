"""Chat formatting with tool-call linking.

Messages are rows (conversation, turn, role, text).  An assistant message whose text is a
JSON object with ``tool_calls`` makes calls, and a message of role ``tool`` whose text is a
JSON object with ``tool_call_id`` is a result.  Calls and results are joined by identifier,
the calls of a message are put in topological order of their references, arguments are
validated against the tools' schemas, and every message becomes one line of canonical JSON.

Call object: ``{"id": str, "name": str, "arguments": object}``; an argument
``{"$ref": id}`` uses the result of that call.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from graphlib import CycleError, TopologicalSorter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

#: Tool traffic nested deeper than this is left a plain message: no message may exhaust a worker's stack.
MAX_DEPTH = 200

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_SURROGATE = re.compile("[\ud800-\udfff]")


def plain_text(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 can't hold, as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; lone surrogates stay escaped."""
    return plain_text(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """Breaches of a JSON schema (type, enum, required, properties, additionalProperties, items,
    minimum, maximum).  A reference to another call's result fits any schema."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kind = schema.get("type")
    if kind in ("integer", "number"):
        right = isinstance(value, (int, float)) and not isinstance(value, bool)
        right = right and (kind == "number" or isinstance(value, int) or value.is_integer())
    else:
        right = kind is None or isinstance(value, _TYPES[kind])
    if not right:
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += schema_errors(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}: {k} unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_errors(v, schema["items"], f"{at}[{i}]")
    return sorted(out)


def references(value) -> set[str]:
    out, left = set(), [value]
    while left:
        x = left.pop()
        if isinstance(x, dict) and set(x) == {"$ref"}:
            out.add(_name(x["$ref"]))
        elif isinstance(x, (dict, list)):
            left += x.values() if isinstance(x, dict) else x
    return out


def _name(identifier) -> str:
    """An identifier as text: strings as they are, other JSON in canonical form."""
    return plain_text(identifier) if isinstance(identifier, str) else canonical(identifier)


def ordered_calls(calls: list) -> list[tuple[dict, str | None]]:
    """Calls in topological order, each with an error or None.  Calls that wait for nothing come in
    the order given; calls on a cycle come last, in the order given, and are errors."""
    good = [c if isinstance(c, dict) else {} for c in calls]
    place = {}
    for i, c in enumerate(good):
        if c.get("id") is not None:
            place.setdefault(_name(c["id"]), i)
    graph = {i: {place[r] for r in references(c.get("arguments")) if r in place} for i, c in enumerate(good)}
    sorter, order = TopologicalSorter(graph), []
    try:
        sorter.prepare()
    except CycleError:
        pass
    while ready := sorted(sorter.get_ready()):
        order += ready
        sorter.done(*ready)
    rest = [i for i in range(len(good)) if i not in set(order)]
    return [(good[i], None) for i in order] + [(good[i], "cycle") for i in rest]


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("not a JSON number")
    return value


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _depth(value) -> int:
    deepest, left = 0, [(value, 1)]
    while left:
        x, d = left.pop()
        if isinstance(x, (dict, list)):
            deepest = max(deepest, d)
            left += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x)]
    return deepest


def _parsed(text: str | None) -> dict:
    """The object that a text holds; empty where it is none: not JSON (NaN and infinite numbers are not), another
    value, or nested deeper than ``MAX_DEPTH``.  Of equal keys the last counts."""
    if not text or not text.lstrip().startswith("{"):
        return {}
    try:
        out = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except (ValueError, RecursionError):
        return {}
    return out if isinstance(out, dict) and _depth(out) <= MAX_DEPTH else {}


def message_parts(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(place, kind, call id, canonical JSON, errors, references) of one message: one ``message`` or ``result``
    part, or a part for each call.  ``errors`` is a comma-joined list or null; ``references`` are the identifiers
    that a call uses and its message doesn't have."""
    value = _parsed(text) if role in ("assistant", "tool") else {}
    if role == "tool" and value.get("tool_call_id") is not None:
        call_id = _name(value["tool_call_id"])
        given = value["tool_call_id"]
        line = {"type": "tool_result", "tool_call_id": given if isinstance(given, str) else call_id, "content": value.get("content")}
        return [(0, "result", call_id, canonical(line), None, [])]
    if role == "assistant" and isinstance(value.get("tool_calls"), list) and value["tool_calls"]:
        out = []
        here = {_name(c["id"]) for c in value["tool_calls"] if isinstance(c, dict) and c.get("id") is not None}
        for i, (call, error) in enumerate(ordered_calls(value["tool_calls"])):
            name, arguments = call.get("name"), call.get("arguments", {})
            errors = [error] if error else []
            if not isinstance(name, str) or name not in schemas:
                errors.append("unknown tool")
            else:
                errors += schema_errors(arguments, schemas[name])
            call_id = _name(call["id"]) if call.get("id") is not None else None
            if call_id is None:
                errors.append("no id")
            line = {"type": "tool_call", "id": call["id"] if isinstance(call.get("id"), str) else call_id, "name": name, "arguments": arguments}
            out.append((i, "call", call_id, canonical(line), plain_text(",".join(errors)) or None,
                        sorted(references(arguments) - here)))
        return out
    return [(0, "message", None, canonical({"type": "message", "role": role, "content": text}), None, [])]


_PART = T.ArrayType(T.StructType([
    T.StructField("place", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("call_id", T.StringType()), T.StructField("json", T.StringType()),
    T.StructField("errors", T.StringType()), T.StructField("refs", T.ArrayType(T.StringType()))]))


def format_chats(messages: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message, call and result: (conversation, turn, place, kind, call_id, linked,
    errors, json), ``json`` being canonical.  Sorted by (conversation, turn, place, kind, json) these
    are the lines of a chat; a result that links to a call stands right behind it, with the turn and
    place of the call.

    The n-th call with an identifier in a conversation, by turn and place, links to the n-th result
    with it that is not before the first such call.  Calls without a result and results without a
    call have ``linked`` false and the error ``no result`` or ``no call``; ``linked`` is null for
    plain messages.  A reference to a call of another message is right if a message before names that call; else the
    call has the error ``unknown reference`` or, where only later messages name it, ``later reference``.

    A null role or text makes a plain message with JSON null, and so does an empty or very long text that is no tool
    traffic; a text that only resembles tool traffic (not JSON, NaN, numbers beyond DOUBLE, nested deeper than 200) stays a plain
    message whole.  Lone surrogates stay escaped.  Repeated rows are
    messages of their own; rows that tie by turn and place are told by their JSON.  A null conversation is one
    of its own; calls and results with a null
    turn come first.  Other columns, clashing names included, are not read; an empty table gives an empty one.

    Plain messages, the bulk, are formatted where they are read; the parts of tool traffic are written to the shared folder.  Only calls and results, without
    the plain messages, are shuffled for the join, by conversation and identifier: a hot
    conversation with many identifiers is spread over all tasks."""
    schema = T.StructType([
        T.StructField("conv", messages.schema[conv_col].dataType), T.StructField("turn", messages.schema[turn_col].dataType),
        T.StructField("parts", _PART)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(schema)
        names = [f.name for f in _PART.elementType]
        for batch in batches:
            parts = [[dict(zip(names, p)) for p in message_parts(r.as_py(), t.as_py(), schemas)]
                     for r, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(parts, shape.field(2).type)], schema=shape)

    def parts_of(rows: DataFrame) -> DataFrame:
        chosen = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                             F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
        return chosen.mapInArrow(parse, schema).select("conv", "turn", F.explode("parts").alias("p")).select(
            "conv", "turn", "p.*")

    # a message can only hold calls or a result if it is of these roles and an object
    special = (F.coalesce(F.col(role_col).isin("assistant", "tool"), F.lit(False))
               & F.coalesce(F.col(text_col).rlike(r"^\s*\{"), F.lit(False))
               & F.coalesce(F.col(text_col).contains("tool_call"), F.lit(False)))
    plain = parts_of(messages.filter(~special))
    # calls and results are looked at several times; they are parsed once
    parts = stage(parts_of(messages.filter(special)))
    key = ["conv", "call_id"]
    nth = W.partitionBy(*key).orderBy("turn", "place", "json", "errors")
    calls = _checked_references(parts.filter("kind = 'call'"))
    # calls without an identifier are never numbered: nothing can link to them
    calls = calls.filter("call_id is not null").withColumn("n", F.row_number().over(nth)).unionByName(
        calls.filter("call_id is null").withColumn("n", F.lit(None).cast("int")))
    results = parts.filter("kind = 'result'").drop("refs")
    first = calls.groupBy(*key).agg(F.min("turn").alias("first"))
    r = results.alias("r").join(first.alias("f"), F.col("r.conv").eqNullSafe(F.col("f.conv"))
                                & (F.col("r.call_id") == F.col("f.call_id")), "left")
    early = F.coalesce(F.col("r.turn") < F.col("f.first"), F.col("f.call_id").isNull())
    r = r.select("r.*", early.alias("early"))
    r = r.withColumn("n", F.when(~F.col("early"), F.row_number().over(
        W.partitionBy(*key, "early").orderBy("turn", "place", "json"))))
    on = (F.col("c.conv").eqNullSafe(F.col("r.conv")) & (F.col("c.call_id") == F.col("r.call_id"))
          & (F.col("c.n") == F.col("r.n")))
    pairs = calls.alias("c").join(r.alias("r"), on, "full_outer")
    both = F.col("c.kind").isNotNull() & F.col("r.kind").isNotNull()

    def line(turn, place, side: str, none: str):
        errors = F.concat_ws(",", F.col(f"{side}.errors"), F.when(~both, F.lit(none)))
        return F.struct(F.coalesce(F.col("c.conv"), F.col("r.conv")).alias("conv"), turn.alias("turn"), place.alias("place"),
                        F.col(f"{side}.kind").alias("kind"), F.col(f"{side}.call_id").alias("call_id"),
                        F.col(f"{side}.json").alias("json"), F.nullif(errors, F.lit("")).alias("errors"),
                        both.alias("linked"))

    lines = pairs.select(F.explode(F.array(
        F.when(F.col("c.kind").isNotNull(), line(F.col("c.turn"), F.col("c.place"), "c", "no result")),
        F.when(F.col("r.kind").isNotNull(), line(F.coalesce(F.col("c.turn"), F.col("r.turn")),
                                                 F.coalesce(F.col("c.place"), F.col("r.place")), "r", "no call")))).alias("x"))
    linked = lines.filter("x is not null").select("x.*")
    rest = (plain.unionByName(parts.filter("kind = 'message'")).drop("refs")
            .withColumn("linked", F.lit(None).cast("boolean")))
    every = linked.unionByName(rest.select(*linked.columns))
    return every.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "place", "kind", "call_id",
                        "linked", "errors", "json")


def _checked_references(calls: DataFrame) -> DataFrame:
    """``calls`` without ``refs``, with the errors of references to other messages.

    References meet the first turn of the call they name by conversation and identifier; identifiers named by no
    reference are not looked at."""
    uses = calls.filter(F.size("refs") > 0).select("conv", "turn", "place", "json", F.explode("refs").alias("ref")).distinct()
    known = calls.filter("call_id is not null").groupBy("conv", "call_id").agg(
        F.min(F.struct("turn")).alias("first"))  # a null turn comes first
    found = uses.alias("u").join(known.alias("k"), F.col("u.conv").eqNullSafe(F.col("k.conv"))
                                 & (F.col("u.ref") == F.col("k.call_id")), "left")
    at, own = F.col("k.first.turn"), F.col("u.turn")
    before = (at < own) | (at.isNull() & own.isNotNull())
    wrong = F.when(F.col("k.call_id").isNull(), F.concat(F.lit("unknown reference "), F.col("u.ref"))).when(
        ~F.coalesce(before, F.lit(False)), F.concat(F.lit("later reference "), F.col("u.ref")))
    bad = found.select("u.conv", "u.turn", "u.place", "u.json", wrong.alias("wrong")).filter("wrong is not null").groupBy(
        "conv", "turn", "place", "json").agg(F.array_join(F.array_sort(F.collect_list("wrong")), ",").alias("wrong"))
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"b.{x}")) for x in ("conv", "turn", "place", "json")]
    return calls.alias("c").join(bad.alias("b"), same[0] & same[1] & same[2] & same[3], "left").select(
        *[F.col(f"c.{x}") for x in calls.columns if x not in ("errors", "refs")],
        F.nullif(F.concat_ws(",", F.col("c.errors"), F.col("b.wrong")), F.lit("")).alias("errors"))
