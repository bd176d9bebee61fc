"""Chat formatting with tool calls linked to their results.

Calls and results meet by identifier in a hash join. Calls are ordered by what
they wait for, their arguments are checked against the tools' schemas, and each
call becomes one canonical JSON message.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

CALL = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULT = "conv_id long, call_id string, turn long, content string"


#: Nested arrays and objects that arguments may have; deeper ones are no JSON to this library.
DEEPEST = 100


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, and characters as they are; half a surrogate pair, which no text can hold, stays escaped."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out)


def _refuse(what: str) -> object:
    raise ValueError(what)


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    return dict(pairs) if len(dict(pairs)) == len(pairs) else _refuse("a key twice")


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refuse("too large")


def _whole(digits: str) -> int:
    return int(digits) if len(digits) <= 4000 else _refuse("too large")  # Python's own limit for reading and writing is 4,300


def _depth(text: str) -> int:
    """The deepest nesting of brackets outside of strings."""
    deepest = now = 0
    for bracket in _BRACKETS.findall(_STRINGS.sub("", text)):
        now += 1 if bracket in "[{" else -1
        deepest = max(deepest, now)
    return deepest


_BRACKETS, _STRINGS = re.compile(r"[\[\]{}]"), re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL)


def parsed(text: str) -> object:
    """The value of strict JSON, or ``ValueError``: for ``NaN`` and infinities, numbers that no double or 4,000 digits hold, a key that an object has twice, and more than ``DEEPEST`` levels."""
    if _depth(text) > DEEPEST:
        raise ValueError("too deep")
    return json.loads(text, parse_constant=_refuse, parse_float=_finite, parse_int=_whole, object_pairs_hook=_once)


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}


def _known_types(schema: dict) -> None:
    """Refuse a schema with a type that there is none of, before any task begins."""
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _TYPES:
            raise ValueError(f"unknown type in a schema: {kind}")
    for part in (*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])):
        _known_types(part)


def _same(a: object, b: object) -> bool:
    """Equality of JSON: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def schema_errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """Faults of ``value`` by ``type``, ``enum``, ``required``, ``properties``, ``additionalProperties``, ``items``, ``minLength`` and ``minimum``."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if _TYPES["number"](value) and "minimum" in schema and value < schema["minimum"]:
        out.append(f"{at}: too small")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_errors(v, schema["items"], f"{at}[{i}]")
    return out


def _message(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, messages = [], []
            for r in batch.to_pylist():
                found: list[str] = []
                arguments = None
                if r["status"] != "orphan_result":
                    try:
                        arguments = parsed(r["arguments"]) if r["arguments"] is not None else {}
                    except ValueError:
                        found.append("$: not JSON")
                    else:
                        if r["name"] in schemas:
                            found += schema_errors(arguments, schemas[r["name"]])
                        else:
                            found.append("$: unknown tool")
                message = {"id": r["call_id"], "status": r["status"]}
                if r["status"] != "orphan_result":
                    message |= {"name": r["name"], "arguments": arguments, "after": sorted({a for a in r["after"] or () if a is not None})}
                if r["content"] is not None:
                    message["content"] = r["content"]
                errors.append([f.encode("utf-8", "backslashreplace").decode() for f in sorted(found)])  # names may hold half a surrogate pair
                messages.append(canonical(message))
            kept = [c for c in batch.schema.names if c not in ("name", "arguments", "after", "content")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(errors, pa.list_(pa.string())), pa.array(messages, pa.string())], names=[*kept, "errors", "message"])

    return run


def _levels(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id`` and ``level``: 0 without calls to wait for, else one more than the highest of them.

    Calls that wait in a circle, or for a call of a circle, have no level. A
    call that waits for one other points to it, and pointers double their reach
    each round, so a chain takes as many rounds as its length has binary digits.
    Calls that wait for several are settled round by round on what is left.
    """
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, F.explode(F.array_distinct("after")).alias("before")).where("before is not null")
    known = calls.select("conv_id", F.col("call_id").alias("before"))
    edges = edges.join(known, ["conv_id", "before"], "left_semi")  # waiting for an unknown call is no wait
    edges = written(edges.join(edges.groupBy(*key).count(), key), "waits")
    free = calls.select(*key).join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0).cast("long"))

    at = written(edges.where("count = 1").select(*key, F.col("before").alias("above"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")), "pointers")
    longest = calls.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):
        further = at.select("conv_id", F.col("call_id").alias("above"), F.col("above").alias("next"), F.col("steps").alias("more"))
        at = at.join(further, ["conv_id", "above"], "left").select(*key, F.coalesce("next", "above").alias("above"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open"))
        at = written(at, "pointers")
        if at.where("open").isEmpty():
            break
    at = at.where("not open")  # what is open still goes around a circle

    placed = written(free, "levels")
    tail = at.select("conv_id", F.col("call_id").alias("before"), "above", "steps")
    left = edges.where("count > 1").join(tail, ["conv_id", "before"], "left")
    left = written(left.select(*key, F.coalesce("above", "before").alias("above"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.lit(None).cast("long").alias("value")), "several")
    last = placed
    while not left.isEmpty():
        reached = last.select("conv_id", F.col("call_id").alias("above"), "level")
        valued = left.join(reached, ["conv_id", "above"], "left").withColumn("value", F.coalesce("value", F.col("level") + F.col("steps"))).drop("level")
        valued = written(valued, "several")
        last = written(valued.groupBy(*key).agg(F.max("value").alias("level"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing")).where("missing = 0").drop("missing"), "levels")
        if last.isEmpty():
            break
        left = valued.join(last.select(*key), key, "left_anti")
        placed = placed.unionByName(last)
    below = placed.select("conv_id", F.col("call_id").alias("above"), "level")
    chained = at.join(below, ["conv_id", "above"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return placed.unionByName(chained).withColumn("level", F.col("level").cast("int"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls joined with their results, checked, in an order that respects what waits for what.

    ``calls`` has ``conv_id``, ``call_id``, ``turn``, ``name``, ``arguments``
    (JSON text) and ``after`` (ids of calls of the conversation that it waits
    for); ``results`` has ``conv_id``, ``call_id``, ``turn`` and ``content``.

    Returns a row for each call and for each result without one: ``conv_id``,
    ``call_id``, ``turn``, ``result_turn``, ``status`` (``linked``, ``no_result``,
    ``orphan_result``, ``circular``), ``level`` (null for the last two),
    ``n_calls`` and ``n_results`` of the id, ``valid``, ``errors`` and
    ``message``. Sorting by ``conv_id, level, turn, call_id`` is a topological
    order. Of an id's repeated calls or results the first by turn, then by
    content, counts. Rows with a null ``conv_id`` or ``call_id`` match nothing
    and are left out. Null arguments are ``{}``; arguments that are no JSON, by
    the rule of ``parsed``, or of an unknown tool, are invalid, and the former are null in the message. A
    schema with an unknown type is a ``ValueError``. Every message is strict JSON. Other columns are ignored.
    """
    for schema in schemas.values():
        _known_types(schema)
    key = ["conv_id", "call_id"]
    first = lambda rows, cols, n: rows.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct(*cols)).alias("r"), F.count("*").alias(n)).select(*key, n, "r.*")
    calls = written(first(calls.selectExpr("cast(conv_id AS long) AS conv_id", "call_id", "cast(turn AS long) AS turn", "name", "arguments", "cast(after AS array<string>) AS after"), ["turn", "name", "arguments", "after"], "n_calls"), "calls")
    results = first(results.selectExpr("cast(conv_id AS long) AS conv_id", "call_id", "cast(turn AS long) AS result_turn", "content"), ["result_turn", "content"], "n_results")
    joined = calls.join(_levels(calls), key, "left").withColumn("called", F.lit(True)).join(results, key, "full")
    status = F.when(F.col("called").isNull(), "orphan_result").when(F.col("level").isNull(), "circular").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    rows = joined.select(*key, "turn", "result_turn", status.alias("status"), "level", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_calls", "n_results")), "name", "arguments", "after", "content")
    schema = "conv_id long, call_id string, turn long, result_turn long, status string, level int, n_calls long, n_results long, errors array<string>, message string"
    out = rows.mapInArrow(_message(schemas), schema)
    return out.withColumn("valid", (F.size("errors") == 0) & (F.col("status") != "orphan_result"))


LINKED = "conv_id long, call_id string, turn long, result_turn long, status string, level int, n_calls long, n_results long, valid boolean, message string"


def _turn_columns(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (``conv_id``, ``turn``, ``role``, ``text``).

    A user turn calls the tool ``reply`` under its turn as id, and the assistant
    turn right after it is the result. A call waits for the last call before it
    whose answer stands between them, which is known from the turns alone. All
    other turns are those of ``other_turns``. Repeated turns are repeated calls
    or results; a null text is a null argument or content; other columns are ignored.
    """
    rows = _turn_columns(messages).where("conv_id is not null and turn is not null")
    asked = rows.where("role = 'user'")
    text = F.to_json(F.struct(F.col("text").alias("text")), {"ignoreNullFields": "false"})
    # the turn two before it, if that asked: an equality that the links settle, so no order within a conversation is needed
    calls = asked.select("conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.lit("reply").alias("name"), text.alias("arguments"), F.array_compact(F.array(F.when(F.col("turn") >= 2, (F.col("turn") - 2).cast("string")))).alias("after"))
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, answers


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        messages = [canonical({k: v for k, v in (("content", r["text"]), ("role", r["role"]), ("status", "message")) if v is not None}) for r in batch.to_pylist()]
        n = batch.num_rows
        none, zero = pa.nulls(n, pa.string()), pa.array([0] * n, pa.int64())
        columns = [batch.column("conv_id"), none, batch.column("turn"), pa.nulls(n, pa.int64()), pa.array(["message"] * n), pa.array([0] * n, pa.int32()), zero, zero, pa.array([True] * n), pa.array(messages, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in LINKED.split(", ")])


def other_turns(messages: DataFrame) -> DataFrame:
    """A row for each turn that ``turns_as_calls`` does not take, in the columns of the links: of another role or of none, or without a conversation or turn.

    ``status`` is ``message``, ``level`` 0, ``call_id`` null, and ``message`` the
    canonical JSON of role and content, without those that are null. Repeated
    turns give a row each; no rows give none.
    """
    rows = _turn_columns(messages).where("conv_id is null or turn is null or role is null or role not in ('user', 'assistant')")
    return rows.mapInArrow(_plain, LINKED)


def link_turns(messages: DataFrame) -> DataFrame:
    """Every turn of plain conversations: calls with their results, results without a call, and other turns, as ``LINKED``."""
    calls, answers = turns_as_calls(messages)
    linked = link_tool_calls(calls, answers, REPLY)
    return linked.select(*(f.split()[0] for f in LINKED.split(", "))).unionByName(other_turns(messages))


REPLY = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}
