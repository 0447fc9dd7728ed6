"""Chat formatting with linked tool calls.

An assistant's message names its calls in blocks `<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`;
a message of role `tool` is a result, `{"tool_call_id": ..., "content": ...}`. Arguments may ask for the result of
another call as `{"$result": id}`.

Calls and results are hash-joined by conversation and identifier. Calls are ordered topologically: a call's level is the
longest chain of calls that it waits for. Each round settles the calls whose prerequisites are settled, and lets what
waits for a call with a single prerequisite wait for that prerequisite instead, so chains halve with every round and a
chain of a thousand calls takes ten. What waits over more steps than its conversation has calls, or is left when a round changes
nothing, is in, or behind, a cycle. Arguments are checked against the tools' JSON schemas. Every message becomes a line of
canonical JSON: sorted keys, no white space, calls with their status.

The result has a row per message with its place (order_turn, order_step) instead of a row per conversation, so a
conversation with a third of all messages is many rows like others; no step gathers a conversation. Messages are read and
parsed once, and the parse is written.

A call's status is the first that holds of: malformed (no JSON object with a string id and name), duplicate_id (an
earlier call of the conversation has the id), unknown_tool, invalid_arguments, cycle, missing_result (of its own, or
of a call it asks for), ok. A result is linked if a call with its id exists that isn't malformed; of several results
the first counts, by turn and content.

Defined results: null texts are empty; a null role is written as null; null turns come last (order_turn null); messages
without a conversation are a conversation of their own. Rows that repeat are equal messages with equal results. NaN,
infinities and numbers beyond those of doubles aren't JSON: such a call is malformed, such a result a text. Lone surrogates,
which JSON may name but no text holds, stay escaped. A schema that can't be read (an unknown type, a bad pattern) raises
before anything runs. Long texts are read whole. An empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import batches, free, join_small, materialise

BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """Sorted keys, no white space, characters as they are but for lone surrogates."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def _float(text: str) -> float:
    x = float(text)
    if math.isinf(x):
        raise ValueError(f"{text} is beyond doubles")
    return x


def read_json(text: str) -> object:
    """Standard JSON; ValueError or RecursionError for anything else."""
    return json.loads(text, parse_constant=_no_constant, parse_float=_float)


def check_schema(schema: object) -> None:
    """ValueError for a schema that `valid` couldn't read."""
    stack = [schema]
    while stack:
        s = stack.pop()
        if not isinstance(s, dict):
            raise ValueError(f"{s!r} is no schema")
        kinds = s.get("type", [])
        unknown = {*([kinds] if isinstance(kinds, str) else kinds)} - KINDS.keys()
        if unknown:
            raise ValueError(f"no types of JSON: {sorted(unknown)}")
        if "pattern" in s:
            try:
                re.compile(s["pattern"])
            except re.error as e:
                raise ValueError(f"bad pattern {s['pattern']!r}: {e}") from e
        stack += s.get("properties", {}).values()
        stack += [s[k] for k in ("items", "additionalProperties") if k in s and not isinstance(s[k], bool)]


def is_reference(value: object) -> bool:
    return isinstance(value, dict) and value.keys() == {"$result"} and isinstance(value["$result"], str)


def references(value: object) -> set[str]:
    found, stack = set(), [value]
    while stack:
        v = stack.pop()
        if is_reference(v):
            found.add(v["$result"])
        elif isinstance(v, dict):
            stack += v.values()
        elif isinstance(v, list):
            stack += v
    return found


def valid(value: object, schema: dict) -> bool:
    """JSON Schema's common keywords. The result of another call fits any schema."""
    if is_reference(value):
        return True
    kinds = schema.get("type")
    if kinds is not None and not any(KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(canonical(value) == canonical(v) for v in schema["enum"]) or "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())):
            return False
        more = schema.get("additionalProperties", True)
        for k, v in value.items():
            if k in known:
                if not valid(v, known[k]):
                    return False
            elif more is False or isinstance(more, dict) and not valid(v, more):
                return False
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return False
        if "items" in schema and not all(valid(v, schema["items"]) for v in value):
            return False
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) or "pattern" in schema and not re.search(schema["pattern"], value):
            return False
    elif KINDS["number"](value):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            return False
    return True


def parse_call(text: str, schemas: dict[str, dict] | None) -> dict:
    """A call with its id, name, arguments and the ids of what it asks for, as canonical JSON each."""
    try:
        call = read_json(text)
        if not isinstance(call, dict) or not isinstance(call.get("id"), str) or not isinstance(call.get("name"), str):
            raise ValueError
        arguments = call.get("arguments", {})
        shown = canonical(arguments)
    except (ValueError, RecursionError):
        return {"id": None, "name": None, "arguments": canonical(text), "refs": [], "problem": "malformed"}
    problem = None
    if schemas is not None and call["name"] not in schemas:
        problem = "unknown_tool"
    elif schemas is not None and not valid(arguments, schemas[call["name"]]):
        problem = "invalid_arguments"
    return {"id": canonical(call["id"]), "name": canonical(call["name"]), "arguments": shown, "refs": sorted(map(canonical, references(arguments))), "problem": problem}


def parse(role: str | None, text: str | None, schemas: dict[str, dict] | None) -> tuple[str, list[dict], str | None]:
    """Content as JSON, calls, and the id, as JSON, that a result is for."""
    text = text or ""
    if role == "tool":
        try:
            result = read_json(text)
            if isinstance(result, dict) and isinstance(result.get("tool_call_id"), str):
                return canonical(result.get("content")), [], canonical(result["tool_call_id"])
        except (ValueError, RecursionError):
            pass
        return canonical(text), [], None
    if role == "assistant" and "<tool_call>" in text:
        return canonical(BLOCK.sub("", text).strip()), [parse_call(m, schemas) for m in BLOCK.findall(text)], None
    return canonical(text), [], None


CALL = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string())), ("problem", pa.string())])
PARSED = "conv_id long, conv string, turn long, role string, msg string, content string, calls array<struct<id: string, name: string, arguments: string, refs: array<string>, problem: string>>, result_of string"


def _parsed(messages: DataFrame, schemas: dict[str, dict] | None) -> DataFrame:
    """Messages with conv, their conversation's key, and msg, a digest of all that a message says."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4000):
            found = [parse(r, t, schemas) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("conv_id", "conv", "turn", "role", "msg")] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(CALL)), pa.array([f[2] for f in found], pa.string())],
                names=["conv_id", "conv", "turn", "role", "msg", "content", "calls", "result_of"],
            )

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    said = F.sha2(F.concat(*(part(F.col(c).cast("string")) for c in ("turn", "role", "text"))), 256)
    return rows.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), "msg": said}).mapInArrow(run, PARSED)


def _links(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The first call of each id: conv, id, turn, msg, k, refs, problem, with result_msg and result_turn of its result."""
    first = calls.filter("problem is null or problem <> 'malformed'").groupBy("conv", "id").agg(F.min(F.struct(F.col("turn").isNull(), "turn", "msg", "k")).alias("f"))
    answer = results.groupBy("conv", F.col("result_of").alias("id")).agg(F.min(F.struct(F.col("turn").isNull(), "turn", "msg")).alias("r"))
    heads = calls.join(first, ["conv", "id"]).filter((F.col("f.msg") == F.col("msg")) & (F.col("f.k") == F.col("k"))).dropDuplicates(["conv", "id"])
    return heads.drop("f").join(answer, ["conv", "id"], "left").select("conv", "id", "turn", "msg", "k", "refs", "problem", F.col("r.msg").alias("result_msg"), F.col("r.turn").alias("result_turn"))


#: What a call knows of those it waits for: the least level they give it, their last turn, whether all have results, and
#: whether one is in a cycle.
KNOWN = {"level": (F.max, F.greatest, 0), "before": (F.max, F.greatest, None), "sound": (F.every, lambda a, b: a & b, True), "cyclic": (F.some, lambda a, b: a | b, False)}


def _told(facts: DataFrame) -> DataFrame:
    """Facts (conv, id and those of KNOWN) gathered by call, under names with an underscore."""
    return facts.groupBy("conv", "id").agg(*(gather(c).alias(f"_{c}") for c, (gather, _, _) in KNOWN.items()))


def _learned(calls: DataFrame, told: DataFrame) -> DataFrame:
    both = calls.join(told, ["conv", "id"], "left")
    merged = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(merge(F.col(c), F.col(f"_{c}"))) for c, (_, merge, _) in KNOWN.items()}
    return both.withColumns(merged).drop(*(f"_{c}" for c in KNOWN))


def _levels(heads: DataFrame) -> DataFrame:
    """A materialised row (conv, id, level, before, sound, cyclic) per head. before: the last turn that it waits for;
    sound: it and what it waits for have results."""
    start = heads.select(
        "conv", "id", F.greatest("turn", "result_turn").alias("own"), F.col("result_msg").isNotNull().alias("answered"),
        F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("before"), F.lit(True).alias("sound"), F.lit(False).alias("cyclic"),
    )
    waits = heads.select("conv", "id", F.explode("refs").alias("need"), F.lit(1).cast("long").alias("steps"))
    known = heads.select("conv", F.col("id").alias("need"), F.lit(True).alias("exists"))
    waits = materialise(waits.join(known, ["conv", "need"], "left"), "waits")
    lost = waits.filter("exists is null").select("conv", "id", F.lit(1).cast("long").alias("level"), F.lit(None).cast("long").alias("before"), F.lit(False).alias("sound"), F.lit(False).alias("cyclic"))
    open_ = materialise(_learned(start, _told(lost)), "open")
    edges = materialise(waits.filter("exists").select("conv", "id", "need", "steps"), "edges")
    free(waits)
    most = open_.groupBy("conv").count().agg(F.max("count")).first()[0] or 0  # no chain without a cycle is longer
    done = []
    now = open_.join(edges.select("conv", "id").distinct(), ["conv", "id"], "left_anti").select("conv", "id", "own", "answered", *KNOWN)
    while True:
        settled = materialise(now, "settled")
        done.append(settled)
        left = materialise(open_.join(settled.select("conv", "id"), ["conv", "id"], "left_anti"), "open")
        free(open_)
        waiting = left.count()
        if not waiting:
            free(left, edges)
            break
        of = settled.select("conv", F.col("id").alias("need"), F.col("level").alias("l"), F.greatest("own", "before").alias("b"), (F.col("answered") & F.col("sound")).alias("s"), F.col("cyclic").alias("c"))
        met = materialise(edges.join(left.select("conv", "id"), ["conv", "id"], "left_semi").join(of, ["conv", "need"], "left"), "met")
        free(edges)
        told = met.filter("c is not null").select("conv", "id", (F.col("l") + F.col("steps")).alias("level"), F.col("b").alias("before"), F.col("s").alias("sound"), F.col("c").alias("cyclic"))
        rest = met.filter("c is null").select("conv", "id", "need", "steps")
        one = rest.groupBy("conv", "id").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("next"), F.max("steps").alias("far"))
        left_now = materialise(_learned(left, _told(told)).join(one, ["conv", "id"], "left"), "open")
        free(left)
        # what waits for a call that itself waits for one only, waits for that one instead
        via = left_now.filter("n = 1").select("conv", F.col("id").alias("need"), "next", "far", F.col("level").alias("l"), F.greatest("own", "before").alias("b"), (F.col("answered") & F.col("sound")).alias("s"), F.col("cyclic").alias("c"))
        jumped = materialise(rest.join(via, ["conv", "need"], "left"), "jumped")
        steps = F.col("steps") + F.coalesce("far", F.lit(0))
        told = jumped.filter("next is not null").select("conv", "id", (F.col("l") + F.col("steps")).alias("level"), F.col("b").alias("before"), F.col("s").alias("sound"), (F.col("c") | (steps > most)).alias("cyclic"))
        edges = materialise(jumped.groupBy("conv", "id", F.coalesce("next", "need").alias("need")).agg(F.max(steps).alias("steps")), "edges")
        open_ = materialise(_learned(left_now.drop("n", "next", "far"), _told(told)), "open")
        jumps = jumped.filter("next is not null").limit(1).count()
        free(met, left_now, jumped)
        ready = open_.join(edges.select("conv", "id").distinct(), ["conv", "id"], "left_anti").union(open_.filter("cyclic")).distinct()
        if not jumps and not ready.limit(1).count():  # all that is left waits for something that waits
            settled = materialise(open_.withColumn("cyclic", F.lit(True)).select("conv", "id", "own", "answered", *KNOWN), "settled")
            done.append(settled)
            free(open_, edges)
            break
        now = ready.select("conv", "id", "own", "answered", *KNOWN)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    out = materialise(every.select("conv", "id", "level", "before", (F.col("sound") & F.col("answered")).alias("sound"), "cyclic"), "levels")
    free(*done)
    return out


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per row of messages: conv_id, turn, role, order_turn, order_step, n_calls, n_ok, result_linked, json.

    schemas: JSON schema of the arguments by tool; without, any tool and arguments pass.
    """
    for schema in (schemas or {}).values():
        check_schema(schema)
    parsed = materialise(_parsed(messages, schemas), "parsed")
    calls = parsed.filter(F.size("calls") > 0).select("conv", "turn", "msg", F.posexplode("calls").alias("k", "c")).select("conv", "turn", "msg", "k", "c.id", "c.refs", "c.problem")
    calls = materialise(calls.dropDuplicates(["conv", "msg", "k"]), "calls")
    results = materialise(parsed.filter("result_of is not null").select("conv", "turn", "msg", "result_of").distinct(), "results")
    heads = materialise(_links(calls, results), "heads")
    levels = _levels(heads)
    settled = materialise(heads.join(levels, ["conv", "id"]).select("conv", "id", "msg", "k", "result_msg", F.when(~F.col("cyclic"), F.col("level")).alias("level"), F.when(~F.col("cyclic"), F.greatest("turn", "before")).alias("order_turn"), "sound"), "settled")
    own = F.struct(F.lit(True).alias("first"), "level", "order_turn", "sound")
    judged = calls.join(settled.select("conv", "id", "msg", "k", own.alias("h")), ["conv", "id", "msg", "k"], "left")
    status = F.when(F.col("problem") == "malformed", "malformed").when(F.col("h").isNull(), "duplicate_id").when(F.col("problem").isNotNull(), F.col("problem"))
    status = status.when(F.col("h.level").isNull(), "cycle").when(~F.col("h.sound"), "missing_result").otherwise("ok")
    by_call = judged.groupBy("conv", "msg").agg(F.array_sort(F.collect_list(F.struct("k", status.alias("status")))).alias("statuses"), F.max("h.order_turn").alias("call_turn"), F.max("h.level").alias("call_level"))
    of = settled.select("conv", F.col("id").alias("result_of"), "order_turn", "level", "result_msg")
    by_result = results.join(of, ["conv", "result_of"]).select("conv", "msg", F.col("order_turn").alias("of_turn"), F.coalesce("level", F.lit(0)).alias("of_level"), (F.col("msg") == F.col("result_msg")).alias("linked"))
    facts = materialise(by_call.join(by_result, ["conv", "msg"], "full_outer"), "facts")
    free(calls, results, heads, levels, settled)
    rows = join_small(parsed, facts, ["conv", "msg"])
    shown = F.transform(
        "calls",
        lambda c, i: F.concat(F.lit('{"arguments":'), c["arguments"], F.lit(',"id":'), F.coalesce(c["id"], F.lit("null")), F.lit(',"name":'), F.coalesce(c["name"], F.lit("null")), F.lit(',"status":"'), F.col("statuses")[i]["status"], F.lit('"}')),
    )
    some = F.when(F.size("calls") > 0, F.concat(F.lit('"calls":['), F.array_join(shown, ","), F.lit("],"))).otherwise("")
    result = F.when(F.col("result_of").isNotNull(), F.concat(F.lit(',"tool_call_id":'), F.col("result_of"))).otherwise("")
    line = F.concat(F.lit("{"), some, F.lit('"content":'), F.col("content"), F.lit(',"role":'), _text(F.col("role")), result, F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    return rows.select(
        "conv_id", "turn", "role", F.greatest("turn", "call_turn", "of_turn").alias("order_turn"),
        F.coalesce(2 * F.col("of_level") + 1, 2 * F.col("call_level"), F.lit(0)).cast("long").alias("order_step"),
        F.size("calls").cast("long").alias("n_calls"), F.coalesce(F.size(F.filter("statuses", lambda s: s["status"] == "ok")), F.lit(0)).cast("long").alias("n_ok"),
        F.when(F.col("result_of").isNotNull(), F.coalesce("linked", F.lit(False))).alias("result_linked"), line.alias("json"),
    )


def _text(c: Column) -> Column:
    """A string column as a JSON string, null as null."""
    quoted = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), "null").otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))
