"""Tool-call linking for chat formatting.

Calls and results meet by a hash join on (conversation, identifier). Calls are ordered topologically by what they depend on:
where each dependency comes earlier in the conversation that is the conversation's own order; the other conversations are ordered
by rounds that each take the calls whose dependencies are taken, and calls left over are on or behind a cycle. Arguments are
validated against the JSON schema of the call's name, and each linked call is serialised as canonical JSON (keys
sorted, no spaces, shortest numbers, no escapes that JSON does not need).

No step gathers a conversation: a row of output is a call, and keys of joins are single calls, so a conversation of any
length spreads over all tasks.

Of calls that repeat an identifier the earliest counts, of results the earliest, and ``n_results`` says how many there
were. A call without result has status ``open``; a result without call gives a row of status ``orphan``. Arguments
that are null or no JSON object are invalid. Rows with a null conversation or identifier link with nothing. No messages, no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, TYPES[kind])


def violations(value, schema: dict, at: str = "") -> list[str]:
    """What is wrong with a value, in a fixed order: type, enum, bounds, lengths, required and unknown keys, then parts."""
    out, here = [], at or "$"
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{here}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{here}: not one of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{here}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{here}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{here}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{here}: longer than {schema['maxLength']}")
    if isinstance(value, list):
        for i, x in enumerate(value):
            out += violations(x, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{here}: {k} is missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{here}: {k} is unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}" if at else k)
    return out


def canonical(value) -> str:
    """Canonical JSON; numbers without fraction are integers, and numbers that JSON cannot say are refused."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() and abs(x) < 1e21 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _arguments(text: str | None):
    try:
        return json.loads(text, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x))) if text is not None else None
    except ValueError:
        return None


def levels(calls: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(conv, call_id, level): of conversations in which a call depends on itself or a later one; level null on or behind a cycle.

    Rounds go on until no call is ready. With ``max_rounds``, calls that are ready beyond it are an error.
    """
    left, done = common.materialize(calls.select("conv", "call_id"), "calls"), []
    edges = common.materialize(edges.select("conv", "call_id", "dep"), "edges")
    for level in count():
        waiting = edges.join(left.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"], "left_semi").select("conv", "call_id").distinct()
        ready = common.materialize(left.join(waiting, ["conv", "call_id"], "left_anti"), "ready")
        if ready.isEmpty():
            break
        if level == max_rounds:
            raise RuntimeError(f"calls are still ready after {max_rounds} rounds")
        done.append(ready.withColumn("level", F.lit(level).cast("long")))
        left = common.materialize(left.join(ready, ["conv", "call_id"], "left_anti"), "calls")
    return reduce(DataFrame.unionAll, [*done, left.withColumn("level", F.lit(None).cast("long"))])


LINKED = "conv_id long, call_id string, turn long, topo_order long, result_turn long, n_results long, status string, valid boolean, errors array<string>, json string"


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Links ``calls(conv_id, call_id, turn, name, arguments, depends_on)`` and ``results(conv_id, call_id, turn, content)``.

    ``topo_order`` sorts a conversation's calls so that each comes after what it depends on.
    """
    calls = calls.select(F.col("conv_id").cast("long").alias("conv"), "call_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("deps"))
    results = results.select(F.col("conv_id").cast("long").alias("conv"), "call_id", F.col("turn").cast("long").alias("turn"), "content")
    usable = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    call = calls.where(usable).groupBy("conv", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "deps")).alias("c"))
    result = results.where(usable).groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n"))
    loose = calls.where(~usable).select("conv", "call_id", F.struct("turn", "name", "arguments", "deps").alias("c"))
    lost = results.where(~usable).select("conv", "call_id", F.struct("turn", "content").alias("r"), F.lit(1).cast("long").alias("n"))
    both = call.hint("shuffle_hash").join(result, ["conv", "call_id"], "full_outer").unionByName(loose, True).unionByName(lost, True)
    both = common.materialize(both, "linked")

    known = both.where("c is not null and conv is not null and call_id is not null")
    edges = known.select("conv", "call_id", F.col("c.turn").alias("at"), F.explode("c.deps").alias("dep"))
    edges = common.materialize(edges.join(known.select("conv", F.col("call_id").alias("dep"), F.col("c.turn").alias("dep_at")).hint("shuffle_hash"), ["conv", "dep"]), "edges")
    odd = edges.where("not coalesce(dep_at < at, false)").select("conv").distinct()
    ordered = both.withColumn("topo_order", F.coalesce("c.turn", "r.turn"))
    if not odd.isEmpty():
        odd = common.materialize(odd, "odd")
        found = levels(known.join(odd, "conv", "left_semi"), edges.join(odd, "conv", "left_semi"))
        found = found.select("conv", "call_id", F.col("level"), F.lit(True).alias("odd"))
        ordered = both.join(found, ["conv", "call_id"], "left").withColumn("topo_order", F.when(F.col("odd"), F.col("level")).otherwise(F.coalesce("c.turn", "r.turn")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                c, r = x["c"], x["r"]
                answer = {"content": r["content"], "turn": r["turn"]} if r else None
                if c is None:
                    out.append((x["conv"], x["call_id"], None, x["topo_order"], r["turn"], x["n"], "orphan", None, [], canonical({"id": x["call_id"], "result": answer})))
                    continue
                value, schema = _arguments(c["arguments"]), schemas.get(c["name"])
                errors = ["the name has no schema"] if schema is None else ["arguments are not a JSON object"] if not isinstance(value, dict) else violations(value, schema)
                if x["topo_order"] is None and c["turn"] is not None:
                    errors = [*errors, "depends on a cycle"]
                said = {"arguments": value, "depends_on": c["deps"], "errors": errors, "id": x["call_id"], "name": c["name"], "result": answer}
                out.append((x["conv"], x["call_id"], c["turn"], x["topo_order"], r["turn"] if r else None, x["n"] or 0, "linked" if r else "open", not errors, errors, canonical(said)))
            cols = zip(*out) if out else [[]] * 10
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, types)], names=[f.split()[0] for f in LINKED.split(", ")])

    return ordered.select("conv", "call_id", "c", "r", "n", "topo_order").mapInArrow(run, LINKED)


def calls_of_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat messages (conv_id, turn, role, text) that carry them as JSON.

    An assistant's message is ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``, a tool's is ``{"tool_call_id", "content"}``. Other messages have none.
    """
    call = "struct<id:string,name:string,arguments:string,depends_on:array<string>>"
    said = messages.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", f"struct<tool_calls:array<{call}>>")["tool_calls"]).alias("c"))
    calls = said.select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on"))
    got = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("r"))
    return calls, got.select("conv_id", F.col("r.tool_call_id").alias("call_id"), "turn", F.col("r.content").alias("content"))


#: The schema of the calls that dialogue turns are read as.
REPLY = {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 100}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads dialogue as tool use: a user's turn calls ``reply``, the assistant's next turn is its result, and a call depends on the one two turns before, if the user spoke then."""
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    user = messages.where("role = 'user'").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    before = user.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("has")).distinct()
    user = user.join(before, ["conv_id", "turn"], "left")
    calls = user.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"}).alias("arguments"), F.when(F.col("has"), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    assistant = messages.where("role = 'assistant'").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("content"))
    return calls, assistant.select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", "content")
