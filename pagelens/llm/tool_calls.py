"""Tool calls of chat transcripts: linked, checked, ordered and written as canonical JSON.

A message may make calls (id, name, arguments as JSON text, ids of calls whose results it needs) or
carry the result of one call. Calls and results are joined by conversation and identifier, so a conversation
of any length is spread over tasks. Arguments are parsed and checked against the tool's schema; the
subset of JSON Schema is: type, required, properties, additionalProperties, enum, minimum, maximum, items.

Order: a result follows its call, and a call the results that it needs. Where the transcript already has
them in that order, its own order stands and nothing is iterated. An event that stands before something that
it needs moves behind the last such event (`order_turn`, `order_part`), and among those moved behind the same
event the number of steps from it decides (`order_step`), then its own place. Both are found by rounds
over joined tables, as many as the longest chain of displaced events, each round written to the
shared folder. Events on a cycle, or that wait for one, are marked and come last in their place.

Results for odd input: a result whose call is missing is an orphan, a call without result unanswered; of calls that
repeat an identifier in a conversation the first in order counts and later ones are marked repeated; arguments that are null,
no JSON object, too deep, or repeat a key are invalid and written as null; an unknown tool is invalid; messages without call
or result are events of their own; null conversations or identifiers never link; an empty table gives an empty result; events
of one place (repeated rows) are told apart by a number that they get when written; a very long body is parsed within its row, and
one that no parser can hold is an error of its event; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.shipping import map_arrow
from pagelens.session import scratch_path

CALL = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
LATE = 1 << 30


def canonical(value) -> str:
    """Sorted keys, no blanks, text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is repeated")
    return out


def parse(text: str | None) -> tuple[object, str | None]:
    """(value, error)."""
    if text is None:
        return None, "no arguments"
    try:
        value = json.loads(text, object_pairs_hook=_once)
        canonical(value)
    except RecursionError:
        return None, "too deep"
    except ValueError as error:
        return None, f"no JSON: {error}"
    return value, None


TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "null": lambda v: v is None,
}


def violations(value, schema: Mapping, at: str = "$") -> list[str]:
    out = []
    kind = schema.get("type")
    if kind is not None and not TYPES[kind](value):
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def events(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, kind, role, id, name, body, after) of messages (conv_id, turn, role, text, calls, result_of)."""
    none = F.lit(None)
    calls = messages.select("conv_id", "turn", "role", F.posexplode("calls").alias("part", "c")).select(
        "conv_id", "turn", F.col("part").cast("bigint"), F.lit("call").alias("kind"), "role", "c.id", "c.name",
        F.col("c.arguments").alias("body"), "c.after",
    )
    rest = messages.filter(F.coalesce(F.size("calls"), F.lit(0)) <= 0).select(
        "conv_id", "turn", F.lit(0).cast("bigint").alias("part"),
        F.when(F.col("result_of").isNull(), "message").otherwise("result").alias("kind"), "role", F.col("result_of").alias("id"),
        none.cast("string").alias("name"), F.col("text").alias("body"), none.cast("array<string>").alias("after"),
    )
    return calls.unionByName(rest).withColumn("node", F.monotonically_increasing_id())


def dependencies(all_events: DataFrame) -> DataFrame:
    """Edges (node, needs): a result needs its call, a call the results (or else the calls) of the ids it names."""
    place = F.struct("turn", "part", "node")
    calls = all_events.filter("kind = 'call' and id is not null").groupBy("conv_id", "id").agg(F.min(place).alias("c"))
    results = all_events.filter("kind = 'result'").groupBy("conv_id", "id").agg(F.min(place).alias("r"))
    calls = calls.withColumn("call", F.col("c.node")).drop("c")
    answered = calls.join(results.hint("shuffle_hash"), ["conv_id", "id"], "left").select(
        "conv_id", "id", F.coalesce("r.node", "call").alias("needs")
    )
    of_results = all_events.filter("kind = 'result'").join(calls.hint("shuffle_hash"), ["conv_id", "id"]).select("node", F.col("call").alias("needs"))
    wanted = all_events.filter("kind = 'call'").select("conv_id", "node", F.explode("after").alias("id"))
    of_calls = wanted.join(answered.hint("shuffle_hash"), ["conv_id", "id"]).select("node", "needs")
    return of_results.union(of_calls).distinct()


def ordered(all_events: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, behind: place of the event that it follows or its own, step, cyclic) of written events and edges."""
    place = all_events.select("node", F.struct("turn", "part").alias("own"))
    state = place.withColumn("behind", F.col("own"))
    while True:
        needs = state.select(F.col("node").alias("needs"), F.col("behind").alias("b"))
        last = edges.join(needs, "needs").groupBy("node").agg(F.max("b").alias("last"))
        later = _written(
            state.join(last, "node").filter(F.col("last") > F.col("behind")).select("node", "last"), "later"
        )
        if later.limit(1).count() == 0:
            break
        state = _written(
            state.join(later, "node", "left").select("node", "own", F.coalesce("last", "behind").alias("behind")), "behind"
        )
    moved = state.filter(F.col("behind") > F.col("own"))
    if moved.limit(1).count() == 0:
        return state.select("node", "behind", F.lit(0).alias("step"), F.lit(False).alias("cyclic"))
    # Among those moved behind one event: steps from it, found by peeling off whatever no longer waits.
    pair = state.select("node", "behind")
    inner = _written(
        edges.join(pair, "node")
        .join(pair.select(F.col("node").alias("needs"), F.col("behind").alias("b")), "needs")
        .filter(F.col("behind") == F.col("b"))
        .select("node", "needs"),
        "inner",
    )
    # All that were moved wait for something of the same place; an event in its own place does so on a cycle only.
    waiting = _written(inner.select("node").distinct(), "waiting")
    steps, step = None, 0
    while True:
        step += 1
        held = inner.join(waiting.select(F.col("node").alias("needs")), "needs", "left_semi").select("node").distinct()
        free = _written(waiting.join(held, "node", "left_anti"), "free")
        if free.limit(1).count() == 0:
            break
        part = free.withColumn("step", F.lit(step))
        steps = part if steps is None else steps.union(part)
        waiting = _written(waiting.join(free, "node", "left_anti"), "waiting")
    tail = waiting.withColumn("step", F.lit(LATE))
    steps = tail if steps is None else steps.union(tail)
    return state.join(steps, "node", "left").select(
        "node", "behind", F.coalesce("step", F.lit(0)).alias("step"), F.coalesce(F.col("step") == LATE, F.lit(False)).alias("cyclic")
    )


def link(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per event: its place, order, link status, validity and canonical JSON."""
    rows = _written(events(messages), "events")
    edges = _written(dependencies(rows), "edges")
    first = (
        rows.filter("kind = 'call' and conv_id is not null and id is not null")
        .groupBy("conv_id", "id").agg(F.min(F.struct("turn", "part", "node")).alias("f"))
        .select("conv_id", "id", F.col("f.node").alias("first"))
    )
    answers = rows.filter("kind = 'result' and conv_id is not null and id is not null").groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("answers"))
    status = (
        F.when(F.col("kind") == "message", "message")
        .when((F.col("kind") == "result") & F.col("first").isNull(), "orphan")
        .when(F.col("kind") == "result", "linked")
        .when(F.col("first").isNotNull() & (F.col("first") != F.col("node")), "repeated")
        .when(F.col("answers").isNull(), "unanswered")
        .otherwise("linked")
    )
    # Only events with an identifier are dealt out by it: plain messages have none and would all meet in one task.
    has_id = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    linked = (
        rows.filter(has_id).join(first.hint("shuffle_hash"), ["conv_id", "id"], "left")
        .join(answers.hint("shuffle_hash"), ["conv_id", "id"], "left")
    )
    nobody = F.lit(None).cast("bigint")
    plain = rows.filter(~has_id).withColumns({"first": nobody, "answers": nobody})
    out = (
        linked.unionByName(plain)
        .join(ordered(rows, edges), "node")
        .select(
            "conv_id", "turn", "part", "kind", "role", "id", "name", "body", "after", status.alias("status"),
            F.col("behind.turn").alias("order_turn"), F.col("behind.part").alias("order_part"), F.col("step").alias("order_step"), "cyclic",
        )
    )
    sent = out.sparkSession.sparkContext.broadcast({k: dict(v) for k, v in schemas.items()})
    schema = out.drop("body", "after").schema.add("valid", T.BooleanType()).add("errors", T.StringType()).add("json", T.StringType())

    def run(batches):
        for batch in batches:
            valid, errors, texts = [], [], []
            for r in batch.select(["kind", "role", "id", "name", "body", "after"]).to_pylist():
                found: list[str] = []
                shape = {"type": r["kind"], "role": r["role"]}
                if r["kind"] == "call":
                    value, error = parse(r["body"])
                    rules = sent.value.get(r["name"])
                    if error:
                        found.append(error)
                    elif not isinstance(value, dict):
                        found.append("no object")
                    elif rules is None:
                        found.append("unknown tool")
                    else:
                        found += violations(value, rules)
                    shape |= {"id": r["id"], "name": r["name"], "arguments": value if isinstance(value, dict) else None, "after": r["after"] or []}
                else:
                    shape |= {"content": r["body"]} | ({"id": r["id"]} if r["kind"] == "result" else {})
                valid.append(not found)
                errors.append("; ".join(found) or None)
                texts.append(canonical(shape))
            kept = batch.drop_columns(["body", "after"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(valid), pa.array(errors, pa.string()), pa.array(texts, pa.string())],
                [*kept.schema.names, "valid", "errors", "json"],
            )

    return map_arrow(out, run, schema)
