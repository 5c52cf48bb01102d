"""Tool-call linking: calls and results joined by identifier, ordered, validated, serialised.

Calls and results meet by a hash join on (conv_id, call_id). A call may name the call it comes
after (``after_id``); its depth is the length of that chain, found by pointer doubling
-- a logarithmic number of hash joins, however long a conversation -- and sorting a conversation by
(depth, turn, call_id) is a topological order. Arguments are checked against the schema of
the named tool, and each record is written as canonical JSON (sorted keys, no blanks).

Defined results: of calls (or results) that repeat an identifier the one of smallest turn, then
smallest content, counts; rows without an identifier link to nothing and are reported as
``no_id``; a result without a call is an ``orphan``, a call without a result ``unanswered``; a chain
that names a missing call starts there; calls on or behind a cycle are ``cyclic`` with null
depth; null or broken argument text, or a number beyond double range in it, is an error of the record, not of
the job; half a surrogate pair is written as its escape; other columns are never read; empty tables give an empty result.
Of conversations, turns that are neither call nor result have the status ``message``.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import written

ID = ["conv_id", "call_id"]
MAX_ROUNDS = 48  # pointer doubling reaches chains of 2**48 calls

SCHEMAS = {
    "search": {"query": {"type": "string", "required": True, "min_length": 1},
               "limit": {"type": "integer", "required": True, "min": 1, "max": 50}},
    "fetch": {"url": {"type": "string", "required": True}, "depth": {"type": "integer", "min": 0, "max": 5},
              "text": {"type": "string"}},
    "count_words": {"text": {"type": "string", "required": True, "min_length": 1},
                    "unique": {"type": "boolean"}},
}

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


_SURROGATE = re.compile("[\ud800-\udfff]")


def _writable(text: str) -> str:
    """Half a surrogate pair is no character: it stays the escape it was."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    return _writable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


class _TooLarge(ValueError):
    pass


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise _TooLarge(text)
    return value


def check_arguments(name: str | None, text: str | None, schemas: dict) -> tuple[object, list[str]]:
    """Parsed arguments and the list of what is wrong with them, in field order."""
    def no_constant(s):
        raise ValueError(s)
    try:
        value = json.loads(text if text is not None else "", parse_constant=no_constant, parse_float=_number)
    except _TooLarge:
        return None, ["arguments: number too large"]
    except (ValueError, RecursionError):
        return None, ["arguments: not JSON"]
    if name not in schemas:
        return value, ["name: unknown tool"]
    if not isinstance(value, dict):
        return value, ["arguments: not an object"]
    errors = []
    for field, rule in sorted(schemas[name].items()):
        if field not in value:
            if rule.get("required"):
                errors.append(f"{field}: missing")
            continue
        v = value[field]
        if not isinstance(v, _TYPES[rule["type"]]) or rule["type"] != "boolean" and isinstance(v, bool):
            errors.append(f"{field}: not {rule['type']}")
            continue
        if "min" in rule and v < rule["min"] or "min_length" in rule and len(v) < rule["min_length"]:
            errors.append(f"{field}: too small")
        if "max" in rule and v > rule["max"]:
            errors.append(f"{field}: too large")
    errors += [_writable(f"{field}: unknown") for field in sorted(set(value) - set(schemas[name]))]
    return value, errors


def _first(rows: DataFrame, cols: list[str]) -> DataFrame:
    rec = F.min(F.struct(*cols)).alias("r")
    return rows.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()) \
        .groupBy(*ID).agg(rec).select(*ID, *[F.col("r").getField(c).alias(c) for c in cols])


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth); depth is null on or behind a cycle."""
    known = calls.select("conv_id", F.col("call_id").alias("after_id"), F.lit(True).alias("known"))
    cur = written(calls.select(*ID, "after_id").join(known, ["conv_id", "after_id"], "left").select(
        *ID, F.when(F.col("known"), F.col("after_id")).alias("at"),
        F.when(F.col("known"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth")), "depth")
    for _ in range(MAX_ROUNDS):
        # a chain without a cycle is at most as deep as there are calls: a longer one is cyclic
        state = cur.agg(F.count("at").alias("open"), F.count("*").alias("n"), F.max("depth").alias("deep")).first()
        if not state["open"] or state["deep"] > state["n"]:
            break
        hop = cur.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        cur = written(cur.join(hop, ["conv_id", "at"], "left").select(
            *ID, F.col("next").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depth")
    return cur.select(*ID, F.when(F.col("at").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls: conv_id, call_id, turn, name, arguments, after_id; results: conv_id, call_id, turn, content.
    One row per identified call or result, and one per row without identifier: conv_id, call_id,
    turn, depth, status, valid, errors, record."""
    import pyarrow as pa

    c = written(_first(calls, ["turn", "name", "arguments", "after_id"]), "calls")
    r = _first(results, ["turn", "content"]).withColumnsRenamed({"turn": "result_turn"})
    joined = c.withColumn("called", F.lit(True)).join(depths(c), ID, "left") \
        .join(r.withColumn("answered", F.lit(True)), ID, "full")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("depth").isNull(), "cyclic") \
        .when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    rows = joined.select(*ID, F.coalesce("turn", "result_turn").alias("turn"), "depth", status.alias("status"),
                         "name", "arguments", "after_id", "content")
    none = F.lit(None).cast("string")
    lost = calls.where("conv_id is null or call_id is null").select(
        *ID, "turn", F.lit(None).cast("long").alias("depth"), F.lit("no_id").alias("status"), "name", "arguments",
        "after_id", none.alias("content")).unionByName(
        results.where("conv_id is null or call_id is null").select(
            *ID, "turn", F.lit(None).cast("long").alias("depth"), F.lit("no_id").alias("status"), none.alias("name"),
            none.alias("arguments"), none.alias("after_id"), "content"))
    rows = rows.unionByName(lost)
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("conv_id", "call_id", "turn")}

    def run(batches):
        for batch in batches:
            valid, errors, records = [], [], []
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i, status in enumerate(cols["status"]):
                is_call = cols["name"][i] is not None or cols["arguments"][i] is not None or status not in ("orphan", "no_id")
                value, wrong = check_arguments(cols["name"][i], cols["arguments"][i], schemas) if is_call else (None, [])
                rec = {"id": cols["call_id"][i], "after": cols["after_id"][i], "name": cols["name"][i],
                       "arguments": value, "result": cols["content"][i]}
                valid.append(not wrong if is_call else None)
                errors.append(wrong)
                records.append(canonical(rec))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("conv_id", "call_id", "turn", "depth", "status")]
                + [pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(records, pa.string())],
                names=["conv_id", "call_id", "turn", "depth", "status", "valid", "errors", "record"])
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, turn {kinds['turn']}, "
                                "depth long, status string, valid boolean, errors array<string>, record string")


def from_conversations(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from plain conversations: an assistant turn is a call (tool by turn
    number, its whole text in the arguments) after the assistant turn two before it; a user turn
    after the first answers the turn before it. System turns, a user turn 0 and turns of any other
    or no role are neither call nor result (``messages``)."""
    d = conv.select("conv_id", "turn", "role", "text")
    text = F.coalesce("text", F.lit(""))

    def named(turn):
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    tool = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(3))
    args = F.when(tool == 0, F.to_json(F.struct(text.alias("query"), F.pmod(F.length(text), F.lit(60)).alias("limit")))) \
        .when(tool == 1, F.to_json(F.struct(F.concat(F.lit("doc:"), F.col("conv_id").cast("string")).alias("url"),
                                            F.col("turn").alias("depth"), text.alias("text")))) \
        .otherwise(F.to_json(F.struct(text.alias("text"), (F.length(text) % 2 == 0).alias("unique"))))
    calls = d.where("role = 'assistant'").select(
        "conv_id", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), named(F.col("turn"))).alias("call_id"),
        "turn", F.when(tool == 0, "search").when(tool == 1, "fetch").otherwise("count_words").alias("name"),
        args.alias("arguments"), F.when(F.col("turn") >= 2, named(F.col("turn") - 2)).alias("after_id"))
    results = d.where("role = 'user' and (turn > 0 or turn is null)").select(
        "conv_id", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), named(F.col("turn") - 1)).alias("call_id"),
        "turn", F.col("text").alias("content"))
    return calls, results


def messages(conv: DataFrame) -> DataFrame:
    """The turns that are neither call nor result, in the columns of ``link``: status ``message``, the turn as record."""
    import pyarrow as pa

    is_call = F.coalesce(F.col("role") == "assistant", F.lit(False))
    is_result = F.coalesce((F.col("role") == "user") & (F.col("turn").isNull() | (F.col("turn") > 0)), F.lit(False))
    rest = conv.where(~is_call & ~is_result).select("conv_id", "turn", "role", "text")
    kinds = {n: rest.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}

    def run(batches):
        for batch in batches:
            rows = zip(*[batch.column(n).to_pylist() for n in ("turn", "role", "text")])
            records = [canonical({"turn": t, "role": r, "text": x}) for t, r, x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(records, pa.string())],
                                             names=["conv_id", "turn", "record"])

    found = rest.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, record string")
    return found.select("conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.lit(None).cast("long").alias("depth"),
                        F.lit("message").alias("status"), F.lit(None).cast("boolean").alias("valid"),
                        F.array().cast("array<string>").alias("errors"), "record")


def op6(conv: DataFrame) -> DataFrame:
    return link(*from_conversations(conv)).unionByName(messages(conv))
