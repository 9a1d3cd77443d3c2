"""Chat formatting: tool calls linked to results, put in order, validated and serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.llm.common import bounded_batches, written

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}
_MOST_ROUNDS = 64


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks a JSON schema (types, required, properties, items, enum, bounds)."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, (str, list)):
        unit = "Length" if isinstance(value, str) else "Items"
        if len(value) < schema.get(f"min{unit}", 0):
            out.append(f"{at}: shorter than min{unit}")
        if len(value) > schema.get(f"max{unit}", len(value)):
            out.append(f"{at}: longer than max{unit}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                out += violations(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{name}: not allowed")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def canonical(value) -> str:
    """One text for equal values: keys sorted, no spaces, only needed escapes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str]]:
    """A call's arguments in canonical form (null if they are no JSON) and what is wrong with them."""
    if name not in schemas:
        wrong = ["unknown tool"]
    else:
        wrong = []
    try:
        value = json.loads(arguments or "", parse_constant=_no_constant)
        text = canonical(value)
    except (ValueError, RecursionError):
        return None, [*wrong, "arguments are not JSON"]
    return text, wrong or violations(value, schemas[name])


def serialised(item: tuple, schemas: dict[str, dict]) -> tuple[str, list[str]]:
    """Canonical JSON of (kind, id, call_id, name, arguments, role, content, call_name), and a call's errors."""
    kind, own, call_id, name, arguments, role, content, call_name = (None if pd.isna(x) else x for x in item)
    if kind == "call":
        text, errors = checked(name, arguments, schemas)
        head = canonical({"id": own, "kind": kind, "name": name})
        return f'{{"arguments":{text or "null"},{head[1:]}', errors
    if kind == "result":
        return canonical({"call_id": call_id, "content": content, "kind": kind, "name": call_name}), []
    return canonical({"content": content, "kind": "message", "role": role}), []


def _serialised(schemas: dict[str, dict], columns: list[str]) -> Column:
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for series in parts:
            found = [serialised(item, schemas) for item in zip(*series, strict=True)]
            yield pd.DataFrame({"json": [f[0] for f in found], "errors": [f[1] for f in found]})

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "json string, errors array<string>").asNondeterministic()(*columns)


def depths(nodes: DataFrame) -> DataFrame:
    """``(conv_id, id, depth)`` of ``nodes(conv_id, id, up, also)``, each id once: steps of the longest way up; null above or on a cycle.

    ``up`` and ``also`` are what an item comes after. Each item knows its longest
    finished way (``base``) and up to two open ways: at which item each goes on
    and after how many steps. A round follows the open ways through every item that has one open way
    at most, so single chains double; ways that meet become the longer one. Only items
    with two open ways that have not met make others wait for a round.
    """
    one = F.lit(1).cast("long")
    first, second = F.coalesce("up", "also"), F.when(F.col("up") != F.col("also"), F.col("also"))
    at = nodes.select(
        "conv_id", "id", F.when(first.isNull(), one - 1).alias("base"), first.alias("a"), one.alias("s"), second.alias("b"), one.alias("t")
    )
    at = written(at, "pointers")
    done, open_ = at.where("a IS NULL"), at.where("a IS NOT NULL")
    least = left = None
    waited = 0
    while True:
        counts = open_.agg(F.count("a").alias("a"), F.count("b").alias("b")).first()
        if counts.a == 0:
            break
        left, before = (counts.a, counts.b), left
        waited = 0 if left != before else waited + 1
        least = least or counts.a
        # A chain is at an end after so many rounds; what still turns then is a cycle.
        if waited > least.bit_length() + 1:
            break
        # Only items that have not come to an end go on; what they lead to may have.
        known = done.unionByName(open_).where("b IS NULL").select("conv_id", "id", "base", "a", "s")

        def through(name: str, known: DataFrame = known) -> DataFrame:
            return known.select(
                "conv_id", F.col("id").alias(name), F.col("base").alias(f"{name}_base"), F.col("a").alias(f"{name}_a"), F.col("s").alias(f"{name}_s"), F.lit(True).alias(f"{name}_met")
            )

        met = open_.join(through("a"), ["conv_id", "a"], "left").join(through("b"), ["conv_id", "b"], "left")
        ends = {}
        for name, steps in (("a", "s"), ("b", "t")):
            ends[f"{name}1"] = F.when(F.col(f"{name}_met"), F.col(f"{name}_a")).otherwise(F.col(name))
            ends[f"{name}n"] = F.col(steps) + F.when(F.col(f"{name}_met"), F.coalesce(f"{name}_s", one - 1)).otherwise(one - 1)
        met = met.select("conv_id", "id", F.greatest("base", F.col("a_base") + F.col("s"), F.col("b_base") + F.col("t")).alias("base"), *[c.alias(n) for n, c in ends.items()])
        same = F.col("a1").eqNullSafe(F.col("b1")) | F.col("a1").isNull()
        met = met.select(
            "conv_id",
            "id",
            "base",
            F.coalesce("a1", "b1").alias("a"),
            F.when(F.col("a1").isNull(), F.col("bn")).when(F.col("a1") == F.col("b1"), F.greatest("an", "bn")).otherwise(F.col("an")).alias("s"),
            F.when(~same, F.col("b1")).alias("b"),
            F.col("bn").alias("t"),
        )
        met = written(met, "pointers")
        done, open_ = done.unionByName(met.where("a IS NULL")), met.where("a IS NOT NULL")
    return done.unionByName(open_).select("conv_id", "id", F.when(F.col("a").isNull(), F.col("base")).alias("depth"))


def linked(items: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every item of conversations with its link, place and canonical JSON.

    ``items`` has ``conv_id, turn, kind`` (``message``, ``call`` or ``result``),
    ``id, parent_id, call_id, name, arguments, role, content``; more columns are
    ignored. Results: ``(conv_id, position, turn, kind, id, call_id, linked, errors, json)``.

    A result is joined to the call of its ``call_id`` in its conversation, a call
    to its results. An item comes after its parent and a result also after its
    call: ``position`` is the number of items on the longest way to it, so sorting
    by ``(conv_id, position, turn, id)`` is a topological order; it is null on a
    cycle and behind one. A call's ``errors`` say what in its arguments breaks the tool's schema.

    Every row is kept. If several calls share an id, results belong to the first
    (by turn, name and arguments), so no pairs multiply. A null id, parent or
    call links to nothing; a missing parent or call is nothing to come after; a null
    conversation is one conversation; an empty table gives an empty table.
    """
    bounded_batches(items.sparkSession)
    columns = ["conv_id", "turn", "kind", "id", "parent_id", "call_id", "name", "arguments", "role", "content"]
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0null"))
    items = written(items.select(*columns, conv.alias("conv")), "items")
    known = items.where("id IS NOT NULL")
    calls = known.where("kind = 'call'").groupBy("conv", "id").agg(F.min(F.struct("turn", "name", "arguments")).alias("first"))
    results = items.where("kind = 'result' AND call_id IS NOT NULL").groupBy("conv", F.col("call_id").alias("id")).agg(
        F.count(F.lit(1)).alias("answers")
    )
    # Of each id one node; what it comes after counts if it exists.
    nodes = known.groupBy("conv", "id").agg(F.min("parent_id").alias("up"), F.min(F.when(F.col("kind") == "result", F.col("call_id"))).alias("also"))
    nodes = written(nodes, "nodes")
    for before in ("up", "also"):
        there = nodes.select("conv", F.col("id").alias(before), F.lit(True).alias("there"))
        nodes = nodes.join(there, ["conv", before], "left").withColumn(before, F.when(F.col("there"), F.col(before))).drop("there")
    nodes = nodes.select(F.col("conv").alias("conv_id"), "id", "up", "also")
    place = depths(nodes).select(F.col("conv_id").alias("conv"), "id", F.col("depth").alias("position"), F.lit(True).alias("placed"))
    named = calls.select("conv", F.col("id").alias("call_id"), F.col("first.name").alias("call_name"))
    rows = items.join(place, ["conv", "id"], "left").join(results, ["conv", "id"], "left").join(named, ["conv", "call_id"], "left")
    found = F.when(F.col("kind") == "call", F.col("answers").isNotNull()).when(F.col("kind") == "result", F.col("call_name").isNotNull())
    rows = rows.select(
        *columns,
        "call_name",
        F.when(F.col("placed"), F.col("position")).when(F.col("id").isNull(), F.lit(0).cast("long")).alias("position"),
        F.coalesce(found, F.lit(False)).alias("linked"),
    )
    told = ["kind", "id", "call_id", "name", "arguments", "role", "content", "call_name"]
    rows = rows.withColumn("told", _serialised(schemas, told))
    return rows.select("conv_id", "position", "turn", "kind", "id", "call_id", "linked", "told.errors", "told.json")
