"""Chat formatting: tool calls linked to their results, checked, ordered and written as canonical JSON. DataFrame operations only.

Turns are (conv_id, turn, role, text). A text that is a JSON object with ``tool_calls`` (each with id, name, arguments) makes calls; a turn of
role ``tool`` whose text is a JSON object with ``tool_call_id`` and ``content`` is a result; any other turn is a message. Calls and
results are joined by (conv_id, id), in a hash join where Spark finds a side small enough and a sort-merge join beyond, which spills. An argument
"$id" refers to the result of the call of that id, so that call comes first; text that begins with "$" is written with "$$".
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, materialize

CALL = "struct<tool_calls:array<struct<id:string,name:string,arguments:map<string,variant>>>,tool_call_id:string,content:string>"
#: JSON types by the type of the parsed value; a number without a fraction is an integer, however it is written
TYPES = {"integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$"}


def quoted(c: Column) -> Column:
    """JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r"^(?s)\{\"v\":(.*)\}$", 1)


def canonical(fields: dict[str, Column]) -> Column:
    """JSON object with keys by code point and no white space; a field whose value is null is left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_map(m: Column, typed: bool = False) -> Column:
    """JSON object with sorted keys: of values as they are, with keys sorted at every level (variants keep them so), or of strings."""
    value = (lambda v: F.coalesce(F.to_json(v), F.lit("null"))) if typed else (lambda v: quoted(v.cast("string")))
    keys = F.array_sort(F.map_keys(m))
    pairs = F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), value(F.element_at(m, k))))
    return F.when(m.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}")))


def is_reference(value: Column) -> Column:
    """Whether a variant is a string that stands for the result of a call: one "$" and the call's id. Text that begins with "$" is written with "$$"."""
    text = value.cast("string")
    return F.coalesce((F.schema_of_variant(value) == "STRING") & text.startswith("$") & ~text.startswith("$$"), F.lit(False))


def conforms(value: Column, schema: str | dict) -> Column:
    """Whether a variant that is there fits a schema: a type, or {"type", "enum", "properties", "required", "items", "additionalProperties": False}. JSON null fits as if it weren't there."""
    schema = {"type": schema} if isinstance(schema, str) else schema
    good = F.lit(True)
    if "type" in schema:
        good &= F.schema_of_variant(value).rlike(TYPES[schema["type"]])
    if "enum" in schema:
        good &= F.to_json(value).isin([json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in schema["enum"]])
    for name in {*schema.get("properties", ()), *schema.get("required", ())}:
        if "'" in name or "\\" in name:
            raise ValueError(f"an inner name may not hold quotes: {name}")
    inner = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
    for name in sorted(schema.get("required", ())):
        good &= inner(name).isNotNull() & ~F.is_variant_null(inner(name))
    for name, sub in sorted(schema.get("properties", {}).items()):
        good &= F.coalesce(conforms(inner(name), sub), F.lit(True))
    if schema.get("additionalProperties") is False:
        names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        good &= F.coalesce(F.size(F.array_except(names, F.array(*[F.lit(n) for n in sorted(schema.get("properties", ()))]).cast("array<string>"))) == 0, F.lit(True))
    if "items" in schema:
        good &= F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: conforms(x, schema["items"])), F.lit(True))
    return F.when(value.isNull() | F.is_variant_null(value), F.lit(True)).otherwise(F.coalesce(good, F.lit(False)))


def fits(schemas: dict[str, dict]) -> Column:
    """Whether a call (columns name, arguments) fits the schema of its tool: {"required": [...], "properties": {argument: schema}}. An unknown tool fits nothing, an unknown argument neither.

    References fit any type."""
    out = F.lit(False)
    for tool, schema in sorted(schemas.items()):
        properties = schema.get("properties", {})
        good = F.lit(True)
        for name in sorted(schema.get("required", ())):
            value = F.element_at("arguments", F.lit(name))
            good &= value.isNotNull() & F.coalesce(~F.is_variant_null(value), F.lit(False))
        for name, kind in sorted(properties.items()):
            value = F.element_at("arguments", F.lit(name))
            good &= F.coalesce(is_reference(value) | conforms(value, kind), F.lit(True))
        known = F.array(*[F.lit(n) for n in sorted(properties)]).cast("array<string>")
        good &= F.coalesce(F.size(F.array_except(F.map_keys("arguments"), known)) == 0, F.lit(True))
        out = F.when(F.col("name") == tool, good).otherwise(out)
    return out


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth, at of calls that refer to others or are referred to. depth: 1 more than the deepest call they refer to; null if they
    wait for each other in a ring. at: the latest turn of the call and all it needs.

    Rounds end when no depth changes, so a conversation without references costs one, and chains as many as the longest has calls."""
    held = calls.select("conv_id", "call_id", F.explode(F.map_values("arguments")).alias("v")).where(is_reference(F.col("v")))
    refers = held.select("conv_id", "call_id", F.expr("substring(cast(v AS string), 2)").alias("needs"))
    known = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    refers = materialize(refers.join(known.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").distinct(), "refers")
    if refers.isEmpty():
        return refers.select("conv_id", "call_id", F.lit(0).alias("depth"), F.lit(None).cast(calls.schema["turn"].dataType).alias("at"))
    nodes = refers.select("conv_id", "call_id").union(refers.select("conv_id", F.col("needs").alias("call_id"))).distinct().join(known, ["conv_id", "call_id"])
    waits = refers.select("conv_id", "call_id").distinct().withColumn("waits", F.lit(True))
    state = materialize(nodes.join(waits, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "turn", F.when(F.col("waits").isNull(), F.lit(0)).alias("depth"),
        F.when(F.col("waits").isNull(), F.col("turn")).alias("at")), "depths")
    while True:
        had = state.select("conv_id", F.col("call_id").alias("needs"), F.col("depth").alias("d"), F.col("at").alias("a"))
        every = F.count("d") == F.count("*")
        ready = refers.join(had, ["conv_id", "needs"]).groupBy("conv_id", "call_id").agg(F.when(every, F.max("d") + 1).alias("new"), F.when(every, F.max("a")).alias("late"))
        fresh = F.col("depth").isNull() & F.col("new").isNotNull()
        after = state.join(ready, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "turn", F.coalesce("depth", "new").alias("depth"),
            F.when(fresh, F.greatest("turn", "late")).otherwise(F.col("at")).alias("at"), fresh.alias("fresh"))
        after = materialize(after, "depths")
        state = after.drop("fresh")
        if after.where("fresh").isEmpty():
            return state.select("conv_id", "call_id", "depth", "at")


def link_tool_calls(turns: DataFrame, schemas: dict[str, dict], typed: bool = False) -> DataFrame:
    """A row for each message, call and result: conv_id, turn, item (0, or the call's place in its turn), role, kind, call_id, linked, valid, depth, ord, json.

    ``linked``: a call has a later result, or a result an earlier call, of its id in its conversation. Of several calls with one id the first
    counts, of several results the first after it; the others are not linked. ``valid``: of calls only, the arguments fit the schema, and no ring of
    references holds the call. Within a conversation, ``ord`` (latest turn of the call and all it needs, depth, item, 0 for the call and 1 for its result, turn) puts every
    result after its call and every call after those it refers to. Rows with a null conv_id or turn are never linked; a null text is an empty one; equal rows stay and are
    treated alike; broken JSON is a message. ``typed``: arguments in json keep their JSON types, else each is written as a string. An empty table gives an empty result; other columns are ignored.
    """
    rows = bare(turns, conv_id="conv_id", turn="turn", role="role", text=F.coalesce(F.col("text"), F.lit("")))
    looks = F.ltrim("text").startswith("{") & F.col("role").isin("assistant", "tool")
    rows = rows.withColumn("p", F.when(looks, F.from_json("text", CALL)))
    several = F.coalesce(F.size("p.tool_calls") > 0, F.lit(False)) & (F.col("role") == "assistant")
    is_result = F.coalesce((F.col("role") == "tool") & F.col("p.tool_call_id").isNotNull(), F.lit(False))
    kind = F.when(several, "call").when(is_result, "result").otherwise("message")
    # an array of one null stands for "no calls", so explode keeps every turn
    items = rows.withColumn("kind", kind).select("conv_id", "turn", "role", "text", "kind", "p",
        F.posexplode(F.when(several,
        F.col("p.tool_calls")).otherwise(F.array(F.lit(None).cast("struct<id:string,name:string,arguments:map<string,variant>>")))).alias("item", "one"))
    items = items.select("conv_id", "turn", "item", "role", "kind",
        F.when(F.col("kind") == "call", F.col("one.id")).when(F.col("kind") == "result", F.col("p.tool_call_id")).alias("call_id"), F.col("one.name").alias("name"),
        F.col("one.arguments").alias("arguments"), F.when(F.col("kind") == "result", F.coalesce("p.content", F.lit(""))).otherwise(F.col("text")).alias("content"))

    able = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("call_id").isNotNull()
    first_call = items.where(able & (F.col("kind") == "call")).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "item")).alias("c"))
    answers = items.where(able & (F.col("kind") == "result")).select("conv_id", "call_id", "turn").join(first_call, ["conv_id", "call_id"]).where("turn > c.turn")
    pairs = answers.groupBy("conv_id", "call_id", "c").agg(F.min("turn").alias("answer"))
    ids = first_call.select("conv_id", "call_id", "c").join(pairs.drop("c"), ["conv_id", "call_id"], "left")
    deep = depths(items.where(able & (F.col("kind") == "call")).select("conv_id", "call_id", "turn", "arguments"))
    ids = ids.join(deep.withColumn("ranked", F.lit(True)), ["conv_id", "call_id"], "left")

    out = items.join(ids, ["conv_id", "call_id"], "left")
    own = (F.col("kind") == "call") & (F.col("c.turn") == F.col("turn")) & (F.col("c.item") == F.col("item"))
    answer = (F.col("kind") == "result") & (F.col("answer") == F.col("turn"))
    linked = F.coalesce((own & F.col("answer").isNotNull()) | answer, F.lit(False))
    ring = F.col("ranked").isNotNull() & F.col("depth").isNull()
    valid = F.when(F.col("kind") == "call", F.coalesce(fits(schemas), F.lit(False)) & ~F.coalesce(ring & own, F.lit(False)))
    depth = F.when(F.col("kind") == "message", F.lit(0)).otherwise(F.coalesce("depth", F.lit(0)))
    at = F.when(linked | F.coalesce(own, F.lit(False)), F.coalesce(F.col("at"), F.col("c.turn"))).otherwise(F.col("turn"))
    order = F.struct(at.alias("at"), depth.alias("depth"), F.when(linked, F.col("c.item")).otherwise(F.col("item")).alias("item"), (F.col("kind") == "result").cast("int").alias("result"), F.col("turn").alias("turn"))
    written = F.when(F.col("kind") == "call",
        canonical({"role": quoted(F.col("role")), "id": quoted(F.col("call_id")), "name": quoted(F.col("name")),
        "arguments": canonical_map(F.col("arguments"), typed)})).when(F.col("kind") == "result",
        canonical({"role": quoted(F.col("role")), "id": quoted(F.col("call_id")),
        "content": quoted(F.col("content"))})).otherwise(canonical({"role": F.when(F.col("role").isNotNull(), quoted(F.col("role"))),
        "content": quoted(F.col("content"))}))
    return out.select("conv_id", "turn", "item", "role", "kind", "call_id", linked.alias("linked"), valid.alias("valid"), depth.alias("depth"), order.alias("ord"), written.alias("json"))
