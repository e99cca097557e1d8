"""Tool calls linked to their results, ordered, checked against schemas and written as canonical JSON.

Calls and results meet by identifier in a shuffled join, the least call of an identifier with its least
result; whatever else bears the identifier stays as a row of its own, dealt by its values, so no identifier is hot
and no conversation is gathered. A call may need another call's
result first. Its depth, the number of calls before it on that chain, comes from pointer doubling: after
each round a call knows twice as many of its predecessors, so a chain of n calls takes log2(n) rounds. A
call is at place ``2 * depth`` and its result right behind, so ordering a conversation's rows by
``place, turn, call_id`` is topological. Calls on a cycle, or that need one, have no place.

Arguments are parsed once into typed values. Canonical JSON has keys in code point order at every level, no
white space, and numbers without trailing zeros.

Only DataFrame functions are used, so nothing leaves the JVM.

Defined cases: a call without result is ``unanswered``, a result without call ``orphan``; under a
repeated identifier the least call and least result by ``turn``, then by their values, are linked, and every other
distinct call or result is a row with status ``conflict`` (further results without any call: ``orphan``); ``copies`` and ``result_copies`` count equal
rows; a chain goes through the linked call, so all calls of an identifier have its place; rows without identifier are left out; a ``needs`` that names no call counts as nothing before;
arguments that are no JSON are a problem and stand in the JSON as an object that holds their text; a tool without schema is a problem;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ridgework.session import checked_broadcast, stage

CALLS = ("conv_id", "call_id", "turn", "name", "arguments", "needs")
RESULTS = ("conv_id", "call_id", "turn", "content")

# Fixed: how JSON Schema's type names start in the names Spark gives to typed values.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def depths(calls: DataFrame) -> DataFrame:
    """``call_id, depth`` (NULL on a cycle) for unique ``call_id, needs``."""
    known = calls.select(F.col("call_id").alias("needs"))
    state = stage(calls.join(known, "needs", "left_semi").select("call_id", F.col("needs").alias("before"), F.lit(1).cast("bigint").alias("depth")), "chains")
    roots = calls.join(state.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(0).cast("bigint").alias("depth"))
    live = total = state.count()
    reach = 1
    while live and reach <= 2 * total:
        ahead = state.select(F.col("call_id").alias("at"), F.col("before").alias("next"), F.col("depth").alias("more"))
        state = stage(state.join(ahead, F.col("before") == F.col("at"), "left").select(
            "call_id", F.col("next").alias("before"), (F.col("depth") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("depth")
        ), "chains")
        live, reach = state.where("before is not null").count(), 2 * reach
    ended = F.when(F.col("before").isNull(), F.col("depth"))
    return roots.unionByName(state.select("call_id", ended.alias("depth")))


def problems(types: Column, parameters: Column) -> Column:
    """What is wrong with arguments of the given ``map<name, type>``; NULL types: no JSON object."""
    allowed = F.create_map(*[part for name, starts in TYPES.items() for part in (F.lit(name), F.lit(starts))])
    missing = F.transform(
        F.filter(parameters, lambda p: p["required"] & ~F.map_contains_key(types, p["parameter"])),
        lambda p: F.concat(F.lit("missing "), p["parameter"]),
    )
    wrong = F.transform(
        F.filter(parameters, lambda p: ~F.coalesce(F.exists(
            F.split(F.try_element_at(allowed, p["type"]), "[|]"),
            lambda start: F.startswith(F.try_element_at(types, p["parameter"]), start),
        ), F.lit(True))),
        lambda p: F.concat(F.lit("wrong type "), p["parameter"]),
    )
    named = F.transform(parameters, lambda p: p["parameter"])
    extra = F.transform(F.array_except(F.map_keys(types), named), lambda name: F.concat(F.lit("unknown "), name))
    return F.array_sort(
        F.when(types.isNull(), F.array(F.lit("arguments are no object")))
        .when(parameters.isNull(), F.array(F.lit("no schema")))
        .otherwise(F.concat(missing, wrong, extra))
    )


def _leading(rows: DataFrame, values: list[str], side: str, counted: str) -> DataFrame:
    """Distinct ``rows`` with how often each came, and ``slot``: empty for the least of its identifier.

    The others have a slot of their own, which keeps an identifier with many of them from being one hot key.
    """
    each = rows.where("call_id is not null").groupBy("call_id", *values).agg(F.count("*").alias(counted))
    least = each.groupBy("call_id").agg(F.min(F.struct(*values)).alias("least"))
    slot = F.when(F.struct(*values).eqNullSafe(F.col("least")), "").otherwise(F.concat(F.lit(side), F.xxhash64(*values).cast("string")))
    return each.join(least, "call_id").withColumn("slot", slot).drop("least")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per distinct call, with its result, and per distinct result that no call took.

    ``schemas`` has ``name, parameter, type, required``, one row per parameter.
    """
    called = stage(_leading(calls.select(*CALLS), ["turn", "conv_id", "name", "arguments", "needs"], "c", "copies"), "calls")
    first = called.where("slot = ''")
    answered = _leading(results.select(*RESULTS), ["turn", "conv_id", "content"], "r", "result_copies").select(
        "call_id", "slot", "result_copies", F.struct("turn", "conv_id", "content").alias("result")
    ).join(first.select("call_id", F.lit(True).alias("has_call")), "call_id", "left")
    parameters = schemas.groupBy("name").agg(F.collect_set(F.struct("parameter", "type", "required")).alias("parameters"))
    values = F.from_json("arguments", "map<string, variant>")
    typed = F.when(F.trim("arguments").startswith("{"), F.transform_values(values, lambda _, v: F.schema_of_variant(v)))
    checked = called.withColumn("types", typed).join(checked_broadcast(parameters, 4096), "name", "left")
    checked = checked.withColumn("problems", problems(F.col("types"), F.col("parameters"))).drop("types", "parameters")
    linked = checked.join(depths(first.select("call_id", "needs")), "call_id").join(answered, ["call_id", "slot"], "full_outer")

    is_call, more = F.col("copies").isNotNull(), F.col("slot") != ""
    status = F.when(more & (is_call | F.col("has_call")), "conflict").when(~is_call, "orphan").when(F.col("result").isNull(), "unanswered").otherwise("linked")
    nothing = F.array().cast("array<string>")
    found = F.concat(
        F.coalesce("problems", nothing), F.when(is_call & F.col("depth").isNull(), F.array(F.lit("cycle"))).otherwise(nothing),
        F.when(status == "conflict", F.array(F.lit("identifier taken"))).otherwise(nothing),
    )
    none = F.lit(0).cast("bigint")
    return linked.select(
        F.coalesce("conv_id", "result.conv_id").alias("conv_id"), "call_id", F.coalesce("turn", "result.turn").alias("turn"),
        "name", status.alias("status"), (2 * F.col("depth")).alias("place"), F.coalesce("copies", none).alias("copies"),
        F.coalesce("result_copies", none).alias("result_copies"), (is_call & (F.size(found) == 0)).alias("valid"),
        F.concat_ws("; ", found).alias("problems"), canonical().alias("json"),
    )


def canonical() -> Column:
    """The call with its result as JSON; typed values keep the keys of objects sorted."""
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct("arguments")))
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), "name", "needs", F.col("result.content").alias("result")))
    return F.concat(F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(","), F.substr(rest, F.lit(2)))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation table implies.

    A user's turn calls ``ask`` (the first of a conversation) or ``follow_up`` (which needs the call two
    turns before); an assistant's turn is the result of the call one turn before.
    """
    identifier = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = conversations.where("conv_id is not null and turn is not null")
    asks = known.where("role = 'user'")
    calls = asks.select(
        "conv_id", identifier(0).alias("call_id"), "turn", F.when(F.col("turn") < 2, "ask").otherwise("follow_up").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text"), F.length("text").alias("chars"))).alias("arguments"),
        F.when(F.col("turn") >= 2, identifier(2)).alias("needs"),
    )
    results = known.where("role = 'assistant'").select("conv_id", identifier(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
