"""Operator 8: chat messages with their tool calls linked, ordered and checked. Built-in functions only."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import checkpointed, discard, pick, written

CALLS = "struct<content string, tool_calls array<struct<id string, name string, arguments string>>>"
RESULT = "struct<tool_call_id string, content string>"
#: Kinds of a schema's parameters, with the variant types that pass.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
#: A reference to another call's result inside arguments.
REFERENCE = r'"\$result:([^"\\]+)"'


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null if it is none."""
    return F.to_json(F.try_parse_json(text))


def tool_schemas(spark, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(name, parameters) of {tool: {parameter: (kind, required)}}."""
    rows = [F.struct(F.lit(tool).alias("name"), F.array(*(F.struct(F.lit(p).alias("parameter"), F.lit(kind).alias("kind"), F.lit(need).alias("required")) for p, (kind, need) in sorted(told.items()))).alias("parameters")) for tool, told in sorted(schemas.items())]
    return spark.range(1).select(F.inline(F.array(*rows)))


def checked(calls: DataFrame) -> DataFrame:
    """calls with `faults`: what is wrong with each one's arguments under the parameters of its tool, sorted; empty if nothing."""
    held = F.from_json("arguments", "map<string,variant>")
    calls = calls.withColumn("_types", F.when(F.col("arguments").startswith("{"), F.transform_values(held, lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))))
    types = F.col("_types")
    missing = F.transform(F.filter("parameters", lambda p: p["required"] & ~F.map_contains_key(types, p["parameter"])), lambda p: F.concat(F.lit("missing "), p["parameter"]))

    def fits(p: Column) -> Column:
        own = types[p["parameter"]]
        out = F.lit(False)
        for kind, pattern in KINDS.items():
            out = F.when(p["kind"] == kind, own.rlike(f"^({pattern})$")).otherwise(out)
        return out

    wrong = F.transform(F.filter("parameters", lambda p: F.map_contains_key(types, p["parameter"]) & ~fits(p)), lambda p: F.concat(F.lit("not "), p["kind"], F.lit(": "), p["parameter"]))
    extra = F.transform(F.array_except(F.map_keys(types), F.transform("parameters", lambda p: p["parameter"])), lambda k: F.concat(F.lit("unknown "), k))
    faults = F.when(F.col("parameters").isNull(), F.array(F.lit("unknown tool"))).when(types.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.concat(missing, wrong, extra)))
    return calls.withColumn("faults", faults).drop("_types", "parameters")


def levels(calls: DataFrame) -> DataFrame:
    """(_c, id, level) of calls (_c, id, arguments), _c their conversation: 0 for calls that refer to no other call of it, else one more than the highest they refer to; null in a cycle or behind one.

    Calls with one reference are chains: pointers are doubled until each points to its
    chain's head, in as many rounds as the logarithm of their number; what still moves
    then is in a cycle. Calls with more references settle round by round, as soon as
    all heads they refer to have; that ends when a round settles none. All by joins on
    (_c, id), so a long conversation is no task's own.
    """
    ids = written(calls.select("_c", "id").distinct())
    told = calls.select("_c", "id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(REFERENCE), F.lit(1)))).alias("to")).distinct()
    needs = written(told.join(ids.select("_c", F.col("id").alias("to")), ["_c", "to"], "left_semi"))
    if needs.isEmpty():
        return ids.withColumn("level", F.lit(0))
    number = written(needs.groupBy("_c", "id").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to")))
    jumps = written(number.where("n = 1").select("_c", "id", "to", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moves")))
    for _ in range(max(1, jumps.count()).bit_length() + 1):
        further = jumps.select("_c", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        after = jumps.join(further, ["_c", "to"], "left")
        after = written(after.select("_c", "id", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_to").isNotNull().alias("moves")))
        discard(jumps)
        jumps = after
        if jumps.where("moves").isEmpty():
            break
    heads = jumps.select("_c", F.col("id").alias("to"), F.when(~F.col("moves"), F.col("to")).alias("head"), "steps", F.lit(True).alias("_chained"))
    waiting = needs.join(number.where("n > 1").select("_c", "id"), ["_c", "id"], "left_semi").join(heads, ["_c", "to"], "left")
    waiting = written(waiting.select("_c", "id", F.when(F.col("_chained"), F.col("head")).otherwise(F.col("to")).alias("to"), F.coalesce("steps", F.lit(0)).alias("steps")))
    settled = written(ids.join(number, ["_c", "id"], "left_anti").select("_c", "id", F.lit(0).cast("long").alias("level")))
    while True:
        found = waiting.join(settled.select("_c", F.col("id").alias("to"), "level"), ["_c", "to"], "left")
        ready = found.groupBy("_c", "id").agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        ready = written(ready.select("_c", "id", (F.col("level") + 1).alias("level")))
        if ready.isEmpty():
            break
        more, rest = written(settled.unionByName(ready)), written(waiting.join(ready, ["_c", "id"], "left_anti"))
        for done in (settled, waiting, ready):
            discard(done)
        settled, waiting = more, rest
    chained = heads.where("head is not null").join(settled.select("_c", F.col("id").alias("head"), "level"), ["_c", "head"]).select("_c", F.col("to").alias("id"), (F.col("level") + F.col("steps")).alias("level"))
    return ids.join(settled.unionByName(chained), ["_c", "id"], "left").withColumn("level", F.col("level").cast("int"))


def format_chat(conversations: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_calls, n_linked, n_valid, problems, message) of each row.

    A text of an assistant that is JSON with `tool_calls` (id, name, arguments as an
    object or its JSON) makes calls; a text of role `tool` that is JSON with
    `tool_call_id` is a result. Calls and results are hash-joined by (conv_id, id), the
    first call and the first result by turn; both keys are summed up before, so a
    frequent id is one row. Calls of a message come in topological order of the results
    they refer to (`"$result:<id>"` in arguments), then as written. `message` is
    canonical JSON: sorted keys, no spaces, calls with their result's turn.

    Each row stays a row, however long its conversation. Any other text, also null
    (empty) or broken JSON, is plain content. Calls without an id can't be linked; a null conv_id
    or turn is one conversation or turn of its own; rows alike in conv_id, turn, role
    and text give equal rows; an empty table gives none; other columns are left out.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.col("text").rlike(r"^\s*\{")
    asks = said & (F.col("role") == "assistant") & F.col("text").contains('"tool_calls"')
    answers = said & (F.col("role") == "tool")
    rows = rows.withColumn("_calls", F.when(asks, F.from_json("text", CALLS))).withColumn("_result", F.when(answers, F.from_json("text", RESULT)))
    made = F.col("_calls.tool_calls")
    key = F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256)  # null conv_ids and turns are left out there, so they differ from empty ones
    own = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))  # a null conversation differs from an empty one
    calls = rows.where(F.size(made) > 0).select("conv_id", "turn", key.alias("_row"), F.posexplode(made).alias("pos", "call")).select("conv_id", "turn", "_row", "pos", F.coalesce("call.id", F.lit("")).alias("id"), F.coalesce("call.name", F.lit("")).alias("name"), canonical(F.col("call.arguments")).alias("arguments")).distinct()
    calls = checkpointed(calls)
    results = rows.where(F.col("_result.tool_call_id").isNotNull()).groupBy("conv_id", F.col("_result.tool_call_id").alias("id")).agg(F.min("turn").alias("result_turn"), F.count(F.lit(1)).alias("n_results"))
    results = checkpointed(results)
    first = calls.where("id <> ''").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "pos")).alias("_first"))
    known = checked(calls.join(schemas, "name", "left"))
    one = known.join(first.withColumnsRenamed({"conv_id": "_c", "id": "_i"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i")), "left").drop("_c", "_i")
    repeated = F.col("_first").isNotNull() & ~F.struct("turn", "pos").eqNullSafe(F.col("_first"))
    linked = one.withColumn("_again", repeated).join(results.withColumnsRenamed({"conv_id": "_c", "id": "_i"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i")) & ~repeated, "left").drop("_c", "_i")
    depth = levels(calls.where("id <> ''").select(own.alias("_c"), "id", "arguments"))
    linked = linked.withColumn("_c", own).join(depth, ["_c", "id"], "left").drop("_c")
    more = F.array_compact(F.array(F.when(F.col("id") == "", F.lit("no id")), F.when(F.col("_again"), F.lit("repeated id")), F.when((F.col("id") != "") & F.col("level").isNull(), F.lit("cycle")), F.when(F.col("result_turn").isNull(), F.lit("no result")), F.when(F.col("result_turn") <= F.col("turn"), F.lit("result before call")), F.when(F.col("n_results") > 1, F.lit("more results"))))
    call = F.struct(F.coalesce("level", F.lit((1 << 31) - 1)).alias("level"), "pos", F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(","), F.substring(F.to_json(F.struct("id", "name", "result_turn")), 2, 1 << 30)).alias("json"), F.transform(F.concat("faults", more), lambda f: F.concat_ws(" ", "id", F.lit("-"), f)).alias("problems"), (F.size("faults") == 0).alias("valid"), F.col("result_turn").isNotNull().alias("linked"))
    by_row = linked.groupBy("_row").agg(F.array_sort(F.collect_list(call)).alias("_made"))  # the calls of one text
    asked = calls.where("id <> ''").select("conv_id", "id").distinct()
    stray = results.join(asked.withColumnsRenamed({"conv_id": "_c", "id": "_i"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i")), "left_anti").select(F.col("conv_id").alias("_c"), F.col("id").alias("_i"), F.lit(True).alias("_stray"))
    plain = rows.where(F.coalesce(F.size(made), F.lit(0)) <= 0)
    tools = plain.where("_result.tool_call_id is not null").join(stray, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_result.tool_call_id") == F.col("_i")), "left").drop("_c", "_i")
    talk = plain.where("_result.tool_call_id is null")
    asking = rows.where(F.size(made) > 0).withColumn("_row", key).join(by_row, "_row")
    none, nil = F.lit(0), F.array().cast("array<string>")

    def out(df: DataFrame, n: Column, linked: Column, valid: Column, problems: Column, message: Column) -> DataFrame:
        return df.select("conv_id", "turn", "role", n.alias("n_calls"), linked.alias("n_linked"), valid.alias("n_valid"), F.array_join(problems, "; ").alias("problems"), message.alias("message"))

    parts = F.col("_made")
    number = lambda field: F.size(F.filter(parts, lambda c: c[field]))
    head = F.to_json(F.struct(F.coalesce("_calls.content", F.lit("")).alias("content"), "role"))
    message = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"tool_calls":['), F.array_join(F.transform(parts, lambda c: c["json"]), ","), F.lit("]}"))
    answer = F.to_json(F.struct(F.coalesce("_result.content", F.lit("")).alias("content"), "role", F.col("_result.tool_call_id").alias("tool_call_id")))
    strays = F.when(F.col("_stray"), F.array(F.concat(F.col("_result.tool_call_id"), F.lit(" - no call")))).otherwise(nil)
    return (
        out(talk, none, none, none, nil, F.to_json(F.struct(F.col("text").alias("content"), "role")))
        .unionByName(out(tools, none, none, none, strays, answer))
        .unionByName(out(asking, F.size(parts), number("linked"), number("valid"), F.flatten(F.transform(parts, lambda c: c["problems"])), message))
    )
