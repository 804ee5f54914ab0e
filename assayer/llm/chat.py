"""Tool calls of chats: linked to their results by identifier, ordered topologically, checked against schemas, as canonical JSON.

DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.shared import store

# Kinds that a schema can ask for, and the start of the variant types that satisfy each.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"],
         "array": ["ARRAY"], "null": ["VOID"]}
# What became of an identifier.
STATES = ("linked", "early", "unanswered", "orphan", "no_id")
KEY = ("conv_id", "call_id")


def schema_table(spark: SparkSession, tools: Mapping[str, Mapping[str, tuple[str, bool]]]) -> DataFrame:
    """`tool, parameters` from tool -> parameter -> (kind, required)."""
    rows = [(tool, [(p, kind, needed) for p, (kind, needed) in sorted(parameters.items())]) for tool, parameters in tools.items()]
    return spark.createDataFrame(rows, "tool string, parameters array<struct<name: string, kind: string, required: boolean>>")


def problems(arguments: Column, values: Column, parameters: Column) -> Column:
    """Sorted texts: malformed, not_an_object, unknown_tool, missing:<name>, type:<name>, unexpected:<name>."""
    def wrong_kind(p: Column) -> Column:
        found = F.schema_of_variant(values[p["name"]])
        allowed = F.lit(False)
        for kind, starts in KINDS.items():
            for start in starts:
                allowed = allowed | ((p["kind"] == kind) & F.startswith(found, F.lit(start)))
        return F.map_contains_key(values, p["name"]) & ~allowed
    names = F.transform(parameters, lambda p: p["name"])
    missing = F.transform(F.filter(parameters, lambda p: p["required"] & ~F.map_contains_key(values, p["name"])), lambda p: F.concat(F.lit("missing:"), p["name"]))
    typed = F.transform(F.filter(parameters, wrong_kind), lambda p: F.concat(F.lit("type:"), p["name"]))
    extra = F.transform(F.array_except(F.map_keys(values), names), lambda k: F.concat(F.lit("unexpected:"), k))
    return (
        F.when(arguments.isNull(), F.array(F.lit("malformed"))).when(values.isNull(), F.array(F.lit("not_an_object")))
        .when(parameters.isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.array_sort(F.concat(missing, typed, extra))))


def levels(calls: DataFrame) -> DataFrame:
    """`conv_id, call_id, level` of calls `conv_id, call_id, depends_on`: 0 without known calls it depends on, else one
    more than the highest of theirs; null in or behind a cycle. Order by level, then by anything: every call comes after
    those that it depends on.

    Calls with one dependency are chains: pointers along them are doubled, so a chain takes rounds as the logarithm of
    its length. Calls with several wait until the ends of their chains are known, one round for each such call on the
    longest path. All tables are keyed by conversation and call, so a very long conversation is spread like any other.
    """
    key = list(KEY)
    known_ids = calls.select(F.col("conv_id"), F.col("call_id").alias("to"))
    edges = store(
        calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("to")).join(known_ids, ["conv_id", "to"], "left_semi"), "edges")
    counted = store(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to")), "counted")
    chain = counted.where("n = 1").select(*key, "to", F.lit(1).cast("long").alias("steps"))
    longest = counted.where("n = 1").groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 1)) if longest else 0):
        further = chain.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("to").alias("next"), F.col("steps").alias("more"))
        chain = store(chain.join(further, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("k")), "left").select(
            *key, F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chains")
    ends = chain.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("to").alias("end"), "steps")
    waiting = store(
        edges.join(counted.where("n > 1").select(*key), key, "left_semi")
        .join(ends, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("k")), "left")
        .select(*key, F.coalesce("end", "to").alias("to"), (1 + F.coalesce("steps", F.lit(0))).alias("steps")), "waiting")
    found = store(calls.join(counted.select(*key), key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")), "levels")
    while True:
        last = found.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "level")
        more = (
            waiting.join(found.select(*key), key, "left_anti").join(last, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("k")), "left")
            .groupBy(*key).agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")))
        more = store(more.where("open = 0").drop("open"), "levels")
        if more.isEmpty():
            break
        found = store(found.union(more), "levels")
    last = found.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "level")
    behind = chain.join(last, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("k"))).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return calls.select(*key).join(found.union(behind), key, "left")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier: `conv_id, call_id, turn, tool, level, state, n_calls, n_results, problems, message`.

    calls: `conv_id, call_id, turn, tool, arguments, depends_on`, arguments being JSON text; results: `conv_id, call_id,
    turn, content`; schemas: `tool, parameters`. Of several calls or results with an identifier the one with the
    smallest turn counts, then the smallest text; the others are only counted. state: linked; early (the result comes
    first); unanswered; orphan (a result without a call; level, tool and problems are null); no_id (conv_id or call_id
    is null: nothing can be linked, one row per conversation and identifier, as far as they are known).

    message is canonical JSON: names in code point order at all levels, no spaces, numbers in shortest form, null where
    there is nothing. Calls and results are combined per identifier before they meet in a hash join on it, so rows that
    repeat cannot heat a key. Null texts are null, empty tables give empty results, other columns are ignored.
    """
    some = lambda rows, *columns: rows.select("conv_id", F.col("call_id").cast("string").alias("call_id"), F.struct(*columns).alias("row"))
    asked = some(calls, "turn", "tool", "arguments", "depends_on").groupBy(*KEY).agg(F.min("row").alias("call"), F.count(F.lit(1)).alias("n_calls"))
    told = some(results, "turn", "content").groupBy(*KEY).agg(F.min("row").alias("result"), F.count(F.lit(1)).alias("n_results"))
    told = told.withColumnsRenamed({"conv_id": "_conv", "call_id": "_call"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("call_id").eqNullSafe(F.col("_call"))
    linked = store(
        asked.join(told.hint("shuffle_hash"), same, "full_outer").select(
            F.coalesce("conv_id", "_conv").alias("conv_id"), F.coalesce("call_id", "_call").alias("call_id"), "call", "result",
            F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results")), "linked")
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    order = levels(linked.where(keyed & F.col("call").isNotNull()).select(*KEY, F.col("call.depends_on").alias("depends_on")))
    order = order.withColumnsRenamed({"conv_id": "_conv", "call_id": "_call"})
    parsed = F.try_parse_json("call.arguments")
    rows = (
        linked.join(order, same, "left").withColumn("arguments", parsed).withColumn("values", F.expr("try_cast(arguments AS map<string, variant>)"))
        .join(schemas.select(F.col("tool").alias("_tool"), "parameters"), F.col("call.tool") == F.col("_tool"), "left"))
    early = F.coalesce(F.col("result.turn") < F.col("call.turn"), F.lit(False))
    state = (
        F.when(~keyed, "no_id").when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered").when(early, "early").otherwise("linked"))
    message = F.to_json(F.struct(
        F.col("arguments"), F.col("call_id").alias("id"), F.col("level"), F.col("result.content").alias("result"), F.col("call.tool").alias("tool")),
        {"ignoreNullFields": "false"})
    return rows.select(
        *KEY, F.coalesce("call.turn", "result.turn").alias("turn"), F.col("call.tool").alias("tool"), "level", state.alias("state"), "n_calls", "n_results",
        F.when(F.col("call").isNotNull(), problems(F.col("arguments"), F.col("values"), F.col("parameters"))).alias("problems"), message.alias("message"))


# Tools of the calls that `calls_of` makes of a chat: parameter -> (kind, required).
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "answer": {"chars": ("integer", True), "text": ("string", True)},
    "outline": {"lines": ("integer", True), "text": ("string", True), "style": ("string", False)},
}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a chat `conv_id, turn, role, text` stands for.

    A user's turn is a call named after conversation and turn; it depends on the call two turns before, and one at turn
    8, 16, 32 and so on also on that at half its turn. A text of several lines asks for an outline, another for an
    answer; the number of characters is given as a text where there are non-ASCII ones, which the schema does not allow,
    and an outline of more than three lines has a depth, which it does not know. An assistant's turn is the result of
    the call one turn before. Other turns are neither.
    """
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    n_lines = F.size(F.split("text", "\n"))
    text, chars = F.to_json(F.struct("text"), {"ignoreNullFields": "false"}), F.char_length("text")
    inner = F.substr(text, F.lit(2), F.char_length(text) - 2)
    number = F.when(F.octet_length("text") == chars, chars.cast("string")).otherwise(F.concat(F.lit('"'), chars.cast("string"), F.lit('"')))
    answer = F.concat(F.lit('{"chars":'), F.coalesce(number, F.lit("null")), F.lit(","), inner, F.lit("}"))
    depth = F.when(n_lines > 3, F.lit('"depth":1,')).otherwise("")
    outline = F.concat(F.lit("{"), depth, F.lit('"lines":'), n_lines.cast("string"), F.lit(","), inner, F.lit("}"))
    several = F.coalesce(n_lines > 1, F.lit(False))
    t = F.col("turn")
    halved = F.when((t >= 8) & (F.bit_count(t) == 1), name(F.expr("turn div 2")))
    known = F.col("conv_id").isNotNull() & t.isNotNull()
    calls = turns.where(F.col("role") == "user").select(
        "conv_id", F.when(known, name(t)).alias("call_id"), t.alias("turn"), F.when(several, "outline").otherwise("answer").alias("tool"),
        F.when(several, outline).otherwise(answer).alias("arguments"),
        F.array_compact(F.array(F.when(known, name(t - 2)), F.when(known, halved))).alias("depends_on"))
    results = turns.where(F.col("role") == "assistant").select("conv_id", F.when(known, name(t - 1)).alias("call_id"), t.alias("turn"), F.col("text").alias("content"))
    return calls, results


def chat_calls(turns: DataFrame, tools: Mapping[str, Mapping[str, tuple[str, bool]]] = TOOLS, columns: Sequence[str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """`link` of the calls and results of a chat table; other columns of it are ignored."""
    chat = turns.select(*[F.col(c).alias(n) for c, n in zip(columns, ("conv_id", "turn", "role", "text"), strict=True)])
    calls, results = calls_of(chat)
    return link(calls, results, schema_table(turns.sparkSession, tools))
