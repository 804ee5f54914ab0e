"""What texts that hold JSON are made of: kinds and values of every path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("object", "array", "string", "number", "boolean", "null")


def _entered(rows: DataFrame) -> DataFrame:
    """Rows `path, kind, value, v` with kind and value of a variant v that is not null, and its members `_m` or elements `_e`."""
    v = F.col("v")
    inside = rows.select("*", F.try_variant_get(v, "$", "map<string,variant>").alias("_m"), F.try_variant_get(v, "$", "array<variant>").alias("_e"))
    # only a scalar is asked for its schema: that of an object names all that it holds
    shape = inside.withColumn("_s", F.when(v.isNotNull() & F.col("_m").isNull() & F.col("_e").isNull(), F.schema_of_variant(v)))
    scalar = F.when(F.col("_s") == "STRING", "string").when(F.col("_s") == "BOOLEAN", "boolean").when(F.col("_s") == "VOID", "null").otherwise("number")
    return shape.select("path", F.when(v.isNull(), F.col("kind")).when(F.col("_m").isNotNull(), "object").when(F.col("_e").isNotNull(), "array").otherwise(scalar).alias("kind"),
                        F.when(F.col("_s") != "VOID", v.cast("string")).otherwise(F.col("value")).alias("value"), "_m", "_e")


def json_paths(df: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """`path, kind, value` of everything in the JSON of a text column, `depth` levels below the root `$`.

    Members are `.name`, all elements of an array `[]`; value is the text of a string, number or boolean, else null. A
    text that is no JSON is one row of kind `invalid`; a null text has no row. Deeper levels are not entered.

    A text is parsed once: each step leaves what was found as a row, and adds what is inside it.
    """
    none = F.lit(None).cast("string")
    rows = df.where(F.col(column).isNotNull()).select(F.lit("$").alias("path"), F.lit("invalid").alias("kind"), none.alias("value"), F.try_parse_json(column).alias("v"))
    for _ in range(depth):
        below = lambda name, v: F.struct(F.concat("path", name).alias("path"), none.alias("kind"), none.alias("value"), v.alias("v"))
        own = F.array(F.struct("path", "kind", "value", F.lit(None).cast("variant").alias("v")))
        members = F.transform(F.map_entries("_m"), lambda e: below(F.concat(F.lit("."), e["key"]), e["value"]))
        elements = F.transform("_e", lambda e: below(F.lit("[]"), e))
        rows = _entered(rows).select(F.inline(F.when(F.col("_m").isNotNull(), F.concat(own, members)).when(F.col("_e").isNotNull(), F.concat(own, elements)).otherwise(own)))
    return _entered(rows).select("path", "kind", "value")


def json_profile(df: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """`path, kind, rows, distinct_values, shortest, longest` per path and kind; values are told apart as text.

    Equal values of a path are one row before they are shuffled, so a frequent value is no hot group.
    """
    values = json_paths(df, column, depth).groupBy("path", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("path", "kind").agg(
        F.sum("n").alias("rows"), F.count("value").alias("distinct_values"), F.min(F.length("value")).cast("long").alias("shortest"), F.max(F.length("value")).cast("long").alias("longest"))


def json_contract(df: DataFrame, column: str, expected: dict[str, tuple[str, ...]], depth: int = 4) -> DataFrame:
    """`path, status, kinds, rows` of declared and found paths: `match`, `mismatch` (a kind that is not declared), `missing`, `undeclared`.

    `expected` maps a path to its kinds. rows counts what was found at the path.
    """
    found = json_profile(df, column, depth).groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.sum("rows").alias("rows"))
    rows = [(p, list(k)) for p, k in expected.items()]
    declared = df.sparkSession.createDataFrame(rows, "path string, wanted array<string>")
    joined = found.join(F.broadcast(declared), "path", "full_outer")  # one row per declared path
    status = (F.when(F.col("rows").isNull(), "missing").when(F.col("wanted").isNull(), "undeclared")
              .when(F.size(F.array_except(F.split("kinds", ","), "wanted")) > 0, "mismatch").otherwise("match"))
    return joined.select("path", status.alias("status"), F.coalesce("kinds", F.lit("")).alias("kinds"), F.coalesce("rows", F.lit(0)).alias("rows"))
