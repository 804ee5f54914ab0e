"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.shared import positions, store

ROWS_PER_BUCKET = 100_000


@F.pandas_udf(T.LongType())
def count_words(texts: pd.Series) -> pd.Series:
    """Number of runs without ASCII white space; bytes.split() parts at exactly these six characters. 0 for null."""
    return pd.Series([0 if t is None else len(t.encode().split()) for t in texts], dtype="int64")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`source, source_size, target` from `source, source_size`.

    Sources in code point order, null last, take the weights in turn and divide `share` of all sizes by them. A target
    stops at `most` times the source's size; what is left over is divided among the others by weight until no target is
    above. The loop carries only two sums to the driver; each round settles at least one source more.
    """
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    kind = sources.schema["source"].dataType.simpleString()
    table = store(
        sources.sparkSession.createDataFrame(ordered, f"source {kind}, source_size bigint, _i bigint").withColumn(
            "_w", F.array(*[F.lit(float(w)) for w in weights])[F.pmod("_i", F.lit(len(weights))).cast("int")]), "sources")
    full = most * F.col("source_size")
    total = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, settled = 0.0, -1
    while True:
        above = F.col("_w") * level >= full
        held, weight, n = table.agg(
            F.coalesce(F.sum(F.when(above, full)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0.0)),
            F.count_if(above)).first()
        if n == settled or not weight:
            break
        level, settled = (total - held) / weight, n
    return table.select("source", "source_size", F.least(full, F.col("_w") * level).cast("double").alias("target"))


def tilts(classes: DataFrame, goals: DataFrame, most: float, tolerance: float = 1e-7, rounds: int = 100) -> DataFrame:
    """`source, source_size, target, tilt`: the dual variable that meets each source's token constraint.

    A document of size n in a source of mean size m is taken at the rate min(most, exp(tilt x n / m)): of all rates with
    the target as their number of words, those with the least relative entropy to taking each document once, under the
    upper limit. The dual is convex with one variable per source. Newton's step on the logarithm of the taken words is
    one join and one combined aggregate over `classes` (source, size, count); a step that leaves the bracket known so
    far is replaced by bisection or doubling. Terms are summed as decimals, so the order of rows has no effect. A target
    at the limit needs no tilt: null means the rate `most`.
    """
    infinity = F.lit(float("inf"))
    state = store(
        goals.join(classes.groupBy(F.col("source").alias("_s")).agg(F.sum("count").alias("_n")), F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "source_size", "target", (F.col("source_size") / F.col("_n")).alias("_mean"), F.lit(0.0).alias("tilt"),
                (-infinity).alias("_lo"), infinity.alias("_hi"),
                (F.col("target") >= most * F.col("source_size")).alias("_done"), (F.col("target") >= most * F.col("source_size")).alias("_full")), "tilts")
    rows = classes.select(F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("count").alias("_count"))
    for _ in range(rounds):
        if state.where(~F.col("_done")).isEmpty():
            break
        x = F.col("_size") / F.col("_mean")
        bounded = F.col("tilt") * x >= math.log(most)
        taken = F.col("_count") * F.col("_size") * F.when(bounded, F.lit(most)).otherwise(F.exp(F.least(F.col("tilt") * x, F.lit(math.log(most)))))
        sums = rows.join(state.where(~F.col("_done")), F.col("_s").eqNullSafe(F.col("source"))).groupBy("_s").agg(
            F.sum(taken.cast("decimal(30,6)")).cast("double").alias("_f"),
            F.sum(F.when(bounded, 0).otherwise(taken * x).cast("decimal(30,6)")).cast("double").alias("_d"))
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        low = F.col("_f") < F.col("target")
        lo, hi = F.when(low, F.col("tilt")).otherwise(F.col("_lo")), F.when(low, F.col("_hi")).otherwise(F.col("tilt"))
        step = F.col("tilt") + F.log(F.col("target") / F.col("_f")) * F.try_divide("_f", "_d")
        halved = F.when(lo == -infinity, 2 * hi - 1).when(hi == infinity, 2 * lo + 1).otherwise((lo + hi) / 2)
        near = F.abs(F.col("_f") - F.col("target")) <= tolerance * F.col("target")
        state = store(joined.select(
            "source", "source_size", "target", "_mean",
            F.when(F.col("_done") | near, F.col("tilt")).when((step > lo) & (step < hi), step).otherwise(halved).alias("tilt"),
            F.when(F.col("_done"), F.col("_lo")).otherwise(lo).alias("_lo"), F.when(F.col("_done"), F.col("_hi")).otherwise(hi).alias("_hi"),
            (F.col("_done") | near).alias("_done"), "_full"), "tilts")
    return state.select("source", "source_size", "target", "_mean", F.when(~F.col("_full"), F.col("tilt")).alias("tilt"))


def _round_down_the_sizes(most: float):
    def step(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ascending=False)
        carry, out = 0.0, []
        for size, count, rate in zip(part["size"], part["count"], part["rate"], strict=True):
            want = count * size * rate + carry
            k = int(min(max(round(want / size), 0), math.floor(most) * count)) if size else count
            carry = want - k * size
            out.append(k)
        return part.assign(copies=out)[["source", "size", "count", "copies"]]
    return step


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_column: str = "doc_id",
        text_column: str = "text", source_column: str = "source") -> DataFrame:
    """`id, text_hash, source, size, source_size, target, copies, taken` of every row; no other column of docs is read.

    Rates of `tilts` are rounded per class (documents of equal source and size): the copies of a class are rounded to
    whole ones from the largest size down, what rounding leaves goes to the next smaller size, so a source misses its
    target by about its smallest document. Inside a class, the documents first in a hash of the id get the copy more. A
    task rounds the distinct sizes of one source, at most as many as its longest text has words. Null and blank texts
    have size 0 and stay once. A null source is a source. Rows that repeat are interchangeable. An empty table gives an
    empty result. Runs agree, as sums are exact and the hash depends on id and text alone.
    """
    rows = store(docs.select(
        F.col(id_column).alias("_id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash"),
        F.col(source_column).alias("source"), count_words(F.col(text_column)).alias("size")), "sizes")
    classes = store(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("count")), "classes")
    sources = store(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), "sources")
    found = tilts(classes, targets(sources, weights, share, most), most).withColumnRenamed("source", "_s")
    reached = F.least(F.col("tilt") * F.col("size") / F.col("_mean"), F.lit(math.log(most)))
    rates = classes.join(found, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "size", "count", F.coalesce(F.exp(reached), F.lit(most)).alias("rate"))
    rounded = rates.groupBy("source").applyInPandas(
        _round_down_the_sizes(most), classes.schema.add("copies", "long")).withColumnsRenamed({"source": "_cs", "size": "_csize"})
    known = store(rounded.join(found, F.col("_cs").eqNullSafe(F.col("_s"))).select("_cs", "_csize", "count", "copies", "source_size", "target"), "copies")
    buckets = max(8, rows.count() // ROWS_PER_BUCKET)
    placed = positions(rows, ["source", "size"], ["_id", "text_hash"], ["_id", "text_hash"], "_place", buckets)
    copies = F.expr("copies div count") + (F.col("_place") < F.expr("copies % count")).cast("long")
    return placed.join(known, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("size") == F.col("_csize"))).select(
        F.col("_id").alias(id_column), "text_hash", F.col("source").alias(source_column), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))
