"""Exact quantiles, running totals and ranks that hold when one group has most of the rows.

None of these sorts a whole group in one task:

* `quantiles` brackets each quantile with a sketch, then sorts only the values inside the bracket;
* `running` deals the ordered rows out by fixed ranges of value and adds the totals of the earlier ranges;
* `hash_rank` ranks by a hash whose first digits are the buckets, so the borders are known beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; the keys of the left side stay. Without keys the right side is one row."""
    if not keys:
        return left.join(F.broadcast(right))
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], bounded: bool | None = None) -> DataFrame:
    """Null-safe inner join of rows with one row per group.

    `bounded=True` states that the groups come from the schema or a declared list, so the small side is broadcast.
    Otherwise the choice is left to Spark, which broadcasts below its threshold and splits skewed keys beyond.
    """
    return _null_safe(big, F.broadcast(small) if bounded else small, keys)


def quantiles(df: DataFrame, by: Sequence[str], value: str | Column, probs: Sequence[float],
              accuracy: int = 20_000, few_groups: bool | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: `by…, n, qs` with qs in the order of probs.

    First pass: a quantile sketch per group, whose rank error is at most n/accuracy, gives a bracket
    around every wanted position. Second pass: rows inside a bracket are counted per value, rows
    between brackets only per gap, both with partial aggregation and without multiplying rows. So at
    most about 5n/accuracy distinct values per quantile are ordered in one task, however large a
    group is, and the result does not depend on where the sketch put the brackets. Groups of at most
    10 x accuracy rows skip the brackets. `few_groups` is the `bounded` of `join_small`.
    """
    by = list(by)
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    slack = 2.5 / accuracy
    points = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-slack, slack)]
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", points, accuracy).alias("_e"))
    tiny = F.col("_n") <= 10 * accuracy
    bounds = []
    for i, p in enumerate(probs):
        low = F.lit(float("-inf")) if p - slack <= 0 else F.when(tiny, float("-inf")).otherwise(F.col("_e")[2 * i])
        high = F.lit(float("inf")) if p + slack >= 1 else F.when(tiny, float("inf")).otherwise(F.col("_e")[2 * i + 1])
        bounds += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}")]
    brackets = sketch.select(*by, *bounds)
    joined = join_small(rows, brackets, by, few_groups)
    v, k = F.col("_x"), range(len(probs))
    inside = F.lit(False)
    for i in k:
        inside = inside | ((v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}")))
    before = [F.when(v > F.col(f"_hi{i}"), F.col(f"_hi{i}")).otherwise(F.lit(float("-inf"))) for i in k]
    gap = F.greatest(*before) if len(before) > 1 else before[0]
    counted = joined.groupBy(*by, F.when(inside, v).otherwise(gap).alias("_k"), (~inside).alias("_gap")).agg(
        F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    placed = counted.withColumns({
        "_end": F.sum("_c").over(group.orderBy("_k", "_gap").rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.sum("_c").over(group)})

    def at(place: Column) -> Column:
        here = (place >= F.col("_end") - F.col("_c")) & (place < F.col("_end")) & ~F.col("_gap")
        return F.max(F.when(here, F.col("_k")))

    spot = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    picked = placed.groupBy(*by).agg(
        F.max("_n").alias("n"), *[c for i in k for c in (
            at(F.floor(spot[i])).alias(f"_a{i}"), at(F.ceil(spot[i])).alias(f"_b{i}"),
            F.max(spot[i] - F.floor(spot[i])).alias(f"_f{i}"))])
    value_of = [
        F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(
            F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")) for i in k]
    out = picked.select(*by, "n", F.array(*value_of).alias("qs"))
    return out if by else out.where(F.col("n") > 0)


PER_OCTAVE, OFFSET = 256, 300_000


def scale_bucket(x: Column, descending: bool = False) -> Column:
    """Whole number that never falls as the number x rises: 256 buckets for each doubling of its size. NULL comes last.

    A rule of the value alone: the same in every branch of a plan and every run, without a look at the data.
    """
    size = F.abs(x)
    place = F.when(size == float("inf"), 2 * OFFSET).otherwise(
        F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size).otherwise(1.0)) * PER_OCTAVE).cast("int") + OFFSET)
    signed = F.when(F.isnan(x), 3 * OFFSET).when(x == 0, 0).when(x > 0, place).otherwise(-place)
    return F.coalesce(signed, F.lit(-4 * OFFSET if descending else 4 * OFFSET))


def running(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False,
            bucket: Column | None = None) -> DataFrame:
    """Running totals `run_<c>` (own row included) per group over an order that is unique in the group.

    Rows are dealt out by (group, bucket of the order), so a hot group covers many tasks; totals of earlier buckets are
    added from one small table. `bucket` must never fall as the order rises; for a numeric order it is `scale_bucket`.
    """
    by = list(by)
    direction = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    placed = df.withColumn("_part", scale_bucket(F.col(order).cast("double"), descending) if bucket is None else bucket)
    part = F.col("_part").desc() if descending else F.col("_part").asc()
    inside = Window.partitionBy("_part", *by).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums})
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
        .select("_part", *by, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums]))
    joined = _null_safe(local, offsets, ["_part", *by])
    return joined.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"_o_{c}") for c in sums}).drop(
        "_part", *[f"_o_{c}" for c in sums])


def average_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None,
                  rank: str = "rank") -> DataFrame:
    """Average rank of every distinct value in its group: `by…, value, n, rank`.

    Rows collapse to (group, value) counts before anything is ordered.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*by, value).agg(n.alias("n"))
    placed = running(counts, by, value, ["n"])
    return placed.select(
        *by, value, "n", (F.col("run_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias(rank))


def hash_rank(df: DataFrame, by: Sequence[str], keys: Sequence[str], seed: str, name: str = "rank",
              digits: int | None = None) -> DataFrame:
    """1-based position of every row in its group by md5(seed || keys), whatever the input order.

    The first hex digits of the hash are evenly filled buckets; only their counts are accumulated
    per group, the positions inside a bucket are local. There are at least 16 buckets for each shuffle
    partition of the session; their number has no effect on the positions.
    """
    by = list(by)
    if digits is None:
        digits = math.ceil(math.log(16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16))
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    hashed = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, digits))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
    local = hashed.withColumn("_local", F.row_number().over(inside))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    return _null_safe(local, offsets, [*by, "_b"]).withColumn(
        name, F.col("_o") + F.col("_local")).drop("_h", "_b", "_local", "_o")
