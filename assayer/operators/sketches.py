"""Profiles that add up: stored per part of a table (a day, a month), merged for any span without reading its rows again.

Counts, extremes and sums are exact. Quantiles come from a KLL sketch, numbers of different values from a theta sketch; both are
merged by the engine, and the stated bounds hold for the merged sketch. `profile_errors` measures both against the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import join_small

K, LG = 800, 14  # a part holds at most about 16 KB of quantiles and 128 KB of hashes per column
PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


def rank_bound(k: int = K) -> float:
    """Share of rows by which the rank of a KLL quantile is off at most, with 99 % confidence (published fit of the sketch)."""
    return 2.296 / k ** 0.9723


def distinct_bound(lg: int = LG) -> float:
    """Three relative standard errors of a theta sketch; up to 2^lg different values it is exact."""
    return 3 / (2 ** lg - 1) ** 0.5


def _number(df: DataFrame, column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def profile_parts(df: DataFrame, by: Sequence[str], numbers: Sequence[str], texts: Sequence[str] = (), k: int = K, lg: int = LG) -> DataFrame:
    """`by…, feature, rows, valid, minimum, maximum, total, squares, summed, quantiles, values`, one row per part and column.

    One scan and one shuffle of partial sketches, whatever the number of columns. Missing is NULL or NaN. Sums are decimals of
    nine digits after the point, so that merging has no order; `summed` counts the values that fit. Texts have no quantiles.
    """
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate([*numbers, *texts]):
        numeric = i < len(numbers)
        x = _number(df, c) if numeric else F.col(c).cast("string")
        one, two = (x.try_cast("decimal(38,9)"), (x * x).try_cast("decimal(38,9)")) if numeric else (None, None)
        aggs += [F.count(x).alias(f"_{i}n"), F.theta_sketch_agg(x, F.lit(lg)).alias(f"_{i}v")]
        cells = [F.lit(c).alias("feature"), F.col("_rows").alias("rows"), F.col(f"_{i}n").alias("valid")]
        if numeric:
            aggs += [F.min(x).alias(f"_{i}lo"), F.max(x).alias(f"_{i}hi"), F.try_sum(one).alias(f"_{i}s"), F.try_sum(two).alias(f"_{i}q"),
                     F.count(two).alias(f"_{i}f"), F.kll_sketch_agg_double(x, F.lit(k)).alias(f"_{i}k")]
            kept = [F.col(f"_{i}{s}") for s in ("lo", "hi", "s", "q", "f", "k")]
        else:
            kept = [F.lit(None).cast(t) for t in ("double", "double", "decimal(38,9)", "decimal(38,9)", "long", "binary")]
        names = ("minimum", "maximum", "total", "squares", "summed", "quantiles")
        rows.append(F.struct(*cells, *[v.alias(n) for v, n in zip(kept, names, strict=True)], F.col(f"_{i}v").alias("values")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def merge_profiles(parts: DataFrame, by: Sequence[str] = (), probs: Sequence[float] = PROBS, k: int = K, lg: int = LG) -> DataFrame:
    """`by…, feature, rows, missing, minimum, maximum, mean, std, qs, distinct_values` of all parts with equal `by`.

    Reads parts only. `std` is NULL below two values; mean and `std` are NULL where a value is too large for the sums.
    Columns without values and texts have no quantiles.
    """
    merged = parts.groupBy(*by, "feature").agg(
        F.sum("rows").alias("rows"), F.sum("valid").alias("_n"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.try_sum("total").alias("_s"), F.try_sum("squares").alias("_q"), F.sum("summed").alias("_f"),
        F.kll_merge_agg_double(F.when(F.col("valid") > 0, F.col("quantiles")), F.lit(k)).alias("_k"), F.theta_union_agg("values", F.lit(lg)).alias("_v"))
    n, s = F.col("_n"), F.col("_s").cast("double")
    fits = (F.col("_f") == n) & (n > 0)
    spread = F.greatest(F.lit(0.0), F.col("_q").cast("double") - s * s / n)
    return merged.select(
        *by, "feature", "rows", (F.col("rows") - n).alias("missing"), "minimum", "maximum", F.when(fits, s / n).alias("mean"),
        F.when(fits & (n > 1), F.sqrt(spread / (n - 1))).alias("std"),
        F.when((n > 0) & F.col("minimum").isNotNull(), F.kll_sketch_get_quantile_double("_k", F.array(*[F.lit(float(p)) for p in probs]))).alias("qs"),
        F.theta_sketch_estimate("_v").alias("distinct_values"))


def profile_errors(df: DataFrame, merged: DataFrame, by: Sequence[str], numbers: Sequence[str], probs: Sequence[float] = PROBS) -> DataFrame:
    """`by…, feature, rank_error, distinct_exact, distinct_error` of merged profiles, from one look at all rows.

    The rank error is how far the wanted share lies outside the shares of rows below and up to the quantile, the largest of
    all probs. Rows collapse to their different values before they meet the profiles. A quantile sketch flips coins, so store
    `merged` first where its own quantiles are to be shown beside their errors.
    """
    values = df.select(*by, *[_number(df, c).alias(c) for c in numbers]).unpivot(list(by), list(numbers), "feature", "_x").where("_x IS NOT NULL")
    counted = values.groupBy(*by, "feature", "_x").agg(F.count(F.lit(1)).alias("_c"))
    placed = join_small(counted, merged.select(*by, "feature", "qs", "distinct_values"), [*by, "feature"])
    aggs = []
    for i in range(len(probs)):
        q = F.col("qs")[i]
        aggs += [F.sum(F.when(F.col("_x") < q, F.col("_c")).otherwise(0)).alias(f"_b{i}"), F.sum(F.when(F.col("_x") <= q, F.col("_c")).otherwise(0)).alias(f"_u{i}")]
    sums = placed.groupBy(*by, "feature").agg(
        F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("distinct_exact"), F.max("distinct_values").alias("_d"), *aggs)
    off = [F.greatest(F.lit(0.0), F.col(f"_b{i}") / F.col("_n") - p, p - F.col(f"_u{i}") / F.col("_n")) for i, p in enumerate(probs)]
    return sums.select(*by, "feature", reduce(F.greatest, off).alias("rank_error"), "distinct_exact",
                       (F.abs(F.col("_d") - F.col("distinct_exact")) / F.col("distinct_exact")).alias("distinct_error"))
