"""Associations between features and a binary, multiclass or continuous target."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import average_ranks, clean, guarded_ratio, is_blank, long_form, quantiles, to_text, wide_rows
from assayer.operators.association import contingency_measures, eta_squared, masked_corr, spearman_pairs

Z95 = 1.959963984540054
EFFECT, SPREAD, ASSOCIATION = 0.5, 0.10, 0.10


def class_statistics(df: DataFrame, features: Sequence[str], target: str, classes: Sequence[str]) -> DataFrame:
    """Count, moments, quartiles and range of each feature in each declared class; classes without rows stay."""
    long = long_form(df.select(to_text(target).alias("class"), *features), ["class"], features)
    long = long.where(F.col("class").isin(*classes) & F.col("value").isNotNull())
    key = ["feature", "class"]
    stats = long.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                   F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    q = quantiles(long, key, "value", [0.25, 0.5, 0.75], few_groups=True).select(
        *key, F.col("qs")[1].alias("median"), (F.col("qs")[2] - F.col("qs")[0]).alias("iqr"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(f, c) for f in features for c in classes], "feature string, class string")
    out = F.broadcast(grid).join(stats, key, "left").join(q, key, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def binary_numeric(df: DataFrame, features: Sequence[str], target: str, positive: str, bins: int = 10) -> DataFrame:
    """Mean and median differences, point-biserial r, Cohen's d, eta squared, quantile rate spread, review flag."""
    y = (to_text(target) == positive).cast("double")
    base = df.where(F.col(target).isNotNull()).select(y.alias("_y"), *features)
    long = long_form(base, ["_y"], features).where(F.col("value").isNotNull())
    side = lambda s: F.when(F.col("_y") == s, F.col("value"))
    a, b = side(1.0), side(0.0)
    na, nb = F.count(a), F.count(b)
    pooled = F.when((na >= 2) & (nb >= 2), ((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2))
    stats = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("valid_rows"), na.alias("positive_rows"), nb.alias("negative_rows"),
        (F.avg(a) - F.avg(b)).alias("mean_difference"), masked_corr(F.col("value"), F.col("_y")).alias("point_biserial"),
        F.when(pooled > 0, (F.avg(a) - F.avg(b)) / F.sqrt(pooled)).alias("cohens_d"))
    med = quantiles(long, ["feature", "_y"], "value", [0.5], few_groups=True).groupBy("feature").agg(
        (F.max(F.when(F.col("_y") == 1, F.col("qs")[0])) - F.max(F.when(F.col("_y") == 0, F.col("qs")[0]))).alias("median_difference"))
    rates = quantile_bins(df, features, target, positive, bins).groupBy("feature").agg(
        (F.max("rate") - F.min("rate")).alias("rate_spread"))
    return stats.join(F.broadcast(med), "feature", "left").join(F.broadcast(rates), "feature", "left").withColumns({
        "eta_squared": F.col("point_biserial") * F.col("point_biserial"),
        "review": F.coalesce(F.abs("cohens_d") >= EFFECT, F.lit(False)) | F.coalesce(F.col("rate_spread") >= SPREAD, F.lit(False))})


def overall_rate(df: DataFrame, target: str, positive: str) -> DataFrame:
    """One row `overall_rate`: positives among all rows with a target, whatever the features hold."""
    return df.where(F.col(target).isNotNull()).agg(F.avg((to_text(target) == positive).cast("double")).alias("overall_rate"))


BIN_SCHEMA = ("feature string, bin int, lower double, upper double, row_count long, positive_count long, rate double, overall_rate double, "
              "rate_difference double, lift double, low_support boolean")


def quantile_bins(df: DataFrame, features: Sequence[str], target: str, positive: str, bins: int = 10,
                  minimum_rows: int = 50) -> DataFrame:
    """Positive rate in quantile bins (right-closed, lowest included, repeated edges merged), lift and support.

    Bins without rows stay with count 0 and no rate; the overall rate is that of all rows with a target. A column with
    fewer distinct values than `bins` gets as many bins as values, a constant one none. That number, one per column,
    is the only thing read on the driver; a theta sketch, exact up to 4 x bins values and far above bins beyond, tells it
    in one aggregate that does not multiply rows by columns.
    """
    y = (to_text(target) == positive).cast("int")
    base = df.where(F.col(target).isNotNull()).select(y.alias("_y"), *[clean(f).alias(f) for f in features])
    lg = max(12, math.ceil(math.log2(4 * bins)))
    distinct = base.agg(*[F.theta_sketch_estimate(F.theta_sketch_agg(f, F.lit(lg))).alias(f) for f in features]).first()
    parts = []
    by_bins: dict[int, list[str]] = {}
    for f in features:
        by_bins.setdefault(min(bins, distinct[f]), []).append(f)
    for k, names in by_bins.items():
        if k <= 1:
            continue
        long = base.unpivot(["_y"], names, "feature", "value").where(F.col("value").isNotNull())
        edges = quantiles(long, ["feature"], "value", [i / k for i in range(k + 1)], few_groups=True).select(
            "feature", F.array_distinct("qs").alias("_e"))
        place = F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: e < F.col("value"))))
        counts = long.join(F.broadcast(edges), "feature").groupBy("feature", place.alias("bin")).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("_y").alias("positive_count"))
        grid = edges.select("feature", "_e", F.explode(F.sequence(F.lit(1), F.size("_e") - 1)).alias("bin"))
        parts.append(grid.join(F.broadcast(counts), ["feature", "bin"], "left"))
    if not parts:
        return df.sparkSession.createDataFrame([], BIN_SCHEMA)
    counts = reduce(DataFrame.unionByName, parts).join(F.broadcast(overall_rate(df, target, positive)))
    n, p = F.coalesce("row_count", F.lit(0)), F.coalesce("positive_count", F.lit(0))
    rate = guarded_ratio(p, n)
    return counts.select(
        "feature", "bin", F.col("_e")[F.col("bin") - 1].alias("lower"), F.col("_e")[F.col("bin")].alias("upper"), n.alias("row_count"),
        p.alias("positive_count"), rate.alias("rate"), "overall_rate", (rate - F.col("overall_rate")).alias("rate_difference"),
        guarded_ratio(rate, F.col("overall_rate")).alias("lift"), (n < minimum_rows).alias("low_support"))


def wilson(positive: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p = positive / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return (F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half)))


def category_counts(df: DataFrame, features: Sequence[str], target: str, positive: str) -> DataFrame:
    y = (to_text(target) == positive).cast("int")
    long = df.where(F.col(target).isNotNull()).select(y.alias("_y"), *[to_text(f).alias(f) for f in features]).unpivot(
        ["_y"], list(features), "feature", "category")
    return long.where(F.col("category").isNotNull() & ~is_blank("category")).groupBy("feature", "category").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("_y").alias("positive_count"))


def category_rates(df: DataFrame, features: Sequence[str], target: str, positive: str,
                   expected: DataFrame | None = None, minimum_rows: int = 50) -> DataFrame:
    """Rate, lift, odds ratio against the rest (0.5 added to all cells when one is empty), Wilson interval, support.

    The overall rate is that of all rows with a target; the rest of a category are the rows that have the feature.
    `expected (feature, category)` keeps declared levels without rows.
    """
    counts = category_counts(df, features, target, positive)
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("row_count").alias("_n"), F.sum("positive_count").alias("_p")))
    if expected is not None:
        counts = counts.join(F.broadcast(expected), ["feature", "category"], "full_outer").select(
            "feature", "category", F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.coalesce("positive_count", F.lit(0)).alias("positive_count"))
    n, p = F.col("row_count"), F.col("positive_count")
    cells = [p.cast("double"), (n - p).cast("double"), (F.col("_p") - p).cast("double"),
             (F.col("_n") - F.col("_p") - n + p).cast("double")]
    empty = reduce(lambda a, b: a | b, [c == 0 for c in cells])
    a, b, c, d = [x + F.when(empty, 0.5).otherwise(0.0) for x in cells]
    low, high = wilson(p.cast("double"), n.cast("double"))
    rate, overall = guarded_ratio(p, n), F.col("overall_rate")
    return counts.join(totals, "feature").join(F.broadcast(overall_rate(df, target, positive))).select(
        "feature", "category", "row_count", "positive_count", rate.alias("rate"), "overall_rate",
        guarded_ratio(rate, overall).alias("lift"), F.when(n > 0, (a * d) / (b * c)).alias("odds_ratio"),
        low.alias("wilson_low"), high.alias("wilson_high"), (n < minimum_rows).alias("low_support"))


def category_association(df: DataFrame, features: Sequence[str], target: str, positive: str) -> DataFrame:
    """Rate spread, weighted absolute rate difference, Cramér's V and U(target | feature) per feature."""
    counts = category_counts(df, features, target, positive)
    rate = F.col("positive_count") / F.col("row_count")
    spread = counts.join(F.broadcast(overall_rate(df, target, positive).withColumnRenamed("overall_rate", "_o"))).groupBy("feature").agg(
        (F.max(rate) - F.min(rate)).alias("rate_spread"),
        (F.sum(F.col("row_count") * F.abs(rate - F.col("_o"))) / F.sum("row_count")).alias("weighted_rate_difference"))
    long = counts.select("feature", F.col("category").alias("x"), F.inline(F.array(
        F.struct(F.lit("1").alias("y"), F.col("positive_count").alias("n")),
        F.struct(F.lit("0").alias("y"), (F.col("row_count") - F.col("positive_count")).alias("n"))))).where(F.col("n") > 0)
    m = contingency_measures(long, ["feature"]).select("feature", "valid_rows", F.col("levels_a").alias("levels"), "cramers_v",
                                                       F.col("u_b_given_a").alias("u_target_given_feature"))
    return m.join(F.broadcast(spread), "feature").withColumn(
        "review", F.coalesce(F.col("rate_spread") >= SPREAD, F.lit(False)) | F.coalesce(F.col("cramers_v") >= ASSOCIATION, F.lit(False)))


def multiclass_numeric(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Eta squared on values and on ranks, and the range of the class means."""
    long = long_form(df.select(to_text(target).alias("class"), *features), ["class"], features)
    counts = long.where(F.col("class").isNotNull() & F.col("value").isNotNull()).groupBy("feature", "class", "value").agg(
        F.count(F.lit(1)).alias("n"))
    plain = eta_squared(counts, ["feature"], "class", "value", "n")
    ranks = average_ranks(counts, ["feature"], "value", weight="n").drop("n")
    ranked = eta_squared(counts.join(ranks, ["feature", "value"]), ["feature"], "class", "rank", "n").select(
        "feature", F.col("eta_squared").alias("rank_eta_squared"))
    means = counts.groupBy("feature", "class").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("_m")).groupBy("feature").agg(
        (F.max("_m") - F.min("_m")).alias("mean_range"))
    return plain.join(ranked, "feature").join(means, "feature").withColumn(
        "review", F.coalesce(F.greatest("eta_squared", "rank_eta_squared") >= ASSOCIATION, F.lit(False)))


def continuous_numeric(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson and Spearman with a continuous target over finite pairs, excluded rows, strongest of both."""
    finite = lambda c: F.when(F.abs(clean(c)) != float("inf"), clean(c))
    base = df.select(finite(target).alias("_t"), *[finite(f).alias(f) for f in features])
    both = lambda f: F.col(f).isNotNull() & F.col("_t").isNotNull()
    p = wide_rows(base, features, {
        "row_count": lambda f: F.count(F.lit(1)), "valid_rows": lambda f: F.count_if(both(f)),
        "pearson": lambda f: masked_corr(F.col(f), F.col("_t"))})
    s = spearman_pairs(base, pairs=[(F.col(f), F.col("_t"), f, target) for f in features]).select(
        F.col("feature_a").alias("feature"), "spearman")
    top = F.greatest(F.abs("pearson"), F.abs("spearman"))
    return p.join(F.broadcast(s), "feature", "left").select(
        "feature", "valid_rows", (F.col("row_count") - F.col("valid_rows")).alias("excluded_rows"), "pearson", "spearman",
        top.alias("max_association"), F.coalesce(top >= ASSOCIATION, F.lit(False)).alias("review"))


def ranked_relationships(relations: DataFrame, strength: str) -> DataFrame:
    """Review order of relationships: flagged first, then strongest, then name. One row per feature, so one small sort."""
    order = Window.orderBy(F.col("review").desc(), F.col("strength").desc_nulls_last(), "feature")
    return relations.select("feature", F.abs(strength).alias("strength"), "review").withColumn(
        "rank", F.row_number().over(order))
