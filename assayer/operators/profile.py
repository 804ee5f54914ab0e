"""Profiles of numeric columns, categories and targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import (
    guarded_ratio, is_blank, join_small, norm_text, quantiles, rows_of, running, scale_bucket, spread, to_text, wide_rows,
)
from assayer.operators.quality import numeric_projection


def adjusted_skewness(x: Column | str) -> Column:
    """Bias-adjusted skewness; NULL below three values or without spread."""
    n = F.count(x)
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def shape_label(skew: Column, threshold: float = 0.5) -> Column:
    return (F.when(skew.isNull() | F.isnan(skew), "Unavailable").when(skew >= threshold, "Right-skewed")
            .when(skew <= -threshold, "Left-skewed").otherwise("Approximately symmetric"))


def numbers_long(projected: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return projected.select(*keep, *[F.col(c)["number"].alias(c) for c in columns]).unpivot(
        list(keep), list(columns), "feature", "value").where(F.col("value").isNotNull())


def numeric_profile(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5,
                    blank_to: Mapping | None = None) -> DataFrame:
    """Counts, moments, quartiles and Tukey fences, one row per column.

    Counts and moments come from one wide aggregate; quartiles are exact and never gather a column in one task.
    """
    needed = dict.fromkeys([*columns, *[v[0] for v in (blank_to or {}).values()]])
    p = numeric_projection(spread(df.select(*needed)), columns, blank_to=blank_to)
    number = lambda c: F.col(c)["number"]
    counts = wide_rows(p, columns, {
        "row_count": lambda c: F.count(F.lit(1)), "valid": lambda c: F.count(number(c)),
        **{f"{m}_count": (lambda c, m=m: F.count_if(F.col(c)[m])) for m in ("missing", "blank", "materialized", "non_numeric")},
        "zero_count": lambda c: F.count_if(number(c) == 0),
        "negative_count": lambda c: F.count_if(number(c) < 0), "mean": lambda c: F.avg(number(c)),
        "std": lambda c: F.stddev_samp(number(c)), "variance": lambda c: F.var_samp(number(c)),
        "minimum": lambda c: F.min(number(c)), "maximum": lambda c: F.max(number(c)),
        "skewness": lambda c: adjusted_skewness(number(c))})
    long = numbers_long(p, columns)
    unique = long.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("unique_count"))
    q = quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75], few_groups=True)
    q = q.join(unique, "feature").select("feature", "unique_count", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("median"), F.col("qs")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return counts.join(F.broadcast(q), "feature", "left").withColumns({
        "unique_count": F.coalesce("unique_count", F.lit(0)),
        "range": F.col("maximum") - F.col("minimum"), "iqr": iqr, "lower_fence": F.col("q1") - multiplier * iqr,
        "upper_fence": F.col("q3") + multiplier * iqr, "shape": shape_label(F.col("skewness"))})


def fences(long: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Tukey fences per feature of long numbers; one row per column, so broadcasting them is bounded."""
    q = quantiles(long, ["feature"], "value", [0.25, 0.75], few_groups=True)
    iqr = F.col("qs")[1] - F.col("qs")[0]
    return F.broadcast(q.select("feature", (F.col("qs")[0] - multiplier * iqr).alias("lower_fence"),
                                (F.col("qs")[1] + multiplier * iqr).alias("upper_fence")))


def outlier_summary(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Values strictly outside the fences and their share of the valid values."""
    long = numbers_long(numeric_projection(spread(df.select(*columns)), columns), columns)
    marked = long.join(fences(long, multiplier), "feature")
    out = marked.groupBy("feature", "lower_fence", "upper_fence").agg(
        F.count(F.lit(1)).alias("valid"), F.count_if(F.col("value") < F.col("lower_fence")).alias("lower_count"),
        F.count_if(F.col("value") > F.col("upper_fence")).alias("upper_count"))
    total = F.col("lower_count") + F.col("upper_count")
    return out.withColumns({"outlier_count": total, "outlier_share": total / F.col("valid")})


def outlier_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str], multiplier: float = 1.5, top: int = 20) -> DataFrame:
    """The first `top` outlying rows per column; the rank filter prunes every partition before the shuffle."""
    long = numbers_long(numeric_projection(spread(df.select(*order, *columns)), columns, keep=order), columns, keep=order)
    marked = long.join(fences(long.select("feature", "value"), multiplier), "feature")
    side = F.when(F.col("value") < F.col("lower_fence"), "lower").when(F.col("value") > F.col("upper_fence"), "upper")
    rank = Window.partitionBy("feature").orderBy(*order, "value")
    return marked.withColumn("side", side).where(F.col("side").isNotNull()).withColumn(
        "rank", F.row_number().over(rank)).where(F.col("rank") <= top).drop("lower_fence", "upper_fence")


def conversion_issues(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """Raw values that did not become numbers, with counts and the span of their positions."""
    p = numeric_projection(df, columns, keep=[position, *[F.col(c).cast("string").alias(f"_raw_{c}") for c in columns]])
    issue = lambda c: (F.when(F.col(c)["missing"], "missing").when(F.col(c)["condition_failed"], "condition failed")
                       .when(F.col(c)["blank"], "blank").when(F.col(c)["non_numeric"], "non-numeric"))
    structs = [F.struct(F.lit(c).alias("feature"), issue(c).alias("issue"), F.col(f"_raw_{c}").alias("raw_value")) for c in columns]
    long = p.select(position, F.inline(F.array(*structs))).where(F.col("issue").isNotNull())
    return long.groupBy("feature", "issue", "raw_value").agg(
        F.count(F.lit(1)).alias("count"), F.min(position).alias("first_position"), F.max(position).alias("last_position"))


# --- categories -------------------------------------------------------------------------------------------------

def category_long(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    return spread(df.select(position, *columns)).select(position, *[to_text(c).alias(c) for c in columns]).unpivot([position], list(columns), "feature", "category")


def category_counts(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """Rows and first position of every non-blank level."""
    long = category_long(df, columns, position)
    return long.where(F.col("category").isNotNull() & ~is_blank("category")).groupBy("feature", "category").agg(
        F.count(F.lit(1)).alias("count"), F.min(position).alias("first_position"))


def category_frequency(df: DataFrame, columns: Sequence[str], position: str,
                       expected: Mapping[str, Sequence[str]] | None = None, rare_count: int = 50,
                       rare_share: float = 0.01) -> DataFrame:
    """Levels with count, share, rank (count descending, then first seen), rarity, expectation and dominance.

    Ranks are running totals over ranges of levels, so a column with very many levels is not sorted in one task. Levels
    with up to 256 rows, of which there may be very many, are dealt out by count and place of the first row.
    """
    counts = category_counts(df, columns, position).withColumns({
        "_one": F.lit(1).cast("bigint"), "_order": F.struct((-F.col("count")).alias("c"), F.col("first_position").alias("p"))})
    n, exact = F.col("count"), F.col("count") <= 256
    places = F.when(exact, scale_bucket(F.col("first_position").cast("double"))).otherwise(0)
    ranked = running(counts, ["feature"], "_order", ["_one"], bucket=F.struct(scale_bucket(-n.cast("double")).alias("a"), places.alias("b")))
    totals = ranked.groupBy("feature").agg(F.sum("count").alias("_valid"), F.max("count").alias("_top"))
    out = ranked.join(F.broadcast(totals), "feature")
    share = F.col("count") / F.col("_valid")
    trigger = F.concat_ws(", ", F.when(F.col("count") < rare_count, F.lit("count")), F.when(share < rare_share, F.lit("share")))
    known = F.lit(True)
    for c, values in (expected or {}).items():
        keys = [str(v).strip().lower() for v in values]
        known = F.when(F.col("feature") == c, norm_text("category").isin(*keys)).otherwise(known)
    return out.select("feature", "category", "count", share.alias("share"), F.col("run__one").alias("rank"),
                      F.coalesce(known, F.lit(False)).alias("expected"), (trigger != "").alias("rare"),
                      trigger.alias("rare_trigger"), (F.col("count") == F.col("_top")).alias("dominant"),
                      norm_text("category").alias("normalized"))


def label_variants(counts: DataFrame) -> DataFrame:
    """Normalised levels spelled in more than one way."""
    return counts.withColumn("normalized", norm_text("category")).groupBy("feature", "normalized").agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("count").alias("rows"),
        F.concat_ws("|", F.array_sort(F.collect_list("category"))).alias("variants")).where(F.col("spellings") > 1)


def category_contract(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Levels outside the expected list and expected levels never seen; `expected` has feature, category."""
    seen = counts.withColumn("_k", norm_text("category"))
    want = expected.withColumn("_k", norm_text("category"))
    ruled = F.broadcast(want.select("feature").distinct())
    extra = seen.join(ruled, "feature", "left_semi").join(F.broadcast(want.select("feature", "_k")), ["feature", "_k"], "left_anti")
    absent = F.broadcast(want).join(seen.select("feature", "_k").distinct(), ["feature", "_k"], "left_anti")
    return extra.select("feature", F.lit("Unexpected category").alias("issue"), "category", F.col("count").alias("rows")).unionByName(
        absent.select("feature", F.lit("Missing expected category").alias("issue"), "category", F.lit(0).cast("bigint").alias("rows")))


def grouping_counts(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows per declared group. Levels in several groups or in none count as Unassigned.

    `mapping (feature, group, category)` is a declared list and is broadcast.
    """
    keyed = mapping.withColumn("_k", norm_text("category"))
    single = keyed.groupBy("feature", "_k").agg(F.count(F.lit(1)).alias("_g"), F.min("group").alias("group")).where("_g = 1")
    ruled = F.broadcast(mapping.select("feature").distinct())
    rows = counts.withColumn("_k", norm_text("category")).join(ruled, "feature", "left_semi")
    hit = rows.join(F.broadcast(single.drop("_g")), ["feature", "_k"], "left")
    observed = hit.groupBy("feature", F.coalesce("group", F.lit("Unassigned")).alias("group")).agg(F.sum("count").alias("_n"))
    valid = F.broadcast(rows.groupBy("feature").agg(F.sum("count").alias("_v")))
    declared = mapping.select("feature", "group").distinct()
    full = observed.join(declared.withColumn("_d", F.lit(True)), ["feature", "group"], "full_outer").join(valid, "feature")
    return full.select("feature", "group", F.coalesce("_n", F.lit(0)).alias("count"),
                       (F.coalesce("_n", F.lit(0)) / F.col("_v")).alias("share"),
                       F.when(F.col("_d"), "Defined").otherwise("Requires review").alias("coverage"))


def grouping_issues(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Unknown, multiply assigned and ungrouped levels."""
    keyed = mapping.withColumn("_k", norm_text("category"))
    per = keyed.groupBy("feature", "_k").agg(F.count(F.lit(1)).alias("_g"))
    seen = counts.join(F.broadcast(mapping.select("feature").distinct()), "feature", "left_semi").select(
        "feature", norm_text("category").alias("_k")).distinct()
    j = per.join(seen.withColumn("_s", F.lit(True)), ["feature", "_k"], "full_outer")
    tell = [F.when(F.col("_s").isNull(), F.lit("Unknown grouping category")),
            F.when((F.col("_g") > 1) & F.col("_s").isNotNull(), F.lit("Category in several groups")),
            F.when(F.col("_g").isNull(), F.lit("Ungrouped category"))]
    return j.select("feature", F.explode(F.array_compact(F.array(*tell))).alias("issue"), F.col("_k").alias("category"))


def category_summary(df: DataFrame, columns: Sequence[str], position: str, high_cardinality: int = 20,
                     rare_count: int = 50, rare_share: float = 0.01) -> DataFrame:
    """One row per column: valid, missing and blank rows, cardinality, modes (all ties), rarity and status."""
    there = lambda c: F.col(c).isNotNull()
    text = df.select(*[to_text(c).alias(c) for c in columns])
    base = wide_rows(text, columns, {
        "row_count": lambda c: F.count(F.lit(1)), "missing_count": lambda c: F.count_if(~there(c)),
        "blank_count": lambda c: F.count_if(there(c) & is_blank(c))})
    counts = category_counts(df, columns, position)
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("count").alias("valid_count"), F.max("count").alias("mode_count")))
    j = counts.join(totals, "feature")
    rare = (F.col("count") < rare_count) | (F.col("count") / F.col("valid_count") < rare_share)
    agg = j.groupBy("feature", "valid_count", "mode_count").agg(
        F.count(F.lit(1)).alias("cardinality"), F.count_if(rare).alias("rare_categories"),
        F.coalesce(F.sum(F.when(rare, F.col("count"))), F.lit(0)).alias("rare_rows"),
        F.count_if(F.col("count") == F.col("mode_count")).alias("mode_ties"),
        F.min(F.when(F.col("count") == F.col("mode_count"), F.struct("first_position", "category")))["category"].alias("mode"))
    variants = label_variants(counts).groupBy("feature").agg(F.count(F.lit(1)).alias("inconsistent_labels"))
    out = base.join(agg, "feature", "left").join(variants, "feature", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("valid_count", "mode_count", "cardinality", "rare_categories", "rare_rows",
                                                 "mode_ties", "inconsistent_labels")}
    out = out.withColumns(zero).withColumns({
        "mode_share": guarded_ratio(F.col("mode_count"), F.col("valid_count")),
        "high_cardinality": F.col("cardinality") > high_cardinality})
    parts = F.concat_ws(
        ", ", F.when(F.col("missing_count") > 0, F.lit("Missing values")), F.when(F.col("blank_count") > 0, F.lit("Blank values")),
        F.when(F.col("inconsistent_labels") > 0, F.lit("Inconsistent labels")),
        F.when(F.col("rare_categories") > 0, F.lit("Rare categories")), F.when(F.col("high_cardinality"), F.lit("High cardinality")))
    return out.withColumn("status", F.when(parts == "", "Analyzed").otherwise(parts))


# --- targets ------------------------------------------------------------------------------------------------------

def class_distribution(df: DataFrame, target: str, expected: Sequence[str], positive: str | None = None,
                       by: Sequence[str] = ()) -> DataFrame:
    """Count, share and role of every observed or expected class, per group."""
    by = list(by)
    seen = df.where(F.col(target).isNotNull()).groupBy(*by, to_text(target).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    groups = seen.select(*by).distinct() if by else seen.agg(F.lit(0).alias("_g")).select()
    want = groups.select(*by, F.explode(F.array(*[F.lit(c) for c in expected])).alias("class"))
    both = want.withColumn("_e", F.lit(True)).join(seen, [*by, "class"], "full_outer").withColumns({
        "count": F.coalesce("count", F.lit(0)), "is_expected": F.coalesce("_e", F.lit(False))}).drop("_e")
    # As many rows per group as there are classes, so the windows are small.
    whole = Window.partitionBy(*by)
    top, low = F.max("count").over(whole), F.min(F.when(F.col("count") > 0, F.col("count"))).over(whole)
    both = both.withColumns({"_top": top, "_low": low, "_n": F.sum("count").over(whole)})
    ties = lambda c: F.count_if(F.col("count") == F.col(c)).over(whole)
    role = (F.when(F.col("count") == 0, "Absent expected")
            .when(F.col("count") == F.col("_top"), F.when(ties("_top") > 1, "Tied").otherwise("Majority"))
            .when(F.col("count") == F.col("_low"), F.when(ties("_low") > 1, "Tied minority").otherwise("Minority"))
            .otherwise("Intermediate"))
    if positive is not None:
        role = F.concat(role, F.when(F.col("class") == positive, " / Positive").otherwise(" / Negative"))
    return both.select(*by, "class", "count", guarded_ratio(F.col("count"), F.col("_n")).alias("share"), "is_expected", role.alias("role"))


def class_balance(distribution: DataFrame, positive: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Imbalance ratio, normalised entropy, majority-baseline accuracy and positive share."""
    n = F.sum("count")
    some = F.when(F.col("count") > 0, F.col("count"))
    classes = F.count(some)
    entropy = F.ln(n) - F.sum(some * F.ln(some)) / n
    out = distribution.groupBy(*by).agg(
        n.alias("rows"), classes.alias("classes"), guarded_ratio(F.max("count"), F.min(some)).alias("imbalance_ratio"),
        F.when(classes >= 2, entropy / F.ln(classes)).alias("normalized_entropy"),
        guarded_ratio(F.max("count"), n).alias("majority_accuracy"),
        F.coalesce(F.sum(F.when(F.col("class") == F.lit(positive), F.col("count"))), F.lit(0)).alias("_p"))
    share = guarded_ratio(F.col("_p"), F.col("rows")) if positive is not None else F.lit(None).cast("double")
    return out.withColumn("positive_share", share).drop("_p")


def continuous_target(df: DataFrame, target: str, by: Sequence[str] = (), multiplier: float = 1.5,
                      few_groups: bool | None = None) -> DataFrame:
    """Finite, missing and non-finite counts, moments, q01…q99, fences and extremes of a continuous target."""
    x = F.col(target).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = df.select(*by, F.when(finite, x).alias("_y"), x.alias("_x"))
    stats = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("_y").alias("finite_count"),
        F.count_if(F.col("_x").isNull() | F.isnan("_x")).alias("missing_count"),
        F.count_if(F.abs("_x") == float("inf")).alias("non_finite_count"), F.count_distinct("_y").alias("unique_count"),
        F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("std"), F.min("_y").alias("minimum"), F.max("_y").alias("maximum"),
        adjusted_skewness("_y").alias("skewness"))
    names = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    q = quantiles(ok, by, "_y", list(names.values()), few_groups=few_groups)
    q = q.select(*by, *[F.col("qs")[i].alias(k) for i, k in enumerate(names)])
    iqr = F.col("q75") - F.col("q25")
    q = q.withColumns({"iqr": iqr, "lower_fence": F.col("q25") - multiplier * iqr, "upper_fence": F.col("q75") + multiplier * iqr})
    joined = stats.join(q, list(by)) if by else stats.join(F.broadcast(q))
    limits = q.select(*by, F.col("lower_fence").alias("_a"), F.col("upper_fence").alias("_b"))
    marked = join_small(ok, limits, list(by), few_groups)
    out = marked.groupBy(*by).agg(F.count_if(F.col("_y") < F.col("_a")).alias("lower_extremes"),
                                  F.count_if(F.col("_y") > F.col("_b")).alias("upper_extremes"))
    return joined.join(out, list(by)) if by else joined.join(F.broadcast(out))


def histogram(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins, by the Freedman-Diaconis width unless `bins` is given; the last bin is closed. Empty bins stay."""
    x = df.select(F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    ends = x.agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.count(F.lit(1)).alias("_n"))
    if bins is None:
        q = quantiles(x, [], "_x", [0.25, 0.75])
        width = 2 * (F.col("qs")[1] - F.col("qs")[0]) / F.pow(F.col("_n").cast("double"), F.lit(1.0 / 3))
        k = F.when((width > 0) & (F.col("_b") > F.col("_a")), F.ceil((F.col("_b") - F.col("_a")) / width)).otherwise(1)
        ends = ends.join(F.broadcast(q.select("qs")))
    else:
        k = F.lit(bins)
    ends = ends.select("_a", "_b", k.cast("bigint").alias("_k"))
    step = (F.col("_b") - F.col("_a")) / F.col("_k")
    index = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col("_x") - F.col("_a")) / step), F.col("_k") - 1)).otherwise(F.lit(0))
    counts = x.join(F.broadcast(ends)).groupBy(index.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select("_a", "_b", "_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("_a") + F.col("bin") * step).alias("lower"), (F.col("_a") + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"))


def boxplot(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Five numbers, whiskers at the last values inside the fences and the number of points outside."""
    long = numbers_long(numeric_projection(spread(df.select(*columns)), columns), columns)
    q = quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75], few_groups=True)
    iqr = F.col("qs")[2] - F.col("qs")[0]
    q = F.broadcast(q.select("feature", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("median"), F.col("qs")[2].alias("q3"),
                             (F.col("qs")[0] - multiplier * iqr).alias("_lo"), (F.col("qs")[2] + multiplier * iqr).alias("_hi")))
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    return long.join(q, "feature").groupBy("feature", "q1", "median", "q3").agg(
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def profile_summary(profile: DataFrame, outliers: DataFrame) -> DataFrame:
    """Metric/value rows over the profiled columns."""
    t = profile.join(outliers.select("feature", "outlier_count"), "feature").agg(
        F.count(F.lit(1)).alias("features"), F.count_if(F.col("valid") == 0).alias("empty_features"),
        F.sum("missing_count").alias("missing_values"), F.sum("blank_count").alias("blank_values"),
        F.sum("non_numeric_count").alias("non_numeric_values"), F.count_if(F.col("unique_count") <= 1).alias("constant_features"),
        F.count_if(F.col("outlier_count") > 0).alias("features_with_outliers"), F.sum("outlier_count").alias("outlier_values"),
        F.count_if(F.col("shape") == "Right-skewed").alias("right_skewed"), F.count_if(F.col("shape") == "Left-skewed").alias("left_skewed"))
    return rows_of(t, [{"metric": F.lit(c), "value": F.col(c).cast("bigint")} for c in t.columns])
