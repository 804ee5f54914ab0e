"""Monthly series keyed by `series_id`: canonical form, calendar checks, profiles, autocorrelation, stability.

A series table has `series_id, period (first of month), t (months since the series start), y`. After the
monthly aggregation a series has at most as many rows as the calendar has months, so windows and exact
percentiles per series are bounded whatever the number of raw events; different series run in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import guarded_ratio, join_small, quantiles, rows_of

Z95 = 1.959963984540054


def month_of(ts: Column | str) -> Column:
    return F.trunc(ts, "MM")


def months_between(late: Column, early: Column) -> Column:
    """Whole calendar months between two month starts."""
    return ((F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)).cast("int")


def with_position(df: DataFrame, by: str = "series_id", period: str = "period") -> DataFrame:
    start = F.min(period).over(Window.partitionBy(by))
    return df.withColumn("t", months_between(F.col(period), start))


def monthly_series(df: DataFrame, by: str | Column, ts: str, value: Column | str, digits: int | None = None,
                   fill: float | None = None) -> DataFrame:
    """Sum events per series and month. `fill` adds the months without events; else gaps stay gaps."""
    x = F.sum(value)
    key = F.col(by) if isinstance(by, str) else by
    sums = df.groupBy(key.alias("series_id"), month_of(ts).alias("period")).agg(
        (F.round(x, digits) + 0.0 if digits is not None else x).alias("y"))
    if fill is not None:
        spans = sums.groupBy("series_id").agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
        grid = spans.select("series_id", F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("period"))
        sums = grid.join(sums, ["series_id", "period"], "left").withColumn("y", F.coalesce("y", F.lit(float(fill))))
    return with_position(sums).select("series_id", "period", "t", "y")


def period_of_fraction(time: Column, tolerance: float = 1e-8) -> tuple[Column, Column]:
    """(month start, violation flag) of a fractional year such as 1920.0833."""
    year = F.floor(time).cast("int")
    raw = (time - F.floor(time)) * 12
    index = F.rint(raw)
    bad = time.isNull() | (F.abs(raw - index) > tolerance) | (index < 0) | (index > 11)
    return F.when(~bad, F.make_date(year, (index + 1).cast("int"), F.lit(1))), F.coalesce(bad, F.lit(True))


def calendar_integrity(df: DataFrame, by: str = "series_id", period: str = "period",
                       start: str | None = None, end: str | None = None) -> DataFrame:
    """Missing, unexpected and duplicated months against the expected calendar, and one-step breaks, per series."""
    counts = df.groupBy(by, period).agg(F.count(F.lit(1)).alias("_n"))
    lo = F.to_date(F.lit(start)) if start else F.min(period)
    hi = F.to_date(F.lit(end)) if end else F.max(period)
    spans = counts.groupBy(by).agg(lo.alias("_a"), hi.alias("_b"))
    expected = spans.select(
        by, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias(period)).withColumn("_e", F.lit(1))
    both = expected.join(counts, [by, period], "full_outer")
    order = Window.partitionBy(by).orderBy(period)
    # Duplicates are zero-length steps: a month seen n times adds n - 1 of them.
    seen = both.withColumn("_p", F.lag(F.when(F.col("_n").isNotNull(), F.col(period)), 1).over(order))
    return seen.groupBy(by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count("_n").alias("distinct_periods"),
        F.count("_e").alias("expected_periods"),
        F.count_if(F.col("_n").isNull()).alias("missing_periods"),
        F.count_if(F.col("_e").isNull()).alias("unexpected_periods"),
        F.count_if(F.col("_n") > 1).alias("duplicated_periods"),
        F.sum(F.coalesce(F.col("_n") - 1, F.lit(0))).alias("excess_rows"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("_n").isNull(), F.date_format(period, "yyyy-MM")))))
        .alias("missing_list"),
    ).withColumn("contiguous", (F.col("missing_periods") == 0) & (F.col("unexpected_periods") == 0)
                 & (F.col("duplicated_periods") == 0))


def calendar_steps(df: DataFrame, by: str = "series_id", period: str = "period") -> DataFrame:
    """Every row whose step from the previous month of its series is not one month."""
    order = Window.partitionBy(by).orderBy(period)
    return (
        df.withColumn("previous_period", F.lag(period).over(order))
        .withColumn("step", months_between(F.col(period), F.col("previous_period")))
        .where(F.col("step") != 1)
        .select(by, period, "previous_period", "step"))


def repeated_values(df: DataFrame, by: str = "series_id", value: str = "y", period: str = "period") -> DataFrame:
    """Values seen in more than one month with the list of their months."""
    return df.groupBy(by, value).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.date_format(period, "yyyy-MM")))).alias("periods"),
    ).where(F.col("occurrences") > 1)


def value_domain(df: DataFrame, by: Sequence[str], value: str, minimum: float, maximum: float) -> DataFrame:
    """Missing, non-finite and out-of-domain counts of a measured value."""
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(x.isNull() | F.isnan(x)).alias("missing_count"),
        F.count_if(F.abs(x) == float("inf")).alias("infinite_count"),
        F.count_if(finite & (x < minimum)).alias("below_count"),
        F.count_if(finite & (x > maximum)).alias("above_count"))


def month_profile(s: DataFrame) -> DataFrame:
    """Statistics per calendar month with the highest and lowest month of each series and the range of means."""
    q = F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = s.groupBy("series_id", F.month("period").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"),
        F.min("y").alias("min"), F.max("y").alias("max"), q.alias("_q"))
    whole = Window.partitionBy("series_id")
    first = lambda c: F.row_number().over(whole.orderBy(c, "month"))
    return stats.select(
        "series_id", "month", "n", "mean", F.col("_q")[1].alias("median"), "std", F.col("_q")[0].alias("q1"),
        F.col("_q")[2].alias("q3"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "min", "max",
        (first(F.col("mean").desc()) == 1).alias("is_highest"), (first(F.col("mean").asc()) == 1).alias("is_lowest"),
        (F.max("mean").over(whole) - F.min("mean").over(whole)).alias("range_of_means"))


def annual_means(s: DataFrame) -> DataFrame:
    """Mean, spread and range of each complete year."""
    return s.groupBy("series_id", F.year("period").alias("year")).agg(
        F.count(F.lit(1)).alias("months"), F.avg("y").alias("annual_mean"), F.stddev_samp("y").alias("annual_std"),
        (F.max("y") - F.min("y")).alias("annual_range")).where(F.col("months") == 12)


def annual_trend(s: DataFrame, span: int = 5) -> DataFrame:
    """Least-squares line through the annual means, fitted change, and last-versus-first mean of `span` years."""
    years = annual_means(s)
    whole = Window.partitionBy("series_id")
    years = years.withColumns({"_a": F.min("year").over(whole), "_b": F.max("year").over(whole)})
    return years.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("years"),
        F.regr_slope("annual_mean", "year").alias("slope"),
        F.regr_intercept("annual_mean", "year").alias("intercept"),
        (F.regr_slope("annual_mean", "year") * (F.max("year") - F.min("year"))).alias("fitted_change"),
        (F.avg(F.when(F.col("year") > F.col("_b") - span, F.col("annual_mean")))
         - F.avg(F.when(F.col("year") < F.col("_a") + span, F.col("annual_mean")))).alias("last_minus_first"))


def guarded_corr(x: str, y: str) -> Column:
    return guarded_ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def level_dispersion(s: DataFrame) -> DataFrame:
    """Correlation of the annual level with the annual spread and range."""
    return annual_means(s).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("years"), guarded_corr("annual_mean", "annual_std").alias("mean_std_corr"),
        guarded_corr("annual_mean", "annual_range").alias("mean_range_corr"))


def autocorrelation(s: DataFrame, lags: int = 36, by: Sequence[str] = ("series_id",), value: str = "y") -> DataFrame:
    """Autocorrelation up to `lags` with Bartlett 95 % intervals.

    Every row is matched with the row `lag` months later, an equi-join on (series, t); only lags
    shorter than the series appear.
    """
    by = list(by)
    whole = Window.partitionBy(*by)
    centred = s.where(F.col(value).isNotNull()).select(
        *by, "t", (F.col(value) - F.avg(value).over(whole)).alias("_d"), F.count(F.lit(1)).over(whole).alias("_n"))
    total = centred.groupBy(*by, "_n").agg(F.sum(F.col("_d") * F.col("_d")).alias("_ss"))
    early = centred.select(*by, F.col("_d").alias("_e"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"),
                           "t").withColumn("t", F.col("t") + F.col("lag"))
    products = early.join(centred, [*by, "t"]).groupBy(*by, "lag").agg(F.sum(F.col("_d") * F.col("_e")).alias("_p"))
    acf = products.join(total, by).select(
        *by, "lag", F.col("_n").alias("n"), guarded_ratio(F.col("_p"), F.col("_ss")).alias("acf"))
    shorter = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    se = F.sqrt((1 + 2 * F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(shorter), F.lit(0.0))) / F.col("n"))
    strongest = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("acf").desc_nulls_last(), "lag"))
    return acf.withColumn("_se", se).select(
        *by, "lag", "n", "acf", (F.col("acf") - Z95 * F.col("_se")).alias("ci_low"),
        (F.col("acf") + Z95 * F.col("_se")).alias("ci_high"),
        (F.abs("acf") > Z95 * F.col("_se")).alias("excludes_zero"), (strongest == 1).alias("is_strongest"))


def months_back(value: Column | str, months: int) -> Column:
    """The value so many months before, by month number `t` and not by row: NULL where that month is missing."""
    return F.max(value).over(Window.partitionBy("series_id").orderBy("t").rangeBetween(-months, -months))


def differenced(s: DataFrame, period: int = 12) -> DataFrame:
    """Level, first, seasonal and seasonal-then-first differences in long form; a difference needs both of its months."""
    d = s.select("series_id", "t", F.col("y").alias("level"), (F.col("y") - months_back("y", 1)).alias("d1"),
                 (F.col("y") - months_back("y", period)).alias("ds"))
    d = d.withColumn("ds_d1", F.col("ds") - months_back("ds", 1))
    return d.unpivot(["series_id", "t"], ["level", "d1", "ds", "ds_d1"], "variant", "x").where(F.col("x").isNotNull())


def difference_profile(s: DataFrame, period: int = 12) -> DataFrame:
    """Size, spread, lag-1 and lag-period autocorrelation and variance ratio to the level of each variant."""
    long = differenced(s, period)
    stats = long.groupBy("series_id", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("std"), F.var_samp("x").alias("_v"))
    acf = autocorrelation(long, period, ("series_id", "variant"), "x").groupBy("series_id", "variant").agg(
        F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("acf_1"),
        F.max(F.when(F.col("lag") == period, F.col("acf"))).alias("acf_period"))
    level = F.max(F.when(F.col("variant") == "level", F.col("_v"))).over(Window.partitionBy("series_id"))
    return stats.withColumn("variance_ratio", guarded_ratio(F.col("_v"), level)).drop("_v").join(
        acf, ["series_id", "variant"], "left")


def component_strength(components: DataFrame) -> DataFrame:
    """Strength of trend and season from additive components `trend, seasonal, resid`, and their movement."""
    def strength(c: str) -> Column:
        share = guarded_ratio(F.var_samp("resid"), F.var_samp(F.col(c) + F.col("resid")))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - share))
    return components.groupBy("series_id").agg(
        strength("trend").alias("trend_strength"), strength("seasonal").alias("seasonal_strength"),
        (F.max("trend") - F.min("trend")).alias("trend_range"),
        (F.max("seasonal") - F.min("seasonal")).alias("seasonal_range"),
        (F.max_by("trend", "t") - F.min_by("trend", "t")).alias("trend_change"))


def robust_anomalies(df: DataFrame, by: Sequence[str], value: str, threshold: float = 3.5) -> DataFrame:
    """Score (x - median) / (1.4826 MAD) of every row and whether its size reaches the threshold. Groups may be of any size."""
    by = list(by)
    median = quantiles(df, by, value, [0.5]).select(*by, F.col("qs")[0].alias("_m"))
    dev = join_small(df, median, by).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = quantiles(dev, by, "_d", [0.5]).select(*by, F.col("qs")[0].alias("mad"))
    scored = join_small(dev, mad, by).withColumn(
        "robust_score", guarded_ratio(F.col(value) - F.col("_m"), 1.4826 * F.col("mad")))
    return scored.withColumn("is_anomaly", F.coalesce(F.abs("robust_score") >= threshold, F.lit(False))).drop("_m", "_d")


def cusum_stability(resid: DataFrame, parameters: int, terms: int = 100) -> DataFrame:
    """Largest standardised excursion of the cumulative residual sum and its Kolmogorov p-value."""
    order = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    path = resid.withColumn("_c", F.abs(F.sum("resid").over(order)))
    stats = path.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("resid") * F.col("resid")).alias("_ss"), F.max("_c").alias("_top"),
        F.max_by("period", F.struct(F.round("_c", 9), -F.col("t"))).alias("largest_excursion"))
    x = F.col("_top") / F.sqrt(F.col("_ss") / (F.col("n") - parameters) * F.col("n"))
    stats = stats.withColumn("statistic", x)
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    p = 2 * F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + sign(k) * F.exp(-2 * k * k * F.col("statistic") * F.col("statistic")))
    return stats.select("series_id", "n", "statistic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p_value"),
                        "largest_excursion")


def temporal_scopes(s: DataFrame, holdout: int = 12) -> DataFrame:
    """Mark every month as development or, for the last `holdout` months of its series, holdout."""
    rest = F.max("t").over(Window.partitionBy("series_id")) - F.col("t")
    return s.withColumn("scope", F.when(rest >= holdout, "development").otherwise("holdout"))


def scope_summary(scoped: DataFrame) -> DataFrame:
    """Bounds of both scopes per series and whether they touch without overlap."""
    of = lambda scope, c: F.when(F.col("scope") == scope, F.col(c))
    return scoped.groupBy("series_id").agg(
        F.count(of("development", "t")).alias("development_rows"), F.count(of("holdout", "t")).alias("holdout_rows"),
        F.min(of("development", "period")).alias("development_start"),
        F.max(of("development", "period")).alias("development_end"),
        F.min(of("holdout", "period")).alias("holdout_start"), F.max(of("holdout", "period")).alias("holdout_end"),
        (F.min(of("holdout", "t")) == F.max(of("development", "t")) + 1).alias("adjacent"),
        (F.min(of("holdout", "t")) > F.max(of("development", "t"))).alias("disjoint"))


def horizon_feasibility(s: DataFrame, horizons: Sequence[int] = (1, 3, 6, 12, 24), initial: int = 24,
                        step: int = 12) -> DataFrame:
    """How many expanding-window origins each horizon leaves, per series."""
    sizes = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    rows = [{
        "horizon": F.lit(h),
        "training_rows": F.greatest(F.col("n") - h, F.lit(0)),
        "origins": F.when(F.col("n") - h >= initial, F.floor((F.col("n") - h - initial) / step) + 1).otherwise(F.lit(0)).cast("bigint"),
        "feasible": F.col("n") - h >= initial,
        "history_to_horizon": F.col("n") / F.lit(float(h)),
    } for h in horizons]
    return rows_of(sizes, rows, keep=["series_id", "n"])


def history_validity(history: DataFrame, training_end: Mapping[str, str] | str) -> DataFrame:
    """Per series: contiguous months, unique months, finite values, and at least up to the training end."""
    x = F.col("y").cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    checks = history.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("period").alias("distinct_periods"),
        (months_between(F.max("period"), F.min("period")) + 1).cast("bigint").alias("span_months"),
        F.max("period").alias("last_period"), F.bool_and(finite).alias("all_finite"))
    return checks.withColumns({
        "contiguous": (F.col("row_count") == F.col("span_months")) & (F.col("row_count") == F.col("distinct_periods")),
        "reaches_training_end": F.col("last_period") >= F.to_date(F.lit(training_end)),
    }).withColumn("valid", F.col("contiguous") & F.col("all_finite") & F.col("reaches_training_end"))
