"""Expanding-window backtests, closed-form candidates, selection and frozen scoring over all series at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import guarded_ratio
from assayer.operators.series import months_back, months_between

KEYS = ["series_id", "fold"]


def expanding_folds(s: DataFrame, initial: int = 120, horizon: int = 12, step: int = 12, period: int = 12) -> DataFrame:
    """Fold table: training covers t < cut, validation the next `horizon` months.

    Months are counted, not rows, so a gap moves no cut. n_train is the number of months up to the origin.
    """
    sizes = s.groupBy("series_id").agg((F.max("t") + 1).alias("_n"), F.min("period").alias("train_start"))
    cuts = sizes.where(F.col("_n") - horizon >= initial).select(
        "series_id", "train_start",
        F.explode(F.sequence(F.lit(initial), (F.col("_n") - horizon).cast("int"), F.lit(step))).alias("cut"))
    at = lambda m: F.add_months("train_start", m)
    return cuts.select(
        "series_id", ((F.col("cut") - initial) / step + 1).cast("int").alias("fold"), "cut", "train_start",
        at(F.col("cut") - 1).alias("origin"), at(F.col("cut")).alias("val_start"),
        at(F.col("cut") + horizon - 1).alias("val_end"), F.col("cut").alias("n_train"),
        F.floor(F.col("cut") / period).cast("int").alias("complete_cycles"))


def schedule_checks(folds: DataFrame) -> DataFrame:
    """Folds are numbered without gaps, validation follows its origin directly and windows do not overlap."""
    order = Window.partitionBy("series_id").orderBy("fold")
    seen = folds.withColumns({
        "_adjacent": F.col("val_start") == F.add_months("origin", 1),
        "_apart": F.coalesce(F.lag("val_end").over(order) < F.col("val_start"), F.lit(True))})
    return seen.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("folds"), (F.max("fold") == F.count(F.lit(1))).alias("numbered"),
        F.bool_and("_adjacent").alias("adjacent"), F.bool_and("_apart").alias("windows_apart"))


def mase_scale(s: DataFrame, folds: DataFrame, period: int = 12) -> DataFrame:
    """Mean absolute seasonal difference over the training months of each fold that have a month one period before."""
    steps = s.select("series_id", "t", F.abs(F.col("y") - months_back("y", period)).alias("_d"))
    return (
        folds.select(*KEYS, "cut").join(steps, "series_id").where(F.col("t") < F.col("cut"))
        .groupBy(*KEYS).agg(F.avg("_d").alias("mase_scale")))


def _future(folds: DataFrame, horizon: int) -> DataFrame:
    return folds.select(
        *KEYS, "cut", "origin", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")).withColumn(
        "period", F.add_months("origin", F.col("horizon")))


def seasonal_naive(s: DataFrame, folds: DataFrame, horizon: int = 12, period: int = 12) -> DataFrame:
    """The value of the same month in the last training cycle."""
    future = _future(folds, horizon).withColumn(
        "t", F.col("cut") - period + (F.col("horizon") - 1) % period)
    return future.join(s.select("series_id", "t", F.col("y").alias("y_pred")), ["series_id", "t"]).select(
        F.lit("seasonal_naive_12" if period == 12 else f"seasonal_naive_{period}").alias("candidate_id"),
        *KEYS, "horizon", "period", "y_pred")


def last_value(s: DataFrame, folds: DataFrame, horizon: int = 12) -> DataFrame:
    """The last training value for every horizon."""
    future = _future(folds, horizon).withColumn("t", F.col("cut") - 1)
    return future.join(s.select("series_id", "t", F.col("y").alias("y_pred")), ["series_id", "t"]).select(
        F.lit("naive_last_value").alias("candidate_id"), *KEYS, "horizon", "period", "y_pred")


def seasonal_trend_fit(train: DataFrame, by: list[str]) -> DataFrame:
    """Least squares with a linear trend and one level per calendar month, in closed form.

    Sweeping out the month means leaves one slope: the pooled within-month covariance of (t, y) over
    the pooled within-month variance of t. A month level is then its mean minus slope times its mean t.
    Two aggregations, no solver. Output `by…, month, slope, level`.
    """
    months = train.groupBy(*by, F.month("period").alias("month")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("t").alias("_t"), F.avg("y").alias("_y"),
        F.covar_pop("t", "y").alias("_c"), F.var_pop("t").alias("_v"))
    whole = Window.partitionBy(*by)
    slope = guarded_ratio(F.sum(F.col("_n") * F.col("_c")).over(whole), F.sum(F.col("_n") * F.col("_v")).over(whole))
    return months.withColumn("slope", slope).select(
        *by, "month", "slope", (F.col("_y") - F.col("slope") * F.col("_t")).alias("level"))


def training_rows(s: DataFrame, folds: DataFrame) -> DataFrame:
    return folds.select(*KEYS, "cut").join(s, "series_id").where(F.col("t") < F.col("cut"))


def seasonal_trend(s: DataFrame, folds: DataFrame, horizon: int = 12) -> DataFrame:
    fit = seasonal_trend_fit(training_rows(s, folds), KEYS)
    future = _future(folds, horizon).withColumn("month", F.month("period"))
    return future.join(fit, [*KEYS, "month"]).select(
        F.lit("seasonal_trend_ols").alias("candidate_id"), *KEYS, "horizon", "period",
        (F.col("level") + F.col("slope") * (F.col("cut") + F.col("horizon") - 1)).alias("y_pred"))


def seasonal_trend_components(s: DataFrame) -> DataFrame:
    """Fitted trend and season and the residual of every month (season centred over the year)."""
    fit = seasonal_trend_fit(s, ["series_id"])
    centre = F.avg("level").over(Window.partitionBy("series_id"))
    fit = fit.withColumn("_base", centre)
    return s.withColumn("month", F.month("period")).join(fit, ["series_id", "month"]).select(
        "series_id", "period", "t", "y", (F.col("_base") + F.col("slope") * F.col("t")).alias("trend"),
        (F.col("level") - F.col("_base")).alias("seasonal"),
        (F.col("y") - F.col("level") - F.col("slope") * F.col("t")).alias("resid"))


def evidence(forecasts: DataFrame, s: DataFrame, folds: DataFrame, scales: DataFrame) -> DataFrame:
    """One row per candidate, fold and horizon with the truth and the error columns. Truth joins after forecasting."""
    truth = s.select("series_id", "period", F.col("y").alias("y_true"))
    error = F.col("y_pred") - F.col("y_true")
    return (
        forecasts.join(truth, ["series_id", "period"]).join(scales, KEYS)
        .join(folds.select(*KEYS, "origin"), KEYS)
        .select("series_id", "candidate_id", "fold", "origin", "period", "horizon", "y_true", "y_pred",
                error.alias("error"), F.abs(error).alias("abs_error"), (error * error).alias("squared_error"),
                "mase_scale", guarded_ratio(F.abs(error), F.col("mase_scale")).alias("scaled_abs_error")))


# Candidates that a selection cannot do without.
BASELINES = ("seasonal_naive_12", "naive_last_value")


def fold_audit(ev: DataFrame, folds: DataFrame, horizon: int = 12, candidates: Sequence[str] | None = None,
               baselines: Sequence[str] = BASELINES) -> DataFrame:
    """Which candidates finished every fold with finite forecasts; the others are not eligible.

    All `candidates`, if given, are listed for every series, with or without forecasts. `blocked`: a baseline is
    absent or incomplete, so nothing may be selected for the series.
    """
    wanted = folds.groupBy("series_id").agg((F.count(F.lit(1)) * horizon).alias("expected_rows"))
    x = F.col("y_pred")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    seen = ev.groupBy("series_id", "candidate_id").agg(
        F.countDistinct("fold").alias("folds_completed"), F.count(F.lit(1)).alias("forecast_rows"),
        F.bool_and(finite).alias("all_finite"))
    listed = wanted.join(seen, "series_id")
    if candidates is not None:
        listed = wanted.withColumn("candidate_id", F.explode(F.array(*[F.lit(c) for c in candidates]))).join(seen, ["series_id", "candidate_id"], "left")
    rows = F.coalesce("forecast_rows", F.lit(0))
    out = listed.select(
        "series_id", "candidate_id", F.coalesce("folds_completed", F.lit(0)).alias("folds_completed"), rows.alias("forecast_rows"),
        F.coalesce("all_finite", F.lit(False)).alias("all_finite"), "expected_rows",
        ((rows == F.col("expected_rows")) & F.coalesce("all_finite", F.lit(False))).alias("eligible"))
    complete = F.count_if(F.col("eligible") & F.col("candidate_id").isin(*baselines)).over(Window.partitionBy("series_id"))
    return out.withColumn("blocked", complete < len(baselines))


def backtest_metrics(ev: DataFrame, baseline: str = "seasonal_naive_12", short: int = 6) -> DataFrame:
    """Pooled errors, spread of the fold MAEs, short and long horizon MAE, and the change against the baseline."""
    by = ["series_id", "candidate_id"]
    folds = ev.groupBy(*by, "fold").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("abs_error").alias("_a"), F.sum("squared_error").alias("_s"),
        F.sum("scaled_abs_error").alias("_m"), F.avg("abs_error").alias("_f"),
        F.sum(F.when(F.col("horizon") <= short, F.col("abs_error"))).alias("_sa"),
        F.count(F.when(F.col("horizon") <= short, 1)).alias("_sn"),
        F.sum(F.when(F.col("horizon") > short, F.col("abs_error"))).alias("_la"),
        F.count(F.when(F.col("horizon") > short, 1)).alias("_ln"))
    pooled = folds.groupBy(*by).agg(
        F.sum("_n").alias("forecast_rows"), F.count(F.lit(1)).alias("folds_completed"),
        (F.sum("_a") / F.sum("_n")).alias("pooled_mae"), F.sqrt(F.sum("_s") / F.sum("_n")).alias("pooled_rmse"),
        (F.sum("_m") / F.sum("_n")).alias("pooled_mase"), F.stddev_pop("_f").alias("fold_mae_std"),
        guarded_ratio(F.sum("_sa"), F.sum("_sn")).alias("short_horizon_mae"),
        guarded_ratio(F.sum("_la"), F.sum("_ln")).alias("long_horizon_mae"))
    base = F.max(F.when(F.col("candidate_id") == baseline, F.col("pooled_mae"))).over(Window.partitionBy("series_id"))
    return pooled.withColumn("_b", base).withColumns({
        "delta_mae": F.col("pooled_mae") - F.col("_b"),
        "improvement_pct": guarded_ratio(100 * (F.col("_b") - F.col("pooled_mae")), F.col("_b"))}).drop("_b")


def metric_breakdown(ev: DataFrame) -> DataFrame:
    """MAE, RMSE and MASE per candidate, per fold and per horizon from one pass of grouping sets."""
    sets = [[F.col("series_id"), F.col("candidate_id")],
            [F.col("series_id"), F.col("candidate_id"), F.col("fold")],
            [F.col("series_id"), F.col("candidate_id"), F.col("horizon")]]
    out = ev.groupingSets(sets, "series_id", "candidate_id", "fold", "horizon").agg(
        F.grouping("fold").alias("_gf"), F.grouping("horizon").alias("_gh"), F.count(F.lit(1)).alias("n"),
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg("scaled_abs_error").alias("mase"))
    level = F.when(F.col("_gf") == 0, "fold").when(F.col("_gh") == 0, "horizon").otherwise("pooled")
    return out.select("series_id", "candidate_id", level.alias("level"),
                      F.coalesce("fold", "horizon", F.lit(0)).cast("int").alias("item"), "n", "mae", "rmse", "mase")


# Candidate names in complexity order, the last but one tie break.
COMPLEXITY = {
    "seasonal_naive_12": 0, "naive_last_value": 1, "seasonal_trend_ols": 2, "holt_winters_additive_no_trend": 3,
    "holt_winters_additive_damped_trend": 4, "holt_winters_additive_trend": 5, "autoreg_lag_1_12_ct": 6,
    "autoreg_lag_1_2_12_ct": 7, "sarima_100_100_12": 8, "sarima_100_011_12": 9,
}


def select_candidate(metrics: DataFrame, tolerance: float, complexity: Mapping[str, int] = COMPLEXITY,
                     baselines: Sequence[str] = BASELINES) -> DataFrame:
    """Rank candidates: the winner among all within `tolerance` of the best MAE comes first, the rest by MAE.

    Finalists are ordered by MASE, RMSE, spread of fold MAEs, long-horizon MAE, complexity, name. A series without
    usable metrics of all baselines has no ranking.
    """
    rank_of = F.create_map(*[x for k, v in complexity.items() for x in (F.lit(k), F.lit(v))])
    usable = metrics
    for c in ("pooled_mae", "pooled_rmse", "pooled_mase", "fold_mae_std", "long_horizon_mae"):
        usable = usable.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    if "eligible" in metrics.columns:
        usable = usable.where("eligible")
    whole = Window.partitionBy("series_id")
    if "complexity" not in metrics.columns:
        usable = usable.withColumn("complexity", F.coalesce(rank_of[F.col("candidate_id")], F.lit(len(complexity))))
    present = F.count_if(F.col("candidate_id").isin(*baselines)).over(whole)
    usable = usable.withColumn("_b", present).where(F.col("_b") >= len(baselines)).drop("_b")
    ranked = usable.withColumn("best_mae", F.min("pooled_mae").over(whole))
    ranked = ranked.withColumn("is_finalist", F.col("pooled_mae") <= F.col("best_mae") + tolerance)
    ladder = whole.orderBy(F.col("is_finalist").desc(), "pooled_mase", "pooled_rmse", "fold_mae_std",
                           "long_horizon_mae", "complexity", "candidate_id")
    ranked = ranked.withColumn("is_winner", F.row_number().over(ladder) == 1)
    final = whole.orderBy(F.col("is_winner").desc(), "pooled_mae", "candidate_id")
    return ranked.withColumn("final_rank", F.row_number().over(final)).select(
        "series_id", "candidate_id", "pooled_mae", "best_mae", "is_finalist", "is_winner", "final_rank")


def freeze_seasonal_trend(scoped: DataFrame) -> DataFrame:
    """Coefficient table `series_id, month, slope, level, train_start, train_end` from development rows only."""
    dev = scoped.where(F.col("scope") == "development")
    bounds = dev.groupBy("series_id").agg(F.min("period").alias("train_start"), F.max("period").alias("train_end"))
    return seasonal_trend_fit(dev, ["series_id"]).join(bounds, "series_id")


def score_periods(coefficients: DataFrame, periods: DataFrame) -> DataFrame:
    """Forecast of `periods (series_id, period, …)` with frozen coefficients."""
    t = months_between(F.col("period"), F.col("train_start"))
    return periods.withColumn("month", F.month("period")).join(coefficients, ["series_id", "month"]).withColumn(
        "y_pred", F.col("level") + F.col("slope") * t).drop(
        "month", "slope", "level", "train_start", "train_end")


def forecast_from_history(coefficients: DataFrame, history: DataFrame, horizon: int = 12) -> DataFrame:
    """The `horizon` months after each history. Only its last month matters, its values do not."""
    last = history.groupBy("series_id").agg(F.max("period").alias("origin"))
    future = last.select("series_id", "origin", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"))
    return score_periods(coefficients, future.withColumn("period", F.add_months("origin", F.col("horizon"))))


def holdout_metrics(scoped: DataFrame, period: int = 12) -> DataFrame:
    """One evaluation of the frozen fit on the holdout months; the MASE divisor comes from development."""
    coef = freeze_seasonal_trend(scoped)
    hold = score_periods(coef, scoped.where(F.col("scope") == "holdout"))
    dev = scoped.where(F.col("scope") == "development")
    scale = dev.select("series_id", F.abs(F.col("y") - months_back("y", period)).alias("_d")).groupBy(
        "series_id").agg(F.avg("_d").alias("mase_scale"))
    e = F.col("y_pred") - F.col("y")
    return hold.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).join(
        scale, "series_id").withColumn("mase", guarded_ratio(F.col("mae"), F.col("mase_scale")))


def holdout_delta(metrics: DataFrame, holdout: DataFrame, candidate: str = "seasonal_trend_ols") -> DataFrame:
    """Backtest against holdout, one row per metric."""
    b = metrics.where(F.col("candidate_id") == candidate).select("series_id", "pooled_mae", "pooled_rmse", "pooled_mase")
    j = b.join(holdout, "series_id")
    pair = lambda name, x, y: F.struct(
        F.lit(name).alias("metric"), F.col(x).alias("backtest"), F.col(y).alias("holdout"),
        (F.col(y) - F.col(x)).alias("delta"))
    return j.select("series_id", F.inline(F.array(
        pair("mae", "pooled_mae", "mae"), pair("rmse", "pooled_rmse", "rmse"), pair("mase", "pooled_mase", "mase"))))


def forecast_output_checks(forecast: DataFrame, horizon: int = 12) -> DataFrame:
    """Per series: exactly `horizon` rows, consecutive months after the origin, finite values."""
    x = F.col("y_pred")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return forecast.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        ((F.count(F.lit(1)) == horizon) & (F.countDistinct("horizon") == horizon)).alias("complete"),
        F.bool_and(months_between(F.col("period"), F.col("origin")) == F.col("horizon")).alias("contiguous"),
        F.bool_and(finite).alias("finite")).withColumn("valid", F.col("complete") & F.col("contiguous") & F.col("finite"))


def closed_form_forecasts(s: DataFrame, folds: DataFrame, horizon: int = 12, period: int = 12) -> DataFrame:
    return (seasonal_naive(s, folds, horizon, period).unionByName(last_value(s, folds, horizon))
            .unionByName(seasonal_trend(s, folds, horizon)))
