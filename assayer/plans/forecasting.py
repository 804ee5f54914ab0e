"""Series and forecasting queries on monthly order value per priority (in millions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import rnd
from assayer.operators import forecast as fc
from assayer.operators import series as sr
from assayer.plans.registry import B, D, R, query, rounded
from assayer.sources.tables import table

INITIAL, HORIZON, STEP, HOLDOUT, TOLERANCE = 24, 12, 12, 12, 0.05


def monthly_orders(spark: SparkSession, sf: str, total: bool = False) -> DataFrame:
    by = F.lit("all") if total else "o_orderpriority"
    return sr.monthly_series(table(spark, sf, "orders"), by, "o_orderdate",
                             F.col("o_totalprice") / 1e6, digits=4)


def development(spark, sf, total: bool = False) -> DataFrame:
    scoped = sr.temporal_scopes(monthly_orders(spark, sf, total), HOLDOUT)
    return scoped.where(F.col("scope") == "development").drop("scope")


def with_gap(s: DataFrame) -> DataFrame:
    low = s.where(F.col("series_id").startswith("5") & ~F.col("t").isin(5, 17, 40))
    return s.unionByName(low.withColumn("series_id", F.concat(F.lit("gap "), F.col("series_id"))))


def backtest(spark, sf, total: bool = False):
    s = development(spark, sf, total)
    folds = fc.expanding_folds(s, INITIAL, HORIZON, STEP)
    ev = fc.evidence(fc.closed_form_forecasts(s, folds, HORIZON), s, folds, fc.mase_scale(s, folds))
    return s, folds, ev


def flagship(spark, sf):
    s, folds, ev = backtest(spark, sf, total=True)
    metrics = fc.backtest_metrics(ev)
    return rounded(fc.select_candidate(metrics, TOLERANCE), 9)


MONTHLY = """
monthly AS (SELECT series_id, period, CAST(date_diff('month', min(period) OVER (PARTITION BY series_id), period) AS BIGINT) AS t, y
 FROM (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
        round(sum(o_totalprice / 1e6), 4) + 0.0 AS y
       FROM orders GROUP BY 1, 2))"""
DEV = MONTHLY + """,
scoped AS (SELECT *, CASE WHEN max(t) OVER (PARTITION BY series_id) - t >= 12 THEN 'development' ELSE 'holdout' END AS scope FROM monthly),
dev AS (SELECT series_id, period, t, y FROM scoped WHERE scope = 'development')"""
FOLDS = DEV + """,
folds AS (SELECT series_id, (cut - 24) // 12 + 1 AS fold, cut, start,
  CAST(start + to_months(CAST(cut - 1 AS INT)) AS DATE) AS origin, CAST(start + to_months(CAST(cut AS INT)) AS DATE) AS val_start,
  CAST(start + to_months(CAST(cut + 11 AS INT)) AS DATE) AS val_end
 FROM (SELECT series_id, min(period) AS start, unnest(range(24, max(t) + 1 - 11, 12)) AS cut FROM dev GROUP BY 1)),
steps AS (SELECT series_id, t, abs(y - max(y) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING)) AS d FROM dev),
scales AS (SELECT f.series_id, f.fold, avg(d) AS mase_scale FROM folds f JOIN steps s ON s.series_id = f.series_id AND s.t < f.cut GROUP BY 1, 2)"""
# A series of which three months are missing, beside the given ones.
DEV_GAP = DEV + """,
devg AS (SELECT * FROM dev UNION ALL SELECT 'gap ' || series_id, period, t, y FROM dev WHERE series_id LIKE '5%' AND t NOT IN (5, 17, 40))"""
FOLDS_GAP = FOLDS.replace(DEV, DEV_GAP).replace("FROM dev GROUP", "FROM devg GROUP").replace("AS d FROM dev)", "AS d FROM devg)")
FIT = """
 fitm AS (SELECT f.series_id, f.fold, month(d.period) AS m, count(*) AS n, avg(d.t) AS tb, avg(d.y) AS yb,
   covar_pop(d.y, d.t) AS c, var_pop(d.t) AS v FROM folds f JOIN dev d ON d.series_id = f.series_id AND d.t < f.cut GROUP BY 1, 2, 3),
 fits AS (SELECT *, sum(n * c) OVER w / sum(n * v) OVER w AS slope FROM fitm WINDOW w AS (PARTITION BY series_id, fold))"""
EVIDENCE = FOLDS + "," + FIT + """,
future AS (SELECT series_id, fold, cut, origin, h, CAST(origin + to_months(CAST(h AS INT)) AS DATE) AS period FROM folds, (SELECT unnest(range(1, 13)) AS h)),
forecasts AS (
 SELECT 'seasonal_naive_12' AS candidate_id, f.*, d.y AS y_pred FROM future f JOIN dev d ON d.series_id = f.series_id AND d.t = f.cut - 12 + f.h - 1
 UNION ALL SELECT 'naive_last_value', f.*, d.y FROM future f JOIN dev d ON d.series_id = f.series_id AND d.t = f.cut - 1
 UNION ALL SELECT 'seasonal_trend_ols', f.*, x.yb - x.slope * x.tb + x.slope * (f.cut + f.h - 1) FROM future f
   JOIN fits x ON x.series_id = f.series_id AND x.fold = f.fold AND x.m = month(f.period)),
evidence AS (SELECT c.series_id, c.candidate_id, c.fold, c.origin, c.period, c.h AS horizon, d.y AS y_true, c.y_pred, c.y_pred - d.y AS error,
  abs(c.y_pred - d.y) AS abs_error, (c.y_pred - d.y) * (c.y_pred - d.y) AS squared_error, s.mase_scale, abs(c.y_pred - d.y) / s.mase_scale AS scaled_abs_error
 FROM forecasts c JOIN dev d ON d.series_id = c.series_id AND d.period = c.period JOIN scales s ON s.series_id = c.series_id AND s.fold = c.fold)"""
METRICS = EVIDENCE + """,
byfold AS (SELECT series_id, candidate_id, fold, avg(abs_error) AS f FROM evidence GROUP BY ALL),
spread AS (SELECT series_id, candidate_id, stddev_pop(f) AS fold_mae_std FROM byfold GROUP BY ALL),
pooled AS (SELECT e.series_id, e.candidate_id, count(*) AS forecast_rows, count(DISTINCT fold) AS folds_completed, avg(abs_error) AS pooled_mae,
  sqrt(avg(squared_error)) AS pooled_rmse, avg(scaled_abs_error) AS pooled_mase, avg(abs_error) FILTER (horizon <= 6) AS short_horizon_mae,
  avg(abs_error) FILTER (horizon > 6) AS long_horizon_mae FROM evidence e GROUP BY ALL),
metrics AS (SELECT p.*, s.fold_mae_std, p.pooled_mae - b.pooled_mae AS delta_mae, 100 * (b.pooled_mae - p.pooled_mae) / b.pooled_mae AS improvement_pct
 FROM pooled p JOIN spread s USING (series_id, candidate_id) JOIN pooled b ON b.series_id = p.series_id AND b.candidate_id = 'seasonal_naive_12')"""
HOLD = DEV + """,
fitm AS (SELECT series_id, month(period) AS m, count(*) AS n, avg(t) AS tb, avg(y) AS yb, covar_pop(y, t) AS c, var_pop(t) AS v FROM dev GROUP BY 1, 2),
coef AS (SELECT series_id, m, slope, yb - slope * tb AS level FROM (SELECT *, sum(n * c) OVER w / sum(n * v) OVER w AS slope FROM fitm WINDOW w AS (PARTITION BY series_id))),
hscale AS (SELECT series_id, avg(d) AS mase_scale FROM (SELECT series_id, abs(y - max(y) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING)) AS d FROM dev) GROUP BY 1),
hold AS (SELECT h.series_id, count(*) AS n, avg(abs(level + slope * t - y)) AS mae, sqrt(avg((level + slope * t - y) ** 2)) AS rmse
 FROM scoped h JOIN coef c ON c.series_id = h.series_id AND c.m = month(h.period) WHERE scope = 'holdout' GROUP BY 1),
holdout AS (SELECT h.*, mase_scale, mae / mase_scale AS mase FROM hold h JOIN hscale USING (series_id))"""
WHOLEFIT = MONTHLY + """,
fitm AS (SELECT series_id, month(period) AS m, count(*) AS n, avg(t) AS tb, avg(y) AS yb, covar_pop(y, t) AS c, var_pop(t) AS v FROM monthly GROUP BY 1, 2),
coef AS (SELECT series_id, m, slope, yb - slope * tb AS level, avg(yb - slope * tb) OVER (PARTITION BY series_id) AS base
 FROM (SELECT *, sum(n * c) OVER w / sum(n * v) OVER w AS slope FROM fitm WINDOW w AS (PARTITION BY series_id))),
comp AS (SELECT s.series_id, s.period, s.t, s.y, base + slope * s.t AS trend, level - base AS seasonal, s.y - level - slope * s.t AS resid
 FROM monthly s JOIN coef c ON c.series_id = s.series_id AND c.m = month(s.period))"""


@query("k01_monthly_series", f"WITH {MONTHLY} SELECT series_id, {D('period')}, {B('t')}, y FROM monthly")
def _(spark, sf):
    return rounded(monthly_orders(spark, sf))


@query("k01_monthly_events", """
SELECT event_type AS series_id, CAST(count(*) AS BIGINT) AS months, round(sum(y), 2) + 0.0 AS total FROM (
 SELECT event_type, date_trunc('month', ts) AS m, round(sum(value), 2) AS y FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    s = sr.monthly_series(table(spark, sf, "events"), "event_type", "ts", F.col("value"), digits=2, fill=0.0)
    return s.groupBy("series_id").agg(F.count(F.lit(1)).alias("months"), rnd(F.sum("y"), 2).alias("total"))


@query("b06_period_of_fraction", """
SELECT strftime(make_date(CAST(floor(x) AS INT), CAST(round((x - floor(x)) * 12) AS INT) + 1, 1), '%Y-%m-%d') AS period,
 CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (abs((x - floor(x)) * 12 - round((x - floor(x)) * 12)) > 1e-8) AS BIGINT) AS violations
FROM (SELECT year(o_orderdate) + (month(o_orderdate) - 1) / 12.0::DOUBLE AS x FROM orders) GROUP BY 1""")
def _(spark, sf):
    x = F.year("o_orderdate") + (F.month("o_orderdate") - 1) / F.lit(12.0)
    period, bad = sr.period_of_fraction(F.col("x"))
    t = table(spark, sf, "orders").select(x.cast("double").alias("x")).select(period.alias("period"), bad.alias("bad"))
    return rounded(t.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("violations")))


GAPPY = """
gappy AS (SELECT series_id, period, t, y FROM monthly WHERE t NOT IN (5, 17) UNION ALL SELECT series_id, period, t, y FROM monthly WHERE t = 9)"""


def gappy(spark, sf):
    s = monthly_orders(spark, sf)
    return s.where(~F.col("t").isin(5, 17)).unionByName(s.where(F.col("t") == 9))


@query("c14_calendar_integrity", f"""WITH {MONTHLY}, {GAPPY},
 c AS (SELECT series_id, period, count(*) AS n FROM gappy GROUP BY 1, 2),
 e AS (SELECT series_id, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM c GROUP BY 1),
 j AS (SELECT coalesce(e.series_id, c.series_id) AS series_id, coalesce(e.period, c.period) AS period, n, e.period IS NOT NULL AS expected
       FROM e FULL JOIN c ON e.series_id = c.series_id AND e.period = c.period)
SELECT series_id, CAST(sum(n) AS BIGINT) AS row_count, count(n) AS distinct_periods, count(*) FILTER (expected) AS expected_periods,
 count(*) FILTER (n IS NULL) AS missing_periods, count(*) FILTER (NOT expected) AS unexpected_periods, count(*) FILTER (n > 1) AS duplicated_periods,
 CAST(sum(coalesce(n - 1, 0)) AS BIGINT) AS excess_rows,
 coalesce(string_agg(strftime(period, '%Y-%m'), ',' ORDER BY period) FILTER (n IS NULL), '') AS missing_list,
 count(*) FILTER (n IS NULL) = 0 AND count(*) FILTER (NOT expected) = 0 AND count(*) FILTER (n > 1) = 0 AS contiguous
FROM j GROUP BY 1""")
def _(spark, sf):
    return rounded(sr.calendar_integrity(gappy(spark, sf)))


@query("c14_calendar_steps", f"""WITH {MONTHLY}, {GAPPY}
SELECT series_id, {D('period', 'previous_period')}, CAST(step AS BIGINT) AS step FROM (
 SELECT *, date_diff('month', previous_period, period) AS step FROM (
  SELECT series_id, period, lag(period) OVER (PARTITION BY series_id ORDER BY period) AS previous_period FROM gappy)) WHERE step <> 1""")
def _(spark, sf):
    return rounded(sr.calendar_steps(gappy(spark, sf)))


@query("c15_repeated_values", f"""WITH {MONTHLY}
SELECT series_id, round(y, 1) + 0.0 AS y, count(*) AS occurrences, string_agg(strftime(period, '%Y-%m'), ',' ORDER BY period) AS periods
FROM monthly GROUP BY series_id, round(y, 1) HAVING count(*) > 1""")
def _(spark, sf):
    s = monthly_orders(spark, sf).withColumn("y", F.round("y", 1))
    return rounded(sr.repeated_values(s))


@query("c16_value_domain", """
SELECT l_returnflag, count(*) AS row_count, count(*) FILTER (x IS NULL) AS missing_count, count(*) FILTER (abs(x) = 'inf'::DOUBLE) AS infinite_count,
 count(*) FILTER (abs(x) < 'inf'::DOUBLE AND x < 0) AS below_count, count(*) FILTER (abs(x) < 'inf'::DOUBLE AND x > 1) AS above_count
FROM (SELECT l_returnflag, CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN 'inf'::DOUBLE ELSE l_discount * l_quantity END AS x FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    x = F.when(F.col("l_quantity") == 1, None).when(F.col("l_quantity") == 2, float("inf")).otherwise(
        F.col("l_discount") * F.col("l_quantity"))
    df = table(spark, sf, "lineitem").select("l_returnflag", x.cast("double").alias("x"))
    return sr.value_domain(df, ["l_returnflag"], "x", 0, 1)


@query("c17_history_validity", f"""WITH {MONTHLY}, {GAPPY}
SELECT *, contiguous AND all_finite AND reaches_training_end AS valid FROM (
SELECT series_id, count(*) AS row_count, count(DISTINCT period) AS distinct_periods, date_diff('month', min(period), max(period)) + 1 AS span_months,
 strftime(max(period), '%Y-%m-%d') AS last_period, bool_and(isfinite(y)) AS all_finite,
 count(*) = date_diff('month', min(period), max(period)) + 1 AND count(*) = count(DISTINCT period) AS contiguous,
 max(period) >= DATE '2000-07-01' AS reaches_training_end
FROM (SELECT 'gappy ' || series_id AS series_id, period, y FROM gappy UNION ALL SELECT series_id, period, y FROM monthly) GROUP BY 1)""")
def _(spark, sf):
    g = gappy(spark, sf).withColumn("series_id", F.concat(F.lit("gappy "), F.col("series_id")))
    return rounded(sr.history_validity(g.unionByName(monthly_orders(spark, sf)), "2000-07-01"))


@query("k02_month_profile", f"""WITH {MONTHLY},
 p AS (SELECT series_id, month(period) AS month, count(*) AS n, avg(y) AS mean, median(y) AS median, stddev_samp(y) AS std,
  quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, min(y) AS min, max(y) AS max FROM monthly GROUP BY 1, 2)
SELECT series_id, CAST(month AS BIGINT) AS month, n, {R('mean', 'median', 'std', 'q1', 'q3')}, round(q3 - q1, 6) + 0.0 AS iqr, {R('min', 'max')},
 row_number() OVER (PARTITION BY series_id ORDER BY mean DESC, month) = 1 AS is_highest,
 row_number() OVER (PARTITION BY series_id ORDER BY mean, month) = 1 AS is_lowest,
 round(max(mean) OVER (PARTITION BY series_id) - min(mean) OVER (PARTITION BY series_id), 6) + 0.0 AS range_of_means FROM p""")
def _(spark, sf):
    return rounded(sr.month_profile(monthly_orders(spark, sf)))


YEARS = """
years AS (SELECT series_id, year(period) AS year, avg(y) AS annual_mean, stddev_samp(y) AS annual_std, max(y) - min(y) AS annual_range
 FROM monthly GROUP BY 1, 2 HAVING count(*) = 12)"""


@query("k03_annual_trend", f"""WITH {MONTHLY}, {YEARS},
 b AS (SELECT *, min(year) OVER (PARTITION BY series_id) AS a, max(year) OVER (PARTITION BY series_id) AS z FROM years)
SELECT series_id, count(*) AS years, round(regr_slope(annual_mean, year), 6) + 0.0 AS slope, round(regr_intercept(annual_mean, year), 5) + 0.0 AS intercept,
 round(regr_slope(annual_mean, year) * (max(year) - min(year)), 6) + 0.0 AS fitted_change,
 round(avg(annual_mean) FILTER (year > z - 3) - avg(annual_mean) FILTER (year < a + 3), 6) + 0.0 AS last_minus_first FROM b GROUP BY 1""")
def _(spark, sf):
    t = sr.annual_trend(monthly_orders(spark, sf), span=3)
    return rounded(t, intercept=5)


@query("k05_component_strength", f"""WITH {WHOLEFIT}
SELECT series_id, round(greatest(0, least(1, 1 - var_samp(resid) / var_samp(trend + resid))), 6) + 0.0 AS trend_strength,
 round(greatest(0, least(1, 1 - var_samp(resid) / var_samp(seasonal + resid))), 6) + 0.0 AS seasonal_strength,
 round(max(trend) - min(trend), 6) + 0.0 AS trend_range, round(max(seasonal) - min(seasonal), 6) + 0.0 AS seasonal_range,
 round(arg_max(trend, t) - arg_min(trend, t), 6) + 0.0 AS trend_change FROM comp GROUP BY 1""")
def _(spark, sf):
    return rounded(sr.component_strength(fc.seasonal_trend_components(monthly_orders(spark, sf))))


def acf_sql(source: str, keys: str, value: str, lags: int) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ka = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
 cen AS (SELECT {keys}, t, {value} - avg({value}) OVER (PARTITION BY {keys}) AS d, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
 tot AS (SELECT {keys}, n, sum(d * d) AS ss FROM cen GROUP BY {keys}, n),
 prod AS (SELECT {ka}, b.t - a.t AS lag, sum(a.d * b.d) AS p FROM cen a JOIN cen b ON {on} AND b.t > a.t AND b.t <= a.t + {lags} GROUP BY {ka}, b.t - a.t),
 acf AS (SELECT {keys}, lag, n, p / ss AS acf FROM prod JOIN tot USING ({keys}))"""


@query("k06_autocorrelation", f"""WITH {MONTHLY}, {acf_sql('monthly', 'series_id', 'y', 36)},
 s AS (SELECT *, sqrt((1 + 2 * coalesce(sum(acf * acf) OVER (PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS se FROM acf)
SELECT series_id, CAST(lag AS BIGINT) AS lag, n, round(acf, 6) + 0.0 AS acf, round(acf - 1.959963984540054 * se, 6) + 0.0 AS ci_low,
 round(acf + 1.959963984540054 * se, 6) + 0.0 AS ci_high, abs(acf) > 1.959963984540054 * se AS excludes_zero,
 row_number() OVER (PARTITION BY series_id ORDER BY abs(acf) DESC, lag) = 1 AS is_strongest FROM s""")
def _(spark, sf):
    return rounded(sr.autocorrelation(monthly_orders(spark, sf), 36))


@query("k08_difference_profile", f"""WITH {MONTHLY}, mg AS (SELECT * FROM monthly UNION ALL SELECT 'gap ' || series_id, period, t, y FROM monthly WHERE series_id LIKE '5%' AND t NOT IN (5, 17, 40)),
 d AS (SELECT *, ds - max(ds) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ds_d1 FROM (SELECT series_id, t, y AS level, y - max(y) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS d1,
   y - max(y) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS ds FROM mg)),
 long AS (SELECT series_id, t, 'level' AS variant, level AS x FROM d UNION ALL SELECT series_id, t, 'd1', d1 FROM d WHERE d1 IS NOT NULL
  UNION ALL SELECT series_id, t, 'ds', ds FROM d WHERE ds IS NOT NULL UNION ALL SELECT series_id, t, 'ds_d1', ds_d1 FROM d WHERE ds_d1 IS NOT NULL),
 {acf_sql('long', 'series_id, variant', 'x', 12)},
 st AS (SELECT series_id, variant, count(*) AS n, stddev_samp(x) AS std, var_samp(x) AS v FROM long GROUP BY 1, 2)
SELECT st.series_id, st.variant, st.n, round(std, 6) + 0.0 AS std, round(v / max(v) FILTER (st.variant = 'level') OVER (PARTITION BY st.series_id), 6) + 0.0 AS variance_ratio,
 round(a.acf, 6) + 0.0 AS acf_1, round(b.acf, 6) + 0.0 AS acf_period FROM st
 LEFT JOIN acf a ON a.series_id = st.series_id AND a.variant = st.variant AND a.lag = 1
 LEFT JOIN acf b ON b.series_id = st.series_id AND b.variant = st.variant AND b.lag = 12""")
def _(spark, sf):
    return rounded(sr.difference_profile(with_gap(monthly_orders(spark, sf))))


@query("k11_level_dispersion", f"""WITH {MONTHLY}, {YEARS}
SELECT series_id, count(*) AS years, round(corr(annual_mean, annual_std), 6) + 0.0 AS mean_std_corr, round(corr(annual_mean, annual_range), 6) + 0.0 AS mean_range_corr
FROM years GROUP BY 1""")
def _(spark, sf):
    return rounded(sr.level_dispersion(monthly_orders(spark, sf)))


@query("k12_robust_anomalies", f"""WITH {WHOLEFIT},
 m AS (SELECT series_id, median(resid) AS m FROM comp GROUP BY 1), a AS (SELECT c.series_id, median(abs(resid - m)) AS mad FROM comp c JOIN m USING (series_id) GROUP BY 1)
SELECT series_id, {D('period')}, round(resid, 6) + 0.0 AS resid, round(mad, 6) + 0.0 AS mad, round((resid - m) / (1.4826 * mad), 5) + 0.0 AS robust_score,
 abs((resid - m) / (1.4826 * mad)) >= 3.5 AS is_anomaly FROM comp JOIN m USING (series_id) JOIN a USING (series_id)""")
def _(spark, sf):
    comp = fc.seasonal_trend_components(monthly_orders(spark, sf)).select("series_id", "period", "resid")
    out = sr.robust_anomalies(comp, ["series_id"], "resid")
    return rounded(out, robust_score=5)


@query("k13_cusum_stability", f"""WITH {WHOLEFIT},
 p AS (SELECT series_id, period, t, resid, abs(sum(resid) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)) AS c FROM comp),
 g AS (SELECT series_id, count(*) AS n, max(c) / sqrt(sum(resid * resid) / (count(*) - 13) * count(*)) AS x, arg_max(period, round(c, 9) * 1000000 - t * 1e-6) AS le FROM p GROUP BY 1)
SELECT series_id, n, round(x, 6) + 0.0 AS statistic,
 round(greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * x * x))))), 6) + 0.0 AS p_value,
 strftime(le, '%Y-%m-%d') AS largest_excursion FROM g""")
def _(spark, sf):
    comp = fc.seasonal_trend_components(monthly_orders(spark, sf))
    return rounded(sr.cusum_stability(comp, parameters=13))


@query("j08_temporal_split", f"""WITH {DEV}
SELECT series_id, count(*) FILTER (scope = 'development') AS development_rows, count(*) FILTER (scope = 'holdout') AS holdout_rows,
 strftime(min(period) FILTER (scope = 'development'), '%Y-%m-%d') AS development_start, strftime(max(period) FILTER (scope = 'development'), '%Y-%m-%d') AS development_end,
 strftime(min(period) FILTER (scope = 'holdout'), '%Y-%m-%d') AS holdout_start, strftime(max(period) FILTER (scope = 'holdout'), '%Y-%m-%d') AS holdout_end,
 min(t) FILTER (scope = 'holdout') = max(t) FILTER (scope = 'development') + 1 AS adjacent,
 min(t) FILTER (scope = 'holdout') > max(t) FILTER (scope = 'development') AS disjoint FROM scoped GROUP BY 1""")
def _(spark, sf):
    return rounded(sr.scope_summary(sr.temporal_scopes(monthly_orders(spark, sf), HOLDOUT)))


@query("j09_horizon_feasibility", f"""WITH {MONTHLY}, n AS (SELECT series_id, count(*) AS n FROM monthly GROUP BY 1)
SELECT series_id, n, CAST(h AS BIGINT) AS horizon, greatest(n - h, 0) AS training_rows, CAST(CASE WHEN n - h >= 24 THEN (n - h - 24) // 12 + 1 ELSE 0 END AS BIGINT) AS origins,
 n - h >= 24 AS feasible, round(n / h::DOUBLE, 6) + 0.0 AS history_to_horizon FROM n, (SELECT unnest([1, 3, 6, 12, 24]) AS h)""")
def _(spark, sf):
    return rounded(sr.horizon_feasibility(monthly_orders(spark, sf), initial=INITIAL, step=STEP))


@query("k14_expanding_folds", f"""WITH {FOLDS_GAP} SELECT series_id, {B('fold', 'cut')}, strftime(start, '%Y-%m-%d') AS train_start, {D('origin', 'val_start', 'val_end')},
 CAST(cut AS BIGINT) AS n_train, CAST(cut // 12 AS BIGINT) AS complete_cycles FROM folds""")
def _(spark, sf):
    return rounded(fc.expanding_folds(with_gap(development(spark, sf)), INITIAL, HORIZON, STEP))


@query("k14_schedule_checks", f"""WITH {FOLDS_GAP}
SELECT series_id, count(*) AS folds, max(fold) = count(*) AS numbered, bool_and(adjacent) AS adjacent, bool_and(apart) AS windows_apart FROM (
 SELECT series_id, fold, val_start = CAST(origin + INTERVAL 1 MONTH AS DATE) AS adjacent,
  coalesce(lag(val_end) OVER (PARTITION BY series_id ORDER BY fold) < val_start, true) AS apart FROM folds) GROUP BY 1""")
def _(spark, sf):
    return rounded(fc.schedule_checks(fc.expanding_folds(with_gap(development(spark, sf)), INITIAL, HORIZON, STEP)))


@query("k15_mase_scale", f"WITH {FOLDS_GAP} SELECT series_id, {B('fold')}, {R('mase_scale')} FROM scales")
def _(spark, sf):
    s = with_gap(development(spark, sf))
    return rounded(fc.mase_scale(s, fc.expanding_folds(s, INITIAL, HORIZON, STEP)))


@query("k16_naive_forecasts", f"""WITH {EVIDENCE} SELECT candidate_id, series_id, {B('fold')}, CAST(h AS BIGINT) AS horizon, {D('period')}, {R('y_pred', digits=9)}
FROM forecasts WHERE candidate_id <> 'seasonal_trend_ols'""")
def _(spark, sf):
    s = development(spark, sf)
    f = fc.expanding_folds(s, INITIAL, HORIZON, STEP)
    return rounded(fc.seasonal_naive(s, f, HORIZON).unionByName(fc.last_value(s, f, HORIZON)), 9)


@query("k17_seasonal_trend_forecasts", f"""WITH {EVIDENCE} SELECT candidate_id, series_id, {B('fold')}, CAST(h AS BIGINT) AS horizon, {D('period')}, {R('y_pred', digits=9)}
FROM forecasts WHERE candidate_id = 'seasonal_trend_ols'""")
def _(spark, sf):
    s = development(spark, sf)
    return rounded(fc.seasonal_trend(s, fc.expanding_folds(s, INITIAL, HORIZON, STEP), HORIZON), 9)


@query("k17_residuals", f"WITH {WHOLEFIT} SELECT series_id, {D('period')}, {B('t')}, {R('y', 'trend', 'seasonal', 'resid', digits=9)} FROM comp")
def _(spark, sf):
    return rounded(fc.seasonal_trend_components(monthly_orders(spark, sf)), 9)


@query("k21_backtest_evidence", f"""WITH {EVIDENCE} SELECT series_id, candidate_id, {B('fold', 'horizon')}, {D('origin', 'period')},
 {R('y_true', 'y_pred', 'error', 'abs_error', 'squared_error', 'mase_scale', 'scaled_abs_error', digits=10)} FROM evidence""")
def _(spark, sf):
    return rounded(backtest(spark, sf)[2], 10)


@query("k22_fold_audit", f"""WITH {EVIDENCE}, w AS (SELECT series_id, count(*) * 12 AS expected_rows FROM folds GROUP BY 1),
 cand AS (SELECT unnest(['seasonal_naive_12', 'naive_last_value', 'seasonal_trend_ols', 'autoreg_lag_1_12_ct']) AS candidate_id),
 seen AS (SELECT series_id, candidate_id, count(DISTINCT fold) AS folds_completed, count(*) AS forecast_rows, bool_and(isfinite(y_pred)) AS all_finite FROM evidence
  WHERE NOT (candidate_id = 'naive_last_value' AND fold = 2 AND series_id LIKE '1%') AND NOT (candidate_id = 'seasonal_naive_12' AND series_id LIKE '2%') AND NOT (candidate_id = 'seasonal_trend_ols' AND fold = 1 AND series_id LIKE '3%') GROUP BY 1, 2),
 a AS (SELECT series_id, candidate_id, coalesce(folds_completed, 0) AS folds_completed, coalesce(forecast_rows, 0) AS forecast_rows, coalesce(all_finite, false) AS all_finite, expected_rows,
  coalesce(forecast_rows = expected_rows AND all_finite, false) AS eligible FROM (SELECT * FROM w, cand) LEFT JOIN seen USING (series_id, candidate_id))
SELECT *, count(*) FILTER (eligible AND candidate_id IN ('seasonal_naive_12', 'naive_last_value')) OVER (PARTITION BY series_id) < 2 AS blocked FROM a""")
def _(spark, sf):
    _, folds, ev = backtest(spark, sf)
    c, sid = F.col("candidate_id"), F.col("series_id")
    failed = (c == "naive_last_value") & (F.col("fold") == 2) & sid.startswith("1") | (c == "seasonal_naive_12") & sid.startswith("2")
    failed = failed | (c == "seasonal_trend_ols") & (F.col("fold") == 1) & sid.startswith("3")
    return rounded(fc.fold_audit(ev.where(~failed), folds, HORIZON, ["seasonal_naive_12", "naive_last_value", "seasonal_trend_ols", "autoreg_lag_1_12_ct"]))


@query("k23_backtest_metrics", f"""WITH {METRICS} SELECT series_id, candidate_id, {B('forecast_rows', 'folds_completed')},
 {R('pooled_mae', 'pooled_rmse', 'pooled_mase', 'fold_mae_std', 'short_horizon_mae', 'long_horizon_mae', 'delta_mae', digits=10)}, round(improvement_pct, 4) + 0.0 AS improvement_pct FROM metrics""")
def _(spark, sf):
    m = fc.backtest_metrics(backtest(spark, sf)[2])
    return rounded(m, 10, improvement_pct=4)


@query("k23_metric_breakdown", f"""WITH {EVIDENCE} SELECT series_id, candidate_id, CASE WHEN grouping(fold) = 0 THEN 'fold' WHEN grouping(horizon) = 0 THEN 'horizon' ELSE 'pooled' END AS level,
 CAST(coalesce(fold, horizon, 0) AS BIGINT) AS item, count(*) AS n, round(avg(abs_error), 9) + 0.0 AS mae, round(sqrt(avg(squared_error)), 9) + 0.0 AS rmse,
 round(avg(scaled_abs_error), 9) + 0.0 AS mase FROM evidence GROUP BY GROUPING SETS ((series_id, candidate_id), (series_id, candidate_id, fold), (series_id, candidate_id, horizon))""")
def _(spark, sf):
    return rounded(fc.metric_breakdown(backtest(spark, sf)[2]), 9)


SELECTION = """
 u AS (SELECT * FROM (SELECT *, count(*) FILTER (candidate_id IN ('seasonal_naive_12', 'naive_last_value')) OVER (PARTITION BY series_id) AS b FROM metrics) WHERE b = 2),
 x AS (SELECT *, min(pooled_mae) OVER (PARTITION BY series_id) AS best_mae,
   CASE candidate_id WHEN 'seasonal_naive_12' THEN 0 WHEN 'naive_last_value' THEN 1 ELSE 2 END AS complexity FROM u),
 y AS (SELECT *, pooled_mae <= best_mae + 0.05 AS is_finalist FROM x),
 z AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY is_finalist DESC, pooled_mase, pooled_rmse, fold_mae_std, long_horizon_mae, complexity, candidate_id) = 1 AS is_winner FROM y)
SELECT series_id, candidate_id, round(pooled_mae, 9) + 0.0 AS pooled_mae, round(best_mae, 9) + 0.0 AS best_mae, is_finalist, is_winner,
 row_number() OVER (PARTITION BY series_id ORDER BY is_winner DESC, pooled_mae, candidate_id) AS final_rank FROM z"""


NO_BASELINE = "NOT (series_id LIKE '1%' AND candidate_id = 'seasonal_naive_12')"


@query("k24_select_candidate", f"WITH {METRICS}, {SELECTION}".replace("OVER (PARTITION BY series_id) AS b FROM metrics)", f"OVER (PARTITION BY series_id) AS b FROM metrics WHERE {NO_BASELINE})"))
def _(spark, sf):
    """One series has lost its primary baseline, so nothing is selected for it."""
    m = fc.backtest_metrics(backtest(spark, sf)[2])
    return rounded(fc.select_candidate(m.where(NO_BASELINE), TOLERANCE), 9)


@query("k24_select_candidate_total", f"WITH {METRICS}, {SELECTION}".replace("o_orderpriority AS series_id", "'all' AS series_id"))
def _(spark, sf):
    return flagship(spark, sf)


@query("k25_holdout_metrics", f"WITH {HOLD} SELECT series_id, n, {R('mae', 'rmse', 'mase_scale', 'mase')} FROM holdout")
def _(spark, sf):
    return rounded(fc.holdout_metrics(sr.temporal_scopes(monthly_orders(spark, sf), HOLDOUT)))


@query("k26_frozen_scoring", f"""WITH {HOLD}, last AS (SELECT series_id, max(period) AS origin, min(period) AS start FROM monthly GROUP BY 1),
 fut AS (SELECT series_id, origin, start, h, CAST(origin + to_months(CAST(h AS INT)) AS DATE) AS period FROM last, (SELECT unnest(range(1, 13)) AS h))
SELECT f.series_id, {D('origin', 'period')}, h AS horizon, round(level + slope * date_diff('month', start, period), 6) + 0.0 AS y_pred
FROM fut f JOIN coef c ON c.series_id = f.series_id AND c.m = month(f.period)""")
def _(spark, sf):
    s = monthly_orders(spark, sf)
    coef = fc.freeze_seasonal_trend(sr.temporal_scopes(s, HOLDOUT))
    return rounded(fc.forecast_from_history(coef, s, HORIZON))


@query("c18_forecast_output", f"""WITH {HOLD}, last AS (SELECT series_id, max(period) AS origin, min(period) AS start FROM monthly GROUP BY 1),
 fut AS (SELECT series_id, origin, start, h, CAST(origin + to_months(CAST(h AS INT)) AS DATE) AS period FROM last, (SELECT unnest(range(1, 13)) AS h)),
 o AS (SELECT f.*, level + slope * date_diff('month', start, period) AS y_pred FROM fut f JOIN coef c ON c.series_id = f.series_id AND c.m = month(f.period)
   WHERE NOT (f.series_id = '5-LOW' AND h = 3))
SELECT *, complete AND contiguous AND finite AS valid FROM (SELECT series_id, count(*) AS row_count, count(*) = 12 AND count(DISTINCT h) = 12 AS complete,
 bool_and(date_diff('month', origin, period) = h) AS contiguous, bool_and(isfinite(y_pred)) AS finite FROM o GROUP BY 1)""")
def _(spark, sf):
    s = monthly_orders(spark, sf)
    out = fc.forecast_from_history(fc.freeze_seasonal_trend(sr.temporal_scopes(s, HOLDOUT)), s, HORIZON)
    broken = (F.col("series_id") == "5-LOW") & (F.col("horizon") == 3)
    return rounded(fc.forecast_output_checks(out.where(~broken), HORIZON))


@query("k27_holdout_delta", f"""WITH {METRICS}, h AS (WITH {HOLD} SELECT * FROM holdout),
 j AS (SELECT m.series_id, pooled_mae, pooled_rmse, pooled_mase, mae, rmse, mase FROM metrics m JOIN h USING (series_id) WHERE candidate_id = 'seasonal_trend_ols')
SELECT series_id, metric, round(b, 6) + 0.0 AS backtest, round(h, 6) + 0.0 AS holdout, round(h - b, 6) + 0.0 AS delta FROM (
 SELECT series_id, 'mae' AS metric, pooled_mae AS b, mae AS h FROM j UNION ALL SELECT series_id, 'rmse', pooled_rmse, rmse FROM j UNION ALL SELECT series_id, 'mase', pooled_mase, mase FROM j)""")
def _(spark, sf):
    m = fc.backtest_metrics(backtest(spark, sf)[2])
    return rounded(fc.holdout_delta(m, fc.holdout_metrics(sr.temporal_scopes(monthly_orders(spark, sf), HOLDOUT))))
