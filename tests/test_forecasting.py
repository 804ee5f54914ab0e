import math

import numpy as np
from pyspark.sql import functions as F

from assayer.operators import forecast as fc
from assayer.operators import series as sr
from assayer.operators import smoothing as sm


def monthly(spark, n=228, noise=0.0, names=("a",), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(s, i, float(50 + .01 * i + 10 * math.sin(2 * math.pi * i / 12) + noise * rng.normal())) for s in names for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, t int, y double")
    return df.withColumn("period", F.add_months(F.lit("1920-01-01").cast("date"), F.col("t")))


def values(s):
    return np.array([r.y for r in s.orderBy("t").collect()])


def test_schedule_and_exact_trend(spark):
    s = monthly(spark)
    folds = fc.expanding_folds(s)
    rows = folds.orderBy("fold").collect()
    assert len(rows) == 9 and [r.n_train for r in rows] == list(range(120, 217, 12)) and str(rows[0].origin) == "1929-12-01"
    assert fc.schedule_checks(folds).first().windows_apart
    ev = fc.evidence(fc.closed_form_forecasts(s, folds), s, folds, fc.mase_scale(s, folds)).cache()
    m = {r.candidate_id: r for r in fc.backtest_metrics(ev).collect()}
    assert m["seasonal_trend_ols"].pooled_mae < 1e-9 and m["seasonal_trend_ols"].forecast_rows == 108
    assert abs(m["seasonal_naive_12"].pooled_mae - 0.12) < 1e-9 and abs(m["seasonal_naive_12"].pooled_mase - 1) < 1e-9
    ranked = fc.select_candidate(fc.backtest_metrics(ev), 0.05).orderBy("final_rank").collect()
    assert ranked[0].candidate_id == "seasonal_trend_ols" and ranked[0].is_winner


def test_closed_form_equals_least_squares(spark):
    s = monthly(spark, 100, noise=2.0)
    fit = {r.month: r for r in fc.seasonal_trend_fit(s, ["series_id"]).collect()}
    y, t = values(s), np.arange(100.0)
    x = np.column_stack([t] + [(np.arange(100) % 12 == m).astype(float) for m in range(12)])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert abs(fit[1].slope - beta[0]) < 1e-9 and all(abs(fit[m + 1].level - beta[m + 1]) < 1e-8 for m in range(12))


def test_holdout_does_not_reach_the_fit(spark):
    s = sr.temporal_scopes(monthly(spark, 60, noise=1.0))
    other = s.withColumn("y", F.when(F.col("scope") == "holdout", 999.0).otherwise(F.col("y")))
    pick = lambda d: [(r.month, r.slope, r.level) for r in fc.freeze_seasonal_trend(d).orderBy("month").collect()]
    assert pick(s) == pick(other)
    f = lambda h: [r.y_pred for r in fc.forecast_from_history(fc.freeze_seasonal_trend(s), h).orderBy("horizon").collect()]
    assert f(s) == f(s.withColumn("y", F.col("y") * 0))


def test_winner_within_tolerance_by_mase(spark):
    rows = [("s", "seasonal_trend_ols", 1.00, 2.0, .9, .1, 1.), ("s", "seasonal_naive_12", 1.04, 3.0, .8, .1, 1.), ("s", "naive_last_value", 1.2, 1.0, .1, .0, .1)]
    m = spark.createDataFrame(rows, "series_id string, candidate_id string, pooled_mae double, pooled_rmse double, pooled_mase double, fold_mae_std double, long_horizon_mae double")
    r = fc.select_candidate(m, 0.05).orderBy("final_rank").collect()
    assert [x.candidate_id for x in r] == ["seasonal_naive_12", "seasonal_trend_ols", "naive_last_value"]
    assert [x.is_finalist for x in r] == [True, True, False]


def test_calendar_gaps(spark):
    s = monthly(spark, 24).where("t not in (5)")
    c = sr.calendar_integrity(s.unionByName(s.where("t = 9"))).first()
    assert (c.missing_periods, c.missing_list, c.duplicated_periods, c.contiguous) == (1, "1920-06", 1, False)
    p, bad = sr.period_of_fraction(F.col("x"))
    r = spark.createDataFrame([(1920 + 1 / 12,), (1920.05,)], "x double").select(p.alias("p"), bad.alias("b")).collect()
    assert (str(r[0].p), r[0].b, r[1].b) == ("1920-02-01", False, True)


def test_autocorrelation_and_partial(spark):
    s = monthly(spark, 90, noise=3.0)
    y = values(s)
    d = y - y.mean()
    want = [float(d[k:] @ d[:-k] / (d @ d)) for k in range(1, 13)]
    got = sr.autocorrelation(s, 12).orderBy("lag").collect()
    assert np.allclose([r.acf for r in got], want, atol=1e-9)
    r = np.array([1.0] + want)
    pacf = [np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1:k + 1])[-1] for k in range(1, 13)]
    assert np.allclose([x.pacf for x in sm.partial_autocorrelation(s, 12).orderBy("lag").collect()], pacf, atol=1e-8)


def test_decomposition_adds_up_and_finds_the_season(spark):
    s = monthly(spark, 120, noise=0.2, names=("a", "b"))
    comp = sm.decompose(s).cache()
    assert comp.agg(F.max(F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("y")))).first()[0] < 1e-9
    st = {r.series_id: r for r in sr.component_strength(comp).collect()}
    assert st["a"].seasonal_strength > 0.98 and len(st) == 2


def test_unit_root_and_stationarity(spark):
    rng = np.random.default_rng(8)
    walk, noise = np.cumsum(rng.normal(0.3, 1, size=200)), rng.normal(size=200)  # a drifting walk
    df = spark.createDataFrame([(n, i, float(v)) for n, vs in (("walk", walk), ("noise", noise)) for i, v in enumerate(vs)], "series_id string, t int, y double")
    adf = {r.series_id: r for r in sm.unit_root(df).collect()}
    kp = {r.series_id: r for r in sm.kpss(df).collect()}
    assert adf["noise"].reject_null and not adf["walk"].reject_null
    assert kp["walk"].reject_null and not kp["noise"].reject_null
    # A plain loop for the stationarity statistic.
    e = walk - walk.mean()
    lags = kp["walk"].lags
    var = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / 200
    assert abs(kp["walk"].statistic - (np.cumsum(e) ** 2).sum() / 200 ** 2 / var) < 1e-9


def test_recursive_candidates(spark):
    s = monthly(spark, 84, noise=0.3, names=("a", "b"))
    folds = fc.expanding_folds(s, 60, 12, 12)
    out = sm.recursive_forecasts(s, folds)
    ev = fc.evidence(out, s, folds, fc.mase_scale(s, folds)).cache()
    assert fc.fold_audit(ev, folds).where("eligible").count() == 2 * len(sm.RECURSIVE)
    m = {(r.series_id, r.candidate_id): r.pooled_mae for r in fc.backtest_metrics(ev).collect()}
    assert m["a", "holt_winters_additive_no_trend"] < 1.0 and m["a", "sarima_100_011_12"] < 1.0
    y = values(s.where("series_id = 'a'"))[:60]
    x = np.array([[1, t + 1, y[t - 1], y[t - 12]] for t in range(12, 60)])
    beta = np.linalg.lstsq(x, y[12:], rcond=None)[0]
    path = list(y)
    for t in range(60, 72):
        path.append(beta @ [1, t + 1, path[t - 1], path[t - 12]])
    got = out.where("series_id = 'a' and fold = 1 and candidate_id = 'autoreg_lag_1_12_ct'").orderBy("horizon").collect()
    assert np.allclose([r.y_pred for r in got], path[60:], atol=1e-6)


def test_cusum_finds_the_break(spark):
    y = np.r_[np.zeros(30), np.ones(30) * 3] - 1.5
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "series_id string, t int, resid double").withColumn(
        "period", F.add_months(F.lit("2000-01-01").cast("date"), F.col("t")))
    r = sr.cusum_stability(df, 1).first()
    assert r.p_value < 0.01 and str(r.largest_excursion) == "2002-06-01"


def test_refined_weights_are_never_worse_than_the_grid(spark, monkeypatch):
    """One-step errors of the search against those of the grid alone, from the weights each finds, and plain loops."""
    import math
    import random

    from assayer.operators import smoothing as sm
    rng = random.Random(5)
    ys = [50 + 0.3 * t + 8 * math.sin(t * math.pi / 6) + rng.gauss(0, 2) for t in range(72)]

    def error(a, b, g, phi, trend):
        level, rise = sum(ys[:12]) / 12, (sum(ys[12:24]) - sum(ys[:12])) / 144 * trend
        season, sse, step = [y - level - rise * (i - 5.5) for i, y in enumerate(ys[:12])], 0.0, rise
        for t, y in enumerate(ys):
            now, line = season[t % 12], level + phi * step
            new = a * (y - now) + (1 - a) * line
            step, sse, level = b * (new - level) + (1 - b) * phi * step, sse + (y - line - now) ** 2, new
            season[t % 12] = g * (y - line) + (1 - g) * now
        return sse

    monkeypatch.setattr(sm, "_forecast_rows", lambda paths, folds: paths)
    series = spark.createDataFrame([("a", t, y) for t, y in enumerate(ys)], "series_id string, t int, y double")
    folds = spark.createDataFrame([("a", 1, 72)], "series_id string, fold int, cut int").selectExpr("*", "date'2001-01-01' AS origin")
    rows = sm.holt_winters(series, folds)
    best = {name: min((error(a, b, g, phi, float(trend)), a, b, g, phi) for a in sm.WEIGHTS for b in (sm.WEIGHTS if trend else (0.0,)) for g in sm.WEIGHTS
                      for phi in (sm.DAMPING if damped else (1.0,))) for name, (trend, damped) in sm.SMOOTHING.items()}
    for r in rows.collect():
        trend, damped = sm.SMOOTHING[r.candidate_id]
        at = list(best[r.candidate_id])
        for size in sm.WEIGHT_STEPS:
            tried = [tuple(at)]
            for i, used in ((1, True), (2, trend), (3, True), (4, damped)):
                for sign in (-1, 1):
                    if used:
                        new = list(at)
                        limits, way = (sm.DAMPING_LIMITS, size * sm.DAMPING_STEP) if i == 4 else (sm.WEIGHT_LIMITS, size)
                        new[i] = min(max(new[i] + sign * way, limits[0]), limits[1])
                        tried.append((error(*new[1:], float(trend)), *new[1:]))
            at = list(min(tried))
        assert at[0] < best[r.candidate_id][0]
        level = r.path[0]
        assert abs(level - forecast_of(ys, *at[1:], float(trend))) < 1e-6


def forecast_of(ys, a, b, g, phi, trend):
    """The month after the last one, in plain loops."""
    level, rise = sum(ys[:12]) / 12, (sum(ys[12:24]) - sum(ys[:12])) / 144 * trend
    season, step = [y - level - rise * (i - 5.5) for i, y in enumerate(ys[:12])], rise
    for t, y in enumerate(ys):
        now, line = season[t % 12], level + phi * step
        new = a * (y - now) + (1 - a) * line
        step, level = b * (new - level) + (1 - b) * phi * step, new
        season[t % 12] = g * (y - line) + (1 - g) * now
    return level + phi * step + season[len(ys) % 12]
