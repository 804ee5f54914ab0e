"""Decomposition, stationarity and recursive forecasters, one short series per group.

A group is one series (or one series and fold): at most as many rows as the calendar has months. Decomposition and the
unit-root test run numpy inside a group, everything else is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import guarded_ratio
from assayer.operators.forecast import KEYS, training_rows
from assayer.operators.series import autocorrelation, months_back


# --- decomposition --------------------------------------------------------------------------------------------------

def _loess(y: np.ndarray, span: int, at: np.ndarray) -> np.ndarray:
    """Local linear fit with tricube weights over the `span` nearest points, evaluated at positions `at`."""
    n = len(y)
    x = np.arange(n, dtype=float)
    d = np.abs(at[:, None] - x[None, :])
    h = np.sort(d, axis=1)[:, min(span, n) - 1] + max(0, (span - n) // 2)
    u = d / np.maximum(h, 1e-12)[:, None]
    w = np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - np.clip(u, 0, 1) ** 3) ** 3, 0.0))
    w /= w.sum(axis=1, keepdims=True)
    mx, my = w @ x, w @ y
    sxx = w @ (x * x) - mx * mx
    slope = np.where(sxx > 1e-9 * n, (w @ (x * y) - mx * my) / np.where(sxx > 0, sxx, 1), 0.0)
    return my + slope * (at - mx)


def _moving(y: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(y, np.ones(k) / k, mode="valid")


def _stl(y: np.ndarray, period: int, seasonal: int = 7, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal-trend decomposition by loess (Cleveland et al. 1990), without robustness weights."""
    n = len(y)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    span += span % 2 == 0
    low = period + (period % 2 == 0)
    trend = np.zeros(n)
    season = np.zeros(n)
    for _ in range(rounds):
        free = y - trend
        cycle = np.empty(n + 2 * period)
        for m in range(period):
            part = free[m::period]
            cycle[m::period] = _loess(part, seasonal, np.arange(-1.0, len(part) + 1))
        level = _moving(_moving(_moving(cycle, period), period), 3)
        season = cycle[period:n + period] - _loess(level, low, np.arange(float(n)))
        trend = _loess(y - season, span, np.arange(float(n)))
    return trend, season


def decompose(s: DataFrame, period: int = 12) -> DataFrame:
    """Additive components per series; series shorter than two cycles give no rows."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["y"].to_numpy(float)
        if len(y) < 2 * period or not np.isfinite(y).all():
            return pdf.iloc[:0].assign(trend=[], seasonal=[], resid=[])
        trend, season = _stl(y, period)
        return pdf.assign(trend=trend, seasonal=season, resid=y - trend - season)
    return s.select("series_id", "period", "t", "y").groupBy("series_id").applyInPandas(
        one, "series_id string, period date, t int, y double, trend double, seasonal double, resid double")


# --- partial autocorrelation and stationarity ------------------------------------------------------------------------

def partial_autocorrelation(s: DataFrame, lags: int = 36) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion over the autocorrelations, as an array fold.

    One row per series with `lags` numbers; no Python. The 95 % bound is 1.96/√n.
    """
    acf = autocorrelation(s, lags).groupBy("series_id", "n").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r"))
    at = lambda a, i: F.element_at(a, i.cast("int"))
    r = F.col("r")

    def dot(phi: Column, k: Column, other) -> Column:
        return F.aggregate(F.sequence(F.lit(1), k - 1), F.lit(0.0), lambda a, j: a + at(phi, j) * other(j))

    def step(acc: Column, k: Column) -> Column:
        phi = acc["phi"]
        last = F.when(k == 1, at(r, k)).otherwise(
            (at(r, k) - dot(phi, k, lambda j: at(r, k - j))) / (1 - dot(phi, k, lambda j: at(r, j))))
        kept = F.transform(phi, lambda p, j: p - last * at(phi, k - 1 - j))
        return F.struct(F.concat(kept, F.array(last)).alias("phi"), F.concat(acc["pacf"], F.array(last)).alias("pacf"))

    empty = F.array().cast("array<double>")
    folded = acf.withColumn("_p", F.aggregate(
        F.sequence(F.lit(1), F.size("r")), F.struct(empty.alias("phi"), empty.alias("pacf")), step)["pacf"])
    bound = 1.959963984540054 / F.sqrt("n")
    return folded.select("series_id", "n", F.posexplode("_p").alias("_i", "pacf")).select(
        "series_id", (F.col("_i") + 1).alias("lag"), "n", "pacf", bound.alias("bound"), (F.abs("pacf") > bound).alias("excludes_zero"))


# Published critical values of the stationarity test (10, 5, 2.5 and 1 percent).
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def _lag_products(d: DataFrame, limit: Column) -> DataFrame:
    early = d.select("series_id", F.col("_d").alias("_e"), "t", F.explode(F.sequence(F.lit(1), limit)).alias("lag")).withColumn(
        "t", F.col("t") + F.col("lag"))
    return early.join(d.select("series_id", "t", "_d"), ["series_id", "t"]).groupBy("series_id", "lag").agg(
        F.sum(F.col("_d") * F.col("_e")).alias("_p"))


def kpss(s: DataFrame, regression: str = "c") -> DataFrame:
    """Stationarity around a level (c) or line (ct): partial residual sums over a Bartlett long-run variance.

    The lag comes from the data (Hobijn, Franses and Ooms 1998). Windows and equi-joins per series only.
    """
    whole = Window.partitionBy("series_id")
    n = F.count(F.lit(1)).over(whole)
    mean = F.avg("y").over(whole)
    if regression == "ct":
        tbar = F.avg("t").over(whole)
        slope = F.covar_pop("t", "y").over(whole) / F.var_pop("t").over(whole)
        resid = F.col("y") - mean - slope * (F.col("t") - tbar)
    else:
        resid = F.col("y") - mean
    d = s.select("series_id", "t", resid.alias("_d"), n.alias("n"))
    d = d.withColumn("_s", F.sum("_d").over(whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    base = d.groupBy("series_id", "n").agg(F.sum(F.col("_d") * F.col("_d")).alias("_ss"), F.sum(F.col("_s") * F.col("_s")).alias("_eta"))
    base = base.withColumn("_cov", F.greatest(F.lit(1), F.floor(F.pow("n", F.lit(2.0 / 9)))).cast("int"))
    first = _lag_products(d.join(base.select("series_id", "_cov"), "series_id"), F.col("_cov")).groupBy("series_id").agg(
        F.sum("_p").alias("_p1"), F.sum(F.col("lag") * F.col("_p")).alias("_p2"))
    lagged = base.join(first, "series_id").withColumns({
        "_s0": F.col("_ss") / F.col("n") + F.col("_p1") / (F.col("n") / 2), "_s1": F.col("_p2") / (F.col("n") / 2)})
    gamma = 1.1447 * F.pow(F.pow(F.col("_s1") / F.col("_s0"), F.lit(2.0)), F.lit(1.0 / 3))
    lagged = lagged.withColumn("lags", F.least(F.floor(gamma * F.pow("n", F.lit(1.0 / 3))), F.col("n") - 1).cast("int"))
    some = d.join(lagged.where(F.col("lags") > 0).select("series_id", "lags"), "series_id")
    second = _lag_products(some, F.col("lags")).join(lagged.select("series_id", "lags"), "series_id").groupBy("series_id").agg(
        F.sum((1 - F.col("lag") / (F.col("lags") + 1)) * F.col("_p")).alias("_w"))
    out = lagged.join(second, "series_id", "left")
    variance = (F.col("_ss") + 2 * F.coalesce("_w", F.lit(0.0))) / F.col("n")
    stat = F.col("_eta") / (F.col("n") * F.col("n")) / variance
    crit, levels = KPSS_CRITICAL[regression], KPSS_LEVELS
    p = F.when(F.col("statistic") <= crit[0], levels[0])
    for i in range(3):
        part = levels[i] + (F.col("statistic") - crit[i]) * ((levels[i + 1] - levels[i]) / (crit[i + 1] - crit[i]))
        p = p.when(F.col("statistic") <= crit[i + 1], part)
    return out.withColumn("statistic", stat).withColumn("p_value", p.otherwise(levels[3])).select(
        "series_id", F.lit(regression).alias("regression"), "n", "lags", "statistic", "p_value",
        (F.col("p_value") < 0.05).alias("reject_null"))


# Published response-surface coefficients of the unit-root p-value (MacKinnon 1994).
ADF_SURFACE = {
    "c": {"star": -1.61, "low": -18.83, "high": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    "ct": {"star": -2.89, "low": -16.18, "high": 0.70, "small": (3.2512, 1.6047, 0.049588), "large": (2.5261, 0.61654, -0.37956, -0.060285)},
}


def _unit_root_p(stat: float, regression: str) -> float:
    s = ADF_SURFACE[regression]
    if stat > s["high"]:
        return 1.0
    if stat < s["low"]:
        return 0.0
    c = s["small"] if stat <= s["star"] else s["large"]
    z = sum(v * stat ** i for i, v in enumerate(c))
    return 0.5 * (1 + erf(z / sqrt(2)))


def _unit_root(y: np.ndarray, regression: str) -> tuple[float, int, int]:
    """t statistic of the level in the augmented regression, its lag by AIC on a common sample, and rows used."""
    dy = np.diff(y)
    most = min(int(np.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2 - (1 if regression == "c" else 2))

    def fit(k: int, start: int):
        rows = len(dy) - start
        cols = [y[start:-1]] + [dy[start - j:len(dy) - j] for j in range(1, k + 1)] + [np.ones(rows)]
        if regression == "ct":
            cols.append(np.arange(1.0, rows + 1))
        x = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(x, dy[start:], rcond=None)
        e = dy[start:] - x @ beta
        return x, beta, float(e @ e), rows
    def aic(k: int) -> float:
        x, _, ss, rows = fit(k, most)
        return rows * (np.log(2 * np.pi * ss / rows) + 1) + 2 * x.shape[1]
    lag = min(range(max(most, 0) + 1), key=aic)
    x, beta, ss, rows = fit(lag, lag)
    var = ss / (rows - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0]
    return float(beta[0] / np.sqrt(var)), lag, rows


def unit_root(s: DataFrame, regression: str = "c") -> DataFrame:
    """Augmented Dickey-Fuller test per series with the lag chosen by AIC."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["y"].to_numpy(float)
        stat, lag, rows = _unit_root(y, regression) if len(y) > 12 and np.ptp(y) > 0 else (np.nan, 0, len(y))
        p = _unit_root_p(stat, regression) if np.isfinite(stat) else np.nan
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "regression": regression, "n": rows, "lags": lag,
                             "statistic": stat, "p_value": p, "reject_null": bool(p < 0.05)})
    return s.select("series_id", "t", "y").groupBy("series_id").applyInPandas(
        one, "series_id string, regression string, n bigint, lags bigint, statistic double, p_value double, reject_null boolean")


# --- recursive forecasters -----------------------------------------------------------------------------------------------
# A series is months long, so the recursions are folds over one array per series and fold; nothing leaves the JVM.

# Candidate names and what each fits; smoothing is (trend, damped), autoregression its lags in months.
SMOOTHING = {"holt_winters_additive_no_trend": (False, False), "holt_winters_additive_damped_trend": (True, True), "holt_winters_additive_trend": (True, False)}
AUTOREGRESSION = {"autoreg_lag_1_12_ct": (1, 12), "autoreg_lag_1_2_12_ct": (1, 2, 12)}
SEASONAL_ARMA = "sarima_100_011_12"
RECURSIVE = (*SMOOTHING, *AUTOREGRESSION, SEASONAL_ARMA)

# Declared grids of the weights. From the point with the least sum of squared one-step errors the search goes on: one step up or
# down in each weight, steps halved each time, down to 1e-4.
WEIGHTS = (0.05, 0.2, 0.4, 0.6, 0.8)
DAMPING = (0.8, 0.9, 0.98)
ARMA_GRID = tuple(round(-0.9 + 0.15 * i, 2) for i in range(13))
WEIGHT_STEPS, ARMA_STEPS = (tuple(first / 2 ** i for i in range(11)) for first in (0.1, 0.075))
DAMPING_STEP = 0.5  # of the step of a weight
WEIGHT_LIMITS, DAMPING_LIMITS, ARMA_LIMITS = (0.0, 1.0), (0.8, 0.98), (-0.99, 0.99)


def _histories(s: DataFrame, folds: DataFrame, period: int) -> DataFrame:
    """`series_id, fold, cut, ys`: the training values in order. Folds with a missing month or less than two cycles have none."""
    rows = training_rows(s, folds).select(*KEYS, "cut", "t", "y")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda x: x["y"])
    return rows.groupBy(*KEYS, "cut").agg(ordered.alias("ys")).where((F.size("ys") == F.col("cut")) & (F.col("cut") >= 2 * period))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _numbered(values: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))


def _forecast_rows(paths: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of `candidate_id, series_id, fold, path`."""
    long = paths.select("candidate_id", *KEYS, F.posexplode("path").alias("_h", "y_pred")).withColumn("horizon", F.col("_h") + 1)
    return long.join(folds.select(*KEYS, "origin"), KEYS).select(
        "candidate_id", *KEYS, "horizon", F.add_months("origin", F.col("horizon")).alias("period"), "y_pred")


def _refined(best: Column, steps: Sequence[float], moves: Column, trial: Callable[[Column, Column, Column], Column]) -> Column:
    """The point after one round per step: the best of itself and what `trial` makes of each move. Points begin with their error."""
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), best, lambda at, s: F.array_min(
        F.concat(F.array(at), F.transform(moves, lambda m: trial(at, m, s)))))


def _once(value: Column) -> Column:
    """The value as the one row of a generator, so that the optimizer does not copy its expression to every use."""
    return F.explode(F.array(value))


def _limited(x: Column, limits: tuple[float, float]) -> Column:
    return F.least(F.greatest(x, F.lit(limits[0])), F.lit(limits[1]))


def holt_winters(s: DataFrame, folds: DataFrame, horizon: int = 12, period: int = 12) -> DataFrame:
    """Additive smoothing with first-cycle starting values, without, with and with damped trend.

    The weights have the least squared one-step error that the grid and the search from its best point find.
    """
    points = [F.struct(F.lit(name).alias("candidate_id"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g"), F.lit(phi).alias("phi"))
              for name, (trend, damped) in SMOOTHING.items() for a in WEIGHTS for b in (WEIGHTS if trend else (0.0,)) for g in WEIGHTS
              for phi in (DAMPING if damped else (1.0,))]
    base = _histories(s, folds, period).withColumn("_start", _mean(F.slice("ys", 1, period))).withColumn(
        "_rise", (_mean(F.slice("ys", period + 1, period)) - F.col("_start")) / period)
    slope = F.when(F.col("candidate_id") == "holt_winters_additive_no_trend", 0.0).otherwise(F.col("_rise"))
    rows = base.select(*KEYS, "ys", "_start", "_rise", F.inline(F.array(*points))).withColumn("_slope", slope)
    season = F.transform(F.slice("ys", 1, period), lambda v, i: v - F.col("_start") - F.col("_slope") * (i - (period - 1) / 2))

    def fit(a: Column, b: Column, g: Column, phi: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            k = (x["i"] % period).cast("int")
            now, line = acc["season"][k], acc["level"] + phi * acc["step"]
            level = a * (x["v"] - now) + (1 - a) * line
            error = x["v"] - line - now
            return F.struct(
                level.alias("level"), (b * (level - acc["level"]) + (1 - b) * phi * acc["step"]).alias("step"),
                F.transform(acc["season"], lambda v, j: F.when(j == k, g * (x["v"] - line) + (1 - g) * v).otherwise(v)).alias("season"),
                (acc["sse"] + error * error).alias("sse"))
        start = F.struct(F.col("_start").alias("level"), F.col("_slope").alias("step"), season.alias("season"), F.lit(0.0).alias("sse"))
        return F.aggregate(_numbered(F.col("ys")), start, step)

    weights = [F.col(c) for c in ("a", "b", "g", "phi")]
    best = rows.withColumn("_sse", fit(*weights)["sse"]).groupBy("candidate_id", *KEYS).agg(F.min(F.struct(F.col("_sse").alias("sse"), *weights)).alias("m"))

    def moved(*ways: str) -> Column:
        return F.array(*[F.struct(*[F.lit(float(sign) if c == w else 0.0).alias(c) for c in ("a", "b", "g", "phi")]) for w in ways for sign in (-1, 1)])

    def trial(at: Column, m: Column, size: Column) -> Column:
        new = [_limited(at[c] + m[c] * size, WEIGHT_LIMITS) for c in ("a", "b", "g")]
        new.append(F.when(m["phi"] == 0, at["phi"]).otherwise(_limited(at["phi"] + m["phi"] * size * DAMPING_STEP, DAMPING_LIMITS)))
        return F.struct(fit(*new)["sse"].alias("sse"), *[v.alias(c) for v, c in zip(new, ("a", "b", "g", "phi"), strict=True)])

    kind = F.col("candidate_id")
    moves = F.when(kind == "holt_winters_additive_no_trend", moved("a", "g")).when(kind == "holt_winters_additive_trend", moved("a", "b", "g")).otherwise(moved("a", "b", "g", "phi"))
    started = base.join(best, KEYS).withColumn("_slope", slope)
    done = started.withColumn("m", _once(_refined(F.col("m"), WEIGHT_STEPS, moves, trial))).withColumn("_f", _once(fit(*[F.col("m")[c] for c in ("a", "b", "g", "phi")])))
    damped = lambda h: F.aggregate(F.sequence(F.lit(1), h), F.lit(0.0), lambda x, j: x + F.pow(F.col("m.phi"), j))
    path = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.col("_f.level") + damped(h) * F.col("_f.step")
                       + F.col("_f.season")[((F.size("ys") + h - 1) % period).cast("int")])
    return _forecast_rows(done.select("candidate_id", *KEYS, path.alias("path")), folds)


def _solve(matrix: Column, size: int) -> Column:
    """Gauss elimination of an augmented array of rows, without pivoting: for matrices of covariances."""
    def step(m: Column, p: Column) -> Column:
        head = F.transform(m[p], lambda v: F.try_divide(v, m[p][p]))
        return F.transform(m, lambda row, i: F.when(i == p, head).otherwise(F.zip_with(row, head, lambda x, y: x - row[p] * y)))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)
    return F.transform(done, lambda row: row[size])


def _next_month(lags: Sequence[int]) -> Callable[[Column, Column], Column]:
    def ahead(values: Column, h: Column) -> Column:
        terms = [F.col("_b")[i + 1] * F.element_at(values, -k) for i, k in enumerate(lags)]
        return F.concat(values, F.array(sum(terms, F.col("_c") + F.col("_b")[0] * (F.col("cut") + h))))
    return ahead


def autoregression(s: DataFrame, folds: DataFrame, horizon: int = 12, period: int = 12) -> DataFrame:
    """Least squares on lagged months, a constant and the time index, forecast recursively.

    The fit is one aggregate of covariances per series and fold, solved as an array.
    """
    history = _histories(s, folds, period)
    parts = []
    for name, lags in AUTOREGRESSION.items():
        most = max(lags)
        lagged = s.select("series_id", "t", "y", *[months_back("y", k).alias(f"_l{k}") for k in lags])
        rows = lagged.join(folds.select(*KEYS, "cut"), "series_id").where((F.col("t") < F.col("cut")) & (F.col("t") >= most)).withColumn("_t", F.col("t") + 1.0)
        x = ["_t", *[f"_l{k}" for k in lags]]
        sums = rows.groupBy(*KEYS).agg(
            F.array(*[F.array(*[F.covar_pop(i, j) for j in [*x, "y"]]) for i in x]).alias("_m"), F.array(*[F.avg(c) for c in x]).alias("_x"), F.avg("y").alias("_y"))
        fit = history.join(sums, KEYS).withColumn("_b", _solve(F.col("_m"), len(x))).withColumn(
            "_c", F.col("_y") - F.aggregate(F.zip_with("_b", "_x", lambda b, v: b * v), F.lit(0.0), lambda acc, v: acc + v))

        whole = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.slice("ys", -most, most), _next_month(lags))
        parts.append(fit.select(F.lit(name).alias("candidate_id"), *KEYS, F.slice(whole, most + 1, horizon).alias("path")).where(
            F.forall("path", lambda v: v.isNotNull())))
    return _forecast_rows(reduce(DataFrame.unionByName, parts), folds)


def seasonal_arma(s: DataFrame, folds: DataFrame, horizon: int = 12, period: int = 12) -> DataFrame:
    """Seasonal difference with one autoregressive and one seasonal moving-average term: conditional least squares, searched from the
    best point of the grid."""
    points = F.array(*[F.struct(F.lit(p).alias("phi"), F.lit(q).alias("theta")) for p in ARMA_GRID for q in ARMA_GRID])
    base = _histories(s, folds, period).withColumn("_w", F.transform(F.slice("ys", F.lit(period + 1), F.size("ys") - period), lambda v, i: v - F.col("ys")[i]))

    def errors(phi: Column, theta: Column) -> Column:
        def step(known: Column, x: Column) -> Column:
            back = F.when(x["i"] >= period, known[x["i"] - period]).otherwise(0.0)
            error = F.when(x["i"] == 0, 0.0).otherwise(x["v"] - phi * F.col("_w")[x["i"] - 1] - theta * back)
            return F.concat(known, F.array(error))
        return F.aggregate(_numbered(F.col("_w")), F.array().cast("array<double>"), step)

    def squared(phi: Column, theta: Column) -> Column:
        return F.aggregate(errors(phi, theta), F.lit(0.0), lambda a, e: a + e * e)

    rows = base.select(*KEYS, "_w", F.inline(points)).withColumn("_sse", squared(F.col("phi"), F.col("theta")))
    best = rows.groupBy(*KEYS).agg(F.min(F.struct(F.col("_sse").alias("sse"), "phi", "theta")).alias("m"))
    moves = F.array(*[F.struct(F.lit(float(p)).alias("phi"), F.lit(float(q)).alias("theta")) for p, q in ((-1, 0), (1, 0), (0, -1), (0, 1))])

    def trial(at: Column, m: Column, size: Column) -> Column:
        new = [_limited(at[c] + m[c] * size, ARMA_LIMITS) for c in ("phi", "theta")]
        return F.struct(squared(*new).alias("sse"), new[0].alias("phi"), new[1].alias("theta"))

    done = base.join(best, KEYS).withColumn("m", _once(_refined(F.col("m"), ARMA_STEPS, moves, trial)))
    best = done.select(*KEYS, _once(F.struct("m.phi", "m.theta", errors(F.col("m.phi"), F.col("m.theta")).alias("e"), F.col("_w").alias("w"), "ys")).alias("m"))
    n, m = F.size("m.w"), F.col("m")

    def ahead(w: Column, h: Column) -> Column:
        old = F.when(h <= period, m["e"][n + h - 1 - period]).otherwise(0.0)
        return F.concat(w, F.array(m["phi"] * F.element_at(w, -1) + m["theta"] * old))

    steps = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), m["w"], ahead), n + 1, F.lit(horizon))
    level = F.aggregate(_numbered(steps), m["ys"], lambda ys, x: F.concat(ys, F.array(x["v"] + F.element_at(ys, -period))))
    return _forecast_rows(best.select(F.lit(SEASONAL_ARMA).alias("candidate_id"), *KEYS, F.slice(level, F.size(m["ys"]) + 1, F.lit(horizon)).alias("path")), folds)


def recursive_forecasts(s: DataFrame, folds: DataFrame, horizon: int = 12, period: int = 12) -> DataFrame:
    """Forecasts of all recursive candidates; a fold that cannot be fitted has no rows."""
    parts = [f(s, folds, horizon, period) for f in (holt_winters, autoregression, seasonal_arma)]
    return reduce(DataFrame.unionByName, parts)
