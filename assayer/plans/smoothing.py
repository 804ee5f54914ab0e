"""Queries of decomposition, stationarity tests, recursive candidates and the full candidate catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import forecast as fc
from assayer.operators import series as sr
from assayer.operators import smoothing as sm
from assayer.plans.forecasting import FOLDS, HORIZON, INITIAL, MONTHLY, STEP, TOLERANCE, acf_sql, development, monthly_orders
from assayer.plans.registry import query, rounded


@query("k04_decomposition")
def _(spark, sf):
    return rounded(sm.decompose(monthly_orders(spark, sf)))


@query("k05_decomposition_strength")
def _(spark, sf):
    return rounded(sr.component_strength(sm.decompose(monthly_orders(spark, sf))))


@query("k07_partial_autocorrelation", f"""WITH RECURSIVE {MONTHLY}, {acf_sql('monthly', 'series_id', 'y', 36)},
 a AS (SELECT series_id, n, list(acf ORDER BY lag) AS r FROM acf GROUP BY 1, 2),
 dl AS (SELECT series_id, n, r, 1 AS k, [r[1]] AS phi, r[1] AS pacf FROM a
  UNION ALL SELECT series_id, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - x * phi[k + 1 - j]), x), x FROM (
   SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS x FROM dl WHERE k < len(r)))
SELECT series_id, CAST(k AS BIGINT) AS lag, n, round(pacf, 6) + 0.0 AS pacf, round(1.959963984540054 / sqrt(n), 6) + 0.0 AS bound, abs(pacf) > 1.959963984540054 / sqrt(n) AS excludes_zero FROM dl""")
def _(spark, sf):
    return rounded(sm.partial_autocorrelation(monthly_orders(spark, sf), 36))


@query("k09_unit_root")
def _(spark, sf):
    s = monthly_orders(spark, sf)
    return rounded(sm.unit_root(s, "c").unionByName(sm.unit_root(s, "ct")))


def kpss_sql(regression: str) -> str:
    resid = "y - avg(y) OVER w" + (" - covar_pop(y, t) OVER w / var_pop(t) OVER w * (t - avg(t) OVER w)" if regression == "ct" else "")
    crit = (0.347, 0.463, 0.574, 0.739) if regression == "c" else (0.119, 0.146, 0.176, 0.216)
    lev = (0.10, 0.05, 0.025, 0.01)
    cases = " ".join(f"WHEN x <= {crit[i + 1]} THEN {lev[i]} + (x - {crit[i]}) * ({lev[i + 1]} - {lev[i]}) / ({crit[i + 1]} - {crit[i]})" for i in range(3))
    return f"""SELECT series_id, '{regression}' AS regression, n, CAST(lags AS BIGINT) AS lags, round(x, 6) + 0.0 AS statistic, round(p::DOUBLE, 6) + 0.0 AS p_value, p < 0.05 AS reject_null FROM (
 SELECT *, CASE WHEN x <= {crit[0]} THEN 0.10 {cases} ELSE 0.01 END AS p FROM (
 WITH d AS (SELECT series_id, t, {resid} AS d, count(*) OVER w AS n FROM monthly WINDOW w AS (PARTITION BY series_id)),
  b AS (SELECT series_id, n, sum(d * d) AS ss, sum(s * s) AS eta, greatest(1, floor(pow(n, 2.0 / 9))) AS cov FROM (SELECT *, sum(d) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM d) GROUP BY 1, 2),
  pr AS (SELECT x.series_id, y.t - x.t AS lag, sum(x.d * y.d) AS p FROM d x JOIN d y ON x.series_id = y.series_id AND y.t > x.t GROUP BY 1, 2),
  l AS (SELECT b.*, ss / n + sum(p) / (n / 2.0) AS s0, sum(lag * p) / (n / 2.0) AS s1 FROM b JOIN pr ON b.series_id = pr.series_id AND lag <= cov GROUP BY b.series_id, b.n, b.ss, b.eta, b.cov),
  g AS (SELECT *, least(floor(1.1447 * pow(pow(s1 / s0, 2.0), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS lags FROM l)
 SELECT g.series_id, n, lags, any_value(eta) / (n * n) / ((any_value(ss) + 2 * coalesce(sum((1 - lag / (lags + 1)) * p), 0)) / n) AS x FROM g LEFT JOIN pr ON g.series_id = pr.series_id AND lag <= lags GROUP BY 1, 2, 3))"""


@query("k10_kpss", f"WITH {MONTHLY} SELECT * FROM ({kpss_sql('c')}) UNION ALL SELECT * FROM ({kpss_sql('ct')})")
def _(spark, sf):
    s = monthly_orders(spark, sf)
    return rounded(sm.kpss(s, "c").unionByName(sm.kpss(s, "ct")))


def forecasts(spark, sf, fit):
    s = development(spark, sf)
    return rounded(fit(s, fc.expanding_folds(s, INITIAL, HORIZON, STEP), HORIZON))


OUT = "candidate_id, series_id, CAST(fold AS BIGINT) AS fold, CAST(h AS BIGINT) AS horizon, strftime(CAST(origin + to_months(CAST(h AS INT)) AS DATE), '%Y-%m-%d') AS period, round(y_pred, 6) + 0.0 AS y_pred"
WEIGHT_LIST, DAMPING_LIST = (", ".join(map(str, v)) for v in (sm.WEIGHTS, sm.DAMPING))
TRAIN = f"""{FOLDS},
tr AS (SELECT f.series_id, f.fold, f.cut, f.origin, list(d.y ORDER BY d.t) AS ys FROM folds f JOIN dev d ON d.series_id = f.series_id AND d.t < f.cut GROUP BY 1, 2, 3, 4 HAVING count(*) = f.cut)"""


def bounded(x: str, limits: tuple[float, float]) -> str:
    return f"least(greatest({x}, {limits[0]}::DOUBLE), {limits[1]}::DOUBLE)"


def hw_sql(a: str, b: str, g: str, phi: str) -> str:
    """The recursion over the months of `ys` from `l0` and `sl`, as a struct of its last state."""
    line, y, k = f"(s.level + {phi} * s.step)", "x.level", "x.k % 12 + 1"
    now = f"s.season[{k}]"
    level = f"({a} * ({y} - {now}) + (1 - {a}) * {line})"
    season = f"list_transform(s.season, lambda v, j: CASE WHEN j = {k} THEN {g} * ({y} - {line}) + (1 - {g}) * v ELSE v END)"
    return f"""list_reduce(list_transform(ys, lambda v, i: {{'k': i - 1, 'level': v, 'step': 0.0::DOUBLE, 'season': CAST([] AS DOUBLE[]), 'sse': 0.0::DOUBLE}}),
 lambda s, x: {{'k': x.k, 'level': {level}, 'step': {b} * ({level} - s.level) + (1 - {b}) * {phi} * s.step, 'season': {season}, 'sse': s.sse + ({y} - {line} - {now}) * ({y} - {line} - {now})}},
 {{'k': 0::BIGINT, 'level': l0, 'step': sl, 'season': list_transform(range(1, 13), lambda j: ys[j] - l0 - sl * (j - 1 - 5.5)), 'sse': 0.0::DOUBLE}})"""


WAYS = {"holt_winters_additive_no_trend": "ag", "holt_winters_additive_trend": "abg", "holt_winters_additive_damped_trend": "abgp"}
MOVES = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {', '.join(f'{v if c == w else 0}::DOUBLE AS v{c}' for c in 'abgp')}" for kind, ways in WAYS.items()
                           for w, v in [("", 0), *((w, v) for w in ways for v in (-1, 1))])


@query("k18_holt_winters", f"""WITH RECURSIVE {TRAIN},
w AS (SELECT unnest([{WEIGHT_LIST}])::DOUBLE AS w), ph AS (SELECT unnest([{DAMPING_LIST}])::DOUBLE AS phi),
g AS (SELECT 'holt_winters_additive_no_trend' AS candidate_id, a.w AS a, 0.0::DOUBLE AS b, c.w AS g, 1.0::DOUBLE AS phi, 0.0::DOUBLE AS trend FROM w a, w c
 UNION ALL SELECT 'holt_winters_additive_trend', a.w, b.w, c.w, 1.0, 1.0 FROM w a, w b, w c UNION ALL SELECT 'holt_winters_additive_damped_trend', a.w, b.w, c.w, phi, 1.0 FROM w a, w b, w c, ph),
b0 AS (SELECT *, list_avg(ys[1:12]) AS l0, (list_avg(ys[13:24]) - list_avg(ys[1:12])) / 12 AS r0 FROM tr),
st AS (SELECT candidate_id, series_id, fold, a, b, g, phi, 0 AS t, l0 AS level, trend * r0 AS step, list_transform(range(1, 13), lambda j: ys[j] - l0 - trend * r0 * (j - 1 - 5.5)) AS season, 0.0::DOUBLE AS sse FROM b0, g
 UNION ALL SELECT candidate_id, series_id, fold, a, b, g, phi, t + 1, nl, b * (nl - level) + (1 - b) * phi * step, list_transform(range(1, 13), lambda j: CASE WHEN j = t % 12 + 1 THEN g * (y - line) + (1 - g) * season[j] ELSE season[j] END), sse + (y - line - now) ** 2
 FROM (SELECT *, a * (y - now) + (1 - a) * line AS nl FROM (SELECT st.*, tr.ys[t + 1] AS y, level + phi * step AS line, season[t % 12 + 1] AS now FROM st JOIN tr ON tr.series_id = st.series_id AND tr.fold = st.fold AND t < tr.cut))),
be AS (SELECT st.*, row_number() OVER (PARTITION BY candidate_id, st.series_id, st.fold ORDER BY sse, a, b, g, phi) AS i FROM st JOIN tr ON tr.series_id = st.series_id AND tr.fold = st.fold AND st.t = tr.cut),
hb AS (SELECT be.candidate_id, b0.*, CASE WHEN candidate_id = 'holt_winters_additive_no_trend' THEN 0.0 ELSE r0 END AS sl, be.a, be.b, be.g, be.phi, be.sse FROM be JOIN b0 ON b0.series_id = be.series_id AND b0.fold = be.fold WHERE i = 1),
mv AS ({MOVES}),
rf AS (SELECT candidate_id, series_id, fold, 0 AS r, {{'sse': sse, 'a': a, 'b': b, 'g': g, 'phi': phi}} AS m FROM hb
 UNION ALL SELECT candidate_id, series_id, fold, r + 1, min({{'sse': CASE WHEN va = 0 AND vb = 0 AND vg = 0 AND vp = 0 THEN m.sse ELSE {hw_sql('na', 'nb', 'ng', 'np')}.sse END, 'a': na, 'b': nb, 'g': ng, 'phi': np}}) FROM (
  SELECT rf.*, hb.ys, hb.l0, hb.sl, mv.* EXCLUDE (kind), {bounded('m.a + va * 0.1 / 2 ** r', sm.WEIGHT_LIMITS)} AS na, {bounded('m.b + vb * 0.1 / 2 ** r', sm.WEIGHT_LIMITS)} AS nb, {bounded('m.g + vg * 0.1 / 2 ** r', sm.WEIGHT_LIMITS)} AS ng,
   CASE WHEN vp = 0 THEN m.phi ELSE {bounded('m.phi + vp * (0.1 / 2 ** r) * 0.5', sm.DAMPING_LIMITS)} END AS np
  FROM rf JOIN hb ON hb.candidate_id = rf.candidate_id AND hb.series_id = rf.series_id AND hb.fold = rf.fold JOIN mv ON mv.kind = rf.candidate_id WHERE r < {len(sm.WEIGHT_STEPS)}) GROUP BY 1, 2, 3, 4),
fi AS (SELECT rf.candidate_id, hb.series_id, hb.fold, hb.origin, hb.cut, m.phi AS phi, {hw_sql('m.a', 'm.b', 'm.g', 'm.phi')} AS f FROM rf JOIN hb ON hb.candidate_id = rf.candidate_id AND hb.series_id = rf.series_id AND hb.fold = rf.fold WHERE r = {len(sm.WEIGHT_STEPS)}),
fo AS (SELECT *, f.level + list_sum(list_transform(range(1, h + 1), lambda j: phi ** j)) * f.step + f.season[(cut + h - 1) % 12 + 1] AS y_pred FROM (SELECT *, unnest(range(1, 13)) AS h FROM fi))
SELECT {OUT} FROM fo""")
def _(spark, sf):
    return forecasts(spark, sf, sm.holt_winters)


def autoregression_sql(name: str, lags: tuple[int, ...]) -> str:
    """Least squares by making the regressors orthogonal one after the other, then a recursion over the future months."""
    x = ["tt", *[f"l{k}" for k in lags]]
    w = "(PARTITION BY series_id, fold)"
    ctes = [f"""r0 AS (SELECT f.series_id, f.fold, f.cut, d.t + 1.0::DOUBLE AS tt, d.y, {', '.join(f'p{k}.y AS l{k}' for k in lags)} FROM folds f JOIN dev d ON d.series_id = f.series_id AND d.t < f.cut AND d.t >= {max(lags)}
 {' '.join(f'JOIN dev p{k} ON p{k}.series_id = d.series_id AND p{k}.t = d.t - {k}' for k in lags)})""",
            f"z0 AS (SELECT *, {', '.join(f'{c} - avg({c}) OVER {w} AS c_{c}, avg({c}) OVER {w} AS m_{c}' for c in [*x, 'y'])} FROM r0)"]
    for i, c in enumerate(x):
        rest = [*x[i + 1:], "y"]
        slopes = ", ".join(f"sum(c_{d} * c_{c}) OVER {w} / sum(c_{c} * c_{c}) OVER {w} AS s_{d}_{c}" for d in rest)
        ctes.append(f"z{i}s AS (SELECT *, {slopes} FROM z{i})")
        ctes.append(f"z{i + 1} AS (SELECT * REPLACE ({', '.join(f'c_{d} - s_{d}_{c} * c_{c} AS c_{d}' for d in rest)}) FROM z{i}s)")
    k = len(x)
    ctes.append(f"o{k} AS (SELECT DISTINCT ON (series_id, fold) * FROM z{k})")
    done: list[str] = []
    for i in reversed(range(k)):
        later = "".join(f" - s_{x[j]}_{x[i]} * b_{x[j]}" for j in range(i + 1, k))
        ctes.append(f"o{i} AS (SELECT *, s_y_{x[i]}{later} AS b_{x[i]} FROM o{i + 1})")
        done.append(f"b_{x[i]} * m_{x[i]}")
    ctes.append(f"co AS (SELECT o.*, m_y - ({' + '.join(done)}) AS c0, tr.ys, tr.origin FROM o0 o JOIN tr USING (series_id, fold))")
    terms = " + ".join(f"b_l{j} * v[len(v) + 1 - {j}]" for j in lags)
    ctes.append(f"""pa AS (SELECT series_id, fold, cut, origin, c0, b_tt, {', '.join(f'b_l{j}' for j in lags)}, 0::BIGINT AS h, ys AS v, 0.0::DOUBLE AS y_pred FROM co
 UNION ALL SELECT series_id, fold, cut, origin, c0, b_tt, {', '.join(f'b_l{j}' for j in lags)}, h + 1, list_append(v, n), n FROM (SELECT *, c0 + b_tt * (cut + h + 1) + {terms} AS n FROM pa WHERE h < 12))""")
    return f"SELECT * FROM (WITH RECURSIVE {', '.join(ctes)} SELECT '{name}' AS candidate_id, series_id, fold, h, origin, y_pred FROM pa WHERE h > 0)"


@query("k19_autoregression", f"WITH {TRAIN} SELECT {OUT} FROM ({' UNION ALL '.join(autoregression_sql(n, k) for n, k in sm.AUTOREGRESSION.items())})")
def _(spark, sf):
    return forecasts(spark, sf, sm.autoregression)


def arma_sql(phi: str, theta: str) -> str:
    """Errors of the months of `w`, in order."""
    error = f"CASE WHEN x.k = 1 THEN 0.0 ELSE x.e[1] - {phi} * w[x.k - 1] - {theta} * CASE WHEN x.k > 12 THEN s.e[x.k - 12] ELSE 0.0 END END"
    return f"list_reduce(list_transform(w, lambda v, i: {{'k': i, 'e': [v]}}), lambda s, x: {{'k': x.k, 'e': list_append(s.e, {error})}}, {{'k': 0::BIGINT, 'e': CAST([] AS DOUBLE[])}}).e"


ARMA_LIST = ", ".join(map(str, sm.ARMA_GRID))


@query("k20_seasonal_arma", f"""WITH RECURSIVE {TRAIN}, g AS (SELECT a.v AS phi, b.v AS theta FROM (SELECT unnest([{ARMA_LIST}])::DOUBLE AS v) a, (SELECT unnest([{ARMA_LIST}])::DOUBLE AS v) b),
w AS (SELECT series_id, fold, cut, origin, ys, list_transform(range(13, cut + 1), lambda j: ys[j] - ys[j - 12]) AS w FROM tr),
er AS (SELECT series_id, fold, cut, phi, theta, 1::BIGINT AS k, [0.0::DOUBLE] AS e FROM w, g
 UNION ALL SELECT er.series_id, er.fold, er.cut, phi, theta, k + 1, list_append(e, w.w[k + 1] - phi * w.w[k] - theta * CASE WHEN k >= 12 THEN e[k - 11] ELSE 0 END) FROM er JOIN w ON w.series_id = er.series_id AND w.fold = er.fold AND k < len(w.w)),
bg AS (SELECT *, list_sum(list_transform(e, lambda x: x * x)) AS sse FROM er WHERE k = cut - 12),
mv AS (SELECT * FROM (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) AS v(vp, vt)),
rf AS (SELECT series_id, fold, 0 AS r, min({{'sse': sse, 'phi': phi, 'theta': theta}}) AS m FROM bg GROUP BY 1, 2
 UNION ALL SELECT series_id, fold, r + 1, min({{'sse': CASE WHEN vp = 0 AND vt = 0 THEN m.sse ELSE list_sum(list_transform({arma_sql('np', 'nt')}, lambda q: q * q)) END, 'phi': np, 'theta': nt}}) FROM (
  SELECT rf.*, w.w, vp, vt, {bounded('m.phi + vp * 0.075 / 2 ** r', sm.ARMA_LIMITS)} AS np, {bounded('m.theta + vt * 0.075 / 2 ** r', sm.ARMA_LIMITS)} AS nt FROM rf JOIN w ON w.series_id = rf.series_id AND w.fold = rf.fold, mv WHERE r < {len(sm.ARMA_STEPS)}) GROUP BY 1, 2, 3),
be AS (SELECT w.series_id, w.fold, w.cut, m.phi AS phi, m.theta AS theta, {arma_sql('m.phi', 'm.theta')} AS e, 1 AS i FROM rf JOIN w ON w.series_id = rf.series_id AND w.fold = rf.fold WHERE r = {len(sm.ARMA_STEPS)}),
pa AS (SELECT b.series_id, b.fold, b.cut, w.origin, phi, theta, e, 0::BIGINT AS h, w.w AS v, w.ys AS y, 0.0::DOUBLE AS y_pred FROM be b JOIN w ON w.series_id = b.series_id AND w.fold = b.fold WHERE i = 1
 UNION ALL SELECT series_id, fold, cut, origin, phi, theta, e, h + 1, list_append(v, n), list_append(y, n + y[len(y) - 11]), n + y[len(y) - 11] FROM (SELECT *, phi * v[len(v)] + theta * CASE WHEN h < 12 THEN e[len(e) + h + 1 - 12] ELSE 0 END AS n FROM pa WHERE h < 12))
SELECT {OUT} FROM (SELECT 'sarima_100_011_12' AS candidate_id, * FROM pa WHERE h > 0)""")
def _(spark, sf):
    return forecasts(spark, sf, sm.seasonal_arma)


@query("k24_full_catalogue")
def _(spark, sf):
    s = development(spark, sf)
    folds = fc.expanding_folds(s, INITIAL, HORIZON, STEP)
    all_ = fc.closed_form_forecasts(s, folds, HORIZON).unionByName(sm.recursive_forecasts(s, folds, HORIZON))
    ev = fc.evidence(all_, s, folds, fc.mase_scale(s, folds))
    eligible = fc.fold_audit(ev, folds, HORIZON).select("series_id", "candidate_id", "eligible")
    metrics = fc.backtest_metrics(ev).join(eligible, ["series_id", "candidate_id"])
    return rounded(fc.select_candidate(metrics, TOLERANCE))
