"""Class profile and regression structure queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from assayer.operators import structure as st
from assayer.plans.registry import R, query, rounded
from assayer.plans.target import DIMS, EMB, vectors
from assayer.sources.tables import table

# One more feature has no spread between its quartiles.
PROFILES = f"""{EMB.replace("elong AS (", "elong AS (SELECT vec_id, label, 'flat' AS feature, CASE WHEN vec_id % 10 = 0 THEN 1.0 ELSE 0.0 END AS value FROM em UNION ALL ")},
 gl AS (SELECT feature, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM elong GROUP BY 1),
 cp AS (SELECT feature, label AS class, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM elong GROUP BY 1, 2),
 pf AS (SELECT cp.*, q3 - q1 AS iqr, CASE WHEN w <> 0 THEN (median - m) / w END AS robust_median, CASE WHEN w = 0 THEN 'Zero interquartile range' END AS issue FROM cp JOIN gl USING (feature))"""


def profiles(spark, sf):
    flat = F.when(F.col("vec_id") % 10 == 0, 1.0).otherwise(0.0)
    return st.class_profiles(vectors(spark, sf).withColumn("flat", flat), [*DIMS, "flat"], "label")


@query("g01_class_profiles", f"WITH {PROFILES} SELECT feature, class, n, {R('mean', 'q1', 'median', 'q3', 'iqr', 'robust_median')}, issue FROM pf")
def _(spark, sf):
    return rounded(profiles(spark, sf))


@query("g02_class_overlap", f"""WITH {PROFILES},
 j AS (SELECT a.class AS class_a, b.class AS class_b, a.robust_median - b.robust_median AS gap, a.issue, CASE WHEN a.iqr <= 0 OR b.iqr <= 0 THEN CASE WHEN greatest(a.q1, b.q1) <= least(a.q3, b.q3) THEN 1.0 ELSE 0.0 END
   ELSE greatest(0, least(a.q3, b.q3) - greatest(a.q1, b.q1)) / least(a.iqr, b.iqr) END AS o FROM pf a JOIN pf b ON a.feature = b.feature AND a.class < b.class)
SELECT class_a, class_b, round(sqrt(avg(gap * gap)), 6) + 0.0 AS rms_median_gap, round(avg(o) FILTER (issue IS NULL), 6) + 0.0 AS mean_overlap, count(*) FILTER (issue IS NULL AND o > 0) AS overlap_features, count(*) FILTER (issue IS NULL AND o <= 0) AS separate_features,
 count(*) FILTER (issue IS NULL) AS features, count(*) FILTER (issue IS NOT NULL) AS blocked_features FROM j GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(st.class_overlap(profiles(spark, sf)))


@query("g03_two_components")
def _(spark, sf):
    return rounded(st.two_components(vectors(spark, sf), DIMS, ["vec_id", "label"]))


H_FEATURES = ["l_quantity", "l_discount", "l_tax"]
H_SOURCE = """
 hs AS (SELECT l_extendedprice + 300 * (l_quantity - 25) * (l_quantity - 25) * l_tax AS y, l_quantity, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS l_discount, l_tax FROM lineitem)"""


def curved(spark, sf):
    q = F.col("l_quantity") - 25
    return table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") + 300 * q * q * F.col("l_tax")).alias("y"), "l_quantity",
        F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("l_discount"), "l_tax")


def curve_sql(f):
    return f"""SELECT '{f}' AS feature, count(*) AS n, corr(z, y) AS a, corr(z * z, y) AS b, corr(z, z * z) AS c FROM (SELECT y, ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS z FROM hs WHERE {f} IS NOT NULL)"""


@query("h01_curvature", f"""WITH {H_SOURCE}, c AS ({' UNION ALL '.join(curve_sql(f) for f in H_FEATURES)}),
 r AS (SELECT *, a * a AS lr, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS qr FROM c), d AS (SELECT *, 1 - (1 - lr) * (n - 1) / (n - 2) AS la, 1 - (1 - qr) * (n - 1) / (n - 3) AS qa FROM r)
SELECT feature, n AS valid_rows, (SELECT count(*) FROM hs) - n AS excluded_rows, round(lr, 6) + 0.0 AS linear_r2, round(qr, 6) + 0.0 AS quadratic_r2, round(la, 6) + 0.0 AS linear_adjusted, round(qa, 6) + 0.0 AS quadratic_adjusted, round(qa - la, 6) + 0.0 AS gain, qa - la >= 0.02 AS signal FROM d""")
def _(spark, sf):
    return rounded(st.curvature(curved(spark, sf), H_FEATURES, "y"))


def interaction_sql() -> str:
    """Regressors are made orthogonal one after the other; what each then explains adds up."""
    w = "OVER (PARTITION BY feature_a, feature_b)"
    z = lambda f, a, b: f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER ()"
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {z(a, a, b)} AS z1, {z(b, a, b)} AS z2, y FROM hs WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combinations(H_FEATURES, 2))
    t = [f"t{i}" for i in range(5)]
    ctes = [f"z AS ({rows})", "q AS (SELECT feature_a, feature_b, z1 AS t0, z1 * z1 AS t1, z2 AS t2, z2 * z2 AS t3, z1 * z2 AS t4, y FROM z)",
            f"o0 AS (SELECT feature_a, feature_b, {', '.join(f'{c} - avg({c}) {w} AS {c}' for c in [*t, 'y'])} FROM q)"]
    for i, c in enumerate(t[:-1]):
        ctes.append(f"o{i + 1} AS (SELECT * REPLACE ({', '.join(f'{d} - sum({d} * {c}) {w} / sum({c} * {c}) {w} * {c} AS {d}' for d in t[i + 1:])}) FROM o{i})")
    part = [f"sum(y * {c}) ** 2 / sum({c} * {c})" for c in t]
    ctes.append(f"r AS (SELECT feature_a, feature_b, count(*) AS n, ({' + '.join(part[:4])}) / sum(y * y) AS br, ({' + '.join(part)}) / sum(y * y) AS ir FROM o4 GROUP BY 1, 2)")
    return (f"WITH {H_SOURCE}, {', '.join(ctes)}, g AS (SELECT *, (1 - (1 - ir) * (n - 1) / (n - 6)) - (1 - (1 - br) * (n - 1) / (n - 5)) AS gain FROM r) "
            "SELECT feature_a, feature_b, n, round(br, 6) + 0.0 AS base_r2, round(ir, 6) + 0.0 AS interaction_r2, round(gain, 6) + 0.0 AS gain, gain >= 0.02 AS signal FROM g")


@query("h02_interactions", interaction_sql())
def _(spark, sf):
    return rounded(st.interactions(curved(spark, sf), H_FEATURES, "y"))
