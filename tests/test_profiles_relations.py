import math

import numpy as np
from pyspark.sql import functions as F

from assayer.operators import association as ac
from assayer.operators import leakage as lk
from assayer.operators import profile as pr
from assayer.operators import structure as st
from assayer.operators import target as tg


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_numeric_profile_small_and_constant(spark):
    df = spark.createDataFrame([("1", 5.0), ("2", 5.0), ("2", 5.0), ("3", None), ("100", float("nan")), (" ", 5.0), ("x", 5.0)], "v string, c double")
    p = by(pr.numeric_profile(df, ["v", "c"]), "feature")
    assert (p["v"].valid, p["v"].blank_count, p["v"].non_numeric_count, p["c"].missing_count, p["c"].unique_count) == (5, 1, 1, 2, 1)
    assert abs(p["v"].skewness - 2.23461) < 1e-5 and p["v"]["shape"] == "Right-skewed"
    assert p["c"].skewness is None and p["c"]["shape"] == "Unavailable"
    assert by(pr.outlier_summary(df, ["v", "c"]), "feature")["v"].upper_count == 1


def test_category_ranks_and_roles(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", "B ", "a", "b", None, " "])], "pos int, c string")
    f = by(pr.category_frequency(df, ["c"], "pos"), "category")
    assert [(f[k]["rank"], f[k].dominant) for k in ("b", "a", "B ")] == [(1, True), (2, True), (3, False)]
    s = pr.category_summary(df, ["c"], "pos").first()
    assert (s.mode, s.mode_ties, s.inconsistent_labels, s.missing_count, s.blank_count) == ("b", 2, 1, 1, 1)
    d = by(pr.class_distribution(df.where("c in ('a', 'b')"), "c", ["a", "b", "z"], "a"), "class")
    assert [d[k].role for k in ("a", "b", "z")] == ["Tied / Positive", "Tied / Negative", "Absent expected / Negative"]


def test_histogram_closes_last_bin(spark):
    h = pr.histogram(spark.createDataFrame([(float(i),) for i in range(11)], "x double"), "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 3]


def test_pairs_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 300).astype(float)
    y = x * 2 + rng.integers(0, 4, 300)
    rows = [(float(a), float(b) if i % 9 else None, 1.0) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, k double")
    p = {(r.feature_a, r.feature_b): r for r in ac.numeric_pairs(df, ["x", "y", "k"]).collect()}
    keep = np.array([i % 9 != 0 for i in range(300)])
    rank = lambda v: np.array([np.mean(np.flatnonzero(np.sort(v) == e)) for e in v])
    assert abs(p["x", "y"].pearson - np.corrcoef(x[keep], y[keep])[0, 1]) < 1e-9
    assert abs(p["x", "y"].spearman - np.corrcoef(rank(x[keep]), rank(y[keep]))[0, 1]) < 1e-9
    assert p["x", "k"].pearson is None and p["x", "k"].spearman is None and not p["x", "k"].strong


def test_structural_categories_and_both_directions(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "y")], "p string, q string")
    m = ac.categorical_pairs(df, ["p", "q"]).first()
    assert abs(m.cramers_v - 1) < 1e-12 and abs(m.u_b_given_a - 1) < 1e-12 and m.u_a_given_b < 1 and m.structural and not m.redundant
    f = {(r.determinant, r.dependent): r.holds for r in ac.functional_dependencies(df, [("p", "q"), ("q", "p")]).collect()}
    assert f == {("p", "q"): True, ("q", "p"): False}


def test_binary_target_measures(spark):
    df = spark.createDataFrame([(1.0, "g", "No"), (2.0, "g", "No"), (3.0, "h", "Yes"), (5.0, "h", "Yes")], "v double, c string, t string")
    b = tg.binary_numeric(df, ["v"], "t", "Yes").first()
    assert b.mean_difference == 2.5 and abs(b.cohens_d - 2.5 / math.sqrt((0.5 + 2) / 2)) < 1e-9
    r = by(tg.category_rates(df, ["c"], "t", "Yes"), "category")
    assert r["h"].rate == 1.0 and r["h"].odds_ratio == 25.0 and r["h"].wilson_high == 1.0


def test_leakage_ladder(spark):
    df = spark.createDataFrame([("1", "yes", "A", "No"), ("2", "no", "B", "Yes"), ("3", "yes", "C", "No"), ("4", "no", "D", "Yes")],
                               "id string, flip string, uniq string, t string")
    df = df.withColumns({"copy": F.col("t"), "shout": F.upper("t"), "bit": F.when(F.col("t") == "Yes", "1").otherwise("0")})
    m = {k: r.method for k, r in by(lk.target_proxies(df, ["id", "flip", "uniq", "copy", "shout", "bit"], "t", ["id"]), "field").items()}
    assert m == {"id": "None", "flip": "Bidirectional target mapping", "uniq": "None", "copy": "Exact target copy",
                 "shout": "Normalized target copy", "bit": "Binary target encoding"}


def test_curvature_interaction_and_components(spark):
    rng = np.random.default_rng(4)
    x, z = rng.uniform(-2, 2, 225), rng.uniform(-2, 2, 225)
    df = spark.createDataFrame([(float(a), float(b), float(4 + 2.5 * a * a + .2 * b), float(3 + a + .5 * b + 4 * a * b)) for a, b in zip(x, z)],
                               "x double, z double, bent double, crossed double")
    c = by(st.curvature(df, ["x", "z"], "bent"), "feature")
    assert c["x"].signal and not c["z"].signal
    zx = (x - x.mean()) / x.std()
    fit = np.column_stack([np.ones(225), zx, zx ** 2])
    y = 4 + 2.5 * x * x + .2 * z
    e = y - fit @ np.linalg.lstsq(fit, y, rcond=None)[0]
    assert abs(c["x"].quadratic_r2 - (1 - (e @ e) / ((y - y.mean()) ** 2).sum())) < 1e-9
    i = st.interactions(df, ["x", "z"], "crossed").first()
    y2 = 3 + x + .5 * z + 4 * x * z
    zz = (z - z.mean()) / z.std()
    base = np.column_stack([np.ones(225), zx, zx ** 2, zz, zz ** 2])
    e2 = y2 - base @ np.linalg.lstsq(base, y2, rcond=None)[0]
    assert abs(i.base_r2 - (1 - (e2 @ e2) / ((y2 - y2.mean()) ** 2).sum())) < 1e-9 and abs(i.interaction_r2 - 1) < 1e-9 and i.signal
    p = st.two_components(df, ["x", "z", "bent"], ["x"]).first()
    m = np.column_stack([x, z, y])
    share = np.linalg.eigvalsh(np.corrcoef(m.T))[::-1] / 3
    assert abs(p.pc1_share - share[0]) < 1e-9 and abs(p.pc2_share - share[1]) < 1e-9


def test_class_overlap_of_separate_classes(spark):
    rows = [(k, float(v + o), float(v)) for k, o in (("A", 0), ("B", 0), ("C", 100)) for v in range(4)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    o = {(r.class_a, r.class_b): r for r in st.class_overlap(st.class_profiles(df, ["x", "y"], "k")).collect()}
    assert o["A", "B"].mean_overlap == 1.0 and o["A", "C"].overlap_features == 1 and o["A", "C"].rms_median_gap > o["A", "B"].rms_median_gap


def test_ranks_of_few_values_are_broadcast_and_no_pair_is_counted(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(5)
    gap = lambda x, p: np.where(rng.random(len(x)) < p, np.nan, x)
    n = 400
    data = pd.DataFrame({"a": gap(rng.integers(0, 4, n) * 1.0, 0.1), "b": gap(rng.integers(0, 60, n) - 30.0, 0.2), "t": gap(rng.normal(size=n).round(2), 0.05), "one": gap(np.ones(n), 0.5), "none": np.nan})
    data["b"] += data["t"].fillna(0).round()
    df = spark.createDataFrame(data).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in data.columns]).repartition(3)
    pairs = [(F.col(x), F.col(y), x, y) for x, y in (("a", "b"), ("a", "t"), ("t", "b"), ("t", "a"), ("one", "t"), ("none", "t"))]
    monkeypatch.setattr(ac, "FEW", 20)
    out = {(r.feature_a, r.feature_b): r for r in ac.spearman_pairs(df, pairs=pairs).collect()}
    assert set(out) == {p[2:] for p in pairs if "none" not in p[2:]}
    for (x, y), r in out.items():
        both = data[[x, y]].dropna()
        want = None if x == "one" else np.corrcoef(both[x].rank(), both[y].rank())[0, 1]
        assert r.valid_rows == len(both) and (r.spearman == want or abs(r.spearman - want) < 1e-12)
    monkeypatch.setattr(ac, "FEW", 10_000)
    plan = tg.continuous_numeric(df, ["a", "b"], "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
