"""Class profiles and the structure of regressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import clean, guarded_ratio, long_form, quantiles, rows_of, spread, to_text


def class_profiles(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Mean, quartiles and robust distance (class median - median) / IQR of each feature per class.

    A feature whose overall IQR is zero has no such distance; `issue` says so.
    """
    long = long_form(df.select(to_text(target).alias("class"), *features), ["class"], features).where(
        F.col("value").isNotNull() & F.col("class").isNotNull())
    probs = [0.25, 0.5, 0.75]
    whole = quantiles(long, ["feature"], "value", probs, few_groups=True).select(
        "feature", F.col("qs")[1].alias("_m"), (F.col("qs")[2] - F.col("qs")[0]).alias("_w"))
    mean = long.groupBy("feature", "class").agg(F.avg("value").alias("mean"))
    per = quantiles(long, ["feature", "class"], "value", probs)
    return per.join(F.broadcast(whole), "feature").join(mean, ["feature", "class"]).select(
        "feature", "class", "n", "mean", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("median"), F.col("qs")[2].alias("q3"),
        (F.col("qs")[2] - F.col("qs")[0]).alias("iqr"),
        guarded_ratio(F.col("qs")[1] - F.col("_m"), F.col("_w")).alias("robust_median"),
        F.when(F.col("_w") == 0, "Zero interquartile range").alias("issue"))


def class_overlap(profiles: DataFrame) -> DataFrame:
    """Class pairs: root mean square gap of the robust medians and overlap of the interquartile ranges.

    Features with an issue are left out and counted as `blocked_features`. The profile table has one row per feature and class, so pairing classes is bounded by the class list.
    """
    a = profiles.select("feature", "issue", *[F.col(c).alias(f"_a_{c}") for c in ("class", "q1", "q3", "robust_median")])
    b = profiles.select("feature", *[F.col(c).alias(f"_b_{c}") for c in ("class", "q1", "q3", "robust_median")])
    j = a.join(b, "feature").where(F.col("_a_class") < F.col("_b_class"))
    lo, hi = F.greatest("_a_q1", "_b_q1"), F.least("_a_q3", "_b_q3")
    wa, wb = F.col("_a_q3") - F.col("_a_q1"), F.col("_b_q3") - F.col("_b_q1")
    inside = F.when(lo <= hi, 1.0).otherwise(0.0)
    overlap = F.when((wa <= 0) | (wb <= 0), inside).otherwise(F.greatest(F.lit(0.0), hi - lo) / F.least(wa, wb))
    gap, fine = F.col("_a_robust_median") - F.col("_b_robust_median"), F.col("issue").isNull()
    return j.groupBy(F.col("_a_class").alias("class_a"), F.col("_b_class").alias("class_b")).agg(
        F.sqrt(F.avg(F.when(fine, gap * gap))).alias("rms_median_gap"), F.avg(F.when(fine, overlap)).alias("mean_overlap"),
        F.count_if(fine & (overlap > 0)).alias("overlap_features"), F.count_if(fine & (overlap <= 0)).alias("separate_features"),
        F.count_if(fine).alias("features"), F.count_if(~fine).alias("blocked_features"))


def two_components(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Two principal components of the standardised features with their explained share.

    Signs are fixed: the largest loading of a component is positive. Only the feature-by-feature
    loadings, bounded by the schema, pass the driver.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    # One array, not many columns: constraints on many derived columns are slow to plan.
    whole = df.select(*keep, F.array(*[clean(f) for f in features]).alias("_a")).where(F.forall("_a", lambda x: x.isNotNull()))
    rows = whole.select(*keep, array_to_vector("_a").alias("_v"))
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="_z", outputCol="_p").fit(scaled)
    load = model.pc.toArray()
    share = [float(x) for x in model.explainedVariance]
    sign = [float(np.sign(load[np.argmax(np.abs(load[:, k])), k])) for k in range(2)]
    # The scaler divides by the sample deviation; the scores are those of the population deviation.
    n = rows.count()
    score = lambda k: F.col("_s")[k] * (sign[k] * (n / max(n - 1, 1)) ** 0.5)
    return model.transform(scaled).select(*keep, vector_to_array("_p").alias("_s")).select(
        *keep, score(0).alias("pc1"), score(1).alias("pc2"), F.lit(share[0]).alias("pc1_share"), F.lit(share[1]).alias("pc2_share"))


def _finite(c: str) -> Column:
    return F.when(F.abs(clean(c)) != float("inf"), clean(c))


def _adjusted(r2: Column, n: Column, k: int) -> Column:
    return 1 - (1 - r2) * (n - 1) / (n - k - 1)


def curvature(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.02) -> DataFrame:
    """Linear against quadratic fit of each standardised feature in closed form from three correlations.

    First aggregate: mean and population deviation; second: the correlations of y, z and z².
    """
    base = spread(df.select(_finite(target).alias("_y"), *[_finite(f).alias(f) for f in features]))
    on = lambda f, c: F.when(F.col(f).isNotNull() & F.col("_y").isNotNull(), c)
    fit = F.broadcast(base.agg(*[x for f in features for x in (
        F.avg(on(f, F.col(f))).alias(f"_m_{f}"), F.stddev_pop(on(f, F.col(f))).alias(f"_s_{f}"),
        F.min(on(f, F.col(f))).alias(f"_lo_{f}"), F.max(on(f, F.col(f))).alias(f"_hi_{f}"))]))
    joined = base.join(fit)
    aggs, rows = [F.count(F.lit(1)).alias("row_count")], []
    for i, f in enumerate(features):
        between = F.count_if(on(f, (F.col(f) > F.col(f"_lo_{f}")) & (F.col(f) < F.col(f"_hi_{f}"))))
        z, y = on(f, guarded_ratio(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}"))), on(f, F.col("_y"))
        corr = lambda a, b: guarded_ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        zy = F.when(z.isNotNull(), y)
        aggs += [F.count(y).alias(f"_n{i}"), between.alias(f"_d{i}"), corr(z, zy).alias(f"_a{i}"),
                 corr(z * z, zy).alias(f"_b{i}"), corr(z, z * z).alias(f"_c{i}")]
        n, a, b, c = (F.col(f"_{k}{i}") for k in ("n", "a", "b", "c"))
        ok = (n >= 5) & (F.col(f"_d{i}") > 0)  # a value between the extremes: at least three distinct
        linear = F.when(ok, a * a)
        quad = F.when(ok, guarded_ratio(a * a + b * b - 2 * a * b * c, 1 - c * c))
        gain = _adjusted(quad, n, 2) - _adjusted(linear, n, 1)
        rows.append({"feature": F.lit(f), "valid_rows": n, "excluded_rows": F.col("row_count") - n, "linear_r2": linear,
                     "quadratic_r2": quad, "linear_adjusted": _adjusted(linear, n, 1), "quadratic_adjusted": _adjusted(quad, n, 2),
                     "gain": gain, "signal": F.coalesce(gain >= threshold, F.lit(False))})
    return rows_of(joined.agg(*aggs), rows)


def _without(matrix: Column, p: int) -> Column:
    """Covariances of what is left of all columns after regression on column p; a column without any of its own changes nothing."""
    pivot = matrix[p][p]
    left = F.transform(matrix, lambda row: F.zip_with(row, matrix[p], lambda x, y: x - row[p] / pivot * y))
    return F.when(pivot > 1e-10, left).otherwise(matrix)


def interactions(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.02) -> DataFrame:
    """Adjusted-R² gain of z1·z2 over z1, z1², z2, z2². One aggregate builds the covariances per pair over already
    standardised columns; partial covariances of one small array per pair give both fits."""
    base = spread(df.select(_finite(target).alias("_y"), *[_finite(f).alias(f) for f in features]))
    pairs = list(combinations(features, 2))
    ok = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("_y").isNotNull()
    fit = F.broadcast(base.agg(*[x for i, (a, b) in enumerate(pairs) for k, c in (("a", a), ("b", b)) for x in (
        F.avg(F.when(ok(a, b), F.col(c))).alias(f"_m{k}{i}"), F.stddev_pop(F.when(ok(a, b), F.col(c))).alias(f"_s{k}{i}"))]))
    z = lambda k, c, i: guarded_ratio(F.col(c) - F.col(f"_m{k}{i}"), F.col(f"_s{k}{i}"))
    long = base.join(fit).select("_y", F.inline(F.array(*[F.struct(
        F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.when(ok(a, b), z("a", a, i)).alias("t0"), F.when(ok(a, b), z("b", b, i)).alias("t2"))
        for i, (a, b) in enumerate(pairs)]))).where(F.col("t0").isNotNull() & F.col("t2").isNotNull() & F.col("_y").isNotNull())
    long = long.select("feature_a", "feature_b", "t0", (F.col("t0") * F.col("t0")).alias("t1"), "t2", (F.col("t2") * F.col("t2")).alias("t3"),
                       (F.col("t0") * F.col("t2")).alias("t4"), F.col("_y").alias("t5"))
    cov = F.array(*[F.array(*[F.covar_pop(f"t{min(p, q)}", f"t{max(p, q)}") for q in range(6)]) for p in range(6)])
    grams = long.groupBy("feature_a", "feature_b").agg(F.count(F.lit(1)).alias("n"), cov.alias("_c0"))
    for p in range(5):
        grams = grams.withColumn(f"_c{p + 1}", _without(F.col(f"_c{p}"), p))
    share = lambda k: 1 - guarded_ratio(F.col(f"_c{k}")[5][5], F.col("_c0")[5][5])
    solved = grams.select("feature_a", "feature_b", "n", share(4).alias("base_r2"), share(5).alias("interaction_r2"))
    gain = _adjusted(F.col("interaction_r2"), F.col("n"), 5) - _adjusted(F.col("base_r2"), F.col("n"), 4)
    return solved.withColumn("gain", F.when(F.col("n") >= 8, gain)).withColumn(
        "signal", F.coalesce(F.col("gain") >= threshold, F.lit(False)))
