"""Data-driven leakage audit: target proxies, affine copies and derived features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import clean, guarded_ratio, norm_text, rows_of, spread, wide_rows
from assayer.operators.association import pair_counts


def target_proxies(df: DataFrame, fields: Sequence[str], target: str, identifiers: Sequence[str] = ()) -> DataFrame:
    """How far each field copies or encodes the target, and the detection method if it does.

    Exact and normalised match rates are one wide aggregate; the mapping checks count distinct
    (field, target) combinations, never rows of one value in one task.
    """
    text = lambda c: F.col(c).cast("string")
    df = spread(df.where(F.col(target).isNotNull()).select(target, *[f for f in fields if f != target])).select(
        text(target).alias("_t"), F.coalesce(norm_text(text(target)), F.lit("")).alias("_tk"), *[text(f).alias(f) for f in fields],
        *[F.when(F.col(f).isNotNull(), F.coalesce(norm_text(text(f)), F.lit(""))).alias(f"_k_{f}") for f in fields])
    key = lambda f: F.col(f"_k_{f}")
    rates = wide_rows(df, fields, {
        "paired_rows": lambda f: F.count(f), "exact_rate": lambda f: F.avg((F.col(f) == F.col("_t")).cast("double")),
        "normalized_rate": lambda f: F.avg((key(f) == F.col("_tk")).cast("double"))}, name="field")
    counts = pair_counts(df, [(key(f), F.col("_tk"), f, "(target)") for f in fields])
    forward = counts.groupBy("feature_a", "x").agg(F.count(F.lit(1)).alias("_k")).groupBy("feature_a").agg(
        F.max("_k").alias("_f"), F.count(F.lit(1)).alias("cardinality"),
        F.bool_and(F.col("x").isin("0", "1", "true", "false")).alias("_binary"))
    reverse = counts.groupBy("feature_a", "y").agg(F.count(F.lit(1)).alias("_k")).groupBy("feature_a").agg(
        F.max("_k").alias("_r"), F.count(F.lit(1)).alias("target_cardinality"))
    j = rates.join(forward.join(reverse, "feature_a").withColumnRenamed("feature_a", "field"), "field")
    deterministic = F.col("_f") == 1
    mutual = deterministic & (F.col("_r") == 1)
    low = F.col("cardinality") <= F.greatest(F.lit(10), F.col("target_cardinality") * 5)
    repeated = F.col("cardinality") / F.col("paired_rows") <= 0.5
    method = (
        F.when(F.col("exact_rate") == 1, "Exact target copy").when(F.col("normalized_rate") == 1, "Normalized target copy")
        .when(mutual & (F.col("cardinality") == F.col("target_cardinality")),
              F.when(F.col("_binary"), "Binary target encoding").otherwise("Bidirectional target mapping"))
        .when(deterministic & low & repeated & ~F.col("field").isin(*identifiers or ("",)), "Deterministic target mapping"))
    severity = F.when(method.endswith("target copy"), "Critical").when(method.isNotNull(), "High").otherwise("None")
    return j.select("field", "paired_rows", "exact_rate", "normalized_rate", deterministic.alias("deterministic"),
                    mutual.alias("bidirectional"), "cardinality", "target_cardinality",
                    F.coalesce(method, F.lit("None")).alias("method"), severity.alias("severity"))


def _match(obs: Column, exp: Column, atol: float, rtol: float) -> Column:
    return F.abs(obs - exp) <= atol + rtol * F.abs(exp)


def affine_proxies(df: DataFrame, fields: Sequence[str], target: str, atol: float = 1e-10, rtol: float = 1e-8,
                   confirmed: float = 0.99) -> DataFrame:
    """Numeric copies and affine transforms of a continuous target. Two scans: the line, then how many rows lie on it.

    Either needs at least 3 pairs and 3 target values; two points always lie on a line. That there are 3
    values is seen from a target strictly between the extremes of its pairs.
    """
    finite = lambda c: F.when(F.abs(clean(c)) != float("inf"), clean(c))
    t, base = F.col("_t"), spread(df.select(finite(target).alias("_t"), *[finite(f).alias(f) for f in fields]))
    on = lambda f, c: F.when(F.col(f).isNotNull() & t.isNotNull(), c)
    lines = base.agg(*[x for i, f in enumerate(fields) for x in (
        guarded_ratio(F.covar_pop(on(f, F.col(f)), on(f, t)), F.var_pop(on(f, t))).alias(f"_s{i}"),
        F.avg(on(f, F.col(f))).alias(f"_mf{i}"), F.avg(on(f, t)).alias(f"_mt{i}"), F.var_pop(on(f, F.col(f))).alias(f"_vf{i}"),
        F.min(on(f, t)).alias(f"_lo{i}"), F.max(on(f, t)).alias(f"_hi{i}"))])
    joined = base.join(F.broadcast(lines))
    aggs, rows = [], []
    for i, f in enumerate(fields):
        x, slope = F.col(f), F.col(f"_s{i}")
        intercept = F.col(f"_mf{i}") - slope * F.col(f"_mt{i}")
        fit = slope * t + intercept
        err = lambda e: on(f, F.abs(x - e))
        aggs += [
            F.count(on(f, x)).alias(f"_n{i}"), F.avg(on(f, _match(x, t, atol, rtol).cast("double"))).alias(f"_c{i}"),
            F.avg(on(f, _match(x, fit, atol, rtol).cast("double"))).alias(f"_a{i}"), F.max(err(fit)).alias(f"_e{i}"), F.max(err(t)).alias(f"_d{i}"),
            (1 - guarded_ratio(F.avg(on(f, (x - fit) * (x - fit))), F.max(f"_vf{i}"))).alias(f"_q{i}"),
            F.max(slope).alias(f"_sl{i}"), F.max(intercept).alias(f"_in{i}"),
            F.count_if(on(f, (t > F.col(f"_lo{i}")) & (t < F.col(f"_hi{i}")))).alias(f"_b{i}")]
        enough = (F.col(f"_n{i}") >= 3) & (F.col(f"_b{i}") > 0)
        copy = F.coalesce(enough & (F.col(f"_c{i}") >= confirmed), F.lit(False))
        affine = F.coalesce(enough & (F.col(f"_a{i}") >= confirmed) & (F.col(f"_q{i}") >= confirmed), F.lit(False))
        rows.append({
            "field": F.lit(f), "paired_rows": F.col(f"_n{i}"),
            "method": F.when(copy, "Exact numeric target copy").when(affine, "Affine numeric target transform").otherwise("None"),
            "slope": F.when(copy, F.lit(1.0)).otherwise(F.col(f"_sl{i}")), "intercept": F.when(copy, F.lit(0.0)).otherwise(F.col(f"_in{i}")),
            "match_rate": F.when(copy, F.col(f"_c{i}")).otherwise(F.col(f"_a{i}")),
            "max_abs_error": F.when(copy, F.col(f"_d{i}")).otherwise(F.col(f"_e{i}")), "r_squared": F.when(copy, F.lit(1.0)).otherwise(F.col(f"_q{i}"))})
    return rows_of(joined.agg(*aggs), rows)


# Formulas of derived features over (area, perimeter, major axis, minor axis).
def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def eccentricity(major: Column, minor: Column) -> Column:
    r = F.try_divide(minor, major)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - r * r))


def equivalent_diameter(area: Column) -> Column:
    return F.sqrt(4 * area / F.pi())


def roundness(area: Column, perimeter: Column) -> Column:
    return F.try_divide(4 * F.pi() * area, perimeter * perimeter)


def shape_factor_3(area: Column, major: Column) -> Column:
    return F.try_divide(4 * area, F.pi() * major * major)


def shape_factor_4(area: Column, major: Column, minor: Column) -> Column:
    return F.try_divide(4 * area, F.pi() * major * minor)


def derived_dependencies(df: DataFrame, formulas: Mapping[str, Column], atol: float = 1e-9, rtol: float = 1e-4,
                         confirmed: float = 0.99) -> DataFrame:
    """Does each column equal its formula over other columns? Match rate and largest errors, one scan for all."""
    aggs, rows = [], []
    for i, (c, formula) in enumerate(formulas.items()):
        obs, exp = clean(c), formula.cast("double")
        both = obs.isNotNull() & exp.isNotNull()
        err = F.when(both, F.abs(obs - exp))
        aggs += [F.count(err).alias(f"_n{i}"), F.avg(F.when(both, _match(obs, exp, atol, rtol).cast("double"))).alias(f"_m{i}"),
                 F.max(err).alias(f"_a{i}"), F.max(F.when(F.abs(exp) > atol, err / F.abs(exp))).alias(f"_r{i}")]
        rows.append({"feature": F.lit(c), "evaluated": F.col(f"_n{i}"), "match_rate": F.col(f"_m{i}"), "max_abs_error": F.col(f"_a{i}"),
                     "max_rel_error": F.coalesce(f"_r{i}", F.lit(0.0)), "confirmed": F.coalesce(F.col(f"_m{i}") >= confirmed, F.lit(False))})
    return rows_of(df.agg(*aggs), rows)
