"""Profiles of shipments stored per month and merged per year and for all, held against the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import sketches as sk
from assayer.plans.registry import R, query, rounded
from assayer.sources.tables import stored, table

NUMBERS = ("l_quantity", "l_extendedprice", "l_partkey")


@query("d01_merged_profile", f"""
WITH x AS ({' UNION ALL '.join(f"SELECT year(l_shipdate) AS year, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in NUMBERS)}),
p AS (SELECT year, feature, count(*) AS rows, count(*) - count(v) AS missing, min(v) AS minimum, max(v) AS maximum, avg(v) AS mean, stddev_samp(v) AS std,
 count(DISTINCT v) AS distinct_exact FROM x GROUP BY GROUPING SETS ((year, feature), (feature)))
SELECT year, feature, rows, missing, {R("minimum", "maximum", "mean", "std", digits=4)}, distinct_exact, true AS quantiles_hold, true AS distinct_holds FROM p""")
def _(spark, sf):
    """Per year and in all: exact figures of the merged parts, and whether quantiles and numbers of values keep their bounds.

    The bound of ranks holds for 99 of 100 sketches, so twice the bound is asked for here.
    """
    rows = table(spark, sf, "lineitem").select("l_shipdate", *NUMBERS).withColumns({"year": F.year("l_shipdate").cast("long"), "month": F.month("l_shipdate")})
    parts = stored(sk.profile_parts(rows, ["year", "month"], NUMBERS), "profile-parts")
    out = []
    for by in (["year"], []):
        merged = stored(sk.merge_profiles(parts, by), "profile-merged")
        errors = sk.profile_errors(rows, merged, by, NUMBERS)
        held = merged.join(errors, [*by, "feature"]) if not by else merged.alias("m").join(
            errors.alias("e"), F.col("m.year").eqNullSafe(F.col("e.year")) & (F.col("m.feature") == F.col("e.feature"))).select("m.*", "rank_error", "distinct_exact", "distinct_error")
        year = F.col("year") if by else F.lit(None).cast("long")
        out.append(held.select(
            year.alias("year"), "feature", "rows", "missing", "minimum", "maximum", "mean", "std", "distinct_exact",
            (F.col("rank_error") <= 2 * sk.rank_bound()).alias("quantiles_hold"), (F.col("distinct_error") <= sk.distinct_bound()).alias("distinct_holds")))
    return rounded(out[0].unionByName(out[1]), 4)
