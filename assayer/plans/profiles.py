"""Profile queries over lineitem numbers, categories and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import profile as pr
from assayer.plans.quality import DIRTY, dirty_lineitem
from assayer.plans.registry import R, query, rounded
from assayer.sources.tables import table

NUMBERS = ["qty", "l_extendedprice", "l_discount", "l_tax"]
LONG = """
 num AS (SELECT *, CASE WHEN isfinite(x) THEN x WHEN isinf(x) THEN 0.0 END AS q2, CASE WHEN qty = '-inf' THEN '0' ELSE qty END AS q3 FROM parsed),
 long AS (SELECT 'qty' AS feature, q2 AS value FROM num WHERE q2 IS NOT NULL UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)"""


def readable(spark, sf):
    """dirty_lineitem with the infinities as zero, so that moments stay finite."""
    return dirty_lineitem(spark, sf).withColumn("qty", F.when(F.col("qty") == "-inf", "0").otherwise(F.col("qty")))


PROFILE = """
 st AS (SELECT feature, count(*) AS valid, count(DISTINCT value) AS unique_count, count(*) FILTER (value = 0) AS zero_count, count(*) FILTER (value < 0) AS negative_count, avg(value) AS mean, stddev_samp(value) AS std,
  var_samp(value) AS variance, min(value) AS minimum, max(value) AS maximum, skewness(value) AS skewness, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1),
 ms AS (SELECT count(*) AS row_count, count(*) FILTER (qty IS NULL) AS missing_count, count(*) FILTER (trim(qty) = '') AS blank_count, count(*) FILTER (qty = 'n/a') AS non_numeric_count FROM num)"""


@query("d01_numeric_profile", f"""WITH {DIRTY}, {LONG}, {PROFILE}
SELECT feature, row_count, valid, CASE WHEN feature = 'qty' THEN missing_count ELSE 0 END AS missing_count, CASE WHEN feature = 'qty' THEN blank_count ELSE 0 END AS blank_count, CAST(0 AS BIGINT) AS materialized_count,
 CASE WHEN feature = 'qty' THEN non_numeric_count ELSE 0 END AS non_numeric_count, unique_count, zero_count, negative_count, round(mean, 4) + 0.0 AS mean, round(std, 4) + 0.0 AS std, round(variance, 2) + 0.0 AS variance,
 {R('minimum', 'maximum')}, round(skewness, 5) + 0.0 AS skewness, {R('q1', 'median', 'q3')}, round(maximum - minimum, 6) + 0.0 AS range, round(q3 - q1, 6) + 0.0 AS iqr, round(q1 - 1.5 * (q3 - q1), 6) + 0.0 AS lower_fence,
 round(q3 + 1.5 * (q3 - q1), 6) + 0.0 AS upper_fence, CASE WHEN skewness >= 0.5 THEN 'Right-skewed' WHEN skewness <= -0.5 THEN 'Left-skewed' ELSE 'Approximately symmetric' END AS shape FROM st, ms""")
def _(spark, sf):
    return rounded(pr.numeric_profile(readable(spark, sf), NUMBERS), mean=4, std=4, variance=2, skewness=5)


FENCES = """
 f AS (SELECT feature, quantile_cont(value, 0.25) - m * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower_fence, quantile_cont(value, 0.75) + m * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper_fence FROM long, (SELECT 0.4 AS m) GROUP BY feature, m)"""


@query("d02_outlier_summary", f"""WITH {DIRTY}, {LONG}, {FENCES}
SELECT feature, {R('lower_fence', 'upper_fence')}, count(*) AS valid, count(*) FILTER (value < lower_fence) AS lower_count, count(*) FILTER (value > upper_fence) AS upper_count,
 count(*) FILTER (value < lower_fence OR value > upper_fence) AS outlier_count, round(count(*) FILTER (value < lower_fence OR value > upper_fence) / count(*)::DOUBLE, 6) + 0.0 AS outlier_share
FROM long JOIN f USING (feature) GROUP BY feature, lower_fence, upper_fence""")
def _(spark, sf):
    return rounded(pr.outlier_summary(readable(spark, sf), NUMBERS, multiplier=0.4))


@query("d03_outlier_rows", """
WITH long AS (SELECT doc_id, 'n_chars' AS feature, n_chars::DOUBLE AS value FROM documents UNION ALL SELECT doc_id, 'text_length', length(text)::DOUBLE FROM documents),
 f AS (SELECT feature, quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS a, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS b FROM long GROUP BY 1)
SELECT * FROM (SELECT doc_id, feature, value, CASE WHEN value < a THEN 'lower' ELSE 'upper' END AS side, row_number() OVER (PARTITION BY feature ORDER BY doc_id, value) AS rank FROM long JOIN f USING (feature) WHERE value < a OR value > b) WHERE rank <= 15""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("text_length"))
    return rounded(pr.outlier_rows(d, ["n_chars", "text_length"], ["doc_id"], top=15))


@query("d04_conversion_issues", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ' ' WHEN event_type = 'click' AND user_id % 5 = 0 THEN 'value ' || event_type ELSE CAST(user_id AS VARCHAR) END AS raw FROM events)
SELECT 'raw' AS feature, CASE WHEN raw IS NULL THEN 'missing' WHEN raw = ' ' THEN 'blank' ELSE 'non-numeric' END AS issue, raw AS raw_value, count(*) AS count, min(event_id) AS first_position, max(event_id) AS last_position
FROM r WHERE raw IS NULL OR raw = ' ' OR raw LIKE 'value%' GROUP BY raw""")
def _(spark, sf):
    raw = (F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, " ")
           .when((F.col("event_type") == "click") & (F.col("user_id") % 5 == 0), F.concat(F.lit("value "), "event_type"))
           .otherwise(F.col("user_id").cast("string")))
    return pr.conversion_issues(table(spark, sf, "events").withColumn("raw", raw), ["raw"], "event_id")


LEVELS = """
 src AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN upper(p_type) || ' ' WHEN p_partkey % 101 = 0 THEN ' ' WHEN p_partkey % 103 = 0 THEN NULL ELSE p_type END AS p_type, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part),
 lv AS (SELECT p_partkey, 'p_type' AS feature, p_type AS category FROM src UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM src UNION ALL SELECT p_partkey, 'p_size', p_size FROM src),
 cnt AS (SELECT feature, category, count(*) AS count, min(p_partkey) AS first_position FROM lv WHERE trim(category) <> '' GROUP BY 1, 2),
 tot AS (SELECT feature, sum(count)::BIGINT AS valid, max(count) AS top FROM cnt GROUP BY 1)"""
LEVEL_COLUMNS = ["p_type", "p_brand", "p_size"]


def part_levels(spark, sf):
    k = F.col("p_partkey")
    kind = (F.when(k % 17 == 0, F.concat(F.upper("p_type"), F.lit(" "))).when(k % 101 == 0, " ").when(k % 103 == 0, F.lit(None))
            .otherwise(F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", kind.alias("p_type"), "p_brand", "p_size")


def part_counts(spark, sf):
    return pr.category_counts(part_levels(spark, sf), LEVEL_COLUMNS, "p_partkey")


BRANDS = ["Brand#11", "brand#12", "Brand#13", "Brand#99"]
FREQUENCY = f"""
 fr AS (SELECT feature, category, count, count / valid::DOUBLE AS share, row_number() OVER (PARTITION BY feature ORDER BY count DESC, first_position) AS rank,
  feature <> 'p_brand' OR lower(trim(category)) IN ('brand#11', 'brand#12', 'brand#13', 'brand#99') AS expected, count = top AS dominant, count < 50 AS rc, count / valid::DOUBLE < 0.02 AS rs, lower(trim(category)) AS normalized FROM cnt JOIN tot USING (feature))"""


@query("d05_category_frequency", f"""WITH {LEVELS}, {FREQUENCY}
SELECT feature, category, count, round(share, 6) + 0.0 AS share, rank, expected, rc OR rs AS rare, CASE WHEN rc AND rs THEN 'count, share' WHEN rc THEN 'count' WHEN rs THEN 'share' ELSE '' END AS rare_trigger, dominant, normalized FROM fr""")
def _(spark, sf):
    return rounded(pr.category_frequency(part_levels(spark, sf), LEVEL_COLUMNS, "p_partkey", {"p_brand": BRANDS}, rare_share=0.02))


@query("d06_rare_categories", f"""WITH {LEVELS}, {FREQUENCY}
SELECT feature, category, count, round(share, 6) + 0.0 AS share, CASE WHEN rc AND rs THEN 'count, share' WHEN rc THEN 'count' ELSE 'share' END AS trigger FROM fr WHERE rc OR rs""")
def _(spark, sf):
    f = pr.category_frequency(part_levels(spark, sf), LEVEL_COLUMNS, "p_partkey", rare_share=0.02)
    return rounded(f.where("rare").select("feature", "category", "count", "share", F.col("rare_trigger").alias("trigger")))


@query("d07_label_variants", f"""WITH {LEVELS}
SELECT feature, lower(trim(category)) AS normalized, count(*) AS spellings, CAST(sum(count) AS BIGINT) AS rows, string_agg(category, '|' ORDER BY category) AS variants FROM cnt GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return pr.label_variants(part_counts(spark, sf))


@query("d08_category_contract", f"""WITH {LEVELS}, e AS (SELECT 'p_brand' AS feature, unnest({BRANDS}) AS category)
SELECT feature, 'Unexpected category' AS issue, category, count AS rows FROM cnt WHERE feature = 'p_brand' AND lower(trim(category)) NOT IN (SELECT lower(category) FROM e)
UNION ALL SELECT feature, 'Missing expected category', category, 0 FROM e WHERE lower(category) NOT IN (SELECT lower(trim(category)) FROM cnt WHERE feature = 'p_brand')""")
def _(spark, sf):
    expected = spark.createDataFrame([("p_brand", b) for b in BRANDS], "feature string, category string")
    return pr.category_contract(part_counts(spark, sf), expected)


GROUPS = [("p_brand", "first", "Brand#11"), ("p_brand", "first", "brand#12"), ("p_brand", "second", "Brand#21"), ("p_brand", "second", "Brand#22"),
          ("p_brand", "first", "Brand#31"), ("p_brand", "second", "Brand#31"), ("p_brand", "third", "Brand#99"), ("p_size", "small", "1"), ("p_size", "small", "2")]
GROUPED = f"""
 m AS (SELECT *, lower(category) AS k FROM (VALUES {', '.join(str(g) for g in GROUPS)}) AS v(feature, grp, category)),
 one AS (SELECT feature, k, min(grp) AS grp FROM m GROUP BY 1, 2 HAVING count(*) = 1), c AS (SELECT *, lower(trim(category)) AS k FROM cnt WHERE feature IN ('p_brand', 'p_size')),
 o AS (SELECT c.feature, coalesce(grp, 'Unassigned') AS grp, sum(count)::BIGINT AS n FROM c LEFT JOIN one ON c.feature = one.feature AND c.k = one.k GROUP BY 1, 2),
 d AS (SELECT DISTINCT feature, grp FROM m)"""


def groups(spark):
    return spark.createDataFrame(GROUPS, "feature string, group string, category string")


@query("d09_grouping_counts", f"""WITH {LEVELS}, {GROUPED}
SELECT coalesce(o.feature, d.feature) AS feature, coalesce(o.grp, d.grp) AS "group", coalesce(n, 0) AS count, round(coalesce(n, 0) / valid::DOUBLE, 6) + 0.0 AS share, CASE WHEN d.grp IS NOT NULL THEN 'Defined' ELSE 'Requires review' END AS coverage
FROM o FULL JOIN d ON o.feature = d.feature AND o.grp = d.grp JOIN tot ON tot.feature = coalesce(o.feature, d.feature)""")
def _(spark, sf):
    return rounded(pr.grouping_counts(part_counts(spark, sf), groups(spark)))


@query("d09_grouping_issues", f"""WITH {LEVELS}, {GROUPED}, s AS (SELECT DISTINCT feature, k FROM c), g AS (SELECT feature, k, count(*) AS n FROM m GROUP BY 1, 2)
SELECT feature, 'Unknown grouping category' AS issue, k AS category FROM g WHERE (feature, k) NOT IN (SELECT feature, k FROM s) UNION ALL SELECT feature, 'Category in several groups', k FROM g WHERE n > 1 AND (feature, k) IN (SELECT feature, k FROM s)
UNION ALL SELECT feature, 'Ungrouped category', k FROM s WHERE (feature, k) NOT IN (SELECT feature, k FROM g)""")
def _(spark, sf):
    return pr.grouping_issues(part_counts(spark, sf), groups(spark))


@query("d10_category_summary", f"""WITH {LEVELS}, {FREQUENCY},
 b AS (SELECT feature, count(*) AS row_count, count(*) FILTER (category IS NULL) AS missing_count, count(*) FILTER (trim(category) = '') AS blank_count FROM lv GROUP BY 1),
 v AS (SELECT feature, count(*) AS n FROM (SELECT feature, lower(trim(category)) AS k FROM cnt GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
 a AS (SELECT feature, count(*) AS cardinality, count(*) FILTER (rc OR rs) AS rare_categories, CAST(coalesce(sum(count) FILTER (rc OR rs), 0) AS BIGINT) AS rare_rows, count(*) FILTER (dominant) AS mode_ties, arg_min(category, rank) AS mode, max(count) AS mode_count, CAST(sum(count) AS BIGINT) AS valid_count FROM fr GROUP BY 1)
SELECT *, cardinality > 20 AS high_cardinality, array_to_string(list_filter([CASE WHEN missing_count > 0 THEN 'Missing values' END, CASE WHEN blank_count > 0 THEN 'Blank values' END, CASE WHEN inconsistent_labels > 0 THEN 'Inconsistent labels' END,
  CASE WHEN rare_categories > 0 THEN 'Rare categories' END, CASE WHEN cardinality > 20 THEN 'High cardinality' END], lambda e: e IS NOT NULL), ', ') AS status
FROM (SELECT b.*, valid_count, mode_count, cardinality, rare_categories, rare_rows, mode_ties, mode, coalesce(v.n, 0) AS inconsistent_labels, round(mode_count / valid_count::DOUBLE, 6) + 0.0 AS mode_share FROM b JOIN a USING (feature) LEFT JOIN v USING (feature))""")
def _(spark, sf):
    return rounded(pr.category_summary(part_levels(spark, sf), LEVEL_COLUMNS, "p_partkey", rare_share=0.02))


CLASSES = """
 c AS (SELECT l_linestatus, l_returnflag AS class, count(*) AS count FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT l_linestatus FROM c), e AS (SELECT l_linestatus, unnest(['A', 'N', 'Q']) AS class FROM g),
 d AS (SELECT coalesce(c.l_linestatus, e.l_linestatus) AS l_linestatus, coalesce(c.class, e.class) AS class, coalesce(count, 0) AS count, e.class IS NOT NULL AS is_expected FROM c FULL JOIN e ON c.class = e.class AND c.l_linestatus = e.l_linestatus),
 w AS (SELECT *, max(count) OVER p AS top, min(CASE WHEN count > 0 THEN count END) OVER p AS low, sum(count) OVER p AS n FROM d WINDOW p AS (PARTITION BY l_linestatus)),
 t AS (SELECT *, count(*) FILTER (count = top) OVER p AS tt, count(*) FILTER (count = low) OVER p AS tl FROM w WINDOW p AS (PARTITION BY l_linestatus))"""


@query("d11_class_distribution", f"""WITH {CLASSES}
SELECT l_linestatus, class, count, round(count / n::DOUBLE, 6) + 0.0 AS share, is_expected, CASE WHEN count = 0 THEN 'Absent expected' WHEN count = top THEN CASE WHEN tt > 1 THEN 'Tied' ELSE 'Majority' END WHEN count = low THEN CASE WHEN tl > 1 THEN 'Tied minority' ELSE 'Minority' END
 ELSE 'Intermediate' END || CASE WHEN class = 'A' THEN ' / Positive' ELSE ' / Negative' END AS role FROM t""")
def _(spark, sf):
    return rounded(pr.class_distribution(table(spark, sf, "lineitem"), "l_returnflag", ["A", "N", "Q"], "A", ["l_linestatus"]))


@query("d12_class_balance", f"""WITH {CLASSES}
SELECT l_linestatus, CAST(sum(count) AS BIGINT) AS rows, count(*) FILTER (count > 0) AS classes, round(max(count) / (min(count) FILTER (count > 0))::DOUBLE, 6) + 0.0 AS imbalance_ratio,
 round(sum(CASE WHEN count > 0 THEN -(count / n::DOUBLE) * ln(count / n::DOUBLE) END) / ln(count(*) FILTER (count > 0)), 6) + 0.0 AS normalized_entropy, round(max(count) / sum(count)::DOUBLE, 6) + 0.0 AS majority_accuracy,
 round(sum(count) FILTER (class = 'A') / sum(count)::DOUBLE, 6) + 0.0 AS positive_share FROM t GROUP BY 1""")
def _(spark, sf):
    d = pr.class_distribution(table(spark, sf, "lineitem"), "l_returnflag", ["A", "N", "Q"], "A", ["l_linestatus"])
    return rounded(pr.class_balance(d, "A", ["l_linestatus"]))


@query("d13_continuous_target", """
WITH s AS (SELECT o_orderstatus, CASE WHEN o_custkey % 40 = 0 THEN NULL WHEN o_custkey % 41 = 0 THEN 'inf'::DOUBLE ELSE o_totalprice END AS y FROM orders),
 q AS (SELECT o_orderstatus, count(*) AS row_count, count(*) FILTER (isfinite(y)) AS finite_count, count(*) FILTER (y IS NULL) AS missing_count, count(*) FILTER (isinf(y)) AS non_finite_count, count(DISTINCT y) FILTER (isfinite(y)) AS unique_count,
  avg(y) FILTER (isfinite(y)) AS mean, stddev_samp(y) FILTER (isfinite(y)) AS std, min(y) FILTER (isfinite(y)) AS minimum, max(y) FILTER (isfinite(y)) AS maximum, skewness(y) FILTER (isfinite(y)) AS skewness,
  quantile_cont(y, 0.01) FILTER (isfinite(y)) AS q01, quantile_cont(y, 0.05) FILTER (isfinite(y)) AS q05, quantile_cont(y, 0.25) FILTER (isfinite(y)) AS q25, quantile_cont(y, 0.5) FILTER (isfinite(y)) AS q50,
  quantile_cont(y, 0.75) FILTER (isfinite(y)) AS q75, quantile_cont(y, 0.95) FILTER (isfinite(y)) AS q95, quantile_cont(y, 0.99) FILTER (isfinite(y)) AS q99 FROM s GROUP BY 1),
 f AS (SELECT *, q75 - q25 AS iqr, q25 - 0.3 * (q75 - q25) AS lower_fence, q75 + 0.3 * (q75 - q25) AS upper_fence FROM q)
SELECT o_orderstatus, row_count, finite_count, missing_count, non_finite_count, unique_count, round(mean, 2) + 0.0 AS mean, round(std, 2) + 0.0 AS std, round(minimum, 3) + 0.0 AS minimum, round(maximum, 3) + 0.0 AS maximum, round(skewness, 5) + 0.0 AS skewness,
 round(q01, 3) + 0.0 AS q01, round(q05, 3) + 0.0 AS q05, round(q25, 3) + 0.0 AS q25, round(q50, 3) + 0.0 AS q50, round(q75, 3) + 0.0 AS q75, round(q95, 3) + 0.0 AS q95, round(q99, 3) + 0.0 AS q99,
 round(iqr, 3) + 0.0 AS iqr, round(lower_fence, 3) + 0.0 AS lower_fence, round(upper_fence, 3) + 0.0 AS upper_fence,
 (SELECT count(*) FROM s WHERE s.o_orderstatus = f.o_orderstatus AND isfinite(y) AND y < lower_fence) AS lower_extremes, (SELECT count(*) FROM s WHERE s.o_orderstatus = f.o_orderstatus AND isfinite(y) AND y > upper_fence) AS upper_extremes FROM f""")
def _(spark, sf):
    y = F.when(F.col("o_custkey") % 40 == 0, None).when(F.col("o_custkey") % 41 == 0, float("inf")).otherwise(F.col("o_totalprice"))
    d = table(spark, sf, "orders").select("o_orderstatus", y.cast("double").alias("y"))
    return rounded(pr.continuous_target(d, "y", ["o_orderstatus"], multiplier=0.3), 3, mean=2, std=2, skewness=5)


HISTOGRAM = """
 x AS (SELECT l_extendedprice AS x FROM lineitem), e AS (SELECT min(x) AS a, max(x) AS b, {k} AS k FROM x),
 h AS (SELECT CAST(least(floor((x - a) / ((b - a) / k)), k - 1) AS BIGINT) AS bin, count(*) AS count FROM x, e GROUP BY 1)
SELECT g.bin, round(a + g.bin * ((b - a) / k), 4) + 0.0 AS lower, round(a + (g.bin + 1) * ((b - a) / k), 4) + 0.0 AS upper, coalesce(count, 0) AS count
FROM (SELECT unnest(range(0, k)) AS bin, a, b, k FROM e) g LEFT JOIN h ON g.bin = h.bin"""


@query("d14_histogram_fd", "WITH " + HISTOGRAM.format(
    k="CAST(ceil((max(x) - min(x)) / (2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / pow(count(*)::DOUBLE, 1.0 / 3))) AS BIGINT)"))
def _(spark, sf):
    return rounded(pr.histogram(table(spark, sf, "lineitem"), "l_extendedprice"), 4)


@query("d14_histogram_fixed", "WITH " + HISTOGRAM.format(k="CAST(30 AS BIGINT)"))
def _(spark, sf):
    return rounded(pr.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30), 4)


@query("d15_boxplot", f"""WITH {DIRTY}, {LONG},
 q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, min(value) AS minimum, max(value) AS maximum FROM long GROUP BY 1)
SELECT feature, {R('q1', 'median', 'q3', 'minimum', 'maximum')}, round(min(value) FILTER (value >= q1 - 0.4 * (q3 - q1)), 6) + 0.0 AS whisker_low, round(max(value) FILTER (value <= q3 + 0.4 * (q3 - q1)), 6) + 0.0 AS whisker_high,
 count(*) FILTER (value < q1 - 0.4 * (q3 - q1) OR value > q3 + 0.4 * (q3 - q1)) AS outliers FROM long JOIN q USING (feature) GROUP BY feature, q1, median, q3, minimum, maximum""")
def _(spark, sf):
    return rounded(pr.boxplot(readable(spark, sf), NUMBERS, multiplier=0.4))


@query("d16_profile_summary", f"""WITH {DIRTY}, {LONG}, {PROFILE}, {FENCES},
 o AS (SELECT feature, count(*) FILTER (value < lower_fence OR value > upper_fence) AS n FROM long JOIN f USING (feature) GROUP BY 1)
SELECT v.metric, v.value FROM (SELECT count(*) AS c, count(*) FILTER (unique_count <= 1) AS k, count(*) FILTER (n > 0) AS f, CAST(sum(n) AS BIGINT) AS t, count(*) FILTER (skewness >= 0.5) AS r, count(*) FILTER (skewness <= -0.5) AS l FROM st JOIN o USING (feature)), ms,
 LATERAL (VALUES ('features', c), ('empty_features', 0), ('missing_values', missing_count), ('blank_values', blank_count), ('non_numeric_values', non_numeric_count), ('constant_features', k), ('features_with_outliers', f), ('outlier_values', t), ('right_skewed', r), ('left_skewed', l)) AS v(metric, value)""")
def _(spark, sf):
    df = readable(spark, sf)
    return pr.profile_summary(pr.numeric_profile(df, NUMBERS), pr.outlier_summary(df, NUMBERS, multiplier=0.4))


@query("b10_shape_label", """
SELECT o_orderpriority, count(*) AS rows, CASE WHEN skewness(x) >= 0.5 THEN 'Right-skewed' WHEN skewness(x) <= -0.5 THEN 'Left-skewed' ELSE 'Approximately symmetric' END AS shape
FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN exp(o_totalprice / 200000) WHEN o_orderpriority = '5-LOW' THEN -exp(o_totalprice / 200000) ELSE o_totalprice END AS x FROM orders) GROUP BY 1""")
def _(spark, sf):
    e = F.exp(F.col("o_totalprice") / 200000)
    x = F.when(F.col("o_orderpriority") == "1-URGENT", e).when(F.col("o_orderpriority") == "5-LOW", -e).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").withColumn("x", x).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), pr.shape_label(pr.adjusted_skewness("x")).alias("shape"))
