"""Feature-target queries: quality labels of documents, embedding classes, line prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import target as tg
from assayer.plans.association import measures_sql, rank_sql
from assayer.plans.registry import R, query, rounded
from assayer.sources.tables import table

DOCS = """
 dl AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS words, lang, source, CAST(quality AS VARCHAR) AS quality, least(n_chars // 2000, 4)::DOUBLE AS size_class
  FROM documents JOIN labels USING (doc_id)),
 dlong AS (SELECT doc_id, quality, lang, source, 'n_chars' AS feature, n_chars AS value FROM dl UNION ALL SELECT doc_id, quality, lang, source, 'words', words FROM dl UNION ALL SELECT doc_id, quality, lang, source, 'size_class', size_class FROM dl)"""
GAPS = DOCS.replace("+ 1)::DOUBLE AS words, lang, source,", "+ 1)::DOUBLE + CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 0 END AS words, lang, CASE WHEN doc_id % 11 <> 0 THEN source END AS source,")
NUM, CAT = ["n_chars", "words", "size_class"], ["lang", "source"]


def labelled(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return d.join(l, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("words"), "lang", "source",
        F.col("quality").cast("string").alias("quality"), F.least(F.floor(F.col("n_chars") / 2000), F.lit(4)).cast("double").alias("size_class"))


def with_gaps(spark, sf):
    """The same with words missing in every seventh and the source in every eleventh document."""
    return labelled(spark, sf).withColumns({"words": F.when(F.col("doc_id") % 7 != 0, F.col("words")), "source": F.when(F.col("doc_id") % 11 != 0, F.col("source"))})


@query("f01_class_statistics", f"""WITH {DOCS}, g AS (SELECT unnest({NUM}) AS feature), k AS (SELECT unnest(['0', '1', '2']) AS class),
 s AS (SELECT feature, quality AS class, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS minimum, max(value) AS maximum, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM dlong GROUP BY 1, 2)
SELECT feature, class, coalesce(n, 0) AS n, {R('mean', 'std', digits=4)}, {R('minimum', 'maximum', 'median', 'iqr')} FROM (SELECT * FROM g, k) LEFT JOIN s USING (feature, class)""")
def _(spark, sf):
    return rounded(tg.class_statistics(labelled(spark, sf), NUM, "quality", ["0", "1", "2"]), mean=4, std=4)


def bins_sql(k: int, feature: str) -> str:
    edges = ", ".join(f"quantile_cont(value, {i}/{k}.0::DOUBLE)" for i in range(k + 1))
    return f"""SELECT feature, list_sort(list_distinct([{edges}])) AS e FROM dlong WHERE feature = '{feature}' AND value IS NOT NULL GROUP BY 1"""


BINS = f"""
 ed AS ({bins_sql(10, 'n_chars')} UNION ALL {bins_sql(10, 'words')} UNION ALL {bins_sql(5, 'size_class')}),
 bi AS (SELECT feature, greatest(1, len(list_filter(e, lambda q: q < value))) AS bin, e, quality FROM dlong JOIN ed USING (feature) WHERE value IS NOT NULL),
 bg AS (SELECT feature, e, unnest(range(1, len(e))) AS bin FROM ed),
 br AS (SELECT feature, bin, any_value(bg.e)[bin] AS lower, any_value(bg.e)[bin + 1] AS upper, count(quality) AS row_count, count(*) FILTER (quality = '1') AS positive_count FROM bg LEFT JOIN bi USING (feature, bin) GROUP BY 1, 2),
 bb AS (SELECT *, (SELECT avg((quality = '1')::INT) FROM dl) AS overall_rate, positive_count / nullif(row_count, 0)::DOUBLE AS rate FROM br)"""


@query("f02_binary_numeric", f"""WITH {GAPS}, {BINS},
 s AS (SELECT feature, count(value) AS valid_rows, count(*) FILTER (quality = '1') AS positive_rows, count(*) FILTER (quality = '0') AS negative_rows, avg(value) FILTER (quality = '1') - avg(value) FILTER (quality = '0') AS mean_difference,
  median(value) FILTER (quality = '1') - median(value) FILTER (quality = '0') AS median_difference, corr(value, quality::DOUBLE) AS point_biserial, var_samp(value) FILTER (quality = '1') AS v1, var_samp(value) FILTER (quality = '0') AS v0 FROM dlong WHERE value IS NOT NULL GROUP BY 1),
 d AS (SELECT *, mean_difference / sqrt(((positive_rows - 1) * v1 + (negative_rows - 1) * v0) / (valid_rows - 2)) AS cohens_d, (SELECT max(rate) - min(rate) FROM bb WHERE bb.feature = s.feature) AS rate_spread FROM s)
SELECT feature, valid_rows, positive_rows, negative_rows, round(mean_difference, 4) + 0.0 AS mean_difference, {R('point_biserial', 'cohens_d', 'median_difference', 'rate_spread')}, round(point_biserial * point_biserial, 6) + 0.0 AS eta_squared,
 abs(cohens_d) >= 0.5 OR rate_spread >= 0.1 AS review FROM d""")
def _(spark, sf):
    return rounded(tg.binary_numeric(with_gaps(spark, sf), NUM, "quality", "1"), mean_difference=4)


@query("f03_quantile_bins", f"""WITH {GAPS}, {BINS}
SELECT feature, CAST(bin AS BIGINT) AS bin, {R('lower', 'upper')}, row_count, positive_count, {R('rate', 'overall_rate')}, round(rate - overall_rate, 6) + 0.0 AS rate_difference, round(rate / overall_rate, 6) + 0.0 AS lift, row_count < 50 AS low_support FROM bb""")
def _(spark, sf):
    return rounded(tg.quantile_bins(with_gaps(spark, sf), NUM, "quality", "1"))


RATES = """
 cl AS (SELECT 'lang' AS feature, lang AS category, quality FROM dl UNION ALL SELECT 'source', source, quality FROM dl),
 cc AS (SELECT feature, category, count(*) AS n, count(*) FILTER (quality = '1') AS p FROM cl WHERE category IS NOT NULL GROUP BY 1, 2)"""


@query("f04_category_rates", f"""WITH {GAPS}, {RATES}, ct AS (SELECT feature, sum(n) AS tn, sum(p) AS tp FROM cc GROUP BY 1),
 a AS (SELECT feature, category, n, p FROM cc UNION ALL SELECT 'lang', 'xx', 0, 0),
 x AS (SELECT *, p::DOUBLE AS a, (n - p)::DOUBLE AS b, (tp - p)::DOUBLE AS c, (tn - tp - n + p)::DOUBLE AS d, p / nullif(n, 0)::DOUBLE AS r, (SELECT avg((quality = '1')::INT) FROM dl) AS o FROM a JOIN ct USING (feature)),
 y AS (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0 END AS h, 1.959963984540054 AS z FROM x),
 w AS (SELECT *, (r + z * z / (2 * n)) / (1 + z * z / n) AS ce, z * sqrt(r * (1 - r) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS ha FROM y)
SELECT feature, category, n AS row_count, p AS positive_count, round(r, 6) + 0.0 AS rate, round(o, 6) + 0.0 AS overall_rate, round(r / o, 6) + 0.0 AS lift, CASE WHEN n > 0 THEN round((a + h) * (d + h) / ((b + h) * (c + h)), 6) + 0.0 END AS odds_ratio,
 CASE WHEN n > 0 THEN round(greatest(0, ce - ha), 6) + 0.0 END AS wilson_low, CASE WHEN n > 0 THEN round(least(1, ce + ha), 6) + 0.0 END AS wilson_high, n < 50 AS low_support FROM w""")
def _(spark, sf):
    expected = spark.createDataFrame([("lang", "xx")], "feature string, category string")
    return rounded(tg.category_rates(with_gaps(spark, sf), CAT, "quality", "1", expected))


ASSOC = f"""{RATES}, ov AS (SELECT feature, (SELECT avg((quality = '1')::INT) FROM dl) AS o FROM cc GROUP BY 1),
 sr AS (SELECT feature, max(p / n::DOUBLE) - min(p / n::DOUBLE) AS rate_spread, sum(n * abs(p / n::DOUBLE - o)) / sum(n) AS weighted_rate_difference FROM cc JOIN ov USING (feature) GROUP BY 1),
 ct AS (SELECT feature, category AS x, quality AS y, count(*)::DOUBLE AS n FROM cl WHERE category IS NOT NULL GROUP BY 1, 2, 3), {measures_sql('feature')},
 fa AS (SELECT feature, valid_rows, levels_a AS levels, cramers_v, u_b_given_a AS u_target_given_feature, rate_spread, weighted_rate_difference, coalesce(rate_spread >= 0.1, false) OR coalesce(cramers_v >= 0.1, false) AS review FROM me JOIN sr USING (feature))"""


@query("f05_category_association", f"WITH {GAPS}, {ASSOC} SELECT feature, valid_rows, levels, {R('cramers_v', 'u_target_given_feature', 'rate_spread', 'weighted_rate_difference')}, review FROM fa")
def _(spark, sf):
    return rounded(tg.category_association(with_gaps(spark, sf), CAT, "quality", "1"))


DIMENSIONS = 64  # declared length of a vector
DIMS = [f"e{i}" for i in range(DIMENSIONS)]
EMB = f"""
 em AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, {', '.join(f'embedding[{i + 1}]::DOUBLE AS {d}' for i, d in enumerate(DIMS))} FROM embeddings),
 elong AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, 'e' || (i - 1) AS feature, embedding[i]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i))"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])


MULTI = f"""{EMB}, rk AS (SELECT feature, label, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r FROM elong),
 gm AS (SELECT feature, avg(value) AS gv, avg(r) AS gr FROM rk GROUP BY 1), cm AS (SELECT feature, label, count(*) AS n, avg(value) AS mv, avg(r) AS mr, var_pop(value) AS vv, var_pop(r) AS vr FROM rk GROUP BY 1, 2),
 mu AS (SELECT feature, CAST(sum(n) AS BIGINT) AS valid_rows, count(*) AS groups, sum(n * (mv - gv) ** 2) / (sum(n * vv) + sum(n * (mv - gv) ** 2)) AS eta_squared, sum(n * (mr - gr) ** 2) / (sum(n * vr) + sum(n * (mr - gr) ** 2)) AS rank_eta_squared,
  max(mv) - min(mv) AS mean_range FROM cm JOIN gm USING (feature) GROUP BY 1)"""


@query("f06_multiclass_numeric", f"WITH {MULTI} SELECT feature, valid_rows, groups, {R('eta_squared', 'rank_eta_squared', 'mean_range')}, greatest(eta_squared, rank_eta_squared) >= 0.1 AS review FROM mu")
def _(spark, sf):
    return rounded(tg.multiclass_numeric(vectors(spark, sf), DIMS, "label"))


CONT = f"""
 ls AS (SELECT CASE WHEN l_linenumber = 7 THEN 'inf'::DOUBLE ELSE l_extendedprice END AS t, l_quantity, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax FROM lineitem),
 pr AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS x, t AS y FROM ls WHERE isfinite(t) AND {c} IS NOT NULL" for c in ('l_quantity', 'l_discount', 'l_tax'))}), rk AS ({rank_sql('feature')}),
 cn AS (SELECT p.*, s.spearman, greatest(abs(pearson), abs(spearman)) AS max_association FROM (SELECT feature, count(*) AS valid_rows, (SELECT count(*) FROM ls) - count(*) AS excluded_rows, corr(x, y) AS pearson FROM pr GROUP BY 1) p
  JOIN (SELECT feature, corr(rx, ry) AS spearman FROM rk GROUP BY 1) s USING (feature))"""


@query("f07_continuous_numeric", f"WITH {CONT} SELECT feature, valid_rows, excluded_rows, {R('pearson', 'spearman', 'max_association')}, max_association >= 0.1 AS review FROM cn")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_extendedprice")).alias("t"), "l_quantity",
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_discount")).alias("l_discount"), "l_tax")
    return rounded(tg.continuous_numeric(df, ["l_quantity", "l_discount", "l_tax"], "t"))


@query("f08_ranked_relationships", f"""WITH {DOCS}, {ASSOC}, {MULTI.replace('rk AS', 'rk2 AS').replace('FROM rk ', 'FROM rk2 ')}
SELECT 'category' AS kind, feature, round(cramers_v, 6) + 0.0 AS strength, review, row_number() OVER (ORDER BY review DESC, cramers_v DESC, feature) AS rank FROM fa
UNION ALL SELECT 'multiclass', feature, round(eta_squared, 6) + 0.0, greatest(eta_squared, rank_eta_squared) >= 0.1, row_number() OVER (ORDER BY greatest(eta_squared, rank_eta_squared) >= 0.1 DESC, eta_squared DESC, feature) FROM mu""")
def _(spark, sf):
    a = tg.ranked_relationships(tg.category_association(labelled(spark, sf), CAT, "quality", "1"), "cramers_v")
    b = tg.ranked_relationships(tg.multiclass_numeric(vectors(spark, sf), DIMS, "label"), "eta_squared")
    return rounded(a.withColumn("kind", F.lit("category")).unionByName(b.withColumn("kind", F.lit("multiclass"))))
