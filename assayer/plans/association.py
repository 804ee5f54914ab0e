"""Feature association and leakage queries over lineitem."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from assayer.functions import rnd
from assayer.operators import association as ac
from assayer.operators import leakage as lk
from assayer.plans.registry import R, query, rounded
from assayer.sources.tables import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "one"]
CAT = ["l_returnflag", "l_linestatus", "line", "joint"]
SOURCE = """
 src AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS l_discount, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_tax END AS l_tax, 1.0::DOUBLE AS one,
  l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS line, CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_returnflag || l_linestatus END AS joint FROM lineitem)"""


def source(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_tax")).alias("l_tax"), F.lit(1.0).alias("one"), "l_returnflag", "l_linestatus",
        F.col("l_linenumber").cast("string").alias("line"),
        F.when(F.col("l_linenumber") == 3, " ").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("joint"))


def pairs_sql(columns, src="src"):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in combinations(columns, 2))


def rank_sql(keys="feature_a, feature_b", src="pr"):
    return f"""SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0::DOUBLE AS ry FROM {src}"""


SAFE = "CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN corr({x}, {y}) END"
PAIRS = f"""{SOURCE}, pr AS ({pairs_sql(NUM)}), rk AS ({rank_sql()}),
 pe AS (SELECT feature_a, feature_b, count(*) AS valid_rows, (SELECT count(*) FROM src) - count(*) AS missing_rows, {SAFE.format(x='x', y='y')} AS pearson FROM pr GROUP BY 1, 2),
 sp AS (SELECT feature_a, feature_b, count(*) AS valid_rows, {SAFE.format(x='rx', y='ry')} AS spearman FROM rk GROUP BY 1, 2),
 np AS (SELECT pe.*, spearman, coalesce(greatest(abs(pearson), abs(spearman)), 0) AS max_association, coalesce(greatest(abs(pearson), abs(spearman)) >= 0.8, false) AS strong, coalesce(abs(pearson) >= 0.9, false) AS redundant
  FROM pe JOIN sp USING (feature_a, feature_b))"""


@query("e01_pearson_pairs", f"WITH {PAIRS} SELECT feature_a, feature_b, valid_rows, missing_rows, {R('pearson')} FROM pe")
def _(spark, sf):
    return rounded(ac.pearson_pairs(source(spark, sf), NUM))


@query("e02_spearman_pairs", f"WITH {PAIRS} SELECT feature_a, feature_b, valid_rows, {R('spearman')} FROM sp")
def _(spark, sf):
    return rounded(ac.spearman_pairs(source(spark, sf), NUM))


PART_NUM = ["p_size", "p_retailprice", "size_copy", "p_partkey"]
PART_SOURCE = "psrc AS (SELECT p_size, p_retailprice, p_size * 2.0 + CASE WHEN p_partkey % 10 = 0 THEN 5 ELSE 0 END AS size_copy, p_partkey FROM part)"
PART_PAIRS = f"""{PART_SOURCE}, pr AS ({pairs_sql(PART_NUM, 'psrc')}), rk AS ({rank_sql()}),
 pe AS (SELECT feature_a, feature_b, count(*) AS valid_rows, corr(x, y) AS pearson FROM pr GROUP BY 1, 2), sp AS (SELECT feature_a, feature_b, corr(rx, ry) AS spearman FROM rk GROUP BY 1, 2),
 np AS (SELECT pe.*, CAST(0 AS BIGINT) AS missing_rows, spearman, greatest(abs(pearson), abs(spearman)) AS max_association, greatest(abs(pearson), abs(spearman)) >= 0.8 AS strong, abs(pearson) >= 0.9 AS redundant FROM pe JOIN sp USING (feature_a, feature_b))"""


def part_source(spark, sf):
    copy = F.col("p_size") * 2.0 + F.when(F.col("p_partkey") % 10 == 0, 5).otherwise(0)
    return table(spark, sf, "part").select("p_size", "p_retailprice", copy.alias("size_copy"), "p_partkey")


@query("e01_numeric_pairs", f"WITH {PART_PAIRS} SELECT feature_a, feature_b, valid_rows, missing_rows, {R('pearson', 'spearman', 'max_association')}, strong, redundant FROM np")
def _(spark, sf):
    return rounded(ac.numeric_pairs(part_source(spark, sf), PART_NUM))


@query("e08_review_list", f"WITH {PART_PAIRS} SELECT feature_a, feature_b, {R('max_association')}, redundant FROM np WHERE strong OR redundant")
def _(spark, sf):
    return rounded(ac.review_list(ac.numeric_pairs(part_source(spark, sf), PART_NUM)).select(
        "feature_a", "feature_b", "max_association", "redundant"))


def text_pairs_sql(columns, src="src"):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, lower(trim({a})) AS x, lower(trim({b})) AS y, count(*)::DOUBLE AS n FROM {src} WHERE trim({a}) <> '' AND trim({b}) <> '' GROUP BY 3, 4"
        for a, b in combinations(columns, 2))


def measures_sql(keys: str, src: str = "ct") -> str:
    return f"""
 mg AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, x) AS r, sum(n) OVER (PARTITION BY {keys}, y) AS c, sum(n) OVER (PARTITION BY {keys}) AS t FROM {src}),
 en AS (SELECT {keys}, any_value(t) AS t, sum(n * n / (r * c)) AS k, count(DISTINCT x) AS la, count(DISTINCT y) AS lb, -sum(n / t * ln(r / t)) AS hx, -sum(n / t * ln(c / t)) AS hy, -sum(n / t * ln(n / t)) AS hxy FROM mg GROUP BY {keys}),
 me AS (SELECT {keys}, CAST(t AS BIGINT) AS valid_rows, la AS levels_a, lb AS levels_b, CASE WHEN la > 1 AND lb > 1 THEN sqrt(greatest(0, least(1, (k - 1) / (least(la, lb) - 1)))) END AS cramers_v,
  CASE WHEN la > 1 AND lb > 1 THEN greatest(0, least(1, (hx - (hxy - hy)) / hx)) END AS u_a_given_b, CASE WHEN la > 1 AND lb > 1 THEN greatest(0, least(1, (hy - (hxy - hx)) / hy)) END AS u_b_given_a FROM en)"""


CONTINGENCY = f"{SOURCE}, ct AS ({text_pairs_sql(CAT)}), {measures_sql('feature_a, feature_b')}"


@query("e03_categorical_pairs", f"""WITH {CONTINGENCY}
SELECT feature_a, feature_b, valid_rows, levels_a, levels_b, {R('cramers_v', 'u_a_given_b', 'u_b_given_a')}, cramers_v >= 0.8 AS strong, greatest(u_a_given_b, u_b_given_a) >= 0.99 AS structural,
 cramers_v >= 0.9 AND least(u_a_given_b, u_b_given_a) >= 0.99 AS redundant FROM me""")
def _(spark, sf):
    return rounded(ac.categorical_pairs(source(spark, sf), CAT))


@query("e04_uncertainty_coefficients", f"""WITH {CONTINGENCY}
SELECT feature_a AS known, feature_b AS explained, round(u_b_given_a, 6) + 0.0 AS u FROM me UNION ALL SELECT feature_b, feature_a, round(u_a_given_b, 6) + 0.0 FROM me""")
def _(spark, sf):
    m = ac.categorical_pairs(source(spark, sf), CAT)
    return rounded(m.select(F.inline(F.array(
        F.struct(F.col("feature_a").alias("known"), F.col("feature_b").alias("explained"), F.col("u_b_given_a").alias("u")),
        F.struct(F.col("feature_b").alias("known"), F.col("feature_a").alias("explained"), F.col("u_a_given_b").alias("u"))))))


MIXED_NUM = ["l_quantity", "l_discount", "l_tax"]
ETA = "greatest(0, least(1, sum(n * (m - g) ** 2) / (sum(n * v) + sum(n * (m - g) ** 2))))"


def mixed_sql(cats, nums, src="src"):
    return " UNION ALL ".join(f"SELECT '{c}' AS category, '{m}' AS number, lower(trim({c})) AS k, {m}::DOUBLE AS v FROM {src} WHERE trim({c}) <> '' AND {m} IS NOT NULL" for c in cats for m in nums)


@query("e05_mixed_pairs", f"""WITH {SOURCE}, mx AS ({mixed_sql(CAT, MIXED_NUM)}), g AS (SELECT category, number, avg(v) AS g FROM mx GROUP BY 1, 2),
 p AS (SELECT category, number, k, count(*) AS n, avg(v) AS m, var_pop(v) AS v FROM mx GROUP BY 1, 2, 3)
SELECT category, number, CAST(sum(n) AS BIGINT) AS valid_rows, count(*) AS groups, round({ETA}, 6) + 0.0 AS eta_squared, {ETA} >= 0.8 AS strong FROM p JOIN g USING (category, number) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(ac.mixed_pairs(source(spark, sf), CAT, MIXED_NUM))


@query("e06_product_interaction", f"""
WITH b AS (SELECT l_quantity * l_discount AS x, l_tax AS y FROM lineitem), rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM b)
SELECT *, greatest(abs(pearson), abs(spearman)) >= 0.8 AS strong, abs(pearson) >= 0.9 AS redundant FROM (
 SELECT 'l_quantity*l_discount' AS interaction, 'l_tax' AS compared, count(*) AS row_count, count(x - y) AS valid_rows, round(corr(x, y), 6) + 0.0 AS pearson, (SELECT round(corr(rx, ry), 6) + 0.0 FROM rk) AS spearman,
  round(avg(abs(x - y)), 6) + 0.0 AS mean_abs_difference, round(median(abs(x - y)), 6) + 0.0 AS median_abs_difference, round(avg(abs(x - y) / abs(y)) FILTER (abs(y) > 0), 5) + 0.0 AS mean_relative_difference FROM b)""")
def _(spark, sf):
    return rounded(ac.product_interaction(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_tax"), mean_relative_difference=5)


@query("e07_association_matrix", f"""WITH {PAIRS}, mi AS (SELECT feature_a AS f, feature_b AS o, pearson AS v FROM pe UNION ALL SELECT feature_b, feature_a, pearson FROM pe)
SELECT f AS feature, {', '.join(f"round(CASE WHEN f = '{c}' THEN 1.0 ELSE max(v) FILTER (o = '{c}') END, 6) + 0.0 AS {c}" for c in NUM)} FROM mi GROUP BY f""")
def _(spark, sf):
    return rounded(ac.association_matrix(ac.pearson_pairs(source(spark, sf), NUM), NUM, "pearson"))


@query("e09_feature_issues", "SELECT 'one' AS feature, 'Constant feature' AS issue, count(DISTINCT 1) AS distinct_values FROM lineitem UNION ALL SELECT 'l_comment', 'Feature missing', 0")
def _(spark, sf):
    return ac.feature_issues(source(spark, sf), ["l_quantity", "l_tax", "one", "l_comment"])


# --- leakage -----------------------------------------------------------------------------------------------------

PROXY = {
    "copy": "l_returnflag", "spelled": "' ' || lower(l_returnflag)", "code": "CASE l_returnflag WHEN 'A' THEN 'k1' WHEN 'N' THEN 'k2' ELSE 'k3' END",
    "fine": "l_returnflag || CAST(l_linenumber AS VARCHAR)", "l_linestatus": "l_linestatus", "partly": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END", "id": "CAST(l_orderkey AS VARCHAR) || l_returnflag",
}


def proxy_sql(name, expr):
    return f"""SELECT '{name}' AS field, {expr} AS f, l_returnflag AS t FROM lineitem"""


@query("i01_target_proxies", f"""
WITH s AS (SELECT field, f, t, lower(trim(f)) AS fn, lower(trim(t)) AS tn FROM ({' UNION ALL '.join(proxy_sql(k, v) for k, v in PROXY.items())}) WHERE f IS NOT NULL),
 r AS (SELECT field, count(*) AS paired_rows, avg((f = t)::INT::DOUBLE) AS exact_rate, avg((fn = tn)::INT::DOUBLE) AS normalized_rate, count(DISTINCT fn) AS cardinality, count(DISTINCT tn) AS target_cardinality FROM s GROUP BY 1),
 fw AS (SELECT field, max(k) AS fk FROM (SELECT field, fn, count(DISTINCT tn) AS k FROM s GROUP BY 1, 2) GROUP BY 1), rv AS (SELECT field, max(k) AS rk FROM (SELECT field, tn, count(DISTINCT fn) AS k FROM s GROUP BY 1, 2) GROUP BY 1),
 m AS (SELECT *, CASE WHEN exact_rate = 1 THEN 'Exact target copy' WHEN normalized_rate = 1 THEN 'Normalized target copy' WHEN fk = 1 AND rk = 1 AND cardinality = target_cardinality THEN 'Bidirectional target mapping'
  WHEN fk = 1 AND cardinality <= greatest(10, target_cardinality * 5) AND cardinality / paired_rows::DOUBLE <= 0.5 AND field <> 'id' THEN 'Deterministic target mapping' ELSE 'None' END AS method FROM r JOIN fw USING (field) JOIN rv USING (field))
SELECT field, paired_rows, {R('exact_rate', 'normalized_rate')}, fk = 1 AS deterministic, fk = 1 AND rk = 1 AS bidirectional, cardinality, target_cardinality, method,
 CASE WHEN method LIKE '%target copy' THEN 'Critical' WHEN method <> 'None' THEN 'High' ELSE 'None' END AS severity FROM m""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", *[F.expr(e.replace("VARCHAR", "STRING")).alias(n) for n, e in PROXY.items()])
    return rounded(lk.target_proxies(df, list(PROXY), "l_returnflag", identifiers=["id"]))


AFFINE = {"copy": "l_extendedprice", "line": "l_extendedprice * 0.25 + 7", "l_quantity": "l_quantity", "noisy": "CASE WHEN l_linenumber = 3 THEN l_extendedprice * 2 + 1 ELSE l_extendedprice * 2 END"}


@query("i02_affine_proxies", f"""
WITH s AS ({' UNION ALL '.join(f"SELECT '{k}' AS field, {v} AS f, l_extendedprice AS t FROM lineitem" for k, v in AFFINE.items())}),
 l AS (SELECT field, regr_slope(f, t) AS s, regr_intercept(f, t) AS i, var_pop(f) AS v FROM s GROUP BY 1),
 m AS (SELECT field, count(*) AS n, any_value(s) AS s, any_value(i) AS i, avg((abs(f - t) <= 1e-10 + 1e-8 * abs(t))::INT::DOUBLE) AS c, avg((abs(f - (s * t + i)) <= 1e-10 + 1e-8 * abs(s * t + i))::INT::DOUBLE) AS a,
  max(abs(f - (s * t + i))) AS e, max(abs(f - t)) AS d, 1 - avg((f - (s * t + i)) ** 2) / any_value(v) AS q FROM s JOIN l USING (field) GROUP BY 1)
SELECT field, n AS paired_rows, CASE WHEN c >= 0.99 THEN 'Exact numeric target copy' WHEN a >= 0.99 AND q >= 0.99 THEN 'Affine numeric target transform' ELSE 'None' END AS method, round(CASE WHEN c >= 0.99 THEN 1.0 ELSE s END, 6) + 0.0 AS slope,
 round(CASE WHEN c >= 0.99 THEN 0.0 ELSE i END, 4) + 0.0 AS intercept, round(CASE WHEN c >= 0.99 THEN c ELSE a END, 4) + 0.0 AS match_rate, round(CASE WHEN c >= 0.99 THEN d ELSE e END, 4) + 0.0 AS max_abs_error, round(CASE WHEN c >= 0.99 THEN 1.0 ELSE q END, 6) + 0.0 AS r_squared FROM m""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_extendedprice", *[F.expr(e).cast("double").alias(n) for n, e in AFFINE.items()])
    return rounded(lk.affine_proxies(df, list(AFFINE), "l_extendedprice"), intercept=4, match_rate=4, max_abs_error=4)


SHAPES = """
 sh AS (SELECT l_extendedprice AS area, l_quantity * 10 AS perimeter, l_quantity + 60 AS major, l_quantity + 1 AS minor, l_linenumber AS ln FROM lineitem),
 dv AS (SELECT *, major / minor AS aspect, sqrt(greatest(0, 1 - (minor / major) * (minor / major))) AS ecc, sqrt(4 * area / pi()) AS diameter, CASE WHEN ln = 5 THEN 0 ELSE 4 * pi() * area / (perimeter * perimeter) END AS round_,
  4 * area / (pi() * major * major) AS sf3, CASE WHEN ln = 5 THEN NULL ELSE 4 * area / (pi() * major * minor) END AS sf4 FROM sh)"""


def dep_sql(col, formula):
    return f"""SELECT '{col}' AS feature, count({col}) AS evaluated, round(avg((abs({col} - f) <= 1e-9 + 1e-4 * abs(f))::INT::DOUBLE) FILTER ({col} IS NOT NULL), 6) + 0.0 AS match_rate, round(max(abs({col} - f)), 4) + 0.0 AS max_abs_error,
 round(coalesce(max(CASE WHEN abs(f) > 1e-9 THEN abs({col} - f) / abs(f) END), 0), 6) + 0.0 AS max_rel_error, avg((abs({col} - f) <= 1e-9 + 1e-4 * abs(f))::INT::DOUBLE) FILTER ({col} IS NOT NULL) >= 0.99 AS confirmed FROM (SELECT *, {formula} AS f FROM dv)"""


@query("i03_derived_dependencies", f"WITH {SHAPES} " + " UNION ALL ".join([
    dep_sql("aspect", "major / minor"), dep_sql("ecc", "sqrt(greatest(0, 1 - (minor / major) * (minor / major)))"), dep_sql("diameter", "sqrt(4 * area / pi())"),
    dep_sql("round_", "4 * pi() * area / (perimeter * perimeter)"), dep_sql("sf3", "4 * area / (pi() * major * major)"), dep_sql("sf4", "4 * area / (pi() * major * minor)")]))
def _(spark, sf):
    a, p, mj, mn = (F.col(c) for c in ("area", "perimeter", "major", "minor"))
    base = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("area"), (F.col("l_quantity") * 10).alias("perimeter"), (F.col("l_quantity") + 60).alias("major"),
        (F.col("l_quantity") + 1).alias("minor"), F.col("l_linenumber").alias("ln"))
    formulas = {"aspect": lk.ratio(mj, mn), "ecc": lk.eccentricity(mj, mn), "diameter": lk.equivalent_diameter(a),
                "round_": lk.roundness(a, p), "sf3": lk.shape_factor_3(a, mj), "sf4": lk.shape_factor_4(a, mj, mn)}
    stored = {k: v for k, v in formulas.items()}
    stored["round_"] = F.when(F.col("ln") == 5, 0.0).otherwise(formulas["round_"])
    stored["sf4"] = F.when(F.col("ln") != 5, formulas["sf4"])
    return rounded(lk.derived_dependencies(base.withColumns(stored), formulas), max_abs_error=4)


DEPENDENCIES = [("n_name", "n_regionkey"), ("n_regionkey", "n_name"), ("c_nationkey", "n_name"), ("o_custkey", "o_orderpriority"), ("o_custkey", "c_nationkey")]


@query("i04_functional_dependencies", f"""
WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT *, violating_groups = 0 AS holds FROM ({' UNION ALL '.join(f'''SELECT '{a}' AS determinant, '{b}' AS dependent, count(*) AS groups, count(*) FILTER (k > 1) AS violating_groups, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS violating_rows
 FROM (SELECT {a}, count(DISTINCT {b}) AS k, count(*) AS n FROM j GROUP BY 1)''' for a, b in DEPENDENCIES)})""")
def _(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return ac.functional_dependencies(j, DEPENDENCIES)
