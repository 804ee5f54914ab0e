"""Validation queries. `dirty_lineitem` injects missing, blank, unreadable and inconsistent values by rule."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import norm_text, rnd
from assayer.operators import identity as idn
from assayer.operators import leakage as lk
from assayer.operators import profile as pf
from assayer.operators import quality as q
from assayer.plans.registry import ORACLE, R, query, rounded
from assayer.sources.tables import table, work_folder

DIRTY = """
dirty AS (SELECT *, CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_linenumber = 7 THEN '  ' WHEN l_orderkey % 97 = 0 THEN 'n/a'
   WHEN l_orderkey % 89 = 0 THEN '-inf' WHEN l_orderkey % 83 = 0 THEN '2.5' ELSE CAST(l_quantity AS VARCHAR) END AS qty,
  CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN ' a' || chr(9) WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 'X' WHEN l_suppkey % 31 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem),
parsed AS (SELECT *, trim(qty) = '' AS blank, TRY_CAST(qty AS DOUBLE) AS x FROM dirty)"""


def dirty_lineitem(spark, sf) -> DataFrame:
    qty = (F.when(F.col("l_partkey") % 50 == 0, F.lit(None)).when(F.col("l_linenumber") == 7, "  ")
           .when(F.col("l_orderkey") % 97 == 0, "n/a").when(F.col("l_orderkey") % 89 == 0, "-inf")
           .when(F.col("l_orderkey") % 83 == 0, "2.5").otherwise(F.col("l_quantity").cast("string")))
    flag = (F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), " a\t")
            .when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 2), "X")
            .when(F.col("l_suppkey") % 31 == 0, F.lit(None)).otherwise(F.col("l_returnflag")))
    return table(spark, sf, "lineitem").withColumns({"qty": qty, "flag": flag})


@query("b01_numeric_projection", f"""WITH {DIRTY}
SELECT 'qty' AS feature, count(*) AS row_count, count(*) FILTER (NOT coalesce(blank, false) AND x IS NOT NULL OR blank AND l_returnflag = 'N') AS valid,
 count(*) FILTER (qty IS NULL) AS missing_count, count(*) FILTER (blank AND l_returnflag <> 'N') AS blank_count, count(*) FILTER (NOT blank AND x IS NULL) AS non_numeric_count,
 count(*) FILTER (blank AND l_returnflag = 'N') AS materialized_count, count(*) FILTER (blank AND l_returnflag <> 'N') AS condition_failed_count FROM parsed
UNION ALL SELECT 'l_discount', count(*), count(l_discount), 0, 0, 0, 0, 0 FROM lineitem""")
def _(spark, sf):
    p = q.numeric_projection(dirty_lineitem(spark, sf), ["qty", "l_discount"], blank_to={"qty": ("l_returnflag", "N", 0.0)})
    return q.projection_counts(p, ["qty", "l_discount"])


@query("b02_materialize_blanks", f"""WITH {DIRTY}
SELECT l_returnflag, l_linenumber = 7 AS was_blank, count(*) AS rows, count(v) AS valid, round(sum(CASE WHEN isfinite(v) THEN v END), 2) + 0.0 AS total FROM
 (SELECT *, CASE WHEN blank AND l_returnflag = 'N' THEN 0.0 ELSE x END AS v FROM parsed) GROUP BY 1, 2""")
def _(spark, sf):
    df = q.materialize_blanks(dirty_lineitem(spark, sf), "qty", "l_returnflag", "N", 0.0)
    finite = F.when(F.abs("qty") != float("inf"), F.col("qty"))
    return df.groupBy("l_returnflag", (F.col("l_linenumber") == 7).alias("was_blank")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("qty").alias("valid"), rnd(F.sum(finite), 2).alias("total"))


@query("b03_change_audit", """
SELECT row_count, lost, 0::BIGINT AS added, repeated, "column", changed, allowed, false AS ok FROM (
 SELECT count(*) FILTER (kept) AS row_count, count(*) FILTER (NOT kept) AS lost, count(*) FILTER (kept AND c_acctbal < 0) AS n1, count(*) FILTER (kept AND c_mktsegment = 'BUILDING') AS n2
 FROM (SELECT *, c_custkey % 100 <> 5 AS kept FROM customer UNION ALL SELECT *, true FROM customer WHERE c_custkey % 100 = 6)),
 (SELECT count(*) FILTER (c_custkey % 100 = 6) AS repeated FROM customer),
 LATERAL (VALUES ('c_name', 0, false), ('c_nationkey', 0, false), ('c_acctbal', n1, true), ('c_mktsegment', n2, false)) AS v("column", changed, allowed)""")
def _(spark, sf):
    """Every hundredth customer is lost, every hundredth repeated."""
    raw = table(spark, sf, "customer")
    prepared = raw.withColumns({
        "c_acctbal": F.when(F.col("c_acctbal") < 0, 1e9).otherwise(F.col("c_acctbal")),
        "c_mktsegment": F.when(F.col("c_mktsegment") == "BUILDING", "HOUSES").otherwise(F.col("c_mktsegment"))})
    prepared = prepared.where(F.col("c_custkey") % 100 != 5).unionByName(prepared.where(F.col("c_custkey") % 100 == 6))
    return q.change_audit(raw, prepared, ["c_custkey"], allowed=["c_acctbal"])


@query("b04_role_projection", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice AS target FROM lineitem")
def _(spark, sf):
    roles = q.Roles(("l_orderkey", "l_linenumber"), ("l_quantity", "l_discount"), "l_extendedprice")
    df = table(spark, sf, "lineitem")
    roles.check(df)
    return df.select(*roles.identifiers, *roles.features, F.col(roles.target).alias("target"))


@query("b05_text_normalisation", f"""WITH {DIRTY} SELECT coalesce(nullif(lower(regexp_replace(flag, '^\\s+|\\s+$', '', 'g')), ''), '(missing)') AS level, count(DISTINCT flag) AS spellings, count(*) AS rows FROM dirty GROUP BY 1""")
def _(spark, sf):
    return dirty_lineitem(spark, sf).groupBy(F.coalesce(norm_text("flag"), F.lit("(missing)")).alias("level")).agg(
        F.count_distinct("flag").alias("spellings"), F.count(F.lit(1)).alias("rows"))


LINE_CONTRACT = {
    "qty": q.Expected("integer", nullable=False, minimum=0, maximum=49), "flag": q.Expected("text", allowed=("A", "N", "R")),
    "l_discount": q.Expected("number", minimum=0, maximum=0.09), "l_comment": q.Expected("text"),
}


@query("b07_contract_violations", f"""WITH {DIRTY},
 v AS (SELECT array_to_string(list_sort(list_filter([
   CASE WHEN l_discount > 0.09 THEN 'above:l_discount' END, CASE WHEN x > 49 THEN 'above:qty' END, CASE WHEN x < 0 THEN 'below:qty' END, 'extra:l_tax',
   CASE WHEN x = 2.5 THEN 'fraction:qty' END, CASE WHEN isinf(x) THEN 'infinite:qty' END, 'missing:l_comment', CASE WHEN flag IS NULL THEN 'null:flag' END,
   CASE WHEN qty IS NULL THEN 'null:qty' END, CASE WHEN qty IS NOT NULL AND x IS NULL THEN 'type:qty' END, CASE WHEN flag NOT IN ('A', 'N', 'R') THEN 'unknown:flag' END],
   lambda e: e IS NOT NULL)), ',') AS violations FROM parsed)
SELECT violations, count(*) AS rows FROM v GROUP BY 1""")
def _(spark, sf):
    df = q.contract_violations(dirty_lineitem(spark, sf), LINE_CONTRACT, prohibited=["l_tax"])
    return df.groupBy(F.concat_ws(",", "violations").alias("violations")).agg(F.count(F.lit(1)).alias("rows"))


@query("b08_encode", """
WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_linestatus, l_returnflag, count(*) AS rows, round(avg((l_quantity - m) / s), 6) + 0.0 AS quantity_z, round(avg((l_tax - m2) / s2), 6) + 0.0 AS tax_z,
 CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS flag_a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS flag_n FROM lineitem, f GROUP BY 1, 2""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    train = df.where(F.col("l_returnflag") != "R")
    levels = q.fit_levels(train, ["l_returnflag"])
    out = q.encode(df, q.fit_encoding(train, ["l_quantity", "l_tax"]), ["l_linestatus", "l_returnflag"], ["l_quantity", "l_tax"], levels)
    return out.groupBy("l_linestatus", "l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.avg("l_quantity_z")).alias("quantity_z"), rnd(F.avg("l_tax_z")).alias("tax_z"),
        F.sum(F.col("`l_returnflag=A`").cast("bigint")).alias("flag_a"), F.sum(F.col("`l_returnflag=N`").cast("bigint")).alias("flag_n"))


@query("b08_encode_long", """
WITH l AS (SELECT o_orderkey, unnest(['o_custkey', 'o_orderstatus']) AS feature, unnest([CAST(o_custkey AS VARCHAR), o_orderstatus]) AS level, o_orderkey % 3 = 0 AS train FROM orders),
 v AS (SELECT DISTINCT feature, level FROM l WHERE train)
SELECT feature, count(*) AS rows, count(DISTINCT level) AS levels FROM l JOIN v USING (feature, level) GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "orders")
    out = q.encode_long(df.where(F.col("o_orderkey") % 3 == 0), df, ["o_orderkey"], ["o_custkey", "o_orderstatus"])
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("level").alias("levels"))


@query("b09_unknown_levels", """
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size FROM part)
SELECT feature, level, count(*) AS rows FROM (
 SELECT 'p_type' AS feature, p_type AS level FROM p WHERE p_size > 25 UNION ALL SELECT 'p_brand', p_brand || CASE WHEN p_size > 48 THEN '*' ELSE '' END FROM p WHERE p_size > 25)
WHERE (feature, level) NOT IN (SELECT 'p_type', p_type FROM p WHERE p_size <= 25 UNION ALL SELECT 'p_brand', p_brand FROM p WHERE p_size <= 25) GROUP BY 1, 2""")
def _(spark, sf):
    p = table(spark, sf, "part")
    scored = p.where(F.col("p_size") > 25).withColumn(
        "p_brand", F.concat("p_brand", F.when(F.col("p_size") > 48, "*").otherwise("")))
    return q.unknown_levels(p.where(F.col("p_size") <= 25), scored, ["p_brand", "p_type"])


UNIT = "WITH u AS (SELECT *, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_orderkey END AS line_order FROM lineitem), i AS (SELECT line_order, l_linenumber, count(*) AS n FROM u GROUP BY 1, 2)"


def unit_rows(spark, sf):
    return table(spark, sf, "lineitem").withColumn("line_order", F.when(F.col("l_partkey") % 50 != 0, F.col("l_orderkey")))


@query("c01_observation_unit", f"""{UNIT}
SELECT *, missing = 0 AND duplicated_ids = 0 AS is_unit FROM (SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n) FILTER (line_order IS NOT NULL) AS BIGINT) AS non_null, count(*) FILTER (line_order IS NOT NULL) AS unique_ids,
 CAST(coalesce(sum(n) FILTER (line_order IS NULL), 0) AS BIGINT) AS missing, count(*) FILTER (line_order IS NOT NULL AND n > 1) AS duplicated_ids,
 CAST(sum(n) FILTER (line_order IS NOT NULL AND n > 1) AS BIGINT) AS duplicated_rows FROM i)""")
def _(spark, sf):
    return q.observation_unit(unit_rows(spark, sf), ["line_order", "l_linenumber"])


@query("c01_duplicated_rows", f"""{UNIT}
SELECT u.l_orderkey, u.l_linenumber, u.l_partkey, u.l_suppkey, i.n AS occurrences FROM u JOIN i ON u.line_order = i.line_order AND u.l_linenumber = i.l_linenumber WHERE i.n > 1""")
def _(spark, sf):
    return q.duplicated_rows(unit_rows(spark, sf), ["line_order", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "occurrences")


@query("c02_value_types", f"""WITH {DIRTY},
 c AS (SELECT feature, count(*) AS row_count, count(*) FILTER (trim(v) <> '') AS present, count(*) FILTER (regexp_full_match(v, '\\s*[+-]?\\d+\\s*')) AS as_integer, count(*) FILTER (trim(v) <> '' AND TRY_CAST(v AS DOUBLE) IS NOT NULL) AS as_number,
  count(*) FILTER (lower(trim(v)) IN ('true', 'false')) AS as_boolean, count(*) FILTER (regexp_full_match(v, '\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}\\s*')) AS as_date FROM (
  SELECT unnest(['qty', 'flag', 'shipped', 'late', 'part_text']) AS feature, unnest([qty, flag, strftime(l_shipdate, '%Y-%m-%d'), CASE WHEN l_tax > 0.04 THEN 'True' ELSE 'false' END, CAST(l_partkey AS VARCHAR)]) AS v FROM dirty) GROUP BY 1),
 o AS (SELECT *, CASE WHEN present = 0 THEN 'any' WHEN as_integer = present THEN 'integer' WHEN as_number = present THEN 'floating' WHEN as_boolean = present THEN 'boolean' WHEN as_date = present THEN 'datetime' ELSE 'string' END AS observed FROM c)
SELECT *, CASE feature WHEN 'qty' THEN 'numeric' WHEN 'shipped' THEN 'datetime | string' WHEN 'part_text' THEN 'numeric' ELSE '' END AS expected,
 CASE WHEN feature IN ('flag', 'late') THEN 'Not declared' WHEN feature = 'qty' AND observed IN ('integer', 'floating') OR feature = 'part_text' AND observed IN ('integer', 'floating') OR feature = 'shipped' AND observed IN ('datetime', 'string') THEN 'Match' ELSE 'Mismatch' END AS status FROM o
UNION ALL SELECT 'absent', 0, 0, 0, 0, 0, 0, '', 'boolean', 'Missing column'""")
def _(spark, sf):
    df = dirty_lineitem(spark, sf).select(
        "qty", "flag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
        F.when(F.col("l_tax") > 0.04, "True").otherwise("false").alias("late"), F.col("l_partkey").cast("string").alias("part_text"))
    return q.value_types(df, df.columns, {"qty": ["numeric"], "shipped": ["datetime", "string"], "part_text": ["numeric"], "absent": ["boolean"]})


RULES = {
    "qty": q.ValueRule(numeric=True, integer=True, minimum=2, maximum=48), "flag": q.ValueRule(allowed=("A", "N", "R")),
    "l_tax": q.ValueRule(numeric=True, maximum=0.07), "l_comment": q.ValueRule(),
}


@query("c03_value_checks", f"""WITH {DIRTY},
 m AS (SELECT *, qty IS NULL AS mi, coalesce(blank, false) AS bl, coalesce(NOT blank AND x IS NULL, false) AS nn, coalesce(isinf(x), false) AS nf, coalesce(x = 2.5, false) AS ni, coalesce(x < 2, false) AS lo, coalesce(x > 48, false) AS hi,
  flag IS NULL AS fm, coalesce(lower(regexp_replace(flag, '^\\s+|\\s+$', '', 'g')) IN ('a', 'n', 'r') AND flag NOT IN ('A', 'N', 'R'), false) AS fi, coalesce(flag = 'X', false) AS fu FROM parsed),
 r AS (SELECT count(*) AS row_count, 'qty' AS "column", count(*) FILTER (mi) AS missing_count, count(*) FILTER (bl) AS blank_count, CAST(0 AS BIGINT) AS inconsistent_count, count(*) FILTER (mi OR bl OR nn OR nf OR ni OR lo OR hi) AS invalid_count,
   count(*) FILTER (mi OR bl OR nn OR nf OR ni OR lo OR hi) AS affected_count, 'Missing value, Blank value, Non-numeric value, Non-finite value, Non-integer value, Below minimum, Above maximum' AS issue_types FROM m
  UNION ALL SELECT count(*), 'flag', count(*) FILTER (fm), 0, count(*) FILTER (fi), count(*) FILTER (fm OR fu), count(*) FILTER (fm OR fu OR fi), 'Inconsistent text, Missing value, Unexpected value' FROM m
  UNION ALL SELECT count(*), 'l_tax', 0, 0, 0, count(*) FILTER (l_tax > 0.07), count(*) FILTER (l_tax > 0.07), 'Above maximum' FROM m)
SELECT *, round(100.0 * affected_count / row_count, 4) + 0.0 AS affected_percent, 'Review required' AS status FROM r
UNION ALL SELECT count(*), 'l_comment', 0, 0, 0, 0, 0, '', 0.0, 'Missing column' FROM lineitem""")
def _(spark, sf):
    return rounded(q.value_checks(dirty_lineitem(spark, sf), RULES), affected_percent=4)


@query("c04_issue_samples", f"""WITH {DIRTY},
 h AS (SELECT 'qty' AS "column", 'Missing value' AS issue, '(missing)' AS value FROM parsed WHERE qty IS NULL UNION ALL SELECT 'qty', 'Blank value', qty FROM parsed WHERE blank
  UNION ALL SELECT 'qty', 'Non-numeric value', qty FROM parsed WHERE NOT blank AND x IS NULL UNION ALL SELECT 'qty', 'Non-finite value', qty FROM parsed WHERE isinf(x)
  UNION ALL SELECT 'qty', 'Non-integer value', qty FROM parsed WHERE x = 2.5 UNION ALL SELECT 'qty', 'Below minimum', qty FROM parsed WHERE x < 2 UNION ALL SELECT 'qty', 'Above maximum', qty FROM parsed WHERE x > 48
  UNION ALL SELECT 'flag', 'Missing value', '(missing)' FROM parsed WHERE flag IS NULL UNION ALL SELECT 'flag', 'Unexpected value', flag FROM parsed WHERE flag = 'X'
  UNION ALL SELECT 'flag', 'Inconsistent text', flag FROM parsed WHERE flag = ' a' || chr(9) UNION ALL SELECT 'l_tax', 'Above maximum', CAST(l_tax AS VARCHAR) FROM parsed WHERE l_tax > 0.07),
 g AS (SELECT "column", issue, value, count(*) AS count FROM h GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column", issue ORDER BY count DESC, value) AS rank FROM g) WHERE rank <= 5""")
def _(spark, sf):
    return rounded(q.issue_samples(dirty_lineitem(spark, sf), RULES))


@query("c05_source_rules", """
SELECT *, round(100.0 * affected_count / row_count, 4) + 0.0 AS affected_percent, CASE WHEN affected_count > 0 THEN 'Review required' ELSE 'Valid' END AS status FROM (
 SELECT count(*) AS row_count, 'l_quantity' AS "column", CAST(0 AS BIGINT) AS missing_count, CAST(0 AS BIGINT) AS blank_count, CAST(0 AS BIGINT) AS inconsistent_count, count(*) FILTER (l_quantity <> floor(l_quantity)) AS invalid_count, count(*) FILTER (l_quantity <> floor(l_quantity)) AS affected_count, '' AS issue_types FROM lineitem
 UNION ALL SELECT count(*), 'l_discount', 0, 0, 0, 0, 0, '' FROM lineitem
 UNION ALL SELECT count(*), 'l_returnflag', 0, 0, 0, count(*) FILTER (l_returnflag NOT IN ('A', 'N')), count(*) FILTER (l_returnflag NOT IN ('A', 'N')), 'Unexpected value' FROM lineitem
 UNION ALL SELECT count(*), 'l_linestatus', 0, 0, 0, 0, 0, '' FROM lineitem)""")
def _(spark, sf):
    source = [{"name": "l_quantity", "type": "integer"}, {"name": "l_discount", "type": "Continuous"},
              {"name": "l_returnflag", "type": "categorical"}, {"name": "l_linestatus", "type": "binary"}]
    rules = q.rules_from_source(source, "l_returnflag", ("A", "N"))
    return rounded(q.value_checks(table(spark, sf, "lineitem"), rules), affected_percent=4)


@query("c06_domain_checks", f"""WITH {DIRTY},
 r AS (SELECT 'l_extendedprice' AS "column", '> 0' AS rule, count(l_extendedprice) AS evaluated, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum, count(*) FILTER (l_extendedprice <= 0) AS violations FROM parsed
  UNION ALL SELECT 'qty', '>= 0', count(qty), min(x), max(x), count(*) FILTER (qty IS NOT NULL AND NOT coalesce(x >= 0, false)) FROM parsed
  UNION ALL SELECT 'l_discount', '0 <= value <= 1', count(l_discount), min(abs(l_discount)), max(l_discount), count(*) FILTER (l_discount < 0 OR l_discount > 1) FROM parsed
  UNION ALL SELECT 'l_quantity', '>= 5', count(*), min(l_quantity), max(l_quantity), count(*) FILTER (l_quantity < 5) FROM parsed
  UNION ALL SELECT 'l_tax', '<= 0.05', count(*), min(abs(l_tax)), max(l_tax), count(*) FILTER (l_tax > 0.05) FROM parsed)
SELECT "column", rule, evaluated, minimum + 0.0 AS minimum, maximum + 0.0 AS maximum, violations, CASE WHEN violations > 0 THEN 'Violation' ELSE 'Valid' END AS status FROM r""")
def _(spark, sf):
    d = q.Domains(positive=("l_extendedprice",), non_negative=("qty",), unit_interval=("l_discount",),
                  minimums={"l_quantity": 5}, maximums={"l_tax": 0.05})
    out = q.domain_checks(dirty_lineitem(spark, sf), d)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("minimum", "maximum")})


@query("c07_relation_checks", """
SELECT relation, evaluated, violations FROM (SELECT count(*) AS n, count(*) FILTER (l_discount > l_tax) AS a, count(*) FILTER (l_extendedprice < l_quantity) AS b, count(*) FILTER (l_partkey <> l_suppkey) AS c FROM lineitem),
 LATERAL (VALUES ('l_discount <= l_tax', n, a), ('l_extendedprice >= l_quantity', n, b), ('l_partkey == l_suppkey', n, c)) AS v(relation, evaluated, violations)""")
def _(spark, sf):
    return q.relation_checks(table(spark, sf, "lineitem"), [
        ("l_discount", "<=", "l_tax"), ("l_extendedprice", ">=", "l_quantity"), ("l_partkey", "==", "l_suppkey")])


@query("c08_duplicate_groups", """
SELECT md5(text) AS text_hash, lang, source, count(*) AS group_size, min(doc_id) AS first_position FROM documents GROUP BY text, lang, source HAVING count(*) > 1""")
def _(spark, sf):
    g = q.duplicate_groups(table(spark, sf, "documents"), ["text", "lang", "source"], "doc_id")
    return g.select(F.md5("text").alias("text_hash"), "lang", "source", "group_size", "first_position")


@query("c08_duplicate_samples", """
WITH g AS (SELECT text, lang, count(*) AS group_size, min(doc_id) AS f FROM documents GROUP BY 1, 2 HAVING count(*) > 1),
 n AS (SELECT *, row_number() OVER (ORDER BY f) AS "group" FROM g ORDER BY f LIMIT 10)
SELECT * FROM (SELECT "group", group_size, doc_id, row_number() OVER (PARTITION BY "group" ORDER BY doc_id) AS member FROM n JOIN documents d ON d.text = n.text AND d.lang = n.lang) WHERE member <= 3""")
def _(spark, sf):
    s = q.duplicate_samples(table(spark, sf, "documents"), ["text", "lang"], "doc_id", groups=10, rows_per_group=3)
    return rounded(s.select("group", "group_size", "doc_id", "member"))


@query("c09_repeated_identifiers", """
SELECT *, CASE WHEN contents > 1 THEN 'conflicting' ELSE 'identical' END AS kind FROM (
 SELECT o_custkey, o_orderpriority, count(*) AS group_size, count(DISTINCT o_orderstatus) AS contents FROM orders GROUP BY 1, 2 HAVING count(*) > 1)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    return q.repeated_identifiers(df, ["o_custkey", "o_orderpriority"])


@query("c10_repeated_profiles", """
SELECT *, CASE WHEN targets > 1 THEN 'target conflict' ELSE 'same target' END AS agreement FROM (
 SELECT l_quantity, l_discount, l_tax, count(*) AS group_size, count(DISTINCT coalesce(CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_returnflag END, '(missing)')) AS targets,
  count(DISTINCT l_orderkey) AS identifiers FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1 AND count(DISTINCT l_orderkey) > 1)""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("t", F.when(F.col("l_linestatus") != "F", F.col("l_returnflag")))
    return q.repeated_profiles(df, ["l_quantity", "l_discount", "l_tax"], "t", ["l_orderkey"])


@query("c11_duplicate_summary", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
 e AS (SELECT count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1), e2 AS (SELECT count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity, l_returnflag) AS k FROM d) WHERE k > 1 GROUP BY l_orderkey, l_linenumber, l_quantity, l_returnflag),
 i AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT CAST(l_quantity AS VARCHAR) || l_returnflag) AS k FROM d GROUP BY 1, 2 HAVING count(*) > 1),
 p AS (SELECT l_quantity, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS k FROM d GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey || '|' || l_linenumber) > 1)
SELECT 'exact rows' AS metric, count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM e2 UNION ALL SELECT 'repeated identifiers', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM i
UNION ALL SELECT 'conflicting identifiers', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM i WHERE k > 1 UNION ALL SELECT 'repeated profiles', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM p
UNION ALL SELECT 'same-target profiles', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM p WHERE k = 1 UNION ALL SELECT 'target conflicts', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM p WHERE k > 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return q.duplicate_summary(df, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_linenumber"], "l_returnflag")


CONTRACT = """
SELECT "check", ok, detail FROM (
 SELECT count(*) FILTER (key IS NULL) AS mi, count(*) FILTER (trim(key) = '') AS bl, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'Q')) AS bt, count(*) FILTER (status NOT IN ('O', 'X')) AS bc, count(*) FILTER (status IS NULL) AS nc,
  count(DISTINCT CASE WHEN l_returnflag IN ('A', 'N', 'Q') THEN l_returnflag END) AS oc, count(DISTINCT CASE WHEN status IN ('O', 'X') THEN status END) AS os, count(*) FILTER (trim(qty) <> '' AND TRY_CAST(qty AS DOUBLE) IS NULL) AS bq FROM k) a,
 (SELECT count(*) AS ri FROM (SELECT key FROM k WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) b,
 LATERAL (VALUES ('columns present', false, 'l_comment'), ('no extra columns', false, 'status'), ('column order', false, ''), ('column types', false, 'key,l_tax'), ('numeric text', bq = 0, CAST(bq AS VARCHAR)),
  ('identifier complete', mi = 0, CAST(mi AS VARCHAR)), ('identifier not blank', bl = 0, CAST(bl AS VARCHAR)), ('identifier unique', ri = 0, CAST(ri AS VARCHAR)),
  ('target values declared', bt = 0, CAST(bt AS VARCHAR)), ('target classes observed', oc = 3, CAST(oc AS VARCHAR)), ('categories of status', bc = 0, CAST(bc AS VARCHAR)),
  ('categories of status present', nc = 0, CAST(nc AS VARCHAR)), ('categories of status observed', os = 2, CAST(os AS VARCHAR))) AS v("check", ok, detail)"""
CONTRACT_ROWS = """WITH k AS (SELECT CASE WHEN l_orderkey % 100 = 1 THEN NULL WHEN l_orderkey % 100 = 2 AND l_linenumber = 1 THEN ' ' WHEN l_orderkey % 100 = 3 THEN CAST(l_orderkey AS VARCHAR) ELSE l_orderkey || '-' || l_linenumber || '-' || l_partkey END AS key,
 l_returnflag, CASE WHEN l_linenumber < 7 THEN l_linestatus END AS status, CASE WHEN l_linenumber = 7 THEN '  ' WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS qty, l_tax FROM lineitem)"""


def line_contract(spark, sf):
    """Every check is violated: a column is absent, one is extra, two have other types, keys are missing, blank and repeated."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(
        F.when(key % 100 == 1, None).when((key % 100 == 2) & (line == 1), " ").when(key % 100 == 3, key.cast("string")).otherwise(
            F.concat_ws("-", key, line, "l_partkey")).alias("key"), "l_returnflag", F.when(line < 7, F.col("l_linestatus")).alias("status"),
        F.when(line == 7, "  ").when(key % 97 == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("qty"), "l_tax")
    return q.dataset_contract(
        df, ["key", "l_returnflag", "qty", "l_tax", "l_comment"], ["key"], "l_returnflag", ["A", "N", "Q"], {"status": ["O", "X"]},
        {"key": "integer", "l_returnflag": "string", "qty": "numeric", "l_tax": "integer"}, numeric_text=["qty"])


@query("c12_dataset_contract", f"{CONTRACT_ROWS} {CONTRACT}")
def _(spark, sf):
    return line_contract(spark, sf)


@query("c13_class_contract", """
WITH s AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS k, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT * FROM (VALUES ('A'), ('N'), ('Q')) AS v(k))
SELECT coalesce(s.k, d.k, '(missing)') AS class, coalesce(n, 0) AS rows, CASE WHEN s.k IS NULL AND n IS NOT NULL THEN 'missing value' WHEN d.k IS NULL THEN 'undeclared' WHEN n IS NULL THEN 'unobserved' ELSE 'agreed' END AS status FROM s FULL JOIN d ON s.k = d.k""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("k", F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")))
    classes = spark.createDataFrame([("A",), ("N",), ("Q",)], "class string")
    return q.class_contract(df, "k", classes)


@query("c13_numeric_target", f"""WITH {DIRTY}
SELECT l_returnflag, *EXCLUDE (l_returnflag), missing_count = 0 AND non_finite_count = 0 AND varies AS satisfied FROM (
 SELECT l_returnflag, count(*) AS row_count, count(*) FILTER (x IS NULL) AS missing_count, count(*) FILTER (isinf(x)) AS non_finite_count, count(*) FILTER (isfinite(x)) AS finite_count,
  min(x) FILTER (isfinite(x)) < max(x) FILTER (isfinite(x)) AS varies FROM parsed GROUP BY 1)""")
def _(spark, sf):
    from assayer.functions import parse_number
    df = dirty_lineitem(spark, sf).withColumn("x", parse_number("qty"))
    return q.numeric_target_contract(df, "x", ["l_returnflag"])


@query("c19_checked_write", ORACLE["c03_value_checks"])
def _(spark, sf):
    """The checks of c03 while the rows are written: one job, one scan."""
    return rounded(q.write_checked(dirty_lineitem(spark, sf), f"{work_folder(spark)}/checked-{uuid.uuid4().hex}", RULES), affected_percent=4)


@query("c19_failed_checks", f"{CONTRACT_ROWS} SELECT * FROM ({CONTRACT}) WHERE NOT ok")
def _(spark, sf):
    return q.failed(line_contract(spark, sf))


FINDING_ROWS = """
 rep AS (SELECT 'orders' AS table_name, 'type_or_domain' AS kind, count(*) FILTER (o_totalprice <= 1000) AS affected, 'o_totalprice' AS fields FROM orders
  UNION ALL SELECT 'lineitem', 'type_or_domain', count(*) FILTER (l_extendedprice <= 0), 'l_extendedprice' FROM lineitem UNION ALL SELECT 'customer', 'type_or_domain', count(*) FILTER (c_acctbal < 0), 'c_acctbal' FROM customer
  UNION ALL SELECT 'lineitem', 'type_or_domain', count(*) FILTER (l_discount > l_tax), 'l_discount <= l_tax' FROM lineitem
  UNION ALL SELECT 'lineitem', 'exact_rows', CAST(coalesce(sum(n), 0) AS BIGINT), 'rows' FROM (SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'orders', 'identity', count(*), 'o_orderkey' FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'customer', 'identity', count(*), 'c_custkey' FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'orders', 'target_contract', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), 'o_orderstatus' FROM orders UNION ALL SELECT 'customer', 'target_contract', count(*) FILTER (c_mktsegment IS NULL), 'c_mktsegment' FROM customer
  UNION ALL SELECT 'lineitem', 'target_conflict', CAST(coalesce(sum(n), 0) AS BIGINT), 'l_returnflag' FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax HAVING count(*) > 1 AND count(DISTINCT l_returnflag) > 1)
  UNION ALL SELECT 'orders', 'value_quality', count(*) FILTER (o_orderpriority IS NULL), 'o_orderpriority' FROM orders UNION ALL SELECT 'lineitem', 'value_quality', count(*) FILTER (l_partkey % 50 = 0), 'l_discount' FROM lineitem
  UNION ALL SELECT 'orders', 'target_conflict', CAST(coalesce(sum(n), 0) AS BIGINT), 'o_orderstatus' FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1 AND count(DISTINCT o_orderstatus) > 1)
  UNION ALL SELECT 'orders', 'class_support', count(*) FILTER (n < m), 'o_orderstatus' FROM (SELECT n, max(n) OVER () AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))
  UNION ALL SELECT 'customer', 'outliers', count(*) FILTER (c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)), 'c_acctbal' FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)
  UNION ALL SELECT 'lineitem', 'outliers', count(*) FILTER (p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1)), 'p' FROM (SELECT l_extendedprice * l_quantity AS p FROM lineitem), (SELECT quantile_cont(l_extendedprice * l_quantity, 0.25) AS q1, quantile_cont(l_extendedprice * l_quantity, 0.75) AS q3 FROM lineitem)
  UNION ALL SELECT 'lineitem', 'leakage', (a >= 0.99 AND r2 >= 0.99)::BIGINT, 'net' FROM (SELECT avg((abs(f - (i + s * t)) <= 1e-10 + 1e-8 * abs(i + s * t))::INT) AS a, 1 - avg((f - (i + s * t)) ** 2) / var_pop(f) AS r2
   FROM (SELECT l_extendedprice AS t, l_extendedprice * 0.5 + 3 AS f, regr_slope(l_extendedprice * 0.5 + 3, l_extendedprice) OVER () AS s, regr_intercept(l_extendedprice * 0.5 + 3, l_extendedprice) OVER () AS i FROM lineitem))
  UNION ALL SELECT 'orders', 'leakage', (a >= 0.99 AND r2 >= 0.99)::BIGINT, 'o_custkey' FROM (SELECT avg((abs(f - (i + s * t)) <= 1e-10 + 1e-8 * abs(i + s * t))::INT) AS a, 1 - avg((f - (i + s * t)) ** 2) / var_pop(f) AS r2
   FROM (SELECT o_totalprice AS t, o_custkey AS f, regr_slope(o_custkey, o_totalprice) OVER () AS s, regr_intercept(o_custkey, o_totalprice) OVER () AS i FROM orders))
  UNION ALL SELECT 'lineitem', 'dependency', (avg((g = l_quantity * 2)::INT) < 0.99)::BIGINT, 'gross' FROM (SELECT l_quantity, l_quantity * 2 + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS g FROM lineitem)
  UNION ALL SELECT 'orders', 'dependency', (avg((y = year(o_orderdate))::INT) < 0.99)::BIGINT, 'year' FROM (SELECT o_orderdate, date_part('year', o_orderdate) AS y FROM orders)
  UNION ALL SELECT 'orders', 'target_extremes', count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)), 'o_totalprice' FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
  UNION ALL SELECT 'customer', 'target_contract', count(*) FILTER (c_acctbal IS NULL OR NOT isfinite(c_acctbal)) + (min(c_acctbal) = max(c_acctbal))::BIGINT, 'c_acctbal' FROM customer
  UNION ALL SELECT 'customer', 'no_dependency', 0, 'none declared'),
 dm AS (SELECT * FROM (VALUES ('type_or_domain', 'Schema and domain validity'), ('value_quality', 'Value quality'), ('identity', 'Record integrity'), ('exact_rows', 'Record integrity'), ('target_conflict', 'Record ambiguity'), ('target_contract', 'Target integrity'),
  ('class_support', 'Target support'), ('target_extremes', 'Target distribution'), ('outliers', 'Numerical distribution'), ('leakage', 'Leakage governance'), ('dependency', 'Derived-feature provenance'), ('no_dependency', 'Derived-feature provenance')) AS v(kind, domain)),
 f AS (SELECT table_name, kind, domain, CAST(sum(affected) AS BIGINT) AS affected, coalesce(string_agg(fields, ',' ORDER BY fields) FILTER (affected > 0 AND fields NOT IN ('rows', 'l_discount <= l_tax')), '') AS affected_fields,
  string_agg(fields || ': ' || affected, '; ' ORDER BY fields || ': ' || affected) AS evidence FROM rep JOIN dm USING (kind) GROUP BY 1, 2, 3),
 r AS (SELECT * FROM (VALUES ('type_or_domain', 'DQ-001', 'High', 'Open', 'Must fix', 'Preparation', 'NI-001', 'No action'), ('value_quality', 'DQ-002', 'High', 'Open', 'Must fix', 'Preparation', 'NI-002', 'No action'),
  ('identity', 'DQ-003', 'High', 'Open', 'Must fix', 'Preparation', 'NI-003', 'Preserve'), ('exact_rows', 'DQ-003', 'Medium', 'Review', 'Monitor', 'None', 'NI-003', 'Preserve'),
  ('target_conflict', 'DQ-004', 'Medium', 'Review', 'Evaluate', 'Model evaluation', NULL, NULL), ('target_contract', 'DQ-005', 'Critical', 'Open', 'Must fix', 'Modeling clearance', 'NI-004', 'No action'),
  ('leakage', 'DQ-006', 'Critical', 'Open', 'Prohibited', 'Modeling clearance', 'NI-007', 'No action'), ('dependency', 'DQ-007', 'Medium', 'Review', 'Evaluate', 'Model evaluation', 'NI-008', 'Monitor')) AS v(kind, id, sev, st, disp, bl, ni, nd)),
 found AS (SELECT table_name, kind, id AS finding_id, sev AS severity, st AS status, disp AS disposition, bl AS blocks, affected, affected_fields, domain, evidence FROM f JOIN r USING (kind) WHERE affected > 0),
 fine AS (SELECT table_name, kind, ni AS finding_id, nd AS disposition, affected, affected_fields, domain, evidence FROM f JOIN r USING (kind) WHERE affected = 0 AND ni IS NOT NULL
  UNION ALL SELECT table_name, kind, 'NI-005', 'Monitor', affected, affected_fields, domain, evidence FROM f WHERE kind = 'class_support' UNION ALL SELECT table_name, kind, 'NI-005', 'Preserve', affected, affected_fields, domain, evidence FROM f WHERE kind = 'target_extremes'
  UNION ALL SELECT table_name, kind, 'NI-008', 'No action', affected, affected_fields, domain, evidence FROM f WHERE kind = 'no_dependency'
  UNION ALL SELECT table_name, kind, 'NI-006', CASE WHEN affected > 0 THEN 'Preserve' ELSE 'No action' END, affected, affected_fields, domain, evidence FROM f WHERE kind = 'outliers'),
 findings AS (SELECT *, CAST(CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 ELSE 2 END AS BIGINT) AS severity_order FROM found
  UNION ALL BY NAME SELECT *, 'None' AS severity, 'Validated' AS status, 'None' AS blocks, 4::BIGINT AS severity_order FROM fine)"""


def minority_classes(df: DataFrame, target: str) -> DataFrame:
    """Number of classes with fewer rows than the largest one."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("m")))).agg(F.count_if(F.col("n") < F.col("m")).alias("n"))


def findings(spark, sf) -> DataFrame:
    o, l, c = (table(spark, sf, n) for n in ("orders", "lineitem", "customer"))
    say = lambda df, name, kind, n, fields: df.select(
        F.lit(name).alias("table_name"), F.lit(kind).alias("kind"), n.cast("bigint").alias("affected"), fields.alias("fields"))
    v, w = F.col("violations"), F.col("column")
    parts = [
        say(q.domain_checks(o, q.Domains(minimums={"o_totalprice": 1000.005})), "orders", "type_or_domain", v, w),
        say(q.domain_checks(l, q.Domains(positive=("l_extendedprice",))), "lineitem", "type_or_domain", v, w),
        say(q.domain_checks(c, q.Domains(non_negative=("c_acctbal",))), "customer", "type_or_domain", v, w),
        say(q.relation_checks(l, [("l_discount", "<=", "l_tax")]), "lineitem", "type_or_domain", v, F.col("relation")),
        say(q.duplicate_groups(l, ["l_orderkey", "l_linenumber"]).agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")),
            "lineitem", "exact_rows", F.col("n"), F.lit("rows")),
        say(q.observation_unit(o, ["o_orderkey"]), "orders", "identity", F.col("duplicated_ids"), F.lit("o_orderkey")),
        say(q.observation_unit(c, ["c_custkey"]), "customer", "identity", F.col("duplicated_ids"), F.lit("c_custkey")),
        say(q.value_checks(o, {"o_orderstatus": q.ValueRule(allowed=("F", "O"))}), "orders", "target_contract", F.col("affected_count"), w),
        say(q.value_checks(c, {"c_mktsegment": q.ValueRule()}), "customer", "target_contract", F.col("affected_count"), w),
        say(q.repeated_profiles(l, ["l_quantity", "l_discount", "l_tax"], "l_returnflag").where(F.col("targets") > 1).agg(
            F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")), "lineitem", "target_conflict", F.col("n"), F.lit("l_returnflag")),
        say(q.value_checks(o, {"o_orderpriority": q.ValueRule()}), "orders", "value_quality", F.col("affected_count"), w),
        say(q.value_checks(l.withColumn("l_discount", F.when(F.col("l_partkey") % 50 != 0, F.col("l_discount"))), {"l_discount": q.ValueRule(numeric=True)}),
            "lineitem", "value_quality", F.col("affected_count"), w),
        say(q.repeated_profiles(o, ["o_orderkey"], "o_orderstatus").where(F.col("targets") > 1).agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")),
            "orders", "target_conflict", F.col("n"), F.lit("o_orderstatus")),
        say(minority_classes(o, "o_orderstatus"), "orders", "class_support", F.col("n"), F.lit("o_orderstatus")),
        say(pf.outlier_summary(c, ["c_acctbal"]), "customer", "outliers", F.col("lower_count") + F.col("upper_count"), F.col("feature")),
        say(pf.outlier_summary(l.select((F.col("l_extendedprice") * F.col("l_quantity")).alias("p")), ["p"]), "lineitem", "outliers", F.col("lower_count") + F.col("upper_count"), F.col("feature")),
        say(lk.affine_proxies(l.withColumn("net", F.col("l_extendedprice") * 0.5 + 3), ["net"], "l_extendedprice"), "lineitem", "leakage",
            (F.col("method") != "None").cast("int"), F.col("field")),
        say(lk.affine_proxies(o, ["o_custkey"], "o_totalprice"), "orders", "leakage", (F.col("method") != "None").cast("int"), F.col("field")),
        say(lk.derived_dependencies(l.withColumn("gross", F.col("l_quantity") * 2 + F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)), {"gross": F.col("l_quantity") * 2}),
            "lineitem", "dependency", (~F.col("confirmed")).cast("int"), F.col("feature")),
        say(lk.derived_dependencies(o.withColumn("year", F.year("o_orderdate")), {"year": F.year("o_orderdate")}), "orders", "dependency",
            (~F.col("confirmed")).cast("int"), F.col("feature")),
        say(pf.outlier_summary(o, ["o_totalprice"]), "orders", "target_extremes", F.col("lower_count") + F.col("upper_count"), F.col("feature")),
        say(q.numeric_target_contract(c, "c_acctbal"), "customer", "target_contract", F.col("missing_count") + F.col("non_finite_count") + (~F.col("varies")).cast("long"), F.lit("c_acctbal")),
        say(spark.createDataFrame([(0,)], "n long"), "customer", "no_dependency", F.col("n"), F.lit("none declared")),
    ]
    known = {"orders": [*o.columns, "year"], "lineitem": [*l.columns, "p", "net", "gross"], "customer": c.columns}
    return q.consolidate_findings(reduce(DataFrame.unionByName, parts), known)


@query("c20_quality_findings", f"WITH {FINDING_ROWS} SELECT * FROM findings")
def _(spark, sf):
    return findings(spark, sf)


@query("c20_readiness", f"""WITH {FINDING_ROWS}
SELECT table_name, count(*) FILTER (severity <> 'None') AS findings, count(*) FILTER (severity = 'None') AS non_issues, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium,
 count(*) FILTER (blocks = 'Preparation') = 0 AS ready_for_preparation, count(*) FILTER (blocks IN ('Preparation', 'Modeling clearance')) = 0 AS ready_for_modeling FROM findings GROUP BY 1""")
def _(spark, sf):
    return q.readiness(findings(spark, sf))
