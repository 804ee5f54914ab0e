"""Structure, dictionary, fingerprint, difference and write queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import spread
from assayer.operators import blocks as bl
from assayer.operators import identity as idn
from assayer.plans.forecasting import EVIDENCE, backtest, development
from assayer.plans.registry import query, rounded
from assayer.sources.tables import parse_delimited, read_with_rejects, table, work_folder

CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
# The variable table of customer: c_name is undocumented, c_phone is not in the data.
CUSTOMER_METADATA = [
    ("c_custkey", "id", "integer", "Customer key"), ("c_nationkey", "feature", "integer", "Nation of the customer"),
    ("c_acctbal", "feature", "continuous", "Account balance"), ("c_mktsegment", "target", "categorical", "Market segment"),
    ("c_phone", "feature", "string", "Phone number"), ("c_name", "feature", "string", " "),
]
CUSTOMER_ROLES = {"c_custkey": "id", "c_nationkey": "feature", "c_acctbal": "feature", "c_mktsegment": "target"}


def values_sql(rows, names) -> str:
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {text}) AS v({', '.join(names)})"


@query("a01_read_delimited", """
SELECT n_nationkey, n_name, n_regionkey, CAST(length(n_name) AS BIGINT) AS name_length FROM
 (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation)""")
def _(spark, sf):
    lines = table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"')), "n_regionkey").alias("line"))
    df = parse_delimited(lines, "line", {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"})
    return df.withColumn("name_length", F.length("n_name").cast("bigint"))


# key,"name, ""segment""",nation
FILED = '''
l AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_custkey::VARCHAR || ',"' || c_name || ', ""' || c_mktsegment || '""",' ||
  CASE WHEN c_custkey % 70 = 5 THEN 'n/a' WHEN c_custkey % 40 = 9 THEN '' ELSE c_nationkey::VARCHAR END AS line FROM customer),
f AS (SELECT *, CASE WHEN c_custkey % 50 = 3 THEN line || ',x' WHEN c_custkey % 90 = 7 THEN c_custkey::VARCHAR || ',' || c_name ELSE line END AS filed FROM l)'''


def filed_customers(spark, sf):
    """Customers as delimited files of the shared folder, some lines with a field too many, too few, or of another type; then read."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    nation = F.when(key % 70 == 5, "n/a").when(key % 40 == 9, "").otherwise(F.col("c_nationkey").cast("string"))
    line = F.concat(key.cast("string"), F.lit(',"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('""",'), nation)
    line = F.when(key % 50 == 3, F.concat(line, F.lit(",x"))).when(key % 90 == 7, F.concat(key.cast("string"), F.lit(","), "c_name")).otherwise(line)
    path = f"{work_folder(spark)}/filed-{uuid.uuid4().hex}"
    c.select(line.alias("line")).write.text(path)
    return read_with_rejects(spark, path, {"key": "integer", "label": "string", "nation": "integer"}, header=False)


@query("a01_delimited_files", f"""WITH {FILED} SELECT c_custkey AS key, c_name || ', "' || c_mktsegment || '"' AS label, CASE WHEN c_custkey % 40 <> 9 THEN c_nationkey END::BIGINT AS nation
FROM f WHERE c_custkey % 50 <> 3 AND c_custkey % 90 <> 7 AND c_custkey % 70 <> 5""")
def _(spark, sf):
    return filed_customers(spark, sf)[0]


@query("a01_rejected_lines", f"""WITH {FILED} SELECT filed AS line, CASE WHEN c_custkey % 50 = 3 OR c_custkey % 90 = 7 THEN 'fields' ELSE 'type' END AS reason
FROM f WHERE c_custkey % 50 = 3 OR c_custkey % 90 = 7 OR c_custkey % 70 = 5""")
def _(spark, sf):
    return filed_customers(spark, sf)[1].select("line", "reason")


@query("a02_structure_summary", """
SELECT 'customer' AS table_name, count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS column_order,
 true AS columns_match, true AS order_matches, count(*) = 1500 AS rows_match, true AS source_matches FROM customer
UNION ALL SELECT 'nation', count(*), 3, 'n_nationkey,n_name,n_regionkey', true, false, count(*) = 24, true FROM nation
UNION ALL SELECT 'supplier', count(*), 4, 's_suppkey,s_name,s_nationkey,s_acctbal', false, false, NULL, false FROM supplier""")
def _(spark, sf):
    t = lambda n: table(spark, sf, n)
    a = idn.describe_structure(t("customer"), "customer", CUSTOMER_COLUMNS, 1500, "customer")
    b = idn.describe_structure(t("nation"), "nation", ["n_name", "n_nationkey", "n_regionkey"], 24, "nation")
    c = idn.describe_structure(t("supplier"), "supplier", ["s_suppkey", "s_name"], None, "suppliers")
    return a.unionByName(b).unionByName(c)


DICT_SQL = f"""
meta AS (SELECT * FROM {values_sql(CUSTOMER_METADATA, ['name', 'role', 'type', 'description'])}),
cnt AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, {i} AS position, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM customer" for i, c in enumerate(CUSTOMER_COLUMNS))}),
dict AS (SELECT coalesce(c.name, m.name) AS name, CAST(coalesce(position, -1) AS BIGINT) AS position,
  CASE coalesce(c.name, m.name) WHEN 'c_custkey' THEN 'id' WHEN 'c_nationkey' THEN 'feature' WHEN 'c_acctbal' THEN 'feature' WHEN 'c_mktsegment' THEN 'target' ELSE 'unassigned' END AS analytical_role,
  role AS source_role, type AS source_type, description, CAST(non_null AS DOUBLE) AS non_null, CAST(distinct_values AS DOUBLE) AS distinct_values,
  CASE WHEN non_null IS NULL THEN 'Missing from data' WHEN m.name IS NULL OR trim(coalesce(description, '')) = '' THEN 'Undocumented' ELSE 'Documented' END AS status
 FROM cnt c FULL JOIN meta m ON c.name = m.name)"""


def customer_dictionary(spark, sf) -> DataFrame:
    meta = spark.createDataFrame(CUSTOMER_METADATA, "name string, role string, type string, description string")
    return idn.dictionary(table(spark, sf, "customer"), meta, CUSTOMER_ROLES)


@query("a03_dictionary", f"WITH {DICT_SQL} SELECT *, coalesce(source_role, '') = analytical_role AS role_agrees FROM dict")
def _(spark, sf):
    d = customer_dictionary(spark, sf)
    return d.withColumns({c: F.col(c).cast("double") for c in ("non_null", "distinct_values")})


@query("a04_dictionary_coverage", f"WITH {DICT_SQL} SELECT status, count(*) AS columns FROM dict GROUP BY 1")
def _(spark, sf):
    return idn.dictionary_coverage(customer_dictionary(spark, sf))


def canon_sql(*cols: str) -> str:
    """The same canonical text in SQL; doubles lose their negative zero."""
    parts = []
    for c in cols:
        name, kind = c.split(":") if ":" in c else (c, "")
        x = f"CAST({name} + 0.0 AS VARCHAR)" if kind == "d" else f"CAST({name} AS VARCHAR)"
        parts.append(f"coalesce(length({x}) || ':' || {x}, '-')")
    return "sha256(" + " || '|' || ".join(parts) + ")"


LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
LINE_CANON = canon_sql("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity:d", "l_discount:d", "l_returnflag")


@query("a05_row_fingerprint", f"SELECT {LINE_CANON} AS row_hash, count(*) AS rows FROM lineitem GROUP BY 1")
def _(spark, sf):
    df = spread(table(spark, sf, "lineitem").select(*LINE_KEY))
    return df.select(idn.row_fingerprint(df, LINE_KEY).alias("row_hash")).groupBy("row_hash").agg(
        F.count(F.lit(1)).alias("rows"))


DOC_CANON = canon_sql("text", "lang", "source")


@query("a06_occurrence_keys", f"""
SELECT doc_id, row_hash, row_number() OVER (PARTITION BY row_hash ORDER BY doc_id) - 1 AS ordinal FROM (SELECT doc_id, {DOC_CANON} AS row_hash FROM documents)""")
def _(spark, sf):
    return idn.occurrence_keys(table(spark, sf, "documents"), "doc_id", ["text", "lang", "source"])


def fingerprint_sql(source: str, canon: str, schema: str) -> str:
    return f"""SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(c, 1, 16) AS UBIGINT)) AS VARCHAR) AS hash_sum,
 CAST(sum(CAST('0x' || substr(c, 17, 16) AS UBIGINT)) AS VARCHAR) AS hash_sum_2, sha256('{schema}') AS schema_hash FROM (SELECT {canon} AS c FROM {source})"""


@query("a07_table_fingerprint", fingerprint_sql(
    "lineitem", LINE_CANON, "l_orderkey:bigint|l_partkey:bigint|l_suppkey:bigint|l_linenumber:int|l_quantity:double|l_discount:double|l_returnflag:string"))
def _(spark, sf):
    return idn.table_fingerprint(table(spark, sf, "lineitem"), LINE_KEY)


@query("a08_write_once", """
SELECT * FROM (VALUES (1, 'new'), (2, 'equivalent'), (3, 'divergent')) AS v(attempt, status), (SELECT count(*) AS row_count FROM customer)""")
def _(spark, sf):
    path = f"{work_folder(spark)}/customer-{uuid.uuid4().hex}"
    df = table(spark, sf, "customer")
    steps = [df, df.repartition(3, "c_name"), df.withColumn("c_acctbal", F.col("c_acctbal") + 1)]
    status = [(i, idn.write_once(d, path)) for i, d in enumerate(steps, 1)]
    attempts = spark.createDataFrame(status, "attempt int, status string")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).join(F.broadcast(attempts))


CHANGED = """
other AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 1000 = 7 THEN 'inf'::DOUBLE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 0.25 WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 0.0001 ELSE o_totalprice END AS o_totalprice,
 o_orderpriority FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'P'
 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 500 = 11)"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def changed_orders(spark, sf):
    left = table(spark, sf, "orders").select(*ORDER_COLUMNS)
    price = (F.when(F.col("o_orderkey") % 1000 == 7, float("inf")).when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 0.25)
             .when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 0.0001).otherwise(F.col("o_totalprice")))
    pending = F.col("o_orderstatus") == "P"
    right = left.select(
        F.when(pending, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_custkey",
        F.when(~pending & (F.col("o_custkey") % 10 == 3), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(pending, F.col("o_totalprice")).otherwise(price).alias("o_totalprice"), "o_orderpriority")
    again = left.where((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 500 == 11))
    return left, right.unionByName(again).withColumn("note", F.lit(""))


DIFF = CHANGED + """,
j AS (SELECT a.o_orderkey AS lk, b.o_orderkey AS rk, a.o_custkey AS ac, b.o_custkey AS bc, a.o_orderstatus AS a_s, b.o_orderstatus AS b_s, a.o_totalprice AS ap, b.o_totalprice AS bp,
  a.o_orderpriority AS ao, b.o_orderpriority AS bo FROM orders a FULL JOIN other b ON a.o_orderkey = b.o_orderkey),
w AS (SELECT count(*) FILTER (rk IS NULL) AS left_only, count(*) FILTER (lk IS NULL) AS right_only, count(*) FILTER (lk IS NOT NULL AND rk IS NOT NULL) AS compared,
  (SELECT count(*) FROM (SELECT 1 FROM other GROUP BY o_orderkey HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS repeated_keys, 1::BIGINT AS other_columns FROM j),
diff AS (
 SELECT 'o_custkey' AS "column", 0 AS position, count(*) FILTER (ac <> bc) AS differing, max(abs(ac - bc))::DOUBLE AS g, 0::BIGINT AS non_finite FROM j
 UNION ALL SELECT 'o_orderstatus', 1, count(*) FILTER (a_s <> b_s), NULL, 0 FROM j UNION ALL SELECT 'o_totalprice', 2, count(*) FILTER (abs(ap - bp) > 0.001), max(abs(ap - bp)) FILTER (isfinite(bp)), count(*) FILTER (lk IS NOT NULL AND isinf(bp)) FROM j
 UNION ALL SELECT 'o_orderpriority', 3, count(*) FILTER (ao <> bo), NULL, 0 FROM j)"""


@query("a09_table_diff", f"""WITH {DIFF} SELECT left_only, right_only, compared, repeated_keys, other_columns, "column", CAST(position AS BIGINT) AS position, differing, round(g, 6) + 0.0 AS max_abs_difference, non_finite FROM diff, w""")
def _(spark, sf):
    l, r = changed_orders(spark, sf)
    return rounded(idn.table_diff(l, r, ["o_orderkey"], tolerance=0.001))


@query("a09_diff_verdict", f"""WITH {DIFF} SELECT max(left_only + right_only + differing + repeated_keys + other_columns + non_finite) = 0 AS equivalent, arg_min("column", position) FILTER (differing > 0) AS first_differing,
 CAST(sum(differing) AS BIGINT) AS differing_cells, round(max(g), 6) + 0.0 AS max_abs_difference FROM diff, w""")
def _(spark, sf):
    l, r = changed_orders(spark, sf)
    return rounded(idn.diff_verdict(idn.table_diff(l, r, ["o_orderkey"], tolerance=0.001)))


FEW = """
other AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2000 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3000 = 5 THEN NULL WHEN o_orderkey % 4000 = 9 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice,
 o_orderpriority FROM orders WHERE o_orderkey % 5000 <> 11 UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 6000 = 13)"""


def few_changes(spark, sf):
    left = table(spark, sf, "orders").select(*ORDER_COLUMNS)
    key = F.col("o_orderkey")
    right = left.where(key % 5000 != 11).withColumns({
        "o_orderstatus": F.when(key % 2000 == 3, "X").otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(key % 3000 != 5, F.when(key % 4000 == 9, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")))})
    return left, right.unionByName(left.where(key % 6000 == 13).withColumn("o_orderkey", -1 - key))


FEW_DIFF = DIFF.replace(CHANGED, FEW).replace("abs(ap - bp) > 0.001", "abs(ap - bp) > 0.001 OR (lk IS NOT NULL AND rk IS NOT NULL AND (ap IS NULL) <> (bp IS NULL))").replace("1::BIGINT AS other_columns", "0::BIGINT AS other_columns")


@query("a09_block_diff", f"""WITH {FEW_DIFF} SELECT left_only, right_only, compared, repeated_keys, other_columns, "column", CAST(position AS BIGINT) AS position, differing, round(g, 6) + 0.0 AS max_abs_difference, non_finite FROM diff, w""")
def _(spark, sf):
    """As a09_table_diff on tables that differ in few rows: only blocks of keys with unequal fingerprints are joined."""
    l, r = few_changes(spark, sf)
    return rounded(bl.block_diff(l, r, ["o_orderkey"], tolerance=0.001).drop("joined_rows", "blocks"))


@query("a09_unequal_blocks", """
SELECT 0 AS level, 1::BIGINT AS compared, 0::BIGINT AS unequal, (SELECT count(*) FROM orders) AS row_count""")
def _(spark, sf):
    """Equal tables in another order: the roots agree, and nothing below them is looked at."""
    o = table(spark, sf, "orders").select(*ORDER_COLUMNS)
    trees = [bl.fingerprint_tree(bl.block_fingerprints(t, ["o_orderkey"])) for t in (o, o.repartition(5, "o_custkey"))]
    rows = trees[0].where("level = 0").select(F.col("rows").alias("row_count"))
    return bl.unequal_nodes(*trees).drop("nodes").join(F.broadcast(rows))


@query("a10_evidence_audit", f"""WITH {EVIDENCE},
 p AS (SELECT * REPLACE (CASE WHEN horizon = 5 THEN squared_error + 0.001 ELSE squared_error END AS squared_error,
   CASE WHEN fold = 2 AND candidate_id = 'naive_last_value' THEN y_true + 1 ELSE y_true END AS y_true) FROM evidence)
SELECT candidate_id, count(*) AS row_count, count(*) FILTER (abs(p.y_true - d.y) > 1e-10 * greatest(abs(p.y_true), abs(d.y), 1)) AS truth_violations,
 count(*) FILTER (abs(error - (y_pred - p.y_true)) > 1e-10 * greatest(abs(error), abs((y_pred - p.y_true)), 1)) AS error_violations, count(*) FILTER (abs(abs_error - abs(y_pred - p.y_true)) > 1e-10 * greatest(abs(abs_error), abs(abs(y_pred - p.y_true)), 1)) AS abs_violations,
 count(*) FILTER (abs(squared_error - (y_pred - p.y_true) ** 2) > 1e-10 * greatest(abs(squared_error), abs((y_pred - p.y_true) ** 2), 1)) AS squared_violations, count(*) FILTER (abs(scaled_abs_error - (abs(y_pred - p.y_true) / mase_scale)) > 1e-10 * greatest(abs(scaled_abs_error), abs((abs(y_pred - p.y_true) / mase_scale)), 1)) AS scaled_violations
FROM p JOIN dev d ON d.series_id = p.series_id AND d.period = p.period GROUP BY 1""")
def _(spark, sf):
    ev = backtest(spark, sf)[2]
    wrong = (F.col("fold") == 2) & (F.col("candidate_id") == "naive_last_value")
    ev = ev.withColumns({
        "squared_error": F.when(F.col("horizon") == 5, F.col("squared_error") + 0.001).otherwise(F.col("squared_error")),
        "y_true": F.when(wrong, F.col("y_true") + 1).otherwise(F.col("y_true"))})
    return idn.evidence_audit(ev, development(spark, sf), tolerance=1e-10)
