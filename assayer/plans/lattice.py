"""Minimal keys and dependencies of whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from assayer.operators import lattice as la
from assayer.plans.registry import query
from assayer.sources.tables import table

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
CUSTOMERS = ["c_custkey", "c_mktsegment", "c_nationkey", "n_name", "n_regionkey", "r_name", "sign", "known"]
CUSTOMER_SQL = """src AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 100 = 7 THEN NULL ELSE c_nationkey END AS c_nationkey, n_name, n_regionkey, r_name, c_acctbal < 0 AS sign, 1 AS known
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def lattice_sql(source: str, columns: list[str], width: int = 3) -> str:
    """Distinct rows of every set of columns, then what is minimal among sets without and with equal numbers of them."""
    sets = [s for k in range(1, width + 1) for s in combinations(columns, k)]
    counts = " UNION ALL ".join(f"SELECT {list(s)!r} AS cols, (SELECT count(DISTINCT row({', '.join(s)})) FROM src) AS d" for s in sets)
    return f"""WITH {source}, t AS (SELECT count(*) AS n FROM src), e AS (SELECT cols, d FROM ({counts}) UNION ALL SELECT CAST([] AS VARCHAR[]), 1),
 k AS (SELECT cols, d FROM e, t WHERE d = n), mk AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE len(o.cols) < len(k.cols) AND list_has_all(k.cols, o.cols))),
 z AS (SELECT cols, d, unnest(cols) AS dependent FROM e), f AS (SELECT z.dependent, l.cols, l.d FROM z, t, e l WHERE l.cols = list_filter(z.cols, lambda c: c <> z.dependent) AND l.d = z.d AND l.d < t.n),
 mf AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.dependent = f.dependent AND len(o.cols) < len(f.cols) AND list_has_all(f.cols, o.cols)))
SELECT 'key' AS kind, array_to_string(cols, ',') AS columns, NULL::VARCHAR AS dependent, len(cols)::BIGINT AS width, d AS classes FROM mk
UNION ALL SELECT 'dependency', array_to_string(cols, ','), dependent, len(cols), d FROM mf"""


@query("i04_lattice_orders", lattice_sql("src AS (SELECT * FROM orders)", ORDERS))
def _(spark, sf):
    return la.keys_and_dependencies(table(spark, sf, "orders"), ORDERS)


@query("i04_lattice_lineitem", lattice_sql("src AS (SELECT * FROM lineitem)", LINES))
def _(spark, sf):
    return la.keys_and_dependencies(table(spark, sf, "lineitem"), LINES)


@query("i04_lattice_customers", lattice_sql(CUSTOMER_SQL, CUSTOMERS))
def _(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return la.keys_and_dependencies(joined.select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 100 != 7, F.col("c_nationkey")).alias("c_nationkey"), "n_name", "n_regionkey", "r_name",
        (F.col("c_acctbal") < 0).alias("sign"), F.lit(1).alias("known")), CUSTOMERS)
