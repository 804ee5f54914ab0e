"""As-of joins and frames over the time of events, orders and shipments."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import asof as ao
from assayer.plans.registry import query, rounded
from assayer.sources.tables import table


@query("k26_last_event_before_purchase", """
WITH v AS (SELECT user_id, ts, arg_max(event_id, (event_id, value)) AS seen_id, arg_max(value, (event_id, value)) AS seen_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, v.seen_id, round(v.seen_value, 6) + 0.0 AS seen_value FROM (SELECT * FROM events WHERE event_type <> 'view') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def _(spark, sf):
    """The view that each other event follows, per user."""
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    others = e.where("event_type <> 'view'").select("event_id", "user_id", "ts")
    return rounded(ao.asof_join(others, views, ["user_id"], "ts", "ts", ["seen_id", "seen_value"], tie=["seen_id"]).drop("ts"))


@query("k26_last_order_before_shipment", """
WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2),
s AS (SELECT l_orderkey, l_linenumber, o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_shipdate - o_orderdate <= INTERVAL 30 DAY THEN o.o_orderkey END AS last_order
FROM s ASOF LEFT JOIN o ON s.o_custkey = o.o_custkey AND s.l_shipdate >= o.o_orderdate""")
def _(spark, sf):
    """The customer's last order at the time of each shipment, if it is at most 30 days old."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o.withColumnRenamed("o_orderkey", "l_orderkey").drop("o_orderdate"), "l_orderkey")
    out = ao.asof_join(s, o.withColumnRenamed("o_orderkey", "last_order"), ["o_custkey"], "l_shipdate", "o_orderdate", ["last_order"], tie=["last_order"],
                       within=30 * 86_400, bucket=90 * 86_400)
    return rounded(out.select("l_orderkey", "l_linenumber", "last_order"))


@query("k12_recent_robust_scores", """
WITH f AS (SELECT event_id, value, count(value) OVER w AS n, median(value) OVER w AS m, list(value) OVER w AS xs FROM events
 WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)),
g AS (SELECT event_id, value, n, m, list_median(list_transform(xs, lambda x: abs(x - m))) AS d FROM f)
SELECT event_id, n::BIGINT AS recent_n, round(m, 6) + 0.0 AS recent_median, round(d, 6) + 0.0 AS recent_mad, round(CASE WHEN n >= 5 AND d > 0 THEN (value - m) / (1.4826 * d) END, 4) + 0.0 AS score,
 coalesce(n >= 5 AND d > 0 AND abs((value - m) / (1.4826 * d)) >= 3.5, false) AS is_anomaly FROM g""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return rounded(ao.recent_robust_score(e, ["event_type"], "ts", "value", 6 * 3600).drop("event_type", "ts", "value"), score=4)
