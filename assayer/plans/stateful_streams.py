"""Repeated identifiers and missing days of events that arrive in three parts, checked part by part with state between them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.plans.registry import query, rounded
from assayer.sources.tables import table, work_folder
from assayer.streaming import closed_days, missing_days, repeated_in_period, run_step

DELAY = "6 hours"


def arriving(rows: DataFrame, time: str, folder: str, parts: int = 3) -> Iterator[None]:
    """Write the rows to a folder in equal parts of their time, one part per step."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    if low is None:
        rows.write.mode("append").parquet(folder)
        yield
        return
    for k in range(parts):
        first, end = low + (high - low) * k / parts, low + (high - low) * (k + 1) / parts
        due = F.col(time) >= F.lit(first)
        if k + 1 < parts:
            due = due & (F.col(time) < F.lit(end))
        rows.where(due).write.mode("append").parquet(folder)
        yield


def _source(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    return table(spark, sf, "events").select("ts", "user_id", "event_type"), f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("c09_repeated_in_stream", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS period, user_id, count(*) AS group_size, count(DISTINCT event_type) AS contents,
 CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflicting' ELSE 'identical' END AS kind
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events) GROUP BY date_trunc('hour', ts), user_id HAVING count(*) > 1""")
def _(spark, sf):
    """Users with several events in an hour that has been closed, and whether those are of different types."""
    rows, folder = _source(spark, sf)
    for _ in arriving(rows, "ts", f"{folder}/in"):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        found = repeated_in_period(stream, ["user_id"], ["event_type"], "ts", DELAY)
        run_step(found, f"{folder}/found", f"{folder}/state")
    out = spark.read.schema(found.schema).parquet(f"{folder}/found")
    return rounded(out.select(F.date_format("period_start", "yyyy-MM-dd HH:mm").alias("period"), "user_id", "group_size", "contents", "kind"))


@query("c14_missing_days_in_stream", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)),
g AS (SELECT user_id, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before, day FROM d)
SELECT user_id, strftime(before + 1, '%Y-%m-%d') AS first_missing, strftime(day - 1, '%Y-%m-%d') AS last_missing, (day - before - 1)::BIGINT AS days FROM g WHERE day > before + 1""")
def _(spark, sf):
    """Gaps between the days on which a user has events, from the table of closed days that the first stream writes."""
    rows, folder = _source(spark, sf)
    rows = rows.select("ts", "user_id")
    for _ in arriving(rows, "ts", f"{folder}/in"):
        days = closed_days(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "user_id", "ts", DELAY)
        run_step(days, f"{folder}/days", f"{folder}/days-state")
        gaps = missing_days(spark.readStream.schema(days.schema).parquet(f"{folder}/days"))
        run_step(gaps, f"{folder}/gaps", f"{folder}/gaps-state")
    out = spark.read.schema(gaps.schema).parquet(f"{folder}/gaps")
    return rounded(out.withColumnRenamed("series", "user_id"))
