"""Checks that need memory across micro-batches: repeated identifiers of a period and days missing from a series.

State is bounded by event time: a period is kept until the watermark passes its end, a series keeps one day. Results are told
once, when they are final. Rows without a time belong to no period. Rows that come after their period was closed cannot be
judged any more; `run_step` counts them and, if strict, fails instead of leaving them out in silence. Times without a zone are
read in that of the session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400


def repeated_in_period(stream: DataFrame, ids: Sequence[str], content: Sequence[str], time: str, delay: str, period: str = "1 hour") -> DataFrame:
    """Identifiers held by two or more rows of a period, with the number of rows and of different contents (NULLs equal).

    Two chained aggregates: rows per identifier and content, combined before the shuffle, then contents per identifier, so that
    a frequent identifier costs one state row per content and never a gathered group. Identifiers that are all NULL are none.
    """
    rows = stream.where(F.coalesce(*[F.col(c).isNotNull() | F.lit(None) for c in ids], F.lit(False))).select(
        F.col(time).cast("timestamp").alias("_time"), *[F.col(c).alias(f"_i{i}") for i, c in enumerate(ids)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(content)])
    own, inner = [f"_i{i}" for i in range(len(ids))], [f"_c{i}" for i in range(len(content))]
    per_content = rows.withWatermark("_time", delay).groupBy(F.window("_time", period).alias("_w"), *own, *inner).agg(F.count(F.lit(1)).alias("_n"))
    per_id = per_content.groupBy(F.window("_w", period).alias("_p"), *own).agg(F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("contents"))
    return per_id.where("group_size > 1").select(
        F.col("_p.start").alias("period_start"), *[F.col(f"_i{i}").alias(c) for i, c in enumerate(ids)], "group_size", "contents",
        F.when(F.col("contents") > 1, "conflicting").otherwise("identical").alias("kind"))


def _gaps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Closed days of one series, all later than those seen before: the days between, as one row per gap."""
    days = sorted(int(d) for frame in frames for d in frame["day"])
    seen = ([state.get[0]] if state.exists else []) + days
    state.update((seen[-1],))
    gaps = [(a, b) for a, b in zip(seen, seen[1:], strict=False) if b > a + 1]
    yield pd.DataFrame({"series": [key[0]] * len(gaps), "first_day": [a + 1 for a, _ in gaps], "last_day": [b - 1 for _, b in gaps]}).astype(
        {"first_day": "int64", "last_day": "int64"})


def closed_days(stream: DataFrame, series: str, time: str, delay: str) -> DataFrame:
    """Number of rows per series and day (UTC, as days since 1970), once the watermark has passed the day: `series, day, rows`."""
    rows = stream.select(F.col(series).alias("series"), F.col(time).cast("timestamp").alias("_time")).withWatermark("_time", delay)
    return rows.groupBy(F.window("_time", "1 day").alias("_w"), "series").agg(F.count(F.lit(1)).alias("rows")).select(
        "series", F.floor(F.unix_timestamp("_w.start") / DAY).alias("day"), "rows")


def missing_days(days: DataFrame) -> DataFrame:
    """Gaps in a stream of `closed_days`: first and last missing day of a series and their number, told with the day after.

    The state of a series is its last day, and a series has one row per day however many rows it had before. A day closes after
    all earlier ones, so later micro-batches hold later days only. Rows without a series form one of their own.
    """
    out = T.StructType([days.schema["series"], T.StructField("first_day", T.LongType()), T.StructField("last_day", T.LongType())])
    gaps = days.groupBy("series").applyInPandasWithState(
        _gaps, out, T.StructType([T.StructField("day", T.LongType())]), "append", GroupStateTimeout.NoTimeout)
    date = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return gaps.select("series", date("first_day").alias("first_missing"), date("last_day").alias("last_missing"),
                       (F.col("last_day") - F.col("first_day") + 1).alias("days"))


def run_step(stream: DataFrame, path: str, checkpoint: str, strict: bool = True) -> int:
    """Process what has arrived since the last step and append what became final to the table at `path`.

    State and progress are in the checkpoint, so each step may run in another session. Returns the number of state rows that
    came too late (rows are combined before they are counted); strict raises an error if there are any.
    """
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    late = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    if late and strict:
        raise ValueError(f"{late} rows came after their period was closed")
    return late
