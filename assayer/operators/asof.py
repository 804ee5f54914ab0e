"""As-of joins and frames over time that hold when one key has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MICROS = 1_000_000


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone (that of the session, and UTC)."""
    return F.unix_micros(F.to_timestamp(c))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: Sequence[str] = (),
              within: int | None = None, bucket: int = 86_400, prefix: str = "") -> DataFrame:
    """All rows of left with `values` of the last row of right that has the same keys and is not later; null where there is none.

    Of right rows at one time the last by `tie`, then by the values, counts. `within`: seconds beyond which a row is too old.
    Both sides become one sequence per key and time bucket of `bucket` seconds, in which the last right row is carried
    on. What was last before a bucket enters its sequence as one more right row: if `within` is no longer than a bucket,
    rows near the end of a bucket are dealt to the next one too; else the last row of each bucket is carried into the later
    ones by another, much shorter sequence, one row per key and bucket. So no join is made, and a key with most of the rows
    is dealt out by its buckets.

    Rows of left without a key or time stay and match nothing; such rows of right are left out. Rows that repeat stay.
    An empty side is allowed. Columns of left keep their names; values get `prefix`, and must then be new ones.
    """
    by, names = list(by), [f"{prefix}{v}" for v in values]
    clash = sorted(set(names) & set(left.columns))
    if clash:
        raise ValueError(f"columns would be there twice: {clash}")
    keys = [f"_k{i}" for i in range(len(by))]
    keyed = lambda df: [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    value = F.struct(micros(right_time).alias("at"), F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)], F.lit(0).alias("t")).alias("tie"),
                     F.struct(*[F.col(c).alias(n) for c, n in zip(values, names, strict=True)]).alias("v"))
    known = right.select(*keyed(right), value.alias("_v")).where(F.col("_v.at").isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    value_type = known.schema["_v"].dataType
    place = lambda at: F.floor(at / (bucket * MICROS))
    kept = {c: f"_l{i}" for i, c in enumerate(left.columns)}  # plain columns: those that are not asked for are not sorted
    a = left.select(*keyed(left), micros(left_time).alias("_at"), F.lit(1).alias("_side"), *[F.col(c).alias(k) for c, k in kept.items()]).withColumn("_b", place(F.col("_at")))
    b = known.select(*keys, F.col("_v.at").alias("_at"), F.lit(0).alias("_side"), "_v").withColumn("_b", place(F.col("_at")))
    if within is not None and within <= bucket:
        carried = b.where(place(F.col("_at") + within * MICROS) > F.col("_b")).withColumn("_b", F.col("_b") + 1)
    else:
        ends = b.groupBy(*keys, "_b").agg(F.max("_v").alias("_v")).withColumn("_side", F.lit(1))
        # buckets that rows of left are in need what was last before them
        asked = a.select(*keys, "_b").distinct().withColumn("_side", F.lit(0))
        earlier = Window.partitionBy(*keys).orderBy("_b", "_side").rowsBetween(Window.unboundedPreceding, -1)
        before = ends.unionByName(asked, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(earlier))
        carried = before.where("_side = 0 and _v is not null").withColumn("_at", F.col("_v.at"))
    order = Window.partitionBy(*keys, "_b").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    every = a.unionByName(b, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    found = F.col("_found")
    if within is not None:
        found = F.when(F.col("_at") - found["at"] <= within * MICROS, found)
    local = every.withColumn("_found", F.last("_v", ignorenulls=True).over(order)).where("_side = 1").withColumn("_found", found)
    return local.select(*[F.col(k).alias(c) for c, k in kept.items()], *[F.col(f"_found.v.{n}").alias(n) for n in names])


def recent(df: DataFrame, by: Sequence[str], time: str, seconds: int, measures: dict[str, Column]) -> DataFrame:
    """df with aggregates over the rows of the same keys in the last `seconds`, the row itself and equal times included.

    A row looks back no further than the bucket before its own, so each row is dealt to its bucket of that width and to
    the next one: a key with most of the rows covers as many tasks as it has buckets, and a frame never leaves one.
    Rows without a time have null measures. `measures`: name -> aggregate without a window.
    """
    by = list(by)
    at = micros(time)
    rows = df.withColumn("_at", at).withColumn("_b", F.floor(F.col("_at") / (seconds * MICROS)))
    dealt = rows.where("_at is not null").withColumn("_to", F.explode(F.array(F.col("_b"), F.col("_b") + 1)))
    frame = Window.partitionBy(*by, "_to").orderBy("_at").rangeBetween(-seconds * MICROS, 0)
    done = dealt.withColumns({n: m.over(frame) for n, m in measures.items()}).where("_to = _b").drop("_to")
    none = rows.where("_at is null")
    return done.unionByName(none, allowMissingColumns=True).drop("_at", "_b")


class _Ranks:
    """The numbers of a sequence by rank: the k-th smallest of any stretch of it, for many stretches at once.

    A bit per number and level tells which half of the ranks it falls into; with the counts of zeros before each place, a
    stretch is followed down the levels (a wavelet matrix). n log n bits, and log n steps per question.
    """

    def __init__(self, x: np.ndarray):
        order = np.argsort(x, kind="stable")
        self.sorted, rank = x[order], np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        self.bits, self.levels = max(1, int(len(x) - 1).bit_length()), []
        for b in range(self.bits - 1, -1, -1):
            one = (rank >> b) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((zeros, zeros[-1]))
            rank = np.concatenate([rank[one == 0], rank[one == 1]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of places low to high, high not included; k is inside each stretch."""
        low, high, k, rank = low.copy(), high.copy(), k.copy(), np.zeros(len(k), np.int64)
        for b, (zeros, whole) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            z0, z1 = zeros[low], zeros[high]
            up = k >= z1 - z0
            k -= np.where(up, z1 - z0, 0)
            rank |= up.astype(np.int64) << b
            low, high = np.where(up, whole + low - z0, z0), np.where(up, whole + high - z1, z1)
        return self.sorted[rank]


def _middle(ranks: _Ranks, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of each stretch, and the median distance from it."""
    n = high - low
    median = (ranks.kth(low, high, (n - 1) // 2) + ranks.kth(low, high, n // 2)) / 2
    below = (n + 1) // 2  # the smallest so many are at most the median, the others at least

    def distance(k):
        """The k-th smallest (from 0) distance: i of the nearest k + 1 lie below, the rest above; i is found by halving."""
        least, most = np.maximum(0, k + 1 - (n - below)), np.minimum(below, k + 1)
        while (open_ := least < most).any():
            i = (least + most) // 2
            # the next one below is nearer than the last one taken above: take more from below
            nearer = np.zeros(len(k), bool)
            lo, hi, m, j = low[open_], high[open_], median[open_], i[open_]
            nearer[open_] = m - ranks.kth(lo, hi, below[open_] - 1 - j) < ranks.kth(lo, hi, below[open_] + k[open_] - j) - m
            least, most = np.where(open_ & nearer, i + 1, least), np.where(open_ & ~nearer, i, most)
        i, none = least, float("-inf")
        under = np.where(i > 0, median - ranks.kth(low, high, np.where(i > 0, below - i, 0)), none)
        over = np.where(k + 1 - i > 0, ranks.kth(low, high, np.where(k + 1 - i > 0, below + k - i, 0)) - median, none)
        return np.maximum(under, over)

    return median, (distance((n - 1) // 2) + distance(n // 2)) / 2


def recent_robust_score(df: DataFrame, by: Sequence[str], time: str, value: str, seconds: int, limit: float = 3.5, least: int = 5) -> DataFrame:
    """df with `recent_n, recent_median, recent_mad, score, is_anomaly`: the distance of a value from the median of its last `seconds`.

    The spread is the median distance from that median in the same frame, times 1.4826; without spread, or with fewer
    than `least` values, there is no score. NaN and null are no values.

    Rows are dealt as by `recent`: a group is a bucket of `seconds` and the one before. Its values are ranked once, and
    the median and spread of each frame are picked from the ranks in log n and log² n steps, without a list per row.
    """
    by, names, width = list(by), df.columns, seconds * MICROS
    x = F.when(~F.isnan(value), F.col(value).cast("double"))
    rows = df.withColumns({"_x": x, "_at": micros(time)}).withColumn("_to", F.floor(F.col("_at") / width))
    rows = rows.select(F.struct(*names).alias("_row"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_x", "_at", "_to")
    mine = rows.where("_at is not null").withColumn("_own", F.lit(True))
    earlier = mine.where("_x is not null").select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *[f"_k{i}" for i in range(len(by))], "_x", "_at", (F.col("_to") + 1).alias("_to"), F.lit(False).alias("_own"))

    def framed(group: pa.Table) -> pa.Table:
        at, own = group["_at"].to_numpy(), group["_own"].to_numpy()
        real = pc.is_valid(group["_x"]).to_numpy()
        order = np.flatnonzero(real)[np.argsort(at[real], kind="stable")]
        times, wanted = at[order], at[own]
        low, high = np.searchsorted(times, wanted - width, "left"), np.searchsorted(times, wanted, "right")
        some = high > low
        median, mad = np.zeros(len(wanted)), np.zeros(len(wanted))
        if some.any():
            median[some], mad[some] = _middle(_Ranks(group["_x"].to_numpy()[order].astype(np.float64) + 0.0), low[some], high[some])
        told = group.select(["_row", "_x"]).filter(pa.array(own))
        for name, v in (("recent_n", pa.array(high - low, pa.int64())), ("recent_median", pa.array(median, mask=~some)), ("recent_mad", pa.array(mad, mask=~some))):
            told = told.append_column(name, v)
        return told

    schema = T.StructType([rows.schema["_row"], T.StructField("_x", T.DoubleType()), T.StructField("recent_n", T.LongType()),
                           T.StructField("recent_median", T.DoubleType()), T.StructField("recent_mad", T.DoubleType())])
    done = mine.unionByName(earlier).groupBy(*[f"_k{i}" for i in range(len(by))], "_to").applyInArrow(framed, schema)
    every = done.unionByName(rows.where("_at is null").select("_row", "_x"), allowMissingColumns=True)
    score = F.when((F.col("recent_n") >= least) & (F.col("recent_mad") > 0), (F.col("_x") - F.col("recent_median")) / (1.4826 * F.col("recent_mad")))
    return every.select("_row.*", "recent_n", "recent_median", "recent_mad", score.alias("score")).withColumn("is_anomaly", F.coalesce(F.abs("score") >= limit, F.lit(False)))
