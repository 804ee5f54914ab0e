import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayer.operators import asof as ao

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


@pytest.mark.parametrize("within", [None, 600])
@pytest.mark.parametrize("bucket", [60, 3600, 10 ** 7])
def test_last_row_that_is_not_later(spark, bucket, within):
    rng = random.Random(bucket)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])  # noqa: E731 one key has most rows
    left = [(i, key(), rng.choice([None, *range(300)])) for i in range(200)] + [(200, 9, 5)] * 2
    right = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(-50, 300)]), rng.randint(0, 5), rng.choice([None, 0.5, 1.5])) for _ in range(150)]
    l = spark.createDataFrame([(i, k, at(m), "own") for i, k, m in left], "id int, k int, t timestamp, _v string")
    r = spark.createDataFrame([(k, at(m), s, x) for k, m, s, x in right], "k int, t timestamp, seq int, x double")
    out = ao.asof_join(l.repartition(3), r.repartition(2), ["k"], "t", "t", ["seq", "x"], tie=["seq"], within=within, bucket=bucket)
    assert out.columns == ["id", "k", "t", "_v", "seq", "x"]
    want = Counter()
    for i, k, m in left:
        best = max(((rm, s, (x is not None, x or 0)) for rk, rm, s, x in right if None not in (k, m, rm) and rk == k and rm <= m), default=None)
        old = best is None or (within is not None and (m - best[0]) * 60 > within)
        want[i, k, at(m), "own", None if old else best[1], None if old or not best[2][0] else best[2][1]] += 1
    assert Counter(map(tuple, out.collect())) == want


def test_empty_sides_and_clashing_names(spark):
    l = spark.createDataFrame([(1, 1, START)], "id int, k int, t timestamp")
    r = spark.createDataFrame([(1, START, 7)], "k int, t timestamp, id int")
    assert ao.asof_join(l, r.limit(0), ["k"], "t", "t", ["id"], prefix="r_").collect()[0].r_id is None
    assert ao.asof_join(l, r, ["k"], "t", "t", ["id"], prefix="r_").collect()[0].r_id == 7
    assert ao.asof_join(l.limit(0), r, ["k"], "t", "t", ["id"], prefix="r_").count() == 0
    with pytest.raises(ValueError, match="twice"):
        ao.asof_join(l, r, ["k"], "t", "t", ["id"])


def test_frames_over_time_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(500)]), rng.choice([None, float("nan"), *map(float, range(8))])) for i in range(300)]
    df = spark.createDataFrame([(i, k, at(m), x) for i, k, m, x in rows], "id int, k string, t timestamp, x double").repartition(3)
    out = {r.id: r for r in ao.recent_robust_score(df, ["k"], "t", "x", 3600, limit=2.0).collect()}
    assert len(out) == 300
    median = lambda v: sorted(v)[(len(v) - 1) // 2] / 2 + sorted(v)[len(v) // 2] / 2
    for i, k, m, x in rows:
        if m is None:
            assert out[i].recent_n is None and out[i].score is None and not out[i].is_anomaly
            continue
        seen = [y for _, o, n, y in rows if o == k and n is not None and 0 <= m - n <= 60 and y is not None and y == y]
        assert out[i].recent_n == len(seen)
        if seen:
            mid = median(seen)
            mad = median([abs(y - mid) for y in seen])
            assert out[i].recent_median == mid and out[i].recent_mad == mad
            good = len(seen) >= 5 and mad > 0 and x is not None and x == x
            assert (out[i].score is not None) == good and (not good or abs(out[i].score - (x - mid) / (1.4826 * mad)) < 1e-9)
    sums = {r.id: r.n for r in ao.recent(df, ["k"], "t", 60, {"n": F.count(F.lit(1))}).collect()}
    assert sums[0] == (None if rows[0][2] is None else sum(o == rows[0][1] and n is not None and 0 <= rows[0][2] - n <= 1 for _, o, n, _ in rows))


def test_medians_and_spreads_of_frames_come_from_ranks(spark):
    import numpy as np

    from assayer.operators import asof
    rng = np.random.default_rng(3)
    for n, values in ((1, 1), (2, 2), (90, 4), (90, 1000)):
        x = rng.integers(0, values, n) / 7.0
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + 1 + rng.integers(0, n, 200))
        median, spread = asof._middle(asof._Ranks(x), low, high)
        for i in range(200):
            frame = x[low[i]:high[i]]
            assert median[i] == np.median(frame) and abs(spread[i] - np.median(np.abs(frame - np.median(frame)))) < 1e-12
    df = spark.range(40_000).selectExpr("id", "timestamp_seconds(1700000000 + id % 3000) AS t", "CAST(id % 97 AS DOUBLE) AS v", "'k' AS k")
    out = asof.recent_robust_score(df, ["k"], "t", "v", 3600)
    assert "collect_list" not in out._jdf.queryExecution().toString().lower()
    last = out.orderBy("t", "id").tail(1)[0]
    frame = np.arange(40_000) % 97.0
    assert last.recent_n == 40_000 and last.recent_median == np.median(frame) and last.recent_mad == np.median(np.abs(frame - np.median(frame)))


def test_what_was_last_before_a_bucket_needs_no_join(spark):
    l = spark.createDataFrame([(i, "note", 1, START + timedelta(seconds=100 * i)) for i in range(40)], "id int, note string, k int, t timestamp")
    r = spark.createDataFrame([(1, START + timedelta(seconds=700 * i), i) for i in range(-2, 3)], "k int, t timestamp, seq int")
    for within, windows in ((600, 1), (601, 2), (None, 2)):  # of a bucket of 600 seconds
        out = ao.asof_join(l, r, ["k"], "t", "t", ["seq"], within=within, bucket=600).select("id", "seq")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "_l1#" not in plan and plan.count("Window [") == windows
        want = {i: 100 * i // 700 if i < 21 else 2 for i in range(40)}
        assert {x.id: x.seq for x in out.collect()} == {i: s if within is None or 100 * i - 700 * s <= within else None for i, s in want.items()}
