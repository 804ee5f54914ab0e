import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest

from assayer.plans.stateful_streams import arriving
from assayer.streaming import closed_days, missing_days, repeated_in_period, run_step

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, who string, part int, what string, _w int"


def made(spark, n=400, days=12):
    rng = random.Random(7)
    rows = []
    for _ in range(n):
        minutes = rng.choice([d for d in range(days) if d not in (3, 4, 8)]) * 1440 + rng.randint(0, 300)
        who = rng.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((START + timedelta(minutes=minutes), who, rng.choice([None, 1]), rng.choice([None, "x", "x", "y"]), 0))
    rows += [(None, "hot", 1, "x", 0)] * 3
    rows.append((START + timedelta(days=days + 2), "end", 1, "x", 0))  # closes all days before
    return rows, spark.createDataFrame(rows, SCHEMA)


def read(spark, df, folder):
    return spark.readStream.schema(df.schema).parquet(folder)


def test_repeats_over_several_steps_equal_those_of_all_rows(spark, tmp_path):
    rows, df = made(spark)
    for _ in arriving(df.repartition(3), "ts", f"{tmp_path}/in", parts=4):
        found = repeated_in_period(read(spark, df, f"{tmp_path}/in"), ["who", "part"], ["what"], "ts", "1 hour", "1 hour")
        assert run_step(found, f"{tmp_path}/out", f"{tmp_path}/state") == 0
    groups = defaultdict(list)
    for ts, who, part, what, _ in rows:
        if ts is not None and (who, part) != (None, None):
            groups[ts.replace(minute=0), who, part].append(what)
    end = max(r[0] for r in rows if r[0]) - timedelta(hours=1)
    want = Counter((*k, len(v), len(set(v)), "conflicting" if len(set(v)) > 1 else "identical")
                   for k, v in groups.items() if len(v) > 1 and k[0] + timedelta(hours=1) <= end)
    out = spark.read.schema(found.schema).parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, out.collect())) == want and len(want) > 50
    assert {r.kind for r in out.collect()} == {"conflicting", "identical"}


def test_gaps_reach_over_steps(spark, tmp_path):
    rows, df = made(spark)
    for _ in arriving(df.repartition(3), "ts", f"{tmp_path}/in", parts=5):
        days = closed_days(read(spark, df, f"{tmp_path}/in"), "who", "ts", "1 hour")
        run_step(days, f"{tmp_path}/days", f"{tmp_path}/s1")
        gaps = missing_days(read(spark, days, f"{tmp_path}/days"))
        run_step(gaps, f"{tmp_path}/gaps", f"{tmp_path}/s2")
    end = max(r[0] for r in rows if r[0]) - timedelta(hours=1)
    seen = Counter((who, ts.date()) for ts, who, *_ in rows if ts and datetime.combine(ts.date(), datetime.min.time()) + timedelta(days=1) <= end)
    got = spark.read.schema(days.schema).parquet(f"{tmp_path}/days").collect()
    assert Counter({(r.series, date(1970, 1, 1) + timedelta(days=r.day)): r["rows"] for r in got}) == seen
    want = set()
    for who in {w for w, _ in seen}:
        own = sorted(d for w, d in seen if w == who)
        want |= {(who, a + timedelta(days=1), b - timedelta(days=1), (b - a).days - 1) for a, b in zip(own, own[1:]) if (b - a).days > 1}
    out = spark.read.schema(gaps.schema).parquet(f"{tmp_path}/gaps").collect()
    assert len(out) == len(want) and set(map(tuple, out)) == want
    assert ("hot", date(2024, 1, 4), date(2024, 1, 5), 2) in want


def test_rows_that_come_too_late_are_not_lost_in_silence(spark, tmp_path):
    df = spark.createDataFrame([(START + timedelta(hours=h), "a", 1, "x", 0) for h in (0, 0, 5)], SCHEMA)
    late = spark.createDataFrame([(START, "a", 1, "y", 0)], SCHEMA)

    def step(rows, **kw):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        found = repeated_in_period(read(spark, df, f"{tmp_path}/in"), ["who"], ["what"], "ts", "1 hour")
        return run_step(found, f"{tmp_path}/out", f"{tmp_path}/state", **kw)
    assert step(df) == 0
    assert step(late, strict=False) == 1
    with pytest.raises(ValueError, match="after their period"):
        step(late)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.group_size, r.contents) for r in out] == [(2, 1)]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    steps = 0
    for _ in arriving(df, "ts", f"{tmp_path}/in"):
        found = repeated_in_period(read(spark, df, f"{tmp_path}/in"), ["who"], ["what"], "ts", "1 hour")
        steps += 1 + run_step(found, f"{tmp_path}/out", f"{tmp_path}/state")
    assert steps == 1 and spark.read.schema(found.schema).parquet(f"{tmp_path}/out").count() == 0
