import math
import random
import statistics

import pytest

from assayer.operators import sketches as sk


def made(spark, n=30_000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        day = rng.choice([1, 1, 1, 2, 3, None])
        v = rng.choice([None, float("nan"), 5.0, 5.0, rng.gauss(1e6, 10), rng.expovariate(1), -0.0, 0.0])
        rows.append((day, v, rng.choice([None, "", "a", f"w{rng.randint(0, 50)}"]), i))
    return rows, spark.createDataFrame(rows, "day int, v double, word string, n long").repartition(5)


@pytest.mark.parametrize("by", [[], ["day"]])
def test_merged_parts_equal_the_rows(spark, by):
    rows, df = made(spark)
    parts = sk.profile_parts(df.withColumn("half", df.n % 2), ["day", "half"], ["v", "n"], ["word"])
    merged = sk.merge_profiles(parts, by)
    merged = spark.createDataFrame(merged.collect(), merged.schema)  # a sketch flips coins: the same one for all that follows
    out = {(r["day"] if by else None, r.feature): r for r in merged.collect()}
    assert len(out) == 3 * (4 if by else 1)
    for (day, feature), r in out.items():
        at = {"v": 1, "word": 2, "n": 3}[feature]
        own = [x[at] for x in rows if not by or x[0] == day]
        fine = [x for x in own if x is not None and x == x]
        assert (r["rows"], r.missing) == (len(own), len(own) - len(fine))
        assert abs(r.distinct_values - len(set(fine))) <= sk.distinct_bound() * len(set(fine))
        if feature == "word":
            assert r.qs is None and r["mean"] is None and r.minimum is None
            continue
        assert (r.minimum, r.maximum) == (min(fine), max(fine))
        assert math.isclose(r["mean"], statistics.fmean(fine), rel_tol=1e-9) and math.isclose(r.std, statistics.stdev(fine), rel_tol=1e-6)
        for p, q in zip(sk.PROBS, r.qs, strict=True):
            below, upto = sum(x < q for x in fine) / len(fine), sum(x <= q for x in fine) / len(fine)
            assert below - 2 * sk.rank_bound() <= p <= upto + 2 * sk.rank_bound()
    errors = {(r["day"] if by else None, r.feature): r for r in sk.profile_errors(df, merged, by, ["v", "n"]).collect()}
    assert len(errors) == 2 * (4 if by else 1)
    for (day, feature), r in errors.items():
        fine = [x for x in ((x[1] if feature == "v" else x[3]) for x in rows if not by or x[0] == day) if x is not None and x == x]
        worst = max(max(0, sum(x < q for x in fine) / len(fine) - p, p - sum(x <= q for x in fine) / len(fine)) for p, q in zip(sk.PROBS, out[day, feature].qs, strict=True))
        assert r.distinct_exact == len(set(fine)) and math.isclose(r.rank_error, worst, abs_tol=1e-12)
        assert r.rank_error <= 2 * sk.rank_bound() and r.distinct_error <= sk.distinct_bound()


def test_parts_without_values_and_values_too_large_for_sums(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1e200), (2, 1.0), (3, 2.0)], "day int, v double")
    parts = sk.profile_parts(df, ["day"], ["v"])
    out = {r.day: r for r in sk.merge_profiles(parts, ["day"]).collect()}
    assert (out[1]["rows"], out[1].missing, out[1].qs, out[1]["mean"], out[1].distinct_values) == (2, 2, None, None, 0)
    assert (out[2]["mean"], out[2].std, out[2].maximum) == (None, None, 1e200)
    assert (out[3]["mean"], out[3].std, out[3].qs[2]) == (2.0, None, 2.0)
    total = sk.merge_profiles(parts).first()
    assert (total["rows"], total.missing, total.distinct_values, total["mean"]) == (5, 2, 3, None)
    assert sk.merge_profiles(sk.profile_parts(df.limit(0), ["day"], ["v"])).count() == 0


def test_a_part_that_comes_later_changes_no_other(spark):
    rows, df = made(spark, 3000)
    old, new = df.where("n < 1000"), df.where("n >= 1000")
    both = sk.merge_profiles(sk.profile_parts(old, ["day"], ["v"]).unionByName(sk.profile_parts(new, ["day"], ["v"]))).first()
    whole = sk.merge_profiles(sk.profile_parts(df, ["day"], ["v"])).first()
    for c in ("rows", "missing", "minimum", "maximum", "mean", "std", "distinct_values"):
        assert both[c] == whole[c]
