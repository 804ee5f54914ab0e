import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import average_ranks, clean, hash_rank, is_blank, norm_text, parse_number, quantiles, running


def test_text_and_number_rules(spark):
    rows = [(" 1.5 ",), ("1d",), ("NaN",), ("-inf",), ("Infinity",), ("\t ",), (".5",), ("1e3",), (None,), ("x",)]
    out = spark.createDataFrame(rows, "s string").select(parse_number("s").alias("x"), is_blank("s").alias("b")).collect()
    assert [r.x for r in out] == [1.5, None, None, -math.inf, math.inf, None, 0.5, 1000.0, None, None]
    assert [r.b for r in out] == [False] * 5 + [True] + [False] * 4
    t = spark.createDataFrame([("\t Straße \n",), ("  ",), (None,)], "s string").select(norm_text("s").alias("k")).collect()
    assert [r.k for r in t] == ["strasse", None, None]


def test_nan_is_missing(spark):
    r = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double").agg(F.count(clean("x")).alias("n"), F.max(clean("x")).alias("m")).first()
    assert (r.n, r.m) == (1, 1.0)


@pytest.mark.parametrize("accuracy", [20, 20_000])
def test_quantiles_match_numpy(spark, accuracy):
    """A small accuracy forces brackets; one value holds a third of the hot group."""
    rng = np.random.default_rng(1)
    groups = {"hot": np.r_[rng.normal(size=4000), np.full(2000, 0.25)], "small": rng.integers(0, 5, 37).astype(float), "one": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("small", float("nan")), ("hot", None)], "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for r in quantiles(df, ["g"], "x", probs, accuracy=accuracy).collect():
        assert r.n == len(groups[r.g])
        assert np.allclose(r.qs, np.quantile(groups[r.g], probs), atol=1e-12)
    whole = quantiles(df, [], "x", probs, accuracy=accuracy).first()
    assert np.allclose(whole.qs, np.quantile(np.concatenate(list(groups.values())), probs), atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([(None,)], "x double"), [], "x", [0.5]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_hot_and_null_group(spark, descending):
    rows = [("hot", i, i % 7) for i in range(900)] + [("b", i, 1) for i in range(10)] + [(None, i, 2) for i in range(20)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v bigint")
    got = {(r.g, r.o): r.run_v for r in running(df, ["g"], "o", ["v"], descending).collect()}
    want = {}
    for g in ("hot", "b", None):
        total = 0
        for k, o, v in sorted([r for r in rows if r[0] == g], key=lambda r: -r[1] if descending else r[1]):
            total += v
            want[(k, o)] = total
    assert got == want


def test_average_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (2.0,)], "x double")
    assert {r.x: r["rank"] for r in average_ranks(df, [], "x").collect()} == {1.0: 1.0, 2.0: 3.0, 3.0: 5.0}


def test_hash_rank_ignores_order_and_partitions(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(500)], "id int, g string")
    one = {r.id: r["rank"] for r in hash_rank(df, ["g"], ["id"], "7").collect()}
    two = {r.id: r["rank"] for r in hash_rank(df.orderBy(F.col("id").desc()).repartition(3), ["g"], ["id"], "7").collect()}
    assert one == two
    assert sorted(v for k, v in one.items() if k % 3 == 0) == list(range(1, 168))
