import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import blocks as bl
from assayer.operators import identity as idn

SCHEMA = "k long, g string, x double, n int"


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, -0.0, rng.random()]), rng.choice([None, rng.randint(0, 9)])) for i in range(n)]


def compare(spark, left, right, **options):
    l, r = spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA).repartition(2)
    fast, plain = bl.block_diff(l, r, ["k"], bits=6, fan=2, **options), idn.table_diff(l, r, ["k"], **options)
    key = lambda d: sorted(map(tuple, d.select(plain.columns).collect()), key=str)
    assert key(fast) == key(plain)
    assert idn.diff_verdict(fast).collect() == idn.diff_verdict(plain).collect()
    return fast.first()


def test_equal_tables_are_not_joined(spark):
    rows = rows_of(500)
    random.Random(2).shuffle(same := list(rows))
    out = compare(spark, rows, same)
    assert (out.joined_rows, out.blocks, out.compared) == (0, 0, 500)


@pytest.mark.parametrize("change", ["value", "null", "missing", "added", "all", "repeated", "nan", "infinite", "swapped"])
def test_verdict_is_that_of_the_whole_join(spark, change):
    rows = rows_of(500)
    other = list(rows)
    if change in ("value", "null"):
        other[40] = (40, "b", None if change == "null" else 7.0, None)
    elif change == "missing":
        del other[17]
    elif change == "added":
        other.append((1000, None, None, 1))
    elif change == "all":
        other = [(k, "z", x, n) for k, _, x, n in rows]
    elif change == "repeated":
        rows, other = [*rows, rows[3]], [*other, other[3]]
    elif change == "nan":
        rows, other = [*rows, (600, "a", float("nan"), 1)], [*other, (600, "a", None, 1)]
    elif change == "infinite":
        rows, other = [*rows, (600, "a", float("inf"), 1)], [*other, (600, "a", float("inf"), 1)]
    else:
        other[5], other[6] = (5, *rows[6][1:]), (6, *rows[5][1:])
    out = compare(spark, rows, other, tolerance=0.01)
    assert (out.blocks == 64) == (change == "all") and (change == "all" or out.joined_rows < 60)


def test_empty_and_null_keys(spark):
    rows = rows_of(30)
    compare(spark, rows, [])
    compare(spark, [], rows)
    compare(spark, [], [])
    compare(spark, [(None, "a", 1.0, 1), *rows], rows)


def test_joined_rows_are_those_of_changed_blocks_and_stored_prints_are_used(spark, tmp_path):
    rows = rows_of(2000)
    l, r = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, g, x, 99 if k == 77 else n) for k, g, x, n in rows], SCHEMA)
    bl.block_fingerprints(l, ["k"], bits=8).write.parquet(f"{tmp_path}/l")
    prints = spark.read.parquet(f"{tmp_path}/l"), bl.block_fingerprints(r, ["k"], bits=8)
    out = bl.block_diff(l, r, ["k"], bits=8, stored=prints)
    block = l.where("k = 77").select(bl.block_of(["k"], 8).alias("b")).first().b
    inside = l.where(bl.block_of(["k"], 8) == block).count()
    first = out.first()
    assert (first.blocks, first.joined_rows, first.compared) == (1, 2 * inside, 2000) and {x.column: x.differing for x in out.collect()} == {"g": 0, "x": 0, "n": 1}
    levels = bl.unequal_nodes(*[bl.fingerprint_tree(p, 8, 2) for p in prints], 8, 2).collect()
    assert [(x.level, x.compared, x.unequal) for x in levels] == [(0, 1, 1), *[(k, 4, 1) for k in range(1, 5)]] and levels[-1].nodes == [block]


def test_levels_add_up(spark):
    blocks = bl.block_fingerprints(spark.createDataFrame(rows_of(700), SCHEMA), ["k"], bits=5)
    tree = bl.fingerprint_tree(blocks, 5, 2).groupBy("level").agg(F.sum("rows").alias("n"), F.sum("sum_a").alias("a"), F.count(F.lit(1)).alias("c")).orderBy("level").collect()
    assert [t.n for t in tree] == [700] * 4 and len({t.a for t in tree}) == 1 and [t.c for t in tree] == [1, 4, 16, 32]
