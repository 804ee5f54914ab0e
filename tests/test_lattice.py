import random
from itertools import combinations

import pytest

from assayer.operators.lattice import keys_and_dependencies


def brute(rows, columns, width):
    """Minimal keys and dependencies by comparing all sets of columns."""
    n, distinct = len(rows), {}
    for k in range(width + 1):
        for s in combinations(range(len(columns)), k):
            distinct[s] = len({tuple(r[i] for i in s) for r in rows})
    keys = [s for s in distinct if distinct[s] == n and not any(distinct[q] == n and set(q) < set(s) for q in distinct)]
    holds = {(tuple(x for x in s if x != a), a) for s in distinct for a in s if distinct[tuple(x for x in s if x != a)] == distinct[s] < n}
    minimal = {(left, a) for left, a in holds if not any(b == a and set(o) < set(left) for o, b in holds)}
    name = lambda s: ",".join(columns[i] for i in s)
    return {("key", name(s), None, len(s), n) for s in keys} | {("dependency", name(s), columns[a], len(s), distinct[s]) for s, a in minimal}


@pytest.mark.parametrize("seed", range(4))
def test_lattice_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        a, b, c = rng.randint(0, 5), rng.randint(0, 9), rng.choice([None, 0, 1, 2])
        rows.append((a, b, a // 2, (a * 7 + b) % 11, c, "k", None if c is None else c % 2, i // (1 + seed)))
    columns = ["a", "b", "half", "mix", "c", "same", "odd", "no"]
    df = spark.createDataFrame(rows, "a int, b int, half int, mix int, c int, same string, odd int, no int").repartition(3)
    got = [tuple(r) for r in keys_and_dependencies(df, columns, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, columns, 3)


def test_lattice_of_equal_few_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (-0.0, "x"), (0.0, "x"), (float("nan"), "x"), (float("nan"), "y")], "d double, s string")
    assert {tuple(r) for r in keys_and_dependencies(df).collect()} == set()
    for n in (0, 1):
        assert [tuple(r) for r in keys_and_dependencies(df.limit(n)).collect()] == [("key", "", None, 0, n)]
    assert {tuple(r) for r in keys_and_dependencies(df.select("s").distinct()).collect()} == {("key", "s", None, 1, 3)}
    with pytest.raises(ValueError):
        keys_and_dependencies(spark.range(1).selectExpr(*[f"id AS c{i}" for i in range(60)]))


def test_a_hot_value_leaves_the_result_alone(spark):
    rows = [(0, i % 7, i) for i in range(2000)] + [(i, i % 7, i) for i in range(2000, 2300)]
    df = spark.createDataFrame(rows, "hot int, week int, no int")
    assert {tuple(r) for r in keys_and_dependencies(df).collect()} == brute(rows, ["hot", "week", "no"], 3)


def test_sets_without_a_claim_that_holds_are_not_shuffled_whole(spark):
    from assayer.operators import lattice
    df = spark.range(60_000, numPartitions=4).selectExpr("id", *[f"pmod(xxhash64(id, {i}), 40) AS c{i}" for i in range(6)], "pmod(xxhash64(id, 0), 40) DIV 8 AS d")
    rows = lattice.Claims(df, df.columns, [60_000, *[40] * 6, 5], 2)
    sets = [((i, j), (7,)) for i in range(2, 7) for j in range(i + 1, 7)]
    assert all(repeated and broken for _, repeated, broken in rows.look(sets, 12).values())
    assert rows.parts(12).count() < 30_000
    got = {tuple(r)[:3] for r in keys_and_dependencies(df, width=2).collect()}
    assert got == {("key", "id", None), ("dependency", "c0", "d")}


def near_keys(n=20_000):
    """Two columns that are a key but for four pairs of rows, one that a column determines but for two rows, a hot value, columns of few values."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        a = i // 4 if i % 3 else 0
        group = rng.randrange(90)
        rows.append([a, rng.randrange(10 ** 9), group, group // 7, group // 7, rng.choice([None, 0, 1, 2, 3]), rng.randrange(5), rng.randrange(7)])
    for i in (11, 12):
        rows[i][3] = 99
    for i, c in ((100, 5), (200, 6), (300, 7), (400, 2)):
        rows[i + 1] = list(rows[i])
        rows[i + 1][c] = -1
    return [tuple(r) for r in rows], ["a", "b", "group", "nearly", "seventh", "c", "d", "e"]


SCHEMA = "a int, b int, group int, nearly int, seventh int, c int, d int, e int"


@pytest.mark.parametrize("most", [200_000, 2])
def test_near_keys_and_near_dependencies_equal_brute_force(spark, monkeypatch, most):
    from assayer.operators import lattice
    monkeypatch.setattr(lattice, "MOST_SHARED", most, raising=False)
    rows, columns = near_keys()
    got = [tuple(r) for r in keys_and_dependencies(spark.createDataFrame(rows, SCHEMA).repartition(4), columns, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, columns, 3)


def test_claims_on_a_near_key_are_not_looked_for_in_all_rows_one_by_one(spark, monkeypatch):
    from assayer.operators import lattice
    whole, look = [], lattice.Claims.look

    def spy(self, claims, share=1, **more):
        whole.extend(claims if share == 1 and more.get("rows") is None else [])
        return look(self, claims, share, **more)

    monkeypatch.setattr(lattice.Claims, "look", spy)
    rows, columns = near_keys()
    keys_and_dependencies(spark.createDataFrame(rows, SCHEMA).repartition(4), columns, 3).collect()
    assert len(whole) == 0
