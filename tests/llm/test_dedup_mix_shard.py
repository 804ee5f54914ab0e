import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import lines, mixing, queries, shards, shared, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _id string, fp int, shard int, component string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", 2, 3, "y") for i, t, s in rows], SCHEMA).repartition(3)


ODD = [(5, None, "b"), (3, "", "b"), (4, "   \n\t", None), (9, "one two", "a"), (2, "one two", "a"), (2, "one two", "a"), (None, "one two", "a"),
       (7, "Zwölf ÄÖÜ ß", "a"), (8, "word " * 3000, None), (6, "\n".join(["a shared line of text"] * 3 + ["own"]), "c"), (1, " A Shared line of text \t", "c")]


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_and_components_match_brute_force(spark, given):
    out = queries.QUERIES["op3_simhash_dedup"](spark, SF).collect()
    rows = sorted(given, key=lambda r: r.doc_id)
    prints = [brute_simhash(r.text) for r in rows]
    roots = brute_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {
        (rows[i].doc_id, f"{prints[i]:016x}", rows[roots[i]].doc_id) for i in range(len(rows))}


def test_simhash_links_of_dense_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = random.Random(1)
    values = set()
    for _ in range(4):
        seed = rng.getrandbits(64)
        values.update({seed} | {seed ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)})
        values.update(rng.getrandbits(64) for _ in range(20))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    mask = (1 << 64) - 1
    roots = brute_components(len(values), lambda i, j: ((values[i] ^ values[j]) & mask).bit_count() <= 2)
    got = {r.node: r.component for r in shared.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2)).collect()}
    want = {values[i]: values[roots[i]] for i in range(len(values))}
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(v == k for k, v in want.items() if k not in got)


def test_near_duplicates_of_odd_rows(spark):
    out = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(out) == len(ODD)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.component)
    assert by[5] == by[3] == by[4] == {3}
    assert by[9] == by[2] == by[None] == {2}
    assert simhash.near_duplicates(frame(spark, []).where("false")).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1500)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 401), 100), **dict.fromkeys(range(1000, 1500), 1000)}


def test_lines_of_odd_rows(spark):
    out = {(r.doc_id, r.kept_text): (r.n_lines, r.n_dropped) for r in lines.drop_shared_lines(frame(spark, ODD)).collect()}
    assert out[(5, "")] == (1, 0) and out[(3, "")] == (1, 0) and out[(4, "   \n\t")] == (2, 0)
    assert out[(6, "own")] == (4, 3) and out[(1, " A Shared line of text \t")] == (1, 0)
    assert out[(8, "word " * 3000)] == (1, 0)
    assert lines.drop_shared_lines(frame(spark, []).where("false")).count() == 0


def test_lines_dropped_whole(spark):
    rows = [(1, "first shared line", "a"), (2, "first shared line\nfirst shared line", "a"), (None, "first shared line\nx", "a")]
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.drop_shared_lines(frame(spark, rows)).collect()}
    assert out == {1: (1, 0, "first shared line"), 2: (2, 2, ""), None: (2, 1, "x")}


def check_shards(rows, docs, shards_):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    groups = defaultdict(int)
    for _, t in docs:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += size(t)
    sizes = [groups[g] for g in sorted(groups)]
    best, _ = shards.smallest_capacity(sizes, shards_)
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(loads.values(), default=0) == best
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_smallest_capacity_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        sizes, k = [rng.randint(1, 30) for _ in range(rng.randint(1, 25))], rng.randint(1, 6)
        best, cut = shards.smallest_capacity(sizes, k)
        ends = [sum(sizes[:i + 1]) for i in range(len(sizes))]
        assert shards.greedy(ends, best, k) == cut and not shards.greedy(ends, best - 1, k)


def test_shards_of_given_rows(spark, given):
    check_shards(queries.QUERIES["op9_sharding"](spark, SF).collect(), [(r.doc_id, r.text) for r in given], 16)


@pytest.mark.parametrize("hot", [0, 300, 4000])
def test_shards_with_a_hot_group(spark, hot):
    rng = random.Random(hot)
    docs = [(i, "x" * rng.randint(0, 40) + str(rng.randint(0, 3000))) for i in range(6000)] + [(10000 + i, "hot text") for i in range(hot)] + [(None, None), (3, "")]
    check_shards(shards.shard(frame(spark, [(i, t, "s") for i, t in docs]), 5).collect(), docs, 5)


def test_shards_of_an_empty_table_and_one_row(spark):
    assert shards.shard(frame(spark, []).where("false")).count() == 0
    assert [(r.shard, r.slot) for r in shards.shard(frame(spark, [(1, "a", "s")]), 4).collect()] == [(0, 0)]


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        more = {s for s in free if w[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= more


def test_mix_of_given_rows(spark, given):
    rows = queries.QUERIES["op10_mixing"](spark, SF).collect()
    sizes, taken, target = Counter(), Counter(), {}
    text = {r.doc_id: r for r in given}
    for r in rows:
        d = text[r.doc_id]
        assert r.size == len(d.text.split()) and r.taken in (0, r.size, 2 * r.size)
        sizes[d.source] += r.size
        taken[d.source] += r.taken
        target[d.source] = r.target
    want = brute_targets(sizes)
    assert len(rows) == len(given) and all(r.source_size == sizes[text[r.doc_id].source] for r in rows)
    for s, t in want.items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.02 * t + 5, s
    again = queries.QUERIES["op10_mixing"](spark, SF).collect()
    assert sorted(rows) == sorted(again)


def test_tilted_rates_meet_the_constraint(spark):
    classes = [("a", n, 1 + n % 3) for n in range(1, 200)] + [(None, 10, 4), ("z", 0, 7), ("full", 5, 2)]
    sizes = Counter()
    for s, n, c in classes:
        sizes[s] += n * c
    goals = [("a", sizes["a"], 1.7 * sizes["a"]), (None, 40, 13.0), ("z", 0, 0.0), ("full", 10, 20.0)]
    out = {r.source: r for r in mixing.tilts(spark.createDataFrame(classes, "source string, size long, count long"),
                                             spark.createDataFrame(goals, "source string, source_size long, target double"), 2.0).collect()}
    assert out["full"].tilt is None and out["z"].tilt is None
    for s, _, goal in goals[:2]:
        got = sum(c * n * min(2.0, math.exp(out[s].tilt * n / out[s]._mean)) for k, n, c in classes if k == s)
        assert got == pytest.approx(goal, rel=1e-6)


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert Counter(r["size"] for r in rows) == Counter(len((t or "").split()) for _, t, _ in ODD)
    assert mixing.mix(frame(spark, []).where("false")).count() == 0
    assert mixing.mix(frame(spark, [(1, "", None), (2, None, None)])).agg(F.sum("taken")).first()[0] == 0


def test_positions_are_gapless(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("n"))
    out = shared.positions(df, ["k", "n"], ["id"], ["id"], "place", 16).groupBy("k", "n").agg(
        F.count("*").alias("c"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.countDistinct("place").alias("d")).collect()
    assert len(out) == 6 and all(r.lo == 0 and r.hi == r.c - 1 and r.d == r.c for r in out)
