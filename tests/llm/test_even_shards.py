import hashlib
import random
from collections import Counter
from itertools import accumulate, combinations_with_replacement

import pytest

from assayer.llm import shards
from tests.llm.test_dedup_mix_shard import check_shards, frame


def loads_of(sizes, cuts):
    sums = [0, *accumulate(sizes)]
    return [sums[b] - sums[a] for a, b in zip([0, *cuts], cuts)]


def test_largest_loads_are_minimal_beside_hot_groups():
    rng = random.Random(5)
    for _ in range(300):
        sizes, k = [rng.randint(1, 9) for _ in range(rng.randint(1, 9))], rng.randint(2, 5)
        hot = rng.randrange(len(sizes))
        sizes[hot] = 200
        cuts, opened = shards.levelled([(str(i), s, 1) for i, s in enumerate(sizes)], k, sum(sizes))
        got = sorted(loads_of(sizes, cuts), reverse=True)
        every = [sorted(loads_of(sizes, [*c, len(sizes)]), reverse=True)[:2] for c in combinations_with_replacement(range(len(sizes) + 1), k - 1)]
        assert not opened and len(cuts) == k and cuts == sorted(cuts) and cuts[-1] == len(sizes) and got[:2] == min(every), (sizes, k, cuts)


@pytest.mark.parametrize("part", [3, 8, 12])
def test_other_shards_stay_even_beside_a_hot_group(spark, part):
    rng = random.Random(part)
    docs = [(i, "x" * rng.randint(0, 40) + str(i)) for i in range(6000)]
    rest = sum(len(t) + 1 for _, t in docs)
    docs += [(10000 + i, "hot text") for i in range(rest // (part - 1) // 9)]
    rows = shards.shard(frame(spark, [(i, t, "s") for i, t in docs]), 16).collect()
    check_shards(rows, docs, 16)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    hot = max(loads, key=loads.get)
    assert len(loads) == 16
    before = sum(len(t) + 1 for _, t in docs if hashlib.md5(t.encode()).hexdigest() < hashlib.md5(b"hot text").hexdigest())
    k = min(range(1, 15), key=lambda k: max(before / k, (rest - before) / (15 - k)))
    assert hot == k
    for side, share in ((range(k), before / k), (range(k + 1, 16), (rest - before) / (15 - k))):
        assert all(share - 60 <= loads[i] <= share + 60 for i in side), sorted(loads.items())
