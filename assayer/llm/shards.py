"""Sharding: minimax contiguous partition of ordered atomic groups into a fixed number of shards."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import positions, store

KEY_DIGITS = 32  # hex digits of a group's key
FIRST_DIGITS, MORE_DIGITS = 3, 2  # hex digits of the first blocks, and those that each opening adds
ROWS_PER_BUCKET = 100_000


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards, as numbers of items, when each takes all that fits; None if they do not hold everything."""
    cuts, at, done = [], 0, 0
    for _ in range(shards):
        at = bisect_right(ends, done + capacity, at)
        cuts.append(at)
        done = ends[at - 1] if at else 0
    return cuts if at == len(ends) else None


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity at which the greedy cut of the ordered sizes needs at most `shards` shards, and that cut."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0, [0] * shards
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low, greedy(ends, low, shards)


def _blocks(groups: DataFrame, opened: list[str]) -> list[tuple[str, int, int]]:
    """(prefix, size, groups) of the blocks in the opened ones; prefixes of one length are one combined count."""
    out = []
    for known in sorted({len(p) for p in opened}):
        digits = min(known + MORE_DIGITS, KEY_DIGITS) if known else FIRST_DIGITS
        rows = groups.where(F.substring("g", 1, known).isin([p for p in opened if len(p) == known])) if known else groups
        counted = rows.groupBy(F.substring("g", 1, digits).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        out += [(r.p, int(r.s), int(r.n)) for r in counted.collect()]
    return out


def even_cut(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of the shards of a feasible cut: each load is as near as it may be to an equal part of what is left."""
    sums, fewest, cuts = [0, *accumulate(sizes)], [len(sizes)], []
    for _ in range(shards):
        fewest.append(bisect_left(sums, sums[fewest[-1]] - capacity))  # items that the shards before must hold
    at = 0
    for left in range(shards, 0, -1):
        goal = sums[at] * left + sums[-1] - sums[at]
        end = bisect_left(sums, -(-goal // left))
        if end > at and goal - sums[end - 1] * left < sums[end] * left - goal:
            end -= 1
        end = max(end, fewest[left - 1], min(at + 1, len(sizes)))
        at = min(end, bisect_right(sums, sums[at] + capacity) - 1)
        cuts.append(at)
    return cuts


def _least(blocks: list[tuple[str, int, int]], shards: int) -> int:
    """No cut has a smaller capacity, whatever is in the blocks."""
    return max([-(-sum(s for _, s, _ in blocks) // shards), *(s for _, s, n in blocks if n == 1)]) if blocks else 0


def _undecided(blocks: list[tuple[str, int, int]], shards: int, high: int, total: int) -> set[str]:
    """Blocks to be opened before it is known whether a capacity below `high` holds them: unusually large ones first."""
    ends = list(accumulate(s for _, s, _ in blocks))
    if not blocks or _least(blocks, shards) >= high:
        return set()
    opened = {p for p, s, n in blocks if n > 1 and s * 16 ** FIRST_DIGITS > 4 * total}
    for k in range(1, 0 if opened else shards):
        first, last = bisect_right(ends, ends[-1] - (shards - k) * high), bisect_right(ends, k * high)
        opened.update(p for p, _, n in blocks[first:last + 1] if n > 1)
    return opened


def levelled(blocks: list[tuple[str, int, int]], shards: int, total: int) -> tuple[list[int], set[str]]:
    """Ends of the shards, as numbers of blocks, and the blocks to be opened before they are final.

    The largest load is the smallest possible one. If a single group is that load, it is a shard of its own and the
    runs before and after it are cut in the same way, with the shards dealt so that the larger of their two capacities
    is as small as possible; and so on for the next such group.
    """
    high, _ = smallest_capacity([s for _, s, _ in blocks], shards)
    cuts, opened = even_cut([s for _, s, _ in blocks], high, shards), _undecided(blocks, shards, high, total)
    hot = next((i for i, (_, s, n) in enumerate(blocks) if n == 1 and s == high), None)
    if opened or hot is None:
        return cuts, opened
    sides, free = (blocks[:hot], blocks[hot + 1:]), shards - 1
    deals = [(k, free - k) for k in range(free + 1) if (k > 0 or not sides[0]) and (k < free or not sides[1])]
    if not sides[0]:
        deals = deals[:1]
    best, deal = min((max(smallest_capacity([s for _, s, _ in side], m)[0] if side else 0 for side, m in zip(sides, deal, strict=True)), deal) for deal in deals)
    for other in deals:
        if max(_least(side, m) if side else 0 for side, m in zip(sides, other, strict=True)) < best:
            opened.update(*(_undecided(side, m, best, total) for side, m in zip(sides, other, strict=True)))
    before, more = levelled(sides[0], deal[0], total) if deal[0] else ([], set())
    after, most = levelled(sides[1], deal[1], total) if deal[1] else ([], set())
    return [*before, hot + 1, *(hot + 1 + c for c in after)], opened | more | most


def plan(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and the last possible key of each shard but the last.

    groups has one row `g, size` per group, g a hex text of fixed length in whose order the shards are contiguous. The
    driver sees sums of blocks (all groups with a common prefix of the key), never the list of groups. Blocks as items
    give a capacity `high` that is feasible. Under the smallest capacity the k-th cut can lie only where the first k
    shards, and the shards after it, stay within `high`; blocks there are opened by more digits until they are single
    groups, and then the binary search over the items is exact. Unusually large blocks are opened first, so a group
    that outweighs a fair share is seen as such; the runs beside it are cut by the same rule. Loads that are not the
    largest of their run are even to within a block.
    """
    blocks = sorted(_blocks(groups, [""]))
    while True:
        cut, opened = levelled(blocks, shards, sum(s for _, s, _ in blocks))
        if not opened:
            sums = [0, *accumulate(s for _, s, _ in blocks)]
            high = max((sums[b] - sums[a] for a, b in zip([0, *cut], cut, strict=False)), default=0)
            return high, [blocks[c - 1][0].ljust(KEY_DIGITS, "f") if c else "" for c in cut[:-1]]
        blocks = sorted([b for b in blocks if b[0] not in opened] + _blocks(groups, sorted(opened)))


def shard(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id of every row and `size, text_crc32, shard, slot`; no other column of docs is read.

    Size is the number of UTF-8 bytes plus 1. Equal texts are one atomic group; groups are ordered by the MD5 of their
    text, so the order has nothing to do with content or source. The largest shard is as small as a contiguous cut
    allows; where a group alone is that shard, so are the shards before and after it. Null counts as the empty text. Slots are gapless from 0 in a shard, equal for every run; rows without an id
    are placed like others, rows that repeat are interchangeable. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = store(docs.select(
        F.col(id_column).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("g")), "sizes")
    groups = rows.groupBy("g").agg(F.sum("size").alias("size"))
    _, ends = plan(store(groups, "groups"), shards)
    number = sum([(F.col("g") > F.lit(e)).cast("int") for e in ends], F.lit(0))
    buckets = max(16, rows.count() // (shards * ROWS_PER_BUCKET))
    placed = positions(rows.withColumn("shard", number), ["shard"], ["_id", "g"], ["_id", "g"], "slot", buckets)
    return placed.select(F.col("_id").alias(id_column), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
