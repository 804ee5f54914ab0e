"""Fingerprints of blocks of a table in a hash tree, and differences that only read blocks which differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.identity import table_diff

BITS = 12  # a table has 2^BITS blocks
FAN = 4  # bits that a step down the tree tells apart


def _hash(seed: int, names: Sequence[str]) -> Column:
    """64 bits of the values; NULL is told from any value and from its place, -0.0 equals 0.0."""
    return F.xxhash64(F.lit(seed), *[x for c in names for x in (F.col(c).isNull(), F.col(c))])


def block_of(keys: Sequence[str], bits: int = BITS) -> Column:
    """The block of a row: the first bits of a hash of its key. Blocks are even, whatever the keys."""
    return F.shiftrightunsigned(_hash(7, keys), 64 - bits)


def block_fingerprints(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, bits: int = BITS) -> DataFrame:
    """`block, rows, sum_a, sum_b, repeated, non_finite, filled` of each block that has rows; equal blocks hold equal rows.

    Two sums of independent 64-bit hashes of whole rows, so order plays no part and copies count. repeated: keys that
    the block has more than once; non_finite: numbers that are no number or infinite; filled: values per column. Rows are combined by block and key
    before they are shuffled, and a block is one row of the result.
    """
    columns = list(columns or [c for c in df.columns if c not in keys])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    odd = [F.coalesce((F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("long"), F.lit(0)) for c in columns if isinstance(kinds[c], (T.DoubleType, T.FloatType))]
    wide = lambda seed: _hash(seed, [*keys, *columns]).cast("decimal(38,0)")
    rows = df.select(block_of(keys, bits).alias("block"), _hash(3, keys).alias("_key"), wide(1).alias("_a"), wide(2).alias("_b"), sum(odd, F.lit(0).cast("long")).alias("_odd"),
                     *[F.col(c).isNotNull().cast("long").alias(f"_f{i}") for i, c in enumerate(columns)])
    filled = [f"_f{i}" for i in range(len(columns))]
    by_key = rows.groupBy("block", "_key").agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("a"), F.sum("_b").alias("b"), F.sum("_odd").alias("odd"),
                                              *[F.sum(c).alias(c) for c in filled])
    return by_key.groupBy("block").agg(
        F.sum("n").alias("rows"), F.sum("a").cast("decimal(38,0)").alias("sum_a"), F.sum("b").cast("decimal(38,0)").alias("sum_b"),
        F.count_if(F.col("n") > 1).alias("repeated"), F.sum("odd").alias("non_finite"),
        (F.array(*[F.sum(c) for c in filled]) if filled else F.array().cast("array<long>")).alias("filled"))


def fingerprint_tree(blocks: DataFrame, bits: int = BITS, fan: int = FAN) -> DataFrame:
    """`level, node, rows, sum_a, sum_b, repeated, non_finite` of all nodes above the blocks: sums of their children.

    Level 0 is the root, the last level the blocks themselves. Each block is counted once for each level.
    """
    depth = -(-bits // fan)
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftrightunsigned("block", max(bits - k * fan, 0)).alias("node")) for k in range(depth + 1)]))
    measures = ["rows", "sum_a", "sum_b", "repeated", "non_finite"]
    return blocks.select(levels.alias("_l"), *measures).groupBy("_l.level", "_l.node").agg(
        *[F.sum(c).cast("decimal(38,0)" if c.startswith("sum") else "long").alias(c) for c in measures])


def unequal_nodes(left: DataFrame, right: DataFrame, bits: int = BITS, fan: int = FAN) -> DataFrame:
    """`level, compared, unequal` per level and, in `nodes` of the last one, the blocks that differ, hold a key more than once
    or a number that is not finite.

    From the root down; a level compares only the children of nodes that differ, so equal tables cost one comparison.
    """
    depth = -(-bits // fan)
    same = ["rows", "sum_a", "sum_b"]
    told = []
    open_nodes = [0]
    for k in range(depth + 1):
        l, r = (t.where((F.col("level") == k) & F.col("node").isin(open_nodes)).alias(n) for t, n in ((left, "l"), (right, "r")))
        joined = l.join(r, F.col("l.node") == F.col("r.node"), "full_outer")
        plain = F.coalesce((F.col("l.repeated") == 0) & (F.col("r.repeated") == 0) & (F.col("l.non_finite") == 0) & (F.col("r.non_finite") == 0), F.lit(False))
        equal = plain
        for c in same:
            equal = equal & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        rows = joined.select(F.coalesce("l.node", "r.node").alias("node"), equal.alias("equal")).collect()
        bad = sorted(x.node for x in rows if not x.equal)
        told.append((k, len(rows), len(bad), bad if k == depth else None))
        if not bad:
            break
        step = min(fan, bits - k * fan)
        open_nodes = [(n << step) + i for n in bad for i in range(1 << step)] if step > 0 else bad
    spark = left.sparkSession
    return spark.createDataFrame(told, "level int, compared long, unequal long, nodes array<long>")


def block_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 0.0, tolerances: Mapping[str, float] | None = None,
               bits: int = BITS, fan: int = FAN, stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The rows of `table_diff`, from a join of the blocks that differ alone; `joined_rows` and `blocks` tell how much that was.

    `stored`: fingerprints of both tables by `block_fingerprints`, where a table was fingerprinted when it was written; else
    each is scanned once. Blocks with equal fingerprints count as compared and equal. Blocks with a repeated key or a
    number that is not finite are joined as well, since equal ones may differ in the sense of the join. The two tables
    are filtered by the hash of the key before the join; a table stored in folders by `block_of` is read only there.

    A column that one side lacks is not compared (other_columns tells how many). An empty side gives one-sided rows only.
    """
    keys = list(keys)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    prints = stored or tuple(block_fingerprints(t, keys, shared, bits) for t in (left, right))
    kept = [p.persist() for p in prints]
    trees = [fingerprint_tree(p, bits, fan) for p in kept]
    found = unequal_nodes(*trees, bits, fan).orderBy(F.desc("level")).first()
    blocks = found.nodes or []
    pick = lambda t: t.where(block_of(keys, bits).isin(blocks)) if blocks else t.limit(0)
    sides = [pick(t) for t in (left, right)]
    inside = F.col("block").isin(blocks) if blocks else F.lit(False)
    count = lambda where: F.coalesce(F.sum(F.when(where, F.col("rows"))), F.lit(0))
    some = [F.coalesce(F.sum(F.when(~inside, F.col("filled")[i])), F.lit(0)).alias(f"f{i}") for i in range(len(shared))]
    totals = [p.agg(count(inside).alias("open"), count(~inside).alias("settled"), *some).first() for p in kept]
    for p in kept:
        p.unpersist()
    diff = table_diff(*sides, keys, tolerance, tolerances)
    numeric = [c for i, c in enumerate(shared) if isinstance(left.schema[c].dataType, T.NumericType) and totals[0][f"f{i}"]]
    # values in blocks that agree do not differ
    gap = F.when(F.col("column").isin(numeric), F.coalesce("max_abs_difference", F.lit(0.0))).otherwise(F.col("max_abs_difference")) if numeric else F.col("max_abs_difference")
    return diff.withColumns({"compared": F.col("compared") + F.lit(totals[0]["settled"]), "max_abs_difference": gap,
                             "joined_rows": F.lit(totals[0]["open"] + totals[1]["open"]).cast("long"), "blocks": F.lit(len(blocks)).cast("long")})
