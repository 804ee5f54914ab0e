"""Helpers of several operators: stored tables, connected components, tiles of large groups, gapless positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folder(spark: SparkSession) -> str:
    """The shared folder of the session. A local one is made only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write the rows to the shared folder and read them back: later stages reread files, whatever executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`node, component` of all nodes of the links `a, b`; component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: every node links to the least node around it, until nothing changes.
    A round moves at most as many rows as there are links, is combined before each shuffle, and is stored; the number
    of rounds grows with the logarithm of the longest path. Links to oneself or with a null are ignored; an empty
    table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    now = store(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = store(small.union(low).distinct(), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()


def tile_pairs(rows: DataFrame, keys: Sequence[str], member: Sequence[str], size: int) -> DataFrame:
    """The rows of all groups with at least two rows, dealt to pairs of tiles: columns `_i`, `_j`, `_tile` are added.

    A group is cut into tiles of about `size` rows by a hash of `member`; a row goes to every pair that its tile is
    part of, so any two rows of a group meet in at least one pair and no task holds more than two tiles. Two rows of
    different tiles meet once, two rows of tile t in the pair (t, t) and in all others with t.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.ceil(F.col("_n") / size).cast("int").alias("_tiles"))
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    placed = rows.join(counts, same).drop(*[f"_k_{k}" for k in keys]).withColumn(
        "_tile", F.pmod(F.xxhash64(*member), F.col("_tiles")).cast("int"))
    other = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return other.withColumns({"_i": F.least("_tile", "_other"), "_j": F.greatest("_tile", "_other")}).drop("_other", "_tiles")


def local_roots(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Root of each of n items: linked(item, others) tells which others it links to. Each item is compared only with
    those that no component has yet, so a dense group costs little and a star of links is enough to describe it."""
    root, unseen = np.full(n, -1, np.int64), np.arange(n)
    while unseen.size:
        start, unseen = unseen[0], unseen[1:]
        root[start], queue = start, [start]
        while queue and unseen.size:
            near = linked(queue.pop(), unseen)
            if near.any():
                hit = unseen[near]
                root[hit] = start
                queue.extend(hit.tolist())
                unseen = unseen[~near]
    root[root < 0] = np.flatnonzero(root < 0)
    return root


def positions(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], spread: Sequence[Column | str], name: str,
              buckets: int) -> DataFrame:
    """0-based gapless position `name` of every row in its group, in the order of a hash of `spread`, then of `order`.

    The first of the hash are `buckets` even buckets, so a group that holds a third of all rows covers many tasks; only
    counts per bucket are accumulated. Equal for every run. Nulls in `by` form a group. Rows that agree in `spread`
    share a bucket, and rows that agree in `order` too are interchangeable.
    """
    placed = df.withColumn("_b", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    counts = placed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_kb"), F.coalesce(before, F.lit(0)).alias("_o"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_b") == F.col("_kb")]
    ranked = placed.withColumn("_r", rank)
    return ranked.join(offsets, same).withColumn(name, F.col("_o") + F.col("_r") - 1).drop(
        "_b", "_r", "_kb", "_o", *[f"_k_{c}" for c in by])


def slices(batch: pa.RecordBatch, text: str, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and about `size` bytes of text; a longer text is a part by itself.

    Parts are copies: Arrow casts a slice that starts at a multiple of 8 to a large string with its offsets left as they
    were, and kernels that follow read other texts.
    """
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + size
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, limit, "right"))))
        yield batch.take(pa.array(np.arange(at, end)))
        at = end


def each_group(df: DataFrame, keys: Sequence[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work on every group of rows with equal whole-number keys, one Arrow table per group.

    Groups are rows of one shuffle partition in order, so a task holds one batch and one group at a time, however many
    small groups there are. Groups have to be bounded, as those of `tile_pairs` are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            first, end = tuple(marks[:, 0]), tuple(marks[:, -1])
            done = []
            if rest and first != last:
                done.append(work(pa.Table.from_batches(rest)))
                rest = []
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                rest.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    done.append(work(pa.Table.from_batches(rest)))
                    rest = []
            last = end
            if done:
                yield from pa.concat_tables(done).to_batches()
        if rest:
            yield from work(pa.Table.from_batches(rest)).to_batches()
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
