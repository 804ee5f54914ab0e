"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.shared import components, each_group, local_roots, store, tile_pairs

BITS, TABLES = 18, 20  # a pair at cosine 0.98 shares a bucket in some table with probability 0.9993, a closer one with a higher one
TILE = 1024  # vectors; a task compares at most two tiles
SEED = 11


@lru_cache(maxsize=8)
def planes(dimensions: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).standard_normal((dimensions, tables * bits))


def directions(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by their largest part first, so that nothing overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def sign_keys(bits: int, tables: int):
    def keys(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        lengths = vectors.map(len).to_numpy()
        for n in np.unique(lengths):
            where = np.flatnonzero(lengths == n)
            signs = directions(np.stack(vectors.iloc[where].to_list())) @ planes(int(n), bits, tables) > 0
            numbers = signs.reshape(len(where), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            for i, row in zip(where.tolist(), numbers, strict=True):
                out[i] = row
        return pd.Series(out, dtype=object)
    return F.pandas_udf(keys, T.ArrayType(T.LongType()))


def link_tile(threshold: float):
    """One bucket, or two tiles of it. Each pair is counted in the first table in which it shares a bucket, and in one
    pair of tiles; links are told as stars."""
    def work(group: pa.Table) -> pa.Table:
        take = lambda c: group[c].combine_chunks()
        n = group.num_rows
        if n < 2:
            return pa.table({"c": pa.array([], pa.string()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.string())})
        vectors = directions(take("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
        tables = take("keys").flatten().to_numpy().reshape(n, -1)
        names, sizes, tile = take("c"), take("members").to_numpy(), take("_tile").to_numpy()
        i, j, table = (group[k][0].as_py() for k in ("_i", "_j", "t"))
        linked = vectors @ vectors.T >= threshold
        np.fill_diagonal(linked, False)
        links = np.zeros(n, np.int64)
        for a in np.flatnonzero(linked.any(axis=1)):
            b = np.flatnonzero(linked[a])
            counted = ((tables[a] == tables[b]).argmax(axis=1) == table) & ((i == j) | (tile[a] != tile[b]))
            links[a] = sizes[b[counted]].sum()
        root = local_roots(n, lambda k, rest: linked[k, rest])
        some = np.flatnonzero(linked.any(axis=1))
        return pa.table({"c": names.take(pa.array(some)), "links": pa.array(links[some], pa.int64()), "root": names.take(pa.array(root[some]))})
    return work


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding",
                    label_column: str = "label", bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """`id, n_links, component_id, kept` of every row; no other column is read.

    Vectors of the same label and length are linked where their cosine, in double precision, is at least the threshold
    and they share a bucket in one of the tables. Equal vectors are one item of the comparison, all linked, whatever
    their number. Vectors that are null, empty, zero or hold null or non-finite parts, and rows without a label, link
    with nothing: their component is their own id. n_links counts rows; rows that repeat link with each other. The
    component of rows without an id is that of their group, null if no member has one. kept: id and component are
    equal. An empty table gives an empty result.
    """
    v = F.col("embedding")
    usable = F.coalesce(
        F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False))
    name = F.concat(F.hex(F.xxhash64("label", "embedding")), F.lit("."), F.hex(F.xxhash64(F.lit(1), "label", "embedding")))
    rows = vectors.select(F.col(id_column).alias("_id"), F.col(vector_column).alias("embedding"), F.col(label_column).alias("label")).withColumn(
        "c", F.when(usable, name))
    classes = store(
        rows.where(F.col("c").isNotNull()).groupBy("c").agg(
            F.first("embedding").alias("embedding"), F.first("label").alias("label"), F.min("_id").alias("_first"), F.count(F.lit(1)).alias("members"))
        .withColumn("keys", sign_keys(bits, tables)(v)), "classes")
    label = F.col("label") if dict(classes.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("label")
    buckets = classes.select("c", label.alias("l"), F.size("embedding").alias("d"), F.posexplode("keys").alias("t", "bucket"))
    tiles = tile_pairs(buckets, ["l", "d", "t", "bucket"], ["c"], TILE)
    told = store(each_group(
        tiles.join(classes.select("c", "embedding", "members", "keys"), "c"), ["l", "d", "t", "bucket", "_i", "_j"], link_tile(threshold),
        "c string, links long, root string"), "links")
    roots = components(told.select(F.col("c").alias("a"), F.col("root").alias("b")))
    links = told.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("c", "_first", "members").join(roots, F.col("c") == F.col("node"), "left").join(links, "c", "left").select(
        "c", "_first", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    lookup = named.join(least, "_root").select(F.col("c").alias("_c"), "n_links", "component_id")
    return rows.join(lookup, F.col("c") == F.col("_c"), "left").select(
        F.col("_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("_c").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col(id_column).eqNullSafe(F.col("component_id")))
