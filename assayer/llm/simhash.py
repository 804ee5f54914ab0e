"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared exactly in tiles by exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.shared import components, each_group, local_roots, store, tile_pairs

# Fixed value: the seed of the shingle hash.
SEED = 42
TILE = 4096  # fingerprints; a task compares at most two tiles
BLOCK = 256  # rows compared at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set where over half of the shingles' hashes have it set.

    A-Z count as a-z, words are parted by ASCII white space, repeated shingles count as often. A text of fewer words is
    one shingle; one without words has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def linked_pairs(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius, block by block. The values are sorted by bit count; a block meets only
    the values whose bit counts are within the radius of its own."""
    count = np.bitwise_count(values).astype(np.int64)
    for first in range(0, len(values), BLOCK):
        block = values[first:first + BLOCK]
        low = np.searchsorted(count, count[first] - radius, "left")
        high = np.searchsorted(count, count[min(first + BLOCK, len(values)) - 1] + radius, "right")
        near = np.bitwise_count(block[:, None] ^ values[None, low:high]) <= radius
        i, j = np.nonzero(near)
        yield i + first, j + low


def star_links(radius: int):
    def step(table: pa.Table) -> pa.Table:
        values = np.unique(table["fp"].to_numpy().view(np.uint64))
        values = values[np.argsort(np.bitwise_count(values), kind="stable")]
        partner = np.zeros(len(values), bool)
        for i, j in linked_pairs(values, radius):
            partner[i[i != j]] = True
        values = values[partner]
        root = local_roots(len(values), lambda k, rest: np.bitwise_count(values[k] ^ values[rest]) <= radius)
        a, b = values.view(np.int64), values[root].view(np.int64) if len(values) else values.view(np.int64)
        return pa.table({"a": a[a != b], "b": b[a != b]})
    return step


def bit_groups(radius: int) -> list[tuple[int, int]]:
    """radius + 1 runs of the 16 four-bit parts, as even as possible: (first part, number of parts)."""
    cuts = [round(16 * i / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links `a, b` that connect all pairs of the distinct fingerprints `fp` with at most `radius` differing bits.

    The bits are cut into radius + 1 groups of four-bit parts. Tiles are made by the bit counts of the parts of one
    group; two tiles that differ in some count of every group are skipped, as their values differ in a bit of each
    group, hence beyond the radius. All other pairs meet and are compared exactly. A tile with very many values is cut
    on, and its parts meet in pairs. A task tells the components among its values as stars, not as all pairs.
    """
    def counts(first: int, parts: int):
        out = F.lit(0)
        for k in range(first, first + parts):
            out = out * 5 + F.bit_count(F.shiftrightunsigned("fp", 4 * k).bitwiseAND(F.lit(15))).cast("int")
        return out
    keys = F.array(*[F.struct(F.lit(g).alias("g"), counts(*run).alias("key")) for g, run in enumerate(bit_groups(radius))])
    rows = prints.select("fp", F.inline(keys))
    tiles = tile_pairs(rows, ["g", "key"], ["fp"], TILE)
    return each_group(tiles.select("g", "key", "_i", "_j", "fp"), ["g", "key", "_i", "_j"], star_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id, fp, component` of every row: the smallest id that can be reached by links of at most `radius` bits.

    Equal fingerprints are one item of the comparison, whatever their number. Null and empty texts have fingerprint
    zero and link like any other. Rows without an id belong to the component of their fingerprint, null if no member of
    it has an id. Rows that repeat give rows that repeat. An empty table gives an empty result.
    """
    prints = store(docs.select(F.col(id_column).alias("_id"), fingerprints(F.col(text_column)).alias("fp")), "fingerprints")
    classes = store(prints.groupBy("fp").agg(F.min("_id").alias("_first")), "classes")
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_first", F.coalesce("component", "fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_first").alias("component"))
    lookup = named.join(least, "_root").select(F.col("fp").alias("_fp"), "component")
    return prints.join(lookup, F.col("fp") == F.col("_fp")).select(F.col("_id").alias(id_column), "fp", "component")


def hexed(fp):
    """16 lower-case hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
