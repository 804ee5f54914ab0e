"""A training corpus from documents: language known, near-duplicates and benchmark text removed, sources mixed, shards cut.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and hands what it reads back
to the next stage. All stages but the last return the columns they are given, whatever else these hold. Rows without a
doc_id share the decision of their group, as do rows that repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm import decontaminate, language, mixing, paragraphs, shards, simhash
from assayer.llm.shared import store
from assayer.sources import table


LEAST_SCORE = 0.4  # of the most probable language


def same_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the ids `_id`; no id equals no id.

    The ids grow with the documents, so both sides are shuffled at every size.
    """
    return docs.join(ids.hint("merge"), ids["_id"].eqNullSafe(docs["doc_id"]), how)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose most probable language is hardly more probable than others.

    The answer is a column of the row itself: nothing is shuffled.
    """
    found = language.answer(language.train(docs), docs["text"])
    return docs.where((found["lang"] != language.UNDETERMINED) & (found["score"] >= LEAST_SCORE))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Of rows that share this id one stays. Groups without any id cannot be told apart and stay.
    """
    found = simhash.near_duplicates(docs, radius=2)
    kept = store(found.where(F.col("doc_id").eqNullSafe(F.col("component"))).groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("_rows")), "kept")
    single = same_ids(docs, kept.where("_rows = 1 or _id is null"), "left_semi")
    repeated = same_ids(docs, kept.where("_rows > 1 and _id is not null"), "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id"]))


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group whose five-word shingles have Jaccard similarity 0.8 or more stays: the one with the smallest id."""
    gone = paragraphs.near_copies(docs, threshold=0.8).select(F.col("id").alias("_id"), F.col("th").alias("_th")).hint("merge")
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, gone["_id"].eqNullSafe(docs["doc_id"]) & (gone["_th"] == hashed), "left_anti")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two bits of a fingerprint are close to exact copies only: of those that stay, the texts are compared by their shingles."""
    return first_of_near_copies(spark, store(first_of_near_duplicates(spark, docs, sf_dir), "near"), sf_dir)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item as a whole, go.

    The text alone decides: rows that share the id of such a document, or have none, stay if their own text is clean.
    """
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    texts = docs.select(hashed.alias("_text"), "text")
    found = decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark"), window=10, id_column="_text")
    gone = found.where(F.size("item_ids") > 0).select("_text").distinct().hint("merge")
    return docs.join(gone, gone["_text"] == hashed, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    The keys of the join hold no null, so the places of rows that repeat are found without another shuffle.
    """
    def keys(doc_id: Column, text_hash: Column, source: Column) -> list[Column]:
        return [F.coalesce(doc_id, F.lit(0)).alias("_k1"), doc_id.isNull().alias("_k2"), text_hash.alias("_k3"), F.coalesce(source, F.lit("")).alias("_k4"),
                source.isNull().alias("_k5")]

    names = [f"_k{i}" for i in range(1, 6)]
    taken = mixing.mix(docs).select(*keys(F.col("doc_id"), F.col("text_hash"), F.col("source")), "copies").groupBy(*names).agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0")
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *keys(docs["doc_id"], hashed, docs["source"]))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1)))
    copies = F.expr("_copies div _rows") + (F.col("_place") <= F.expr("_copies % _rows")).cast("long")
    often = rows.join(taken, names).withColumn("_place", place).withColumn("_n", copies).where("_n > 0")
    return often.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard, slot, size and checksum of every row."""
    return shards.shard(docs, shards=16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("simhash", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Fingerprints and trained classifiers cannot be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
