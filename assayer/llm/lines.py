"""Line dedup: drop lines that many documents share, keep the first document's copy, reassemble the rest by position."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import store

# Fixed value: the characters stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; `lower` does just that where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def drop_shared_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = 10,
                      documents: int = 2) -> DataFrame:
    """The id of every row of docs and `n_lines, n_dropped, kept_text`; no other column of docs is read.

    A text is split at line feeds. The key of a line is the line with white space stripped and A-Z in lower case. Keys
    of at least `least_chars` code points that occur in at least `documents` documents are dropped everywhere but in
    the document with the smallest id. Null and empty texts have one empty line and a kept text of "". Rows with the
    same id are one document; rows without an id are one document that comes after all others. Line hashes have 128
    bits. The keys go through one stored table without text; a key that all documents share is one combined count. The
    shared keys are stored too: both sides of the join back are then plain shuffles, whose hot keys adaptive execution
    can split.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text")).withColumn(
        "_th", F.xxhash64("_text"))
    key = F.btrim(ascii_lower(F.col("_line")), F.lit(SPACE))
    lines = store(
        rows.select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")).select("_id", "_th", "_pos", key.alias("_key"))
        .where(F.char_length("_key") >= least_chars)
        .select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2")), "lines")
    holders = lines.select("_h1", "_h2", "_id").distinct()
    shared = store(holders.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.min("_id").alias("_first")).where(F.col("_docs") >= documents), "shared")
    goes = (
        lines.join(shared, ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_drop")).withColumnsRenamed({"_id": "_kid", "_th": "_kth"}))
    joined = rows.join(goes, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_th") == F.col("_kth")), "left").select(
        "_id", "_text", F.split("_text", "\n").alias("_lines"), F.coalesce("_drop", F.array().cast("array<int>")).alias("_drop"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n")
    return joined.select(
        F.col("_id").alias(id_column), F.size("_lines").cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"),
        F.when(F.size("_drop") == 0, F.col("_text")).otherwise(kept).alias("kept_text"))
