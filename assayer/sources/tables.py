"""Reading tables with declared columns."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Source metadata types and the Spark type each one is read as.
SOURCE_TYPES = {
    "integer": T.LongType(), "continuous": T.DoubleType(), "real": T.DoubleType(), "numeric": T.DoubleType(),
    "categorical": T.StringType(), "binary": T.StringType(), "string": T.StringType(),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def schema_of(columns: Mapping[str, str | T.DataType]) -> T.StructType:
    """Schema from column name -> Spark type, DDL type name or source metadata type, in declared order."""
    fields = []
    for name, kind in columns.items():
        if isinstance(kind, str):
            kind = SOURCE_TYPES.get(kind) or T.DataType.fromDDL(kind)
        fields.append(T.StructField(name, kind, True))
    if len({f.name for f in fields}) != len(fields):
        raise ValueError("column names must be unique")
    return T.StructType(fields)


def read_delimited(spark: SparkSession, path: str, columns: Mapping[str, str | T.DataType], sep: str = ",",
                   header: bool = True, strict: bool = True) -> DataFrame:
    """A delimited table with declared columns; no inference pass. Strict mode fails on malformed rows."""
    return (
        spark.read.schema(schema_of(columns)).option("header", header).option("sep", sep)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", not header)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_with_rejects(spark: SparkSession, path: str, columns: Mapping[str, str | T.DataType], sep: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of delimited files that fit the declared columns, and those that do not: `file, record, line, reason`.

    A line that has too many or too few fields, or a field that is not of its type, is kept as it stands, with the file
    and the number of its record there (from 1; head and empty lines do not count). reason: `fields` or `type`. Empty
    fields are NULL and fit; a quote inside quotes is doubled. The files are read once, into a stored table that both results come from; numbers are
    those of the splits that a file is read in, after the records of its earlier splits.

    No file at the path is an error; files without lines have no rows of either kind.
    """
    schema = schema_of(columns)
    corrupt = "_corrupt_line"
    if corrupt in schema.names or "_place" in schema.names:
        raise ValueError("column names that the reader uses itself")
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType(), True)])
    # without column pruning a line is parsed as a whole, whatever columns are asked for
    read = spark.read.schema(wide).options(header=header, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt, columnPruning=False, enforceSchema=True, escape='"',
                                           ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    placed = stored(read.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("_place")), "delimited")
    by_block = placed.groupBy(F.col("_place.file").alias("_f"), F.col("_place.start").alias("_s")).agg(F.min("_place.n").alias("_first"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_block.select("_f", "_s", (F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_first")).alias("_o"))
    bad = placed.where(F.col(corrupt).isNotNull()).join(offsets, (F.col("_place.file") == F.col("_f")) & (F.col("_place.start") == F.col("_s")))
    # fields of the line as the reader parts it, quotes included
    fields = F.size(F.split(F.regexp_replace(corrupt, r'"(?:[^"]|"")*"', ""), "\\Q" + sep + "\\E"))
    rejects = bad.select(F.col("_f").alias("file"), (F.col("_place.n") + F.col("_o") + 1).alias("record"), F.col(corrupt).alias("line"),
                         F.when(fields != len(schema), "fields").otherwise("type").alias("reason"))
    return placed.where(F.col(corrupt).isNull()).select(*schema.names), rejects


def parse_delimited(lines: DataFrame, column: str, columns: Mapping[str, str | T.DataType], sep: str = ",", strict: bool = True) -> DataFrame:
    """The declared columns of delimited texts that are rows already. Strict mode fails on malformed ones."""
    schema = schema_of(columns)
    options = {"sep": sep, "mode": "FAILFAST" if strict else "PERMISSIVE"}
    return lines.select(F.from_csv(column, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), options).alias("_r")).select("_r.*")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A variable table `name, role, type, description, units`, one row per source column."""
    return read_delimited(
        spark, path, {c: "string" for c in ("name", "role", "type", "description", "units")})


def reject_duplicate_names(df: DataFrame) -> DataFrame:
    repeated = {c for c in df.columns if df.columns.count(c) > 1}
    if repeated:
        raise ValueError(f"column names must be unique: {sorted(repeated)}")
    return df


def work_folder(spark: SparkSession) -> str:
    """The shared folder of the session for tables that a query writes: that for checkpoints, else the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def stored(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """The rows written below `work_folder` and read back: what follows starts from files (of `most` rows, 0: any number), whatever executor is lost."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("maxRecordsPerFile", most) if most else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
