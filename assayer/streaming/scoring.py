"""Contract checks and scoring on a stream. Both are stateless projections, so the batch operators apply unchanged."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.quality import Expected, contract_violations


def contract_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str,
                    contract: Mapping[str, Expected], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Files of a folder as a stream, each row with its violations and, if it has none, its score."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    checked = contract_violations(rows, contract)
    return score(checked).withColumn("accepted", F.size("violations") == 0)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there and stop; the checkpoint makes a rerun append nothing twice."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
