"""The contract check and scoring run as a stream over the event files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer.operators import evaluate as ev
from assayer.operators.quality import Expected
from assayer.plans.registry import query
from assayer.sources.tables import table, work_folder
from assayer.streaming import contract_stream, run_to_table

CONTRACT = {"user_id": Expected("integer", minimum=1), "event_type": Expected("text", allowed=("click", "view", "purchase")),
            "value": Expected("number", minimum=0, maximum=100)}


@query("b07_scored_stream", """
WITH v AS (SELECT *, array_to_string(list_filter([CASE WHEN value > 100 THEN 'above:value' END, CASE WHEN user_id < 1 THEN 'below:user_id' END, CASE WHEN value < 0 THEN 'below:value' END,
 CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown:event_type' END], lambda e: e IS NOT NULL), ',') AS violations, least(1.0, value / 100) AS p FROM events)
SELECT violations, violations = '' AS accepted, CASE WHEN p >= 0 THEN CASE WHEN p >= 0.5 THEN 'high' ELSE 'low' END END AS label, count(*) AS rows FROM v GROUP BY 1, 2, 3""")
def _(spark, sf):
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    score = lambda df: ev.binary_output(df.withColumn("p", F.least(F.lit(1.0), F.col("value") / 100)), 0.5, "high", "low")
    stream = contract_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet", CONTRACT, score)
    out = run_to_table(stream, f"{folder}/rows", f"{folder}/state")
    return out.groupBy(F.concat_ws(",", "violations").alias("violations"), "accepted", "label").agg(F.count(F.lit(1)).alias("rows"))
