import pytest
from pyspark.sql import functions as F

from assayer.operators import quality as q

RULES = {"amount": q.ValueRule(numeric=True, minimum=0), "flag": q.ValueRule(allowed=("A", "B")), "absent": q.ValueRule()}
ROWS = [(1, " 5 ", "A"), (2, "-1", "b"), (3, None, "X"), (4, "", None), (5, "n/a", "B")]
SCHEMA = "id int, amount string, flag string"


def told(df):
    return sorted(map(tuple, df.collect()))


def test_report_is_that_of_the_checks_and_rows_are_written_as_they_are(spark, tmp_path):
    df = spark.createDataFrame(ROWS * 50, SCHEMA).repartition(4)
    report = q.write_checked(df, f"{tmp_path}/t", RULES)
    assert told(report) == told(q.value_checks(df, RULES)) == told(spark.read.parquet(f"{tmp_path}/t-checks"))
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.schema.names == df.schema.names and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_rows_pass_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(ROWS * 20, SCHEMA).mapInArrow(count, SCHEMA)
    q.write_checked(df, f"{tmp_path}/t", RULES)
    assert seen.value == 100


def test_strict_gate_keeps_what_was_written_and_tells_why(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(q.CheckFailed, match="absent, amount, flag") as e:
        q.write_checked(df, f"{tmp_path}/bad", RULES, strict=True)
    assert e.value.report.where("status = 'Review required'").count() == 2 and spark.read.parquet(f"{tmp_path}/bad").count() == 5
    good = df.where("id in (1, 5)").withColumn("amount", F.lit("7"))
    q.write_checked(good, f"{tmp_path}/good", {c: RULES[c] for c in ("amount", "flag")}, strict=True)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2
    with pytest.raises(Exception, match="exist"):
        q.write_checked(good, f"{tmp_path}/good", RULES)


def test_empty_table_and_table_without_ruled_columns(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert told(q.write_checked(df.limit(0), f"{tmp_path}/e", RULES)) == told(q.value_checks(df.limit(0), RULES))
    assert {r.status for r in q.write_checked(df.select("id"), f"{tmp_path}/n", RULES).collect()} == {"Missing column"}
