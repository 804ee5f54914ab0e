import tempfile

import pytest
from pyspark.sql import functions as F

from assayer.operators import identity as idn
from assayer.operators import quality as q
from assayer.sources.tables import read_delimited


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_row_hash_is_canonical(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, -0.0, None), (1, 0.0, "-")], "a int, b double, c string")
    h = [r.h for r in df.select(idn.row_fingerprint(df).alias("h")).collect()]
    assert h[0] == h[1] != h[2]


def test_occurrence_keys_of_a_hot_copy(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(200)], "pos bigint, text string")
    out = idn.occurrence_keys(df.repartition(5), "pos", ["text"], width=16).orderBy("pos").collect()
    assert [r.ordinal for r in out if r.pos % 2] == list(range(100))
    assert all(r.ordinal == 0 for r in out if r.pos % 2 == 0)


def test_fingerprint_and_guarded_write(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert idn.table_fingerprint(df).first() == idn.table_fingerprint(df.orderBy(F.desc("k"))).first()
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    assert idn.write_once(df, path) == "new"
    assert idn.write_once(df.repartition(3), path) == "equivalent"
    assert idn.write_once(df.distinct(), path) == "divergent"
    assert spark.read.parquet(path).count() == 3


def test_diff_names_the_column(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, None)], "k int, v double, t string")
    b = spark.createDataFrame([(2, 2.5, "y"), (1, 1.0, "x"), (4, 3.0, None)], "k int, v double, t string")
    d = by(idn.table_diff(a, b, ["k"], tolerance=0.1), "column")
    assert (d["v"].differing, d["v"].max_abs_difference, d["t"].differing, d["v"].left_only, d["v"].right_only) == (1, 0.5, 0, 1, 1)
    assert idn.diff_verdict(idn.table_diff(a, b, ["k"], tolerance=0.1)).first().first_differing == "v"


def test_value_rules_count_a_row_once(spark):
    df = spark.createDataFrame([("c1", "No"), (None, "Yes"), (" ", " yes "), ("c4", "Maybe")], "id string, churn string")
    c = by(q.value_checks(df, {"id": q.ValueRule(), "churn": q.ValueRule(allowed=("No", "Yes")), "gone": q.ValueRule()}), "column")
    assert (c["id"].missing_count, c["id"].blank_count, c["id"].affected_count, c["id"].affected_percent) == (1, 1, 2, 50.0)
    assert (c["churn"].inconsistent_count, c["churn"].invalid_count, c["churn"].issue_types) == (1, 1, "Inconsistent text, Unexpected value")
    assert c["gone"].status == "Missing column"


def test_issue_samples_are_ranked(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)] * 2 + [(None,)], "x string")
    s = q.issue_samples(df, {"x": q.ValueRule(allowed=("z",))}, top=2).orderBy("issue", "rank").collect()
    assert [(r.issue, r.value, r["count"]) for r in s] == [("Missing value", "(missing)", 1), ("Unexpected value", "a", 3), ("Unexpected value", "b", 2)]


def test_duplicates_and_profiles(spark):
    df = spark.createDataFrame([("c1", 1, "A", "No"), ("c1", 1, "A", "No"), ("c2", 5, "B", "No"), ("c2", 6, "B", "No"), ("c3", 1, "A", None)],
                               "id string, tenure int, contract string, churn string")
    s = by(q.duplicate_summary(df, ["id"], ["tenure", "contract"], "churn"), "metric")
    assert (s["exact rows"].groups, s["exact rows"].rows) == (1, 2)
    assert (s["repeated identifiers"].groups, s["conflicting identifiers"].groups) == (2, 1)
    assert (s["repeated profiles"].groups, s["target conflicts"].groups, s["target conflicts"].rows) == (1, 1, 3)


def test_contract_violations_and_gate(spark):
    df = spark.createDataFrame([("1", "a"), ("1.5", "z"), (None, " "), ("x", "a")], "n string, t string")
    v = {r.n: r.violations for r in q.contract_violations(df, {"n": q.Expected("integer", minimum=0), "t": q.Expected("text", allowed=("a",))}).collect()}
    assert v == {"1": [], "1.5": ["fraction:n", "unknown:t"], None: ["blank:t", "null:n"], "x": ["type:n"]}
    checks = spark.createDataFrame([("one", True, ""), ("two", False, "3")], "check string, ok boolean, detail string")
    assert [r.check for r in q.failed(checks).collect()] == ["two"]
    with pytest.raises(Exception, match="check failed: two 3"):
        q.failed(checks, strict=True).collect()


def test_strict_blank_materialisation(spark):
    df = spark.createDataFrame([(" ", 0), ("7.5", 3)], "total string, tenure int")
    assert [r.total for r in q.materialize_blanks(df, "total", "tenure", 0, 0.0, strict=True).collect()] == [0.0, 7.5]
    with pytest.raises(Exception, match="blank or unreadable"):
        q.materialize_blanks(df, "total", "tenure", 1, 0.0, strict=True).collect()


def test_encoding_of_unseen_level(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "x double, c string")
    rows = spark.createDataFrame([(5.0, "zz")], "x double, c string")
    r = q.encode(rows, q.fit_encoding(train, ["x"]), [], ["x"], q.fit_levels(train, ["c"])).first()
    assert (r["x_z"], r["c=a"], r["c=b"]) == (3.0, 0, 0)
    assert [(u.level, u.rows) for u in q.unknown_levels(train, rows, ["c"]).collect()] == [("zz", 1)]


def test_declared_types_and_reader(spark):
    df = spark.createDataFrame([(1, "a")], "n bigint, s string")
    assert [(c, s) for c, _, _, s in q.declared_types(df, {"n": ["numeric"], "s": ["integer"], "z": ["any"]})] == [
        ("n", "Match"), ("s", "Mismatch"), ("z", "Missing column")]
    path = tempfile.mkdtemp(prefix="spark-") + "/csv"
    df.write.option("header", True).csv(path)
    assert read_delimited(spark, path, {"n": "integer", "s": "string"}).collect() == df.collect()


def test_findings_roll_up(spark):
    e = spark.createDataFrame([("t", "leakage", 1, "f"), ("t", "value_quality", 0, "a"), ("t", "value_quality", 2, "b")],
                              "table_name string, kind string, affected bigint, fields string")
    f = by(q.consolidate_findings(e), "kind")
    assert (f["leakage"].finding_id, f["leakage"].severity, f["value_quality"].affected_fields) == ("DQ-006", "Critical", "b")
    r = q.readiness(q.consolidate_findings(e)).first()
    assert (r.critical, r.high, r.ready_for_preparation, r.ready_for_modeling) == (1, 1, False, False)
