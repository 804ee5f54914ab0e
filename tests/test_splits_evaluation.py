import numpy as np
from pyspark.sql import functions as F

from assayer.operators import evaluate as ev
from assayer.operators import modelsearch as ms
from assayer.operators import split as sp


def test_split_sizes_order_and_checks(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 97 else "c") for i in range(101)], "id int, k string")
    one = {r.id: r.partition for r in sp.split(df, ["id"], "k").collect()}
    assert one == {r.id: r.partition for r in sp.split(df.orderBy(F.desc("id")).repartition(7), ["id"], "k").collect()}
    sizes = [list(one.values()).count(p) for p in sp.PARTS]
    assert sizes == [60, 20, 21]  # held out: ceil(40.4) = 41, of these test: ceil(20.5) = 21
    checks = {r.check: r.ok for r in sp.partition_checks(df, sp.split(df, ["id"], "k"), ["id"], "k").collect()}
    # With 20 validation rows a class can only come within 1/40 of its share, so prevalence is asserted where 0.02 is reachable.
    assert all(v for k, v in checks.items() if not k.startswith("prevalence") or k.startswith("prevalence in train"))
    counts = [(r.fold, r["count"]) for r in sp.folds(df, ["id"], 4).groupBy("fold").count().collect()]
    assert sorted(c for _, c in counts) == [25, 25, 25, 26]


def test_repeated_profiles_across(spark):
    df = spark.createDataFrame([(1, "x", "train"), (1, "y", "test"), (2, "x", "train"), (2, "x", "train"), (3, "z", "test")], "f int, t string, partition string")
    r = sp.repeated_across(df, ["f"], "t").collect()
    assert len(r) == 1 and (r[0].train, r[0].test, r[0].conflict) == (1, 1, True)


def _ap(y, p):
    out, seen = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        out, seen = out + (recall - seen) * y[hit].mean(), recall
    return out


def test_ranking_against_brute_force(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)] + [("only", 1, 0.5)], "model_id string, y int, p double")
    r = {x.model_id: x for x in ev.ranking_metrics(df, ["model_id"]).collect()}
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert abs(r["m"].roc_auc - np.mean(pairs)) < 1e-12 and abs(r["m"].average_precision - _ap(y, p)) < 1e-12
    assert r["only"].roc_auc is None
    sweep = ev.threshold_sweep(df.where("model_id = 'm'"), ["model_id"])
    for row in sweep.collect():
        hit = p >= row.threshold
        assert (row.tp, row.fp) == (int(y[hit].sum()), int((1 - y[hit]).sum()))
    s = {x.scenario: x for x in ev.threshold_scenarios(sweep, ["model_id"]).collect()}
    assert s["minimum_recall_0_80"].satisfied and s["minimum_recall_0_80"].recall >= 0.8
    assert s["maximum_f1"].f1 == max(x.f1 for x in sweep.collect())


def test_choice_ladders(spark):
    cols = "model_id string, average_precision double, dummy_average_precision double, brier double, log_loss double, cv_std double, cv_lower double, cv_upper double, roc_auc double, simplicity int"
    tie = [("a", .80, .3, .20, .5, .1, .7, .9, .8, 0), ("b", .79, .3, .15, .5, .1, .7, .9, .8, 1), ("c", .31, .3, .0, .0, .0, .3, .4, .9, 2)]
    r = ev.choose_binary(spark.createDataFrame(tie, cols), [], .05, .02).first()
    assert (r.selected, r.practical_tie, r.criterion, r.eligible) == ("b", True, "brier", 2)
    r = ev.choose_binary(spark.createDataFrame(tie, cols), [], .05, .001).first()
    assert (r.selected, r.practical_tie, r.criterion) == ("a", False, "average_precision")
    reg = spark.createDataFrame([("a", 1.0, 3.0, 1., 0., .5, 2.0), ("b", 1.01, 2.0, 1., 0., .5, 2.0), ("dummy", 2.0, 1.0, 1., 0., .5, 2.0)],
                                "model_id string, mae double, rmse double, median_error double, cv_std double, r2 double, dummy_mae double")
    out = {x.model_id: x for x in ev.choose_regression(reg, [], 0.05).collect()}
    assert out["b"].selected and not out["a"].selected and not out["dummy"].eligible


def test_calibration_and_outputs(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.1000001), (1, 1.0), (0, 0.0)], "y int, p double")
    bins = {r.bin: r["rows"] for r in ev.calibration(df, []).collect()}
    assert bins == {0: 2, 1: 1, 9: 1}
    m = spark.createDataFrame([([.2, .8],), ([.5, .6],)], "probs array<double>")
    out = ev.multiclass_output(m, ["a", "b"]).collect()
    assert [(r.label, r.valid) for r in out] == [("b", True), ("b", False)]


def test_profiles_seen_in_training_are_left_out(spark):
    train = spark.createDataFrame([(1, None)], "a int, b int")
    rows = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    assert ev.without_training_profiles(train, rows, ["a", "b"]).collect() == [(1, 2)]


def test_search_finds_the_informative_feature(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=120)
    df = spark.createDataFrame([(i, float(v), float(rng.normal()), float(v > 0)) for i, v in enumerate(x)], "id int, good double, bad double, y double")
    rows = sp.folds(df, ["id"], 2, "y")
    t = ms.ablation(rows, ms.Candidate("m", "logistic", ("good",), params={"maxIter": 5}), {"good": ["good"], "bad": ["bad"]}, "binary", 2)
    best = ms.cv_summary(t, "average_precision").where("rank = 1").first()
    assert best.model_id == "good" and best.cv_mean > 0.95
    assert len(ms.grid("t", "tree", ["good"], {"maxDepth": [1, 2, 3], "maxBins": [4, 8]}, sample=4)) == 4


def test_every_family_fits(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(v), "u" if v > 0 else "w", float(k), float(3 * v + rng.normal() / 10)) for i, (v, k) in enumerate(zip(rng.normal(size=90), np.arange(90) % 3))]
    df = spark.createDataFrame(rows, "id int, a double, c string, k double, v double")
    small = {"logistic": {"maxIter": 3}, "tree": {"maxDepth": 2}, "forest": {"numTrees": 3}, "boosting": {"maxIter": 2}, "ridge": {"regParam": 0.1}}
    size = lambda f: {"maxIter": 2} if f == "boosting" else small[f]
    binary = df.withColumn("y", (F.col("k") > 0).cast("double"))
    for f in ms.CLASSIFIERS:
        c = ms.Candidate(f, f, ("a", "v"), ("c",), size(f))
        p = ms.predict(ms.fit(binary, c, "binary"), binary, c, "binary", ["id"])
        assert p.where("p between 0 and 1").count() == 90
        p = ms.predict(ms.fit(df.withColumn("y", F.col("k")), c, "multiclass"), df.withColumn("y", F.col("k")), c, "multiclass", ["id"])
        assert {r.pred for r in p.collect()} <= {0.0, 1.0, 2.0}
    for f in ms.REGRESSORS:
        c = ms.Candidate(f, f, ("a",), (), size(f))
        p = ms.final_evaluation(df.where("id < 50").withColumn("y", F.col("v")), df.where("id between 50 and 69").withColumn("y", F.col("v")),
                                df.where("id >= 70").withColumn("y", F.col("v")), c, "regression")
        assert ev.regression_metrics(p, ["model_id"]).first().r2 > 0.5


def test_rows_of_few_groups_are_not_sorted_by_them(spark):
    from assayer import plans
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size Spark overestimates
    try:
        for q in ("l10_regression_metrics", "l12_target_extremes"):
            assert "SortMergeJoin" not in plans.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_fitted_linear_model_takes_no_table_along(spark):
    df = spark.createDataFrame([(float(i), float(i % 3 > 0)) for i in range(30)], "a double, y double")
    for kind, family in (("binary", "logistic"), ("regression", "ridge")):
        assert not ms.fit(df, ms.Candidate("m", family, ("a",)), kind).stages[-1].hasSummary


def test_a_scope_without_new_profiles_has_its_line(spark, tmp_path):
    from assayer import plans
    rows = [("A", s, 1.0, 0.1, 0.0, 1000.0 + i) for i in range(3) for s in "FO"]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_quantity double, l_discount double, l_tax double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = {r.scope: r for r in plans.QUERIES["l11_without_training_profiles"](spark, str(tmp_path)).collect()}
    assert out["all"].rows == 3 and out["new profiles"].rows == 0 and out["new profiles"].mae is None
