"""Rules that equal results of query and SQL do not show: small frames with known answers."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import running, scale_bucket
from assayer.operators import evaluate, forecast, identity, leakage, quality, series, structure, target


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_rates_are_those_of_all_target_rows(spark):
    rows = [(1.0, "a", "1"), (2.0, "a", "0"), (3.0, "b", "0"), (4.0, "b", "0"), (None, None, "1"), (None, None, "1")]
    df = spark.createDataFrame(rows, "x double, c string, y string")
    assert {r.overall_rate for r in target.quantile_bins(df, ["x"], "y", "1", 2).collect()} == {0.5}
    rates = by(target.category_rates(df, ["c"], "y", "1"), "category")
    assert rates["a"].overall_rate == 0.5 and rates["a"].lift == 1.0 and rates["b"].rate == 0
    assert target.category_association(df, ["c"], "y", "1").first().weighted_rate_difference == pytest.approx(0.25)


def test_bins_without_rows_stay(spark):
    df = spark.createDataFrame([(float(x), "1") for x in (-1, 0, 0, 0, 0, 0, 10, 11, 12)], "x double, y string")
    out = by(target.quantile_bins(df, ["x"], "y", "1", 3), "bin")
    assert sum(r.row_count for r in out.values()) == 9 and sorted(out) == list(range(1, len(out) + 1))
    assert all((r.rate is None) == (r.row_count == 0) for r in out.values())


def test_constant_features_give_no_bins(spark):
    df = spark.createDataFrame([(1.0, "1"), (1.0, "0")], "x double, y string")
    assert target.quantile_bins(df, ["x"], "y", "1").collect() == []
    assert target.binary_numeric(df, ["x"], "y", "1").first().rate_spread is None


def test_two_points_are_no_proxy(spark):
    fields = {"two": [3.0, 5.0, None, None], "values": [1.0, 2.0, 2.0, 1.0], "line": [3.0, 5.0, 7.0, 3.0]}
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 1.0], *fields.values(), strict=True)), "t double, two double, values double, line double")
    out = by(leakage.affine_proxies(df, list(fields), "t"), "field")
    assert out["two"].method == "None" and out["line"].method == "Affine numeric target transform"
    only = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)], "t double, c double")
    assert leakage.affine_proxies(only, ["c"], "t").first().method == "None"


def months(spark, values):
    start = dt.date(2000, 1, 1)
    rows = [("s", dt.date(start.year + t // 12, t % 12 + 1, 1), t, float(y)) for t, y in values]
    return spark.createDataFrame(rows, "series_id string, period date, t long, y double")


def test_a_gap_moves_no_cut_and_no_lag(spark):
    s = months(spark, [(t, t) for t in range(72) if t not in (7, 20, 33)])
    folds = forecast.expanding_folds(s, 24, 12, 12)
    assert sorted(r.cut for r in folds.collect()) == [24, 36, 48, 60]
    assert {r.mase_scale for r in forecast.mase_scale(s, folds).collect()} == {12.0}
    seasonal = [r.x for r in series.differenced(s).where("variant = 'ds'").collect()]
    assert set(seasonal) == {12.0}
    scoped = series.temporal_scopes(s, 12)
    assert forecast.holdout_metrics(scoped).first().mase_scale == 12.0


def test_baselines_block_selection_and_absent_candidates_are_listed(spark):
    metric = ("pooled_mae", "pooled_rmse", "pooled_mase", "fold_mae_std", "long_horizon_mae")
    rows = [(s, c, *[1.0] * 5) for s, cs in (("a", ("seasonal_naive_12", "naive_last_value", "x")), ("b", ("naive_last_value", "x"))) for c in cs]
    out = forecast.select_candidate(spark.createDataFrame(rows, "series_id string, candidate_id string, " + ", ".join(f"{m} double" for m in metric)), 0.05)
    assert {r.series_id for r in out.collect()} == {"a"}
    folds = spark.createDataFrame([("a", 1), ("b", 1)], "series_id string, fold int")
    ev = spark.createDataFrame([("a", c, 1, 0.0) for c in ("seasonal_naive_12", "naive_last_value")] + [("b", "naive_last_value", 1, 0.0)],
                               "series_id string, candidate_id string, fold int, y_pred double")
    audit = by(forecast.fold_audit(ev, folds, 1, ["seasonal_naive_12", "naive_last_value", "none"]), "series_id", "candidate_id")
    assert len(audit) == 6 and not audit["a", "none"].eligible and not audit["a", "none"].blocked and audit["b", "naive_last_value"].blocked


def test_lost_added_and_repeated_rows_fail_the_audit(spark):
    raw = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    one = quality.change_audit(raw, raw.limit(1), ["k"], []).first()
    assert (one.row_count, one.lost, one.changed, one.ok) == (1, 2, 0, False)
    assert quality.change_audit(raw, raw, ["k"], []).first().ok
    twice = quality.change_audit(raw, raw.union(raw.where("k = 1")), ["k"], []).first()
    assert twice.repeated == 1 and not twice.ok
    added = quality.change_audit(raw.where("k = 1"), raw, ["k"], []).first()
    assert added.added == 2 and not added.ok


def test_diff_reports_repeated_keys_other_columns_and_infinite_numbers(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    right = spark.createDataFrame([(1, float("nan")), (2, 2.5), (2, 2.5)], "k int, v double").withColumn("note", F.lit(""))
    r = identity.table_diff(left, right, ["k"], tolerance=1.0).first()
    assert (r.repeated_keys, r.other_columns, r.non_finite, r.max_abs_difference, r.differing) == (1, 1, 1, 0.5, 1)
    assert not identity.diff_verdict(identity.table_diff(left, left.withColumn("note", F.lit("")), ["k"])).first().equivalent
    assert identity.diff_verdict(identity.table_diff(left, left, ["k"])).first().equivalent


def test_undeclared_labels_and_vectors_are_refused(spark):
    df = spark.createDataFrame([("a", "a", [0.9, 0.1]), ("b", "b", [0.2, 0.8]), ("a", "z", [0.3, 0.1])], "y string, pred string, probs array<double>")
    m = evaluate.multiclass_metrics(evaluate.confusion(df, [], ["a", "b"]), []).first()
    assert (m.rows, m.undeclared, m.accuracy) == (2, 1, None)
    loss = evaluate.multiclass_log_loss(df, [], ["a", "b"]).first()
    assert (loss.invalid_rows, loss.log_loss) == (1, None)
    fine = evaluate.multiclass_log_loss(df.limit(2), [], ["a", "b"]).first()
    assert fine.invalid_rows == 0 and fine.log_loss == pytest.approx(-(math.log(0.9) + math.log(0.8)) / 2)


def test_a_feature_without_spread_is_an_issue(spark):
    rows = [(float(i), float(i == 0), "AB"[i % 2]) for i in range(20)]
    p = structure.class_profiles(spark.createDataFrame(rows, "x double, flat double, c string"), ["x", "flat"], "c")
    assert {r.feature: r.issue for r in p.collect()} == {"x": None, "flat": "Zero interquartile range"}
    o = structure.class_overlap(p).first()
    assert (o.features, o.blocked_features) == (1, 1)


def test_contract_sees_blank_keys_missing_and_absent_categories_and_types(spark):
    df = spark.createDataFrame([(" ", None, "yes", "12"), ("k", "x", "no", "twelve")], "id string, cat string, y string, n string")
    out = by(quality.dataset_contract(df, ["id", "cat", "y", "n"], ["id"], "y", ["yes", "no"], {"cat": ["x", "w"]},
                                      {"id": "string", "n": "numeric", "y": "integer"}, numeric_text=["n"]), "check")
    bad = {k for k, r in out.items() if not r.ok}
    assert bad == {"identifier not blank", "categories of cat present", "categories of cat observed", "column types", "numeric text"}


def test_clean_outcomes_have_their_own_ids(spark):
    kinds = ["type_or_domain", "value_quality", "identity", "exact_rows", "target_conflict", "target_contract", "class_support", "outliers", "leakage", "dependency"]
    clean = by(quality.consolidate_findings(spark.createDataFrame([("t", k, 0, "f") for k in kinds], "table_name string, kind string, affected long, fields string")), "kind")
    assert {k: (r.finding_id, r.disposition) for k, r in clean.items()} == {
        "type_or_domain": ("NI-001", "No action"), "value_quality": ("NI-002", "No action"), "identity": ("NI-003", "Preserve"), "exact_rows": ("NI-003", "Preserve"),
        "target_contract": ("NI-004", "No action"), "class_support": ("NI-005", "Monitor"), "outliers": ("NI-006", "No action"), "leakage": ("NI-007", "No action"),
        "dependency": ("NI-008", "Monitor")}
    found = by(quality.consolidate_findings(spark.createDataFrame([("t", k, 3, "f") for k in kinds], "table_name string, kind string, affected long, fields string")), "kind")
    assert found["outliers"].severity == "None" and found["outliers"].disposition == "Preserve" and found["target_conflict"].finding_id == "DQ-004"
    assert found["leakage"].blocks == "Modeling clearance" and found["class_support"].status == "Validated"


def test_unseen_groups_get_the_overall_prior(spark):
    df = spark.createDataFrame([("en", 0, 1), ("en", 1, 0), ("en", 1, 1), ("xx", 0, 1)], "lang string, fold int, y int")
    out = {(r.lang, r.fold, r.y): r.p for r in evaluate.prior_by_fold(df, ["lang"]).collect()}
    assert out[("xx", 0, 1)] == 0.5 and out[("en", 0, 1)] == 0.5 and out[("en", 1, 0)] == 1.0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_values_of_all_sizes(spark, descending):
    rng = random.Random(6)
    values = sorted({0.0, float("inf"), float("-inf"), 1e-300, -1e-300, *[rng.choice([-1, 1]) * 10 ** rng.uniform(-20, 20) for _ in range(300)], *[1 + i * 1e-9 for i in range(50)]})
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "o double, v long").repartition(7)
    buckets = [r.b for r in df.orderBy("o").select(scale_bucket(F.col("o")).alias("b")).collect()]
    assert buckets == sorted(buckets)
    got = {r.o: r.run_v for r in running(df, [], "o", ["v"], descending).collect()}
    total = 0
    for v, i in sorted(((v, i) for i, v in enumerate(values)), reverse=descending):
        total += i
        assert got[v] == total


def test_no_nested_loop_without_groups(spark):
    scored = spark.createDataFrame([(0.1, 0), (0.7, 1), (0.7, 0)], "p double, y int")
    curve = evaluate.score_curve(scored, [])
    assert len(curve.collect()) == 2
