import math
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import modelsearch as ms


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(240):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("xyz")
        label = "high" if a + b > 0.8 else "mid" if a + b > -0.6 else "low"
        out.append((i, a, b, c, label, 3 * a - b + 1.0))
    return spark.createDataFrame(out, "id int, a double, b double, c string, label string, amount double")


def kept(df):
    return {r.id: r for r in df.collect()}


@pytest.mark.parametrize("family", ["logistic", "tree", "forest"])
def test_a_loaded_classifier_scores_as_the_fitted_one(spark, rows, tmp_path, family):
    c = ms.Candidate(family, family, ("a", "b"), ("c",))
    model = ms.fit_labelled(rows, c, "multiclass", "label")
    ms.save_model(model, f"{tmp_path}/m")
    again = ms.load_model(f"{tmp_path}/m")
    assert ms.class_order(again) == ms.class_order(model) == ["high", "low", "mid"]
    new = rows.drop("label", "amount")
    first, second = kept(ms.score(model, new, "multiclass", ["id"])), kept(ms.score(again, new, "multiclass", ["id"]))
    assert first == second and len(first) == 240
    assert all(r.valid and abs(sum(r.probs) - 1) < 1e-9 and r.label == ["high", "low", "mid"][r.probs.index(max(r.probs))] for r in second.values())
    truth = {r.id: r.label for r in rows.collect()}
    assert sum(truth[i] == r.label for i, r in second.items()) > 200
    with pytest.raises(Exception):  # noqa: B017 a model is not written over another
        ms.save_model(model, f"{tmp_path}/m")


def test_binary_threshold_and_class_order_come_from_the_model(spark, rows, tmp_path):
    two = rows.withColumn("label", F.when(F.col("label") == "high", "yes").otherwise("no"))
    ms.save_model(ms.fit_labelled(two, ms.Candidate("l", "logistic", ("a", "b")), "binary", "label"), f"{tmp_path}/m")
    model = ms.load_model(f"{tmp_path}/m")
    assert ms.class_order(model) == ["no", "yes"]
    for t in (0.2, 0.8):
        assert all(r.label == ("yes" if r.p >= t else "no") and r.valid for r in ms.score(model, two.drop("label"), "binary", ["id"], t).collect())


def test_regression_and_rows_that_cannot_be_scored(spark, rows, tmp_path):
    ms.save_model(ms.fit_labelled(rows, ms.Candidate("r", "ridge", ("a", "b"), ("c",)), "regression", "amount"), f"{tmp_path}/m")
    model = ms.load_model(f"{tmp_path}/m")
    odd = spark.createDataFrame([(1, 0.0, 0.0, "x"), (2, None, 0.0, "x"), (3, float("nan"), 1.0, "y"), (4, 1.0, float("inf"), None), (5, 1.0, 1.0, "new"), (6, 1.0, 1.0, None)],
                                "id int, a double, b double, c string")
    out = kept(ms.score(model, odd, "regression", ["id"], unit="eur"))
    assert {i: sorted(r.problems) for i, r in out.items()} == {1: [], 2: ["not_finite:a"], 3: ["not_finite:a"], 4: ["missing:c", "not_finite:b"], 5: ["unknown:c"], 6: ["missing:c"]}
    assert {i for i, r in out.items() if r.valid} == {1, 5} and all(out[i].pred is None for i in (2, 3, 4, 6)) and out[1].unit == "eur"
    assert math.isclose(out[1].pred, 1.0, abs_tol=0.05)
    assert ms.class_order(model) == [] and ms.score(model, odd.limit(0), "regression", ["id"]).count() == 0
    with pytest.raises(ValueError, match="missing"):
        ms.score(model, odd.drop("b"), "regression", ["id"])


def test_rows_without_a_label_are_not_learned_from(spark, rows):
    some = rows.withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")))
    c = ms.Candidate("t", "tree", ("a", "b"))
    assert ms.class_order(ms.fit_labelled(some, c, "multiclass", "label")) == ["high", "low", "mid"]
    assert ms.score(ms.fit_labelled(some, c, "multiclass", "label"), some, "multiclass", ["id"]).count() == 240
