import math
import random

import pytest

from assayer.operators import evaluate as ev
from assayer.operators import rollup as ru

LEVELS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([1, 2, None]), rng.randint(0, 1), rng.random(), rng.choice("pqr"), rng.choice("pqr"), rng.gauss(5, 2), rng.gauss(5, 2)) for _ in range(400)]
    return spark.createDataFrame(out, "a string, b int, y int, p double, truth string, called string, t double, e double").repartition(4)


def segments(df):
    """Rows of each segment by grouping and values of the levels, from plain filters."""
    data = df.collect()
    for g, keep in ((0, 2), (1, 1), (3, 0)):
        for key in {(r.a, r.b)[:keep] for r in data}:
            yield (g, *key, *[None] * (2 - keep)), [r for r in data if (r.a, r.b)[:keep] == key]


def close(got, want):
    assert set(got) >= set(want) and all(math.isclose(got[k], v, abs_tol=1e-7) if isinstance(v, float) else got[k] == v for k, v in want.items()), (got, want)


def keyed(out):
    rows = [r.asDict() for r in out.collect()]
    found = {(r["grouping"], r["a"], r["b"]): r for r in rows}
    assert len(found) == len(rows)
    return found


def test_binary_segments_equal_separate_runs(spark, rows):
    got = keyed(ru.binary_rollup(rows, LEVELS, 0.4))
    want = dict(segments(rows))
    assert set(got) == set(want)
    for key, part in want.items():
        alone = ev.threshold_metrics(spark.createDataFrame([(1, r.y, r.p) for r in part], "g int, y int, p double"), ["g"], 0.4).first().asDict() if key[0] else None
        counts = {"rows": len(part), "tp": sum(r.p >= 0.4 and r.y == 1 for r in part), "fn": sum(r.p < 0.4 and r.y == 1 for r in part)}
        close(got[key], {**counts, **({k: alone[k] for k in ("precision", "recall", "f1", "f2", "balanced_accuracy", "accuracy")} if alone else {})})


def test_regression_segments_equal_separate_runs(spark, rows):
    got = keyed(ru.regression_rollup(rows, LEVELS, "t", "e"))
    for key, part in segments(rows):
        n = len(part)
        err, mean = [r.e - r.t for r in part], sum(r.t for r in part) / n
        sse, sst = sum(x * x for x in err), sum((r.t - mean) ** 2 for r in part)
        close(got[key], {"rows": n, "mae": sum(map(abs, err)) / n, "rmse": math.sqrt(sse / n), "residual_mean": -sum(err) / n, "max_error": max(map(abs, err))})
        assert n < 2 or math.isclose(got[key]["r2"], 1 - sse / sst, abs_tol=1e-5)


def test_multiclass_segments_equal_separate_runs(spark, rows):
    got = keyed(ru.multiclass_rollup(rows, LEVELS, ["p", "q", "r"], "truth", "called"))
    for key, part in segments(rows):
        if key[0] == 0:
            continue
        matrix = ev.confusion(spark.createDataFrame([(1, r.truth, r.called) for r in part], "g int, y string, pred string"), ["g"], ["p", "q", "r"])
        close(got[key], {k: v for k, v in ev.multiclass_metrics(matrix, ["g"]).first().asDict().items() if k in got[key]})


def test_rows_that_cannot_be_judged(spark):
    odd = spark.createDataFrame([("x", 1, None, 0.5, "p", "z", None, 1.0), ("x", 1, 1, None, None, "p", 1.0, float("inf")), ("x", 1, 1, 0.9, "p", "p", 1.0, 2.0)],
                                "a string, b int, y int, p double, truth string, called string, t double, e double")
    whole = (3, None, None)
    close(keyed(ru.binary_rollup(odd, LEVELS, 0.4))[whole], {"rows": 3, "tp": 1, "fp": 0, "fn": 0, "tn": 0})
    close(keyed(ru.regression_rollup(odd, LEVELS, "t", "e"))[whole], {"rows": 1, "mae": 1.0})
    close(keyed(ru.multiclass_rollup(odd, LEVELS, ["p", "q"], "truth", "called"))[whole], {"rows": 1, "undeclared": 2, "accuracy": None})
    for f in (lambda d: ru.binary_rollup(d, LEVELS, 0.4), lambda d: ru.regression_rollup(d, LEVELS, "t", "e"), lambda d: ru.multiclass_rollup(d, LEVELS, ["p"], "truth", "called")):
        assert all(not r["rows"] for r in f(odd.limit(0)).collect())
