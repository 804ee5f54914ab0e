"""Evaluation queries: two document quality scores, nearest-centroid classes of embeddings, a price formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import evaluate as ev
from assayer.operators import rollup as ru
from assayer.operators import split as sp
from assayer.plans.registry import R, query, rounded
from assayer.plans.splits import split_sql
from assayer.plans.target import DIMS, DOCS, EMB, labelled, vectors
from assayer.sources.tables import table

SCORED = f"""{DOCS},
 scored AS (SELECT doc_id, lang, quality::INT AS y, m AS model_id, CASE m WHEN 'length' THEN least(1.0, n_chars / 20000.0) ELSE 0.5 * ((words % 100) / 100.0) + 0.5 * least(1.0, n_chars / 20000.0) END AS p FROM dl, (SELECT unnest(['length', 'mixed']) AS m))"""
BY = ["model_id"]


def scored(spark, sf) -> DataFrame:
    d = labelled(spark, sf)
    length = F.least(F.lit(1.0), F.col("n_chars") / 20000.0)
    mixed = 0.5 * ((F.col("words") % 100) / 100.0) + 0.5 * length
    return d.select("doc_id", "lang", F.col("quality").cast("int").alias("y"), F.inline(F.array(
        F.struct(F.lit("length").alias("model_id"), length.alias("p")), F.struct(F.lit("mixed").alias("model_id"), mixed.alias("p")))))


RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall"""


@query("l01_threshold_metrics", f"""WITH {SCORED},
 c AS (SELECT model_id, lang, count(*) FILTER (p >= 0.3 AND y = 1) AS tp, count(*) FILTER (p >= 0.3 AND y = 0) AS fp, count(*) FILTER (p < 0.3 AND y = 1) AS fn, count(*) FILTER (p < 0.3 AND y = 0) AS tn FROM scored GROUP BY 1, 2),
 r AS (SELECT *, {RATES}, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS specificity FROM c)
SELECT model_id, lang, tp, fp, fn, tn, 0.3::DOUBLE AS threshold, {R('precision', 'recall', 'specificity')}, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) + 0.0 AS f1,
 round(CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END, 6) + 0.0 AS f2, round((recall + specificity) / 2, 6) + 0.0 AS balanced_accuracy, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) + 0.0 AS accuracy,
 round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 6) + 0.0 AS predicted_positive_rate FROM r""")
def _(spark, sf):
    return rounded(ev.threshold_metrics(scored(spark, sf), ["model_id", "lang"], 0.3))


CURVE = f"""{SCORED},
 sc AS (SELECT model_id, p, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM scored GROUP BY 1, 2),
 cu AS (SELECT *, sum(n) OVER w AS rn, sum(pos) OVER w AS rp, sum(n) OVER (PARTITION BY model_id) AS rows, sum(pos) OVER (PARTITION BY model_id) AS positives FROM sc WINDOW w AS (PARTITION BY model_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
 rm AS (SELECT model_id, CAST(any_value(rows) AS BIGINT) AS rows, CAST(any_value(positives) AS BIGINT) AS positives, count(*) AS distinct_scores, sum(pos * rp / rn::DOUBLE) / any_value(positives) AS average_precision,
  sum((n - pos) * (rp - pos / 2.0)) / (any_value(positives) * (any_value(rows) - any_value(positives)))::DOUBLE AS roc_auc FROM cu GROUP BY 1)"""


@query("l02_ranking_metrics", f"WITH {CURVE} SELECT model_id, rows, positives, distinct_scores, {R('average_precision', 'roc_auc')} FROM rm")
def _(spark, sf):
    return rounded(ev.ranking_metrics(scored(spark, sf), BY))


@query("l03_curve_points", f"""WITH {CURVE} SELECT model_id, round(p, 12) + 0.0 AS threshold, round(rp / rn::DOUBLE, 6) + 0.0 AS precision, round(rp / positives::DOUBLE, 6) + 0.0 AS recall, round((rn - rp) / (rows - positives)::DOUBLE, 6) + 0.0 AS false_positive_rate FROM cu""")
def _(spark, sf):
    return rounded(ev.curve_points(scored(spark, sf), BY), threshold=12)


LOSSES = f"""{CURVE}, lo AS (SELECT model_id, count(*) AS rows, avg(CASE WHEN y = 1 THEN -ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) ELSE -ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) END) AS log_loss,
 avg((p - y) * (p - y)) AS brier, avg(y) AS prevalence FROM scored GROUP BY 1)"""


@query("l04_probability_losses", f"WITH {LOSSES} SELECT model_id, rows, {R('log_loss', 'brier', 'prevalence')} FROM lo")
def _(spark, sf):
    return rounded(ev.probability_losses(scored(spark, sf), BY))


def calibration_sql(edges: str) -> str:
    return f"""SELECT model_id, CAST(bin AS BIGINT) AS bin, count(*) AS rows, round(CAST(sum(CAST(p AS DECIMAL(38,15))) AS DOUBLE) / count(*), 12) + 0.0 AS mean_score, round(sum(y)::DOUBLE / count(*), 12) + 0.0 AS observed_rate FROM (
 SELECT s.*, len(list_filter({edges}, lambda e: e < p)) AS bin FROM scored s JOIN ed USING (model_id)) GROUP BY 1, 2"""


@query("l05_calibration_uniform", f"WITH {SCORED}, ed AS (SELECT DISTINCT model_id, [1/10.0::DOUBLE, 2/10.0::DOUBLE, 3/10.0::DOUBLE, 4/10.0::DOUBLE, 5/10.0::DOUBLE, 6/10.0::DOUBLE, 7/10.0::DOUBLE, 8/10.0::DOUBLE, 9/10.0::DOUBLE] AS e0 FROM scored) {calibration_sql('e0')}")
def _(spark, sf):
    return rounded(ev.calibration(scored(spark, sf), BY), 12)


@query("l05_calibration_quantile", f"WITH {SCORED}, ed AS (SELECT model_id, [{', '.join(f'quantile_cont(p, {i}/10.0::DOUBLE)' for i in range(1, 10))}] AS e0 FROM scored GROUP BY 1) {calibration_sql('e0')}")
def _(spark, sf):
    return rounded(ev.calibration(scored(spark, sf), BY, strategy="quantile"), 12)


SWEEP = f"""{SCORED},
 th AS (SELECT DISTINCT model_id, p AS threshold FROM scored UNION SELECT DISTINCT model_id, unnest([0.0, 0.5, 1.0])::DOUBLE FROM scored),
 tc AS (SELECT t.model_id, threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn, count(*) FILTER (p < threshold AND y = 0) AS tn FROM th t JOIN scored s USING (model_id) GROUP BY 1, 2),
 tr AS (SELECT *, {RATES} FROM tc),
 sw AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM tr)"""


@query("l06_threshold_sweep", f"WITH {SWEEP} SELECT model_id, round(threshold, 12) + 0.0 AS threshold, tp, fp, fn, tn, {R('precision', 'recall', 'f1', 'f2')} FROM sw")
def _(spark, sf):
    return rounded(ev.threshold_sweep(scored(spark, sf), BY), threshold=12)


def recall_sql(t: float, name: str) -> str:
    return f"""SELECT '{name}' AS scenario, * FROM (SELECT *, recall >= {t} AS satisfied, row_number() OVER (PARTITION BY model_id ORDER BY recall >= {t} DESC, CASE WHEN recall >= {t} THEN precision ELSE recall END DESC,
 CASE WHEN recall >= {t} THEN f2 ELSE precision END DESC, CASE WHEN recall >= {t} THEN threshold ELSE -threshold END DESC) AS i FROM sw) WHERE i = 1"""


@query("l07_threshold_scenarios", f"""WITH {SWEEP}, ch AS (
 SELECT 'default_0_50' AS scenario, *, true AS satisfied, 1 AS i FROM sw WHERE threshold = 0.5 UNION ALL SELECT 'maximum_f1', * FROM (SELECT *, true, row_number() OVER (PARTITION BY model_id ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC) AS i FROM sw) WHERE i = 1
 UNION ALL SELECT 'maximum_f2', * FROM (SELECT *, true, row_number() OVER (PARTITION BY model_id ORDER BY f2 DESC, precision DESC, recall DESC, threshold DESC) AS i FROM sw) WHERE i = 1
 UNION ALL {recall_sql(0.7, 'minimum_recall_0_70')} UNION ALL {recall_sql(0.8, 'minimum_recall_0_80')} UNION ALL {recall_sql(0.9, 'minimum_recall_0_90')})
SELECT model_id, scenario, satisfied, round(threshold, 12) + 0.0 AS threshold, {R('precision', 'recall', 'f1', 'f2')}, tp, fp, fn, tn FROM ch""")
def _(spark, sf):
    return rounded(ev.threshold_scenarios(ev.threshold_sweep(scored(spark, sf), BY), BY), threshold=12)


# --- multiclass: nearest class centre over all dimensions ---------------------------------------------------------------

CLASSES = [str(i) for i in range(10)]
KS = ", ".join(f"'{c}'" for c in CLASSES)
DIST = " + ".join(f"(v.{d} - c.{d}) * (v.{d} - c.{d})" for d in DIMS)
PREDICTED = f"""{EMB},
 ce AS (SELECT label, {', '.join(f'avg({d}) AS {d}' for d in DIMS)} FROM em GROUP BY 1),
 ds AS (SELECT v.vec_id, v.label AS y, c.label AS k, {DIST} AS d, CASE WHEN vec_id % 2 = 0 THEN 'validation' ELSE 'test' END AS side FROM em v, ce c),
 pp AS (SELECT vec_id, side, y, arg_min(k, round(d, 12)) AS pred, max(exp(-d)) FILTER (k = y) / sum(exp(-d)) AS py, max(exp(-d)) / sum(exp(-d)) AS top, max(exp(-d)) FILTER (k = y) AS ey FROM ds GROUP BY 1, 2, 3),
 kk AS (SELECT unnest([{KS}]) AS k), sd AS (SELECT DISTINCT side FROM pp),
 cf AS (SELECT s.side, a.k AS actual, b.k AS predicted, count(pp.vec_id) AS count FROM sd s CROSS JOIN kk a CROSS JOIN kk b LEFT JOIN pp ON pp.side = s.side AND pp.y = a.k AND pp.pred = b.k GROUP BY 1, 2, 3),
 cm AS (SELECT *, CASE WHEN sum(count) OVER (PARTITION BY side, actual) > 0 THEN count / (sum(count) OVER (PARTITION BY side, actual))::DOUBLE ELSE 0 END AS share FROM cf),
 pk AS (SELECT side, k AS class, CAST(sum(count) FILTER (actual = k) AS BIGINT) AS support, CAST(sum(count) FILTER (predicted = k) AS BIGINT) AS predicted_rows, sum(count) FILTER (actual = k AND predicted = k) AS tp FROM cm, kk GROUP BY 1, 2),
 pr2 AS (SELECT *, CASE WHEN predicted_rows > 0 THEN tp / predicted_rows::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall FROM pk),
 pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr2)"""


def predicted(spark, sf) -> DataFrame:
    """The class centres, one row per class of a declared list, travel as one row of structs."""
    v = vectors(spark, sf)
    centres = v.groupBy("label").agg(*[F.avg(d).alias(d) for d in DIMS]).agg(
        F.sort_array(F.collect_list(F.struct("label", *DIMS))).alias("_c"))
    distance = lambda c: reduce(lambda a, b: a + b, [(F.col(d) - c[d]) * (F.col(d) - c[d]) for d in DIMS])
    scored_ = v.join(F.broadcast(centres)).withColumn("_d", F.transform("_c", distance))
    weights = F.transform("_d", lambda d: F.exp(-d))
    scored_ = scored_.withColumn("_w", weights).withColumn("probs", F.transform(
        "_w", lambda w: w / F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)))
    nearest = F.array_position("_d", F.array_min("_d")).cast("int")
    return scored_.select("vec_id", F.when(F.col("vec_id") % 2 == 0, "validation").otherwise("test").alias("side"),
                          F.col("label").alias("y"), F.element_at("_c", nearest)["label"].alias("pred"), "probs")


def matrix(spark, sf):
    return ev.confusion(predicted(spark, sf), ["side"], CLASSES)


# Some test rows have a label that no one declared.
FOREIGN = PREDICTED.replace("v.label AS y", "CASE WHEN vec_id % 98 = 1 THEN 'x' ELSE v.label END AS y") + """,
 un AS (SELECT side, count(*) FILTER (y = 'x') AS undeclared FROM pp GROUP BY 1)"""


def with_foreign(df: DataFrame) -> DataFrame:
    return df.withColumn("y", F.when(F.col("vec_id") % 98 == 1, "x").otherwise(F.col("y")))


@query("l08_confusion", f"WITH {FOREIGN} SELECT side, actual, predicted, count, {R('share')}, undeclared FROM cm JOIN un USING (side)")
def _(spark, sf):
    return rounded(ev.confusion(with_foreign(predicted(spark, sf)), ["side"], CLASSES))


@query("l08_class_metrics", f"WITH {PREDICTED} SELECT side, class, support, predicted_rows, {R('precision', 'recall', 'f1')} FROM pc")
def _(spark, sf):
    return rounded(ev.class_metrics(matrix(spark, sf), ["side"]))


@query("l08_multiclass_metrics", f"""WITH {FOREIGN}, me AS (
SELECT side, CAST(sum(support) AS BIGINT) AS rows, sum(recall * support) / sum(support) AS accuracy, avg(f1) AS macro_f1, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
 sum(f1 * support) / sum(support) AS weighted_f1, avg(recall) FILTER (support > 0) AS balanced_accuracy, min(recall) AS minimum_recall FROM pc GROUP BY 1)
SELECT side, rows, undeclared, {', '.join(f"CASE WHEN undeclared = 0 THEN round({c}, 6) + 0.0 END AS {c}" for c in ('accuracy', 'macro_f1', 'macro_precision', 'macro_recall', 'weighted_f1', 'balanced_accuracy', 'minimum_recall'))} FROM me JOIN un USING (side)""")
def _(spark, sf):
    return rounded(ev.multiclass_metrics(ev.confusion(with_foreign(predicted(spark, sf)), ["side"], CLASSES), ["side"]))


@query("l08_multiclass_log_loss", f"""WITH {FOREIGN} SELECT side, count(*) AS rows, count(*) FILTER (y = 'x') AS invalid_rows,
 CASE WHEN count(*) FILTER (y = 'x') = 0 THEN round(avg(-ln(greatest(2.220446049250313e-16, py))), 6) + 0.0 END AS log_loss FROM pp GROUP BY 1""")
def _(spark, sf):
    return rounded(ev.multiclass_log_loss(with_foreign(predicted(spark, sf)), ["side"], CLASSES))


CONFUSED = """
 cp AS (SELECT side, least(actual, predicted) AS class_a, greatest(actual, predicted) AS class_b, CAST(sum(count) AS BIGINT) AS mutual_count, CAST(sum(CASE WHEN actual < predicted THEN count ELSE 0 END) AS BIGINT) AS a_as_b,
  CAST(sum(CASE WHEN actual > predicted THEN count ELSE 0 END) AS BIGINT) AS b_as_a, sum(share) AS mutual_rate FROM cm WHERE actual <> predicted GROUP BY 1, 2, 3),
 rp AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY mutual_count DESC, round(mutual_rate, 12) DESC, class_a, class_b) AS rank FROM cp)"""


@query("l09_confused_pairs", f"""WITH {PREDICTED}, {CONFUSED}
SELECT side, class_a, class_b, mutual_count, a_as_b, b_as_a, {R('mutual_rate')}, rank, CASE WHEN class_a = '2' AND class_b = '5' THEN CASE WHEN rank = 1 THEN 'supported' WHEN rank <= 3 THEN 'partially_supported' ELSE 'not_supported' END ELSE '' END AS focal_status FROM rp""")
def _(spark, sf):
    return rounded(ev.confused_pairs(matrix(spark, sf), ["side"], ("5", "2")))


@query("l09_confused_pairs_compared", f"""WITH {PREDICTED}, {CONFUSED}
SELECT v.class_a, v.class_b, v.mutual_count AS validation_count, v.rank AS validation_rank, t.mutual_count AS test_count, t.rank AS test_rank, t.rank - v.rank AS rank_change FROM rp v JOIN rp t ON v.class_a = t.class_a AND v.class_b = t.class_b WHERE v.side = 'validation' AND t.side = 'test'""")
def _(spark, sf):
    p = ev.confused_pairs(matrix(spark, sf), ["side"])
    side = lambda s: p.where(F.col("side") == s)
    return rounded(ev.compare_confused_pairs(side("validation"), side("test"), []))


# --- regression -------------------------------------------------------------------------------------------------------

PRICED = """
 priced AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_extendedprice AS y, l_quantity * 1500.0 * (1 - l_discount) AS pred FROM lineitem)"""
ERRORS = """count(*) AS rows, round(avg(abs(pred - y)), 3) + 0.0 AS mae, round(sqrt(avg((pred - y) ** 2)), 3) + 0.0 AS rmse, round(1 - avg((pred - y) ** 2) / var_pop(y), 6) + 0.0 AS r2, round(avg(y - pred), 3) + 0.0 AS residual_mean, round(stddev_pop(pred - y), 3) + 0.0 AS residual_std,
 round(max(abs(pred - y)), 3) + 0.0 AS max_error, round(median(abs(pred - y)), 3) + 0.0 AS median_error, round(quantile_cont(abs(pred - y), 0.9), 3) + 0.0 AS p90_error, round(quantile_cont(abs(pred - y), 0.95), 3) + 0.0 AS p95_error"""


def priced(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500.0 * (1 - F.col("l_discount"))).alias("pred"))


@query("l10_regression_metrics", f"WITH {PRICED} SELECT l_returnflag, {ERRORS} FROM priced GROUP BY 1")
def _(spark, sf):
    return rounded(ev.regression_metrics(priced(spark, sf), ["l_returnflag"], few_groups=True), 3, r2=6)


@query("l11_without_training_profiles", f"""WITH {PRICED}, tr AS (SELECT DISTINCT l_quantity, l_discount, l_tax FROM priced WHERE l_linestatus = 'F')
SELECT 'all' AS scope, {ERRORS} FROM priced WHERE l_linestatus = 'O' UNION ALL SELECT 'new profiles', {ERRORS} FROM priced WHERE l_linestatus = 'O' AND (l_quantity, l_discount, l_tax) NOT IN (SELECT * FROM tr)""")
def _(spark, sf):
    p = priced(spark, sf)
    train, test = p.where(F.col("l_linestatus") == "F"), p.where(F.col("l_linestatus") == "O")
    new = ev.without_training_profiles(train, test, ["l_quantity", "l_discount", "l_tax"])
    both = test.withColumn("scope", F.lit("all")).unionByName(new.withColumn("scope", F.lit("new profiles")))
    found = ev.regression_metrics(both, ["scope"], few_groups=True)
    scopes = spark.createDataFrame([("all",), ("new profiles",)], "scope string")  # a scope without rows has its line too
    return rounded(scopes.join(found, "scope", "left").withColumn("rows", F.coalesce("rows", F.lit(0))), 3, r2=6)


@query("l12_target_extremes", f"""WITH {PRICED}, q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM priced WHERE l_linestatus = 'F'),
 s AS (SELECT p.*, CASE WHEN y < a - 0.2 * (b - a) OR y > b + 0.2 * (b - a) THEN 'extreme' ELSE 'regular' END AS scope FROM priced p, q WHERE l_linestatus = 'O')
SELECT scope, {ERRORS.replace("3) + 0.0 AS residual_mean", "4) + 0.0 AS residual_mean")} FROM (SELECT * FROM s UNION ALL SELECT * REPLACE ('all' AS scope) FROM s) GROUP BY 1""")
def _(spark, sf):
    p = priced(spark, sf)
    s = ev.extreme_scopes(p.where(F.col("l_linestatus") == "F"), p.where(F.col("l_linestatus") == "O"), "y", multiplier=0.2)
    return rounded(ev.regression_metrics(s, ["scope"], few_groups=True), 3, r2=6, residual_mean=4)  # the mean is half of 0.001 off a round one


# --- choice: candidates are score formulas, groups are languages, folds come from the document hash ------------------------

FOLDED = f"""{SCORED}, fo AS (SELECT doc_id, (row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold FROM dl),
 fs AS (SELECT s.*, f.fold FROM scored s JOIN fo f USING (doc_id)),
 fb AS (SELECT model_id, fold, avg((p - y) * (p - y)) AS brier FROM fs GROUP BY 1, 2),
 ci AS (SELECT model_id, count(*) AS folds, avg(brier) AS cv_mean, stddev_pop(brier) AS cv_std, avg(brier) - 1.96 * stddev_pop(brier) / sqrt(count(*)) AS cv_lower, avg(brier) + 1.96 * stddev_pop(brier) / sqrt(count(*)) AS cv_upper FROM fb GROUP BY 1)"""


def folded_scores(spark, sf):
    d = sp.folds(labelled(spark, sf).select("doc_id"), ["doc_id"], 5)
    return scored(spark, sf).join(d, "doc_id")


@query("l13_cv_interval", f"WITH {FOLDED} SELECT model_id, folds, {R('cv_mean', 'cv_std', 'cv_lower', 'cv_upper')} FROM ci")
def _(spark, sf):
    folds = ev.probability_losses(folded_scores(spark, sf), ["model_id", "fold"])
    return rounded(ev.cv_interval(folds, ["model_id"], "brier"))


LANG_CURVE = f"""{SCORED},
 sc AS (SELECT lang, model_id, p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1, 2, 3),
 cu AS (SELECT *, sum(n) OVER w AS rn, sum(pos) OVER w AS rp FROM sc WINDOW w AS (PARTITION BY lang, model_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
 rm AS (SELECT lang, model_id, sum(pos) / sum(n)::DOUBLE AS dummy, CASE WHEN sum(pos) > 0 THEN sum(pos * rp / rn::DOUBLE) / sum(pos) END AS ap, CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum((n - pos) * (rp - pos / 2.0)) / (sum(pos) * sum(n - pos))::DOUBLE END AS auc FROM cu GROUP BY 1, 2),
 lo AS (SELECT lang, model_id, avg(CASE WHEN y = 1 THEN -ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) ELSE -ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) END) AS ll, avg((p - y) * (p - y)) AS br FROM scored GROUP BY 1, 2),
 ca AS (SELECT lang, model_id, ap, dummy, br, ll, auc, CASE model_id WHEN 'length' THEN 0 ELSE 1 END AS si, ap - dummy > 0.01 AS el FROM rm JOIN lo USING (lang, model_id)),
 pl AS (SELECT *, row_number() OVER (PARTITION BY lang, el ORDER BY ap DESC, model_id) AS i FROM ca),
 pr AS (SELECT g.lang, g.eligible, a.model_id AS am, a.ap AS aap, a.br AS abr, a.ll AS all_, a.auc AS aauc, b.model_id AS bm, b.ap AS bap, b.br AS bbr, b.ll AS bll, b.auc AS bauc FROM (SELECT lang, count(*) FILTER (el) AS eligible FROM ca GROUP BY 1) g
  LEFT JOIN pl a ON a.lang = g.lang AND a.el AND a.i = 1 LEFT JOIN pl b ON b.lang = g.lang AND b.el AND b.i = 2)"""


def lang_candidates(spark, sf):
    s, by = scored(spark, sf), ["lang", "model_id"]
    r = ev.ranking_metrics(s, by).withColumn("dummy_average_precision", F.col("positives") / F.col("rows"))
    return r.join(ev.probability_losses(s, by).drop("rows"), by).select(
        *by, "average_precision", "dummy_average_precision", "brier", "log_loss", F.lit(0.01).alias("cv_std"),
        (F.col("average_precision") - 0.1).alias("cv_lower"), (F.col("average_precision") + 0.1).alias("cv_upper"), "roc_auc",
        F.when(F.col("model_id") == "length", 0).otherwise(1).alias("simplicity"))


@query("l14_choose_binary", f"""WITH {LANG_CURVE}, t AS (SELECT *, coalesce(aap - bap <= 0.05 AND greatest(aap, bap) - 0.1 <= least(aap, bap) + 0.1, false) AS tie FROM pr)
SELECT lang, eligible, tie AS practical_tie, CASE WHEN NOT tie THEN am WHEN abs(abr - bbr) > 1e-12 THEN CASE WHEN abr < bbr THEN am ELSE bm END WHEN abs(all_ - bll) > 1e-12 THEN CASE WHEN all_ < bll THEN am ELSE bm END WHEN abs(aauc - bauc) > 1e-12 THEN CASE WHEN aauc > bauc THEN am ELSE bm END ELSE 'length' END AS selected,
 CASE WHEN am IS NULL THEN 'none' WHEN NOT tie THEN 'average_precision' WHEN abs(abr - bbr) > 1e-12 THEN 'brier' WHEN abs(all_ - bll) > 1e-12 THEN 'log_loss' WHEN abs(aauc - bauc) > 1e-12 THEN 'roc_auc' ELSE 'simplicity' END AS criterion FROM t""")
def _(spark, sf):
    return ev.choose_binary(lang_candidates(spark, sf), ["lang"], margin=0.01, tolerance=0.05)


@query("l15_choose_multiclass", f"""WITH {PREDICTED},
 m AS (SELECT side, avg(f1) AS macro_f1, avg(recall) FILTER (support > 0) AS ba, min(recall) AS mr FROM pc GROUP BY 1),
 ca AS (SELECT side AS study, k AS model_id, macro_f1 - d AS macro_f1, ba - d AS ba, mr, s AS si FROM m, (VALUES ('centre', 0.0, 2), ('copy', 0.0, 1), ('weak', 0.2, 0)) AS v(k, d, s)),
 b AS (SELECT *, macro_f1 - 0.05 > 0.02 AS eligible, max(CASE WHEN macro_f1 - 0.05 > 0.02 THEN macro_f1 END) OVER (PARTITION BY study) AS best FROM ca),
 f AS (SELECT *, coalesce(eligible AND best - macro_f1 <= 0.01, false) AS finalist FROM b)
SELECT study, model_id, round(macro_f1, 6) + 0.0 AS macro_f1, eligible, finalist, finalist AND row_number() OVER (PARTITION BY study ORDER BY finalist DESC, ba DESC, mr DESC, si, model_id) = 1 AS selected FROM f""")
def _(spark, sf):
    m = ev.multiclass_metrics(matrix(spark, sf), ["side"])
    rows = [F.struct(F.lit(k).alias("model_id"), (F.col("macro_f1") - d).alias("macro_f1"), (F.col("balanced_accuracy") - d).alias("balanced_accuracy"),
                     F.col("minimum_recall").alias("minimum_recall"), F.lit(0.01).alias("cv_std"), F.lit(None).cast("double").alias("log_loss"),
                     F.lit(s).alias("simplicity"), F.lit(0.05).alias("dummy_macro_f1")) for k, d, s in (("centre", 0.0, 2), ("copy", 0.0, 1), ("weak", 0.2, 0))]
    return rounded(ev.choose_multiclass(m.select(F.col("side").alias("study"), F.inline(F.array(*rows))), ["study"], 0.02, 0.01))


PRICE_MODELS = {"quantity": "l_quantity * 1500.0", "discounted": "l_quantity * 1500.0 * (1 - l_discount)", "constant": "1000.0"}


@query("l15_choose_regression", f"""WITH s AS ({' UNION ALL '.join(f"SELECT l_returnflag, '{k}' AS model_id, l_extendedprice AS y, {v} AS pred FROM lineitem" for k, v in PRICE_MODELS.items())}),
 md AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1), du AS (SELECT l_returnflag, avg(abs(l_extendedprice - med)) AS dm FROM lineitem JOIN md USING (l_returnflag) GROUP BY 1),
 m AS (SELECT l_returnflag, model_id, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) ** 2)) AS rmse FROM s GROUP BY 1, 2), b AS (SELECT *, dm - mae > 0 AS eligible, min(CASE WHEN dm - mae > 0 THEN mae END) OVER (PARTITION BY l_returnflag) AS best FROM m JOIN du USING (l_returnflag)),
 f AS (SELECT *, coalesce(eligible AND mae <= best + 2000, false) AS finalist FROM b)
SELECT l_returnflag, model_id, round(mae, 3) + 0.0 AS mae, eligible, finalist, finalist AND row_number() OVER (PARTITION BY l_returnflag ORDER BY finalist DESC, rmse, model_id) = 1 AS selected, round(100 * (dm - mae) / dm, 3) + 0.0 AS improvement_pct FROM f""")
def _(spark, sf):
    from assayer.functions import quantiles
    li = table(spark, sf, "lineitem")
    s = li.select("l_returnflag", F.col("l_extendedprice").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("model_id"), F.expr(v).cast("double").alias("pred")) for k, v in PRICE_MODELS.items()])))
    med = quantiles(li, ["l_returnflag"], "l_extendedprice", [0.5], few_groups=True).select("l_returnflag", F.col("qs")[0].alias("_m"))
    dummy = li.join(F.broadcast(med), "l_returnflag").groupBy("l_returnflag").agg(F.avg(F.abs(F.col("l_extendedprice") - F.col("_m"))).alias("dummy_mae"))
    c = ev.regression_metrics(s, ["l_returnflag", "model_id"], few_groups=True).join(dummy, "l_returnflag").withColumn("cv_std", F.lit(0.0))
    return rounded(ev.choose_regression(c, ["l_returnflag"], 2000), 3)


@query("l17_dummy_baselines", f"""WITH {FOLDED}, {PRICED}, ln AS (SELECT * FROM fs WHERE model_id = 'length'), pri AS (SELECT a.doc_id, a.y, coalesce(avg(b.y) FILTER (b.lang = a.lang), avg(b.y)) AS p FROM ln a JOIN ln b ON b.fold <> a.fold GROUP BY 1, 2), med AS (SELECT median(y) AS m FROM priced WHERE l_linestatus = 'F')
SELECT 'prior' AS baseline, count(*) AS rows, round(avg((y - p) ** 2), 6) + 0.0 AS error FROM pri UNION ALL SELECT 'median', count(*), round(avg(abs(y - m)), 3) + 0.0 FROM priced, med WHERE l_linestatus = 'O'""")
def _(spark, sf):
    s = folded_scores(spark, sf).where(F.col("model_id") == "length")
    prior = ev.prior_by_fold(s, ["lang"])
    p = priced(spark, sf)
    med = ev.median_baseline(p.where(F.col("l_linestatus") == "F"), p.where(F.col("l_linestatus") == "O"))
    gap = F.col("y") - F.col("p")
    return prior.agg(F.lit("prior").alias("baseline"), F.count(F.lit(1)).alias("rows"), (F.round(F.avg(gap * gap), 6) + 0.0).alias("error")).unionByName(
        med.agg(F.lit("median").alias("baseline"), F.count(F.lit(1)).alias("rows"), (F.round(F.avg(F.abs(F.col("y") - F.col("pred"))), 3) + 0.0).alias("error")))


@query("l19_generalisation", f"""WITH {PREDICTED}, m AS (SELECT side, sum(recall * support) / sum(support) AS accuracy, avg(f1) AS macro_f1, min(recall) AS minimum_recall FROM pc GROUP BY 1),
 l AS (SELECT side, unnest(['accuracy', 'macro_f1', 'minimum_recall']) AS metric, unnest([accuracy, macro_f1, minimum_recall]) AS v FROM m)
SELECT metric, round(max(v) FILTER (side = 'validation'), 6) + 0.0 AS validation, round(max(v) FILTER (side = 'test'), 6) + 0.0 AS test, round(max(v) FILTER (side = 'test') - max(v) FILTER (side = 'validation'), 6) + 0.0 AS delta FROM l GROUP BY 1""")
def _(spark, sf):
    m = ev.multiclass_metrics(matrix(spark, sf), ["side"])
    side = lambda s: m.where(F.col("side") == s)
    return rounded(ev.generalisation(side("validation"), side("test"), [], ["accuracy", "macro_f1", "minimum_recall"]))


@query("l19_weakest_class", f"""WITH {PREDICTED}, d AS (SELECT t.class, t.recall - v.recall AS delta FROM pc v JOIN pc t USING (class) WHERE v.side = 'validation' AND t.side = 'test')
SELECT 'recall' AS metric, class, round(delta, 6) + 0.0 AS delta FROM d ORDER BY round(delta, 12), class LIMIT 1""")
def _(spark, sf):
    c = ev.class_metrics(matrix(spark, sf), ["side"])
    side = lambda s: c.where(F.col("side") == s)
    return rounded(ev.weakest_class(ev.generalisation(side("validation"), side("test"), ["class"], ["recall"]), ["metric"]))


@query("l20_binary_output", f"WITH {SCORED} SELECT model_id, CASE WHEN p >= 0.4 THEN 'good' ELSE 'poor' END AS label, true AS valid, count(*) AS rows FROM scored GROUP BY 1, 2")
def _(spark, sf):
    o = ev.binary_output(scored(spark, sf), 0.4, "good", "poor")
    return o.groupBy("model_id", "label", "valid").agg(F.count(F.lit(1)).alias("rows"))


@query("l20_multiclass_output", f"WITH {PREDICTED} SELECT vec_id, pred AS label, round(top, 6) + 0.0 AS top_probability, true AS valid FROM pp")
def _(spark, sf):
    o = ev.multiclass_output(predicted(spark, sf), CLASSES)
    return rounded(o.select("vec_id", "label", "top_probability", "valid"))


@query("l20_continuous_output", f"WITH {PRICED} SELECT l_returnflag, 'currency units' AS unit, isfinite(pred) AS valid, count(*) AS rows, round(avg(pred), 3) + 0.0 AS mean_prediction FROM priced GROUP BY 1, 3")
def _(spark, sf):
    o = ev.continuous_output(priced(spark, sf), "currency units")
    return o.groupBy("l_returnflag", "unit", "valid").agg(F.count(F.lit(1)).alias("rows"), (F.round(F.avg("pred"), 3) + 0.0).alias("mean_prediction"))


@query("l01_threshold_rollup", f"""WITH {SCORED},
 c AS (SELECT model_id, lang, GROUPING(model_id, lang) AS g, count(*) AS rows, count(*) FILTER (p >= 0.3 AND y = 1) AS tp, count(*) FILTER (p >= 0.3 AND y = 0) AS fp, count(*) FILTER (p < 0.3 AND y = 1) AS fn, count(*) FILTER (p < 0.3 AND y = 0) AS tn FROM scored GROUP BY ROLLUP (model_id, lang)),
 r AS (SELECT *, {RATES} FROM c)
SELECT model_id, lang, CAST(g AS BIGINT) AS grouping, rows, tp, fp, fn, tn, {R('precision', 'recall')}, round((tp + tn) / rows::DOUBLE, 6) + 0.0 AS accuracy FROM r""")
def _(spark, sf):
    out = ru.binary_rollup(scored(spark, sf), ["model_id", "lang"], 0.3)
    return rounded(out.select("model_id", "lang", "grouping", "rows", "tp", "fp", "fn", "tn", "precision", "recall", "accuracy"))


@query("l10_regression_rollup", f"""WITH {PRICED}, e AS (SELECT l_returnflag, l_linestatus, y, pred - y AS e FROM priced),
 s AS (SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS g, count(*) AS rows, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, -avg(e) AS residual_mean, 1 - avg(e * e) / var_pop(y) AS r2, max(abs(e)) AS max_error FROM e GROUP BY ROLLUP (l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, CAST(g AS BIGINT) AS grouping, rows, {R('mae', 'rmse', 'residual_mean', 'max_error', digits=3)}, round(r2, 6) + 0.0 AS r2 FROM s""")
def _(spark, sf):
    out = ru.regression_rollup(priced(spark, sf), ["l_returnflag", "l_linestatus"])
    return rounded(out, 3, r2=6)


@query("l08_multiclass_rollup", f"""
WITH x AS (SELECT o_orderpriority AS pr, CASE WHEN o_custkey % 5 < 4 THEN o_custkey % 5 END::BIGINT AS seg, o_orderstatus AS y, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 500 = 3 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 7 = 1 THEN 'P' ELSE o_orderstatus END AS pred FROM orders),
m AS (SELECT CASE WHEN g < 3 THEN pr END AS pr, CASE WHEN g < 1 THEN seg END AS seg, g, y, pred FROM (SELECT *, unnest([0, 1, 3])::BIGINT AS g FROM x)),
per AS (SELECT pr, seg, g, c, count(*) FILTER (y = c) AS s, count(*) FILTER (pred = c) AS d, count(*) FILTER (y = c AND pred = c) AS tp, count(*) FILTER (pred IS NULL) AS un FROM m, (SELECT unnest(['F', 'O', 'P']) AS c) GROUP BY ALL),
r AS (SELECT *, CASE WHEN s > 0 THEN tp / s::DOUBLE ELSE 0 END AS rec, CASE WHEN d > 0 THEN tp / d::DOUBLE ELSE 0 END AS pre FROM per),
f AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f1 FROM r),
o AS (SELECT pr, seg, g, sum(s)::BIGINT AS rows, max(un) AS undeclared, sum(tp) / sum(s)::DOUBLE AS accuracy, avg(f1) AS macro_f1, sum(f1 * s) / sum(s) AS weighted_f1, avg(rec) FILTER (s > 0) AS balanced_accuracy, min(rec) AS minimum_recall FROM f GROUP BY ALL)
SELECT pr, seg, g AS grouping, rows - undeclared AS rows, undeclared, {', '.join(f'CASE WHEN undeclared = 0 THEN round({c}, 6) + 0.0 END AS {c}' for c in ('accuracy', 'macro_f1', 'weighted_f1', 'balanced_accuracy', 'minimum_recall'))} FROM o""")
def _(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    pred = F.when((F.col("o_orderpriority") == "5-LOW") & (key % 500 == 3), None).when(key % 3 == 0, "F").when(key % 7 == 1, "P").otherwise(F.col("o_orderstatus"))
    x = o.select(F.col("o_orderpriority").alias("pr"), F.when(F.col("o_custkey") % 5 < 4, F.col("o_custkey") % 5).alias("seg"), F.col("o_orderstatus").alias("y"), pred.alias("pred"))
    return rounded(ru.multiclass_rollup(x, ["pr", "seg"], ["F", "O", "P"]))
