"""Evaluation of scored rows per group of keys, threshold choice and candidate choice.

Input: one row per scored record with grouping keys, truth and score. Metrics are partial aggregates.
Curves collapse rows to distinct scores first and accumulate them by range, so one model or segment
with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import guarded_ratio, join_small, quantiles, running
from assayer.functions.ranks import _null_safe

EPS = 2.220446049250313e-16


def or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def binary_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = or_zero(tp, tp + fp), or_zero(tp, tp + fn)
    return {
        "precision": precision, "recall": recall, "specificity": or_zero(tn, tn + fp),
        "f1": or_zero(2 * precision * recall, precision + recall),
        "f2": or_zero(5 * precision * recall, 4 * precision + recall),
        "balanced_accuracy": (recall + or_zero(tn, tn + fp)) / 2, "accuracy": or_zero(tp + tn, tp + fp + fn + tn),
        "predicted_positive_rate": or_zero(tp + fp, tp + fp + fn + tn)}


def threshold_metrics(scored: DataFrame, by: Sequence[str], threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """Confusion counts and rates at one threshold; positive means p >= threshold."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    c = scored.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
                                F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    return c.withColumn("threshold", F.lit(float(threshold))).withColumns(binary_rates(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def score_curve(scored: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", extra: Sequence[float] = ()) -> DataFrame:
    """Distinct scores, highest first, with rows and positives at or above each: `by…, p, n, pos, run_n, run_pos, rows, positives`."""
    counts = scored.groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    if extra:
        added = totals.select(*by, F.explode(F.array(*[F.lit(float(e)) for e in extra])).alias(p),
                              F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"))
        counts = counts.unionByName(added).groupBy(*by, p).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    curve = running(counts, by, p, ["n", "pos"], descending=True)
    return _null_safe(curve, totals, list(by))


def ranking_metrics(scored: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Average precision and ROC AUC; both NULL without positives, AUC also without negatives."""
    c = score_curve(scored, by, y, p)
    neg = F.col("n") - F.col("pos")
    return c.groupBy(*by, "rows", "positives").agg(
        F.count(F.lit(1)).alias("distinct_scores"),
        guarded_ratio(F.sum(F.col("pos") * F.col("run_pos") / F.col("run_n")), F.max("positives")).alias("average_precision"),
        guarded_ratio(F.sum(neg * (F.col("run_pos") - F.col("pos") / F.lit(2.0))),
                      F.max("positives") * F.max(F.col("rows") - F.col("positives"))).alias("roc_auc"))


def curve_points(scored: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Precision-recall and ROC points, one row per distinct score."""
    c = score_curve(scored, by, y, p)
    return c.select(*by, F.col(p).alias("threshold"), guarded_ratio(F.col("run_pos"), F.col("run_n")).alias("precision"),
                    guarded_ratio(F.col("run_pos"), F.col("positives")).alias("recall"),
                    guarded_ratio(F.col("run_n") - F.col("run_pos"), F.col("rows") - F.col("positives")).alias("false_positive_rate"))


def probability_losses(scored: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(p)))
    loss = F.when(F.col(y) == 1, -F.ln(q)).otherwise(-F.ln(1 - q))
    gap = F.col(p) - F.col(y)
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("log_loss"), F.avg(gap * gap).alias("brier"),
                                   F.avg(F.col(y).cast("double")).alias("prevalence"))


def exact_mean(c: str) -> Column:
    """Mean of a column from a sum of decimals (15 digits after the point): the order of rows has no effect. NaN is skipped."""
    x = F.col(c).cast("double")
    x = F.when(~F.isnan(x), x).cast("decimal(38,15)")
    return F.try_divide(F.sum(x).cast("double"), F.count(x))


def calibration(scored: DataFrame, by: Sequence[str], bins: int = 10, strategy: str = "uniform", y: str = "y", p: str = "p",
                few_groups: bool | None = None) -> DataFrame:
    """Mean score and observed rate per bin (right-closed); empty bins do not appear."""
    if strategy == "uniform":
        edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        placed = scored.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col(p))))
    else:
        q = quantiles(scored, by, p, [i / bins for i in range(1, bins)], few_groups=few_groups).select(
            *by, F.col("qs").alias("_e"))
        placed = join_small(scored, q, list(by), few_groups).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(p))))
    return placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("rows"), exact_mean(p).alias("mean_score"),
                                          exact_mean(y).alias("observed_rate"))


def threshold_sweep(scored: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Confusion and rates at every distinct score and at 0, 0.5 and 1."""
    c = score_curve(scored, by, y, p, extra=(0.0, 0.5, 1.0))
    tp, fp = F.col("run_pos"), F.col("run_n") - F.col("run_pos")
    fn = F.col("positives") - tp
    tn = F.col("rows") - F.col("positives") - fp
    rates = binary_rates(tp, fp, fn, tn)
    return c.select(*by, F.col(p).alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
                    *[rates[k].alias(k) for k in ("precision", "recall", "f1", "f2")])


def threshold_scenarios(sweep: DataFrame, by: Sequence[str], recall_targets: Sequence[float] = (0.7, 0.8, 0.9)) -> DataFrame:
    """Chosen thresholds: 0.5, best F1, best F2, best precision under each recall target. One aggregate, no sort of the sweep."""
    row = ("threshold", "precision", "recall", "f1", "f2", "tp", "fp", "fn", "tn")
    rest = F.struct(*row)
    best = lambda *order: F.max(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], rest.alias("r")))["r"]
    c = F.col
    picks = {"default_0_50": (F.max(F.when(c("threshold") == 0.5, rest)), F.lit(True)),
             "maximum_f1": (best(c("f1"), c("precision"), c("recall"), c("threshold")), F.lit(True)),
             "maximum_f2": (best(c("f2"), c("precision"), c("recall"), c("threshold")), F.lit(True))}
    for t in recall_targets:
        good = c("recall") >= t
        met = F.max(F.when(good, F.struct(c("precision").alias("_0"), c("f2").alias("_1"), c("threshold").alias("_2"), rest.alias("r"))))["r"]
        fallback = best(c("recall"), c("precision"), -c("threshold"))
        picks[f"minimum_recall_{t:.2f}".replace(".", "_")] = (F.coalesce(met, fallback), F.max(good))
    wide = sweep.groupBy(*by).agg(*[x for k, (r, ok) in picks.items() for x in (r.alias(k), ok.alias(f"_ok_{k}"))])
    return wide.select(*by, F.inline(F.array(*[F.struct(
        F.lit(k).alias("scenario"), F.col(f"_ok_{k}").alias("satisfied"), *[F.col(k)[x].alias(x) for x in row]) for k in picks])))


# --- multiclass ---------------------------------------------------------------------------------------------------

def confusion(scored: DataFrame, by: Sequence[str], classes: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Complete confusion counts and shares of the true class over the declared classes.

    `undeclared` is the number of rows of the group whose label or prediction is missing or not declared; they are in
    no cell.
    """
    counts = scored.groupBy(*by, F.col(y).cast("string").alias("actual"), F.col(pred).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("_n"))
    cs = F.array(*[F.lit(c) for c in classes])
    declared = F.coalesce(F.col("actual").isin(*classes) & F.col("predicted").isin(*classes), F.lit(False))
    groups = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(~declared, F.col("_n"))), F.lit(0)).alias("undeclared"))
    grid = groups.select(*by, "undeclared", F.explode(cs).alias("actual")).select(*by, "undeclared", "actual", F.explode(cs).alias("predicted"))
    full = grid.join(counts, [*by, "actual", "predicted"], "left").withColumn("count", F.coalesce("_n", F.lit(0)))
    row = F.sum("count").over(Window.partitionBy(*by, "actual"))
    return full.select(*by, "actual", "predicted", "count", or_zero(F.col("count"), row).alias("share"), "undeclared")


def class_metrics(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    diag = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    rows = matrix.groupBy(*by, F.col("actual").alias("class")).agg(F.sum("count").alias("support"), F.sum(diag).alias("_tp"))
    cols = matrix.groupBy(*by, F.col("predicted").alias("class")).agg(F.sum("count").alias("predicted_rows"))
    precision, recall = or_zero(F.col("_tp"), F.col("predicted_rows")), or_zero(F.col("_tp"), F.col("support"))
    return rows.join(cols, [*by, "class"]).select(
        *by, "class", "support", "predicted_rows", precision.alias("precision"), recall.alias("recall"),
        or_zero(2 * precision * recall, precision + recall).alias("f1"))


def multiclass_metrics(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, macro and weighted F1, balanced accuracy and the weakest recall.

    A group with undeclared labels or predictions has no metrics, only their number.
    """
    per = class_metrics(matrix, by)
    n = F.sum("support")
    seen = F.when(F.col("support") > 0, F.col("recall"))
    measures = {
        "accuracy": F.sum(F.col("recall") * F.col("support")) / n, "macro_f1": F.avg("f1"), "macro_precision": F.avg("precision"),
        "macro_recall": F.avg("recall"), "weighted_f1": F.sum(F.col("f1") * F.col("support")) / n, "balanced_accuracy": F.avg(seen),
        "minimum_recall": F.min("recall")}
    out = per.groupBy(*by).agg(n.alias("rows"), *[m.alias(k) for k, m in measures.items()])
    foreign = matrix.groupBy(*by).agg(F.max("undeclared").alias("undeclared"))
    joined = _null_safe(out, foreign, list(by)) if by else out.join(F.broadcast(foreign))
    return joined.select(*by, "rows", "undeclared", *[F.when(F.col("undeclared") == 0, F.col(k)).alias(k) for k in measures])


def multiclass_log_loss(scored: DataFrame, by: Sequence[str], classes: Sequence[str], y: str = "y", probs: str = "probs",
                        tolerance: float = 1e-6) -> DataFrame:
    """Mean negative log of the probability given to the true class, clipped.

    `invalid_rows` have an undeclared label, a vector of another length, parts outside 0 to 1, or a sum that is not 1;
    a group with any has no loss.
    """
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y).cast("string")).cast("int")
    total = F.aggregate(probs, F.lit(0.0), lambda a, v: a + v)
    valid = F.coalesce((at > 0) & (F.size(probs) == len(classes)) & F.forall(probs, lambda v: (v >= 0) & (v <= 1)) & (F.abs(total - 1) <= tolerance), F.lit(False))
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.when(valid, F.element_at(probs, at))))
    loss = F.avg(F.when(valid, -F.ln(q)))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~valid).alias("invalid_rows"), F.when(F.count_if(~valid) == 0, loss).alias("log_loss"))


def confused_pairs(matrix: DataFrame, by: Sequence[str], focal: tuple[str, str] | None = None) -> DataFrame:
    """Class pairs by mutual confusion, rank and status of the focal pair. As many rows as class pairs."""
    a, b = F.least("actual", "predicted"), F.greatest("actual", "predicted")
    forward = F.col("actual") < F.col("predicted")
    pairs = matrix.where(F.col("actual") != F.col("predicted")).groupBy(*by, a.alias("class_a"), b.alias("class_b")).agg(
        F.sum("count").alias("mutual_count"), F.sum(F.when(forward, F.col("count")).otherwise(0)).alias("a_as_b"),
        F.sum(F.when(~forward, F.col("count")).otherwise(0)).alias("b_as_a"), F.sum("share").alias("mutual_rate"))
    order = Window.partitionBy(*by).orderBy(F.col("mutual_count").desc(), F.round("mutual_rate", 12).desc(), "class_a", "class_b")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    if focal:
        lo, hi = sorted(focal)
        is_focal = (F.col("class_a") == lo) & (F.col("class_b") == hi)
        status = F.when(F.col("rank") == 1, "supported").when(F.col("rank") <= 3, "partially_supported").otherwise("not_supported")
        ranked = ranked.withColumn("focal_status", F.when(is_focal, status).otherwise(""))
    return ranked


def compare_confused_pairs(validation: DataFrame, test: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranks of the class pairs on two evaluations side by side."""
    key = [*by, "class_a", "class_b"]
    pick = lambda df, tag: df.select(*key, F.col("mutual_count").alias(f"{tag}_count"), F.col("rank").alias(f"{tag}_rank"))
    return pick(validation, "validation").join(pick(test, "test"), key).withColumn(
        "rank_change", F.col("test_rank") - F.col("validation_rank"))


# --- regression ---------------------------------------------------------------------------------------------------

def regression_metrics(scored: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred", few_groups: bool | None = None) -> DataFrame:
    """MAE, RMSE, R², median error, residual moments and exact error quantiles."""
    e = F.col(pred) - F.col(y)
    rows = scored.select(*by, F.col(y).cast("double").alias("_y"), e.alias("_e"), F.abs(e).alias("_a"))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_a").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        (1 - guarded_ratio(F.avg(F.col("_e") * F.col("_e")), F.var_pop("_y"))).alias("r2"), F.avg(-F.col("_e")).alias("residual_mean"),
        F.stddev_pop("_e").alias("residual_std"), F.max("_a").alias("max_error"))
    q = quantiles(rows, by, "_a", [0.5, 0.9, 0.95], few_groups=few_groups).select(
        *by, F.col("qs")[0].alias("median_error"), F.col("qs")[1].alias("p90_error"), F.col("qs")[2].alias("p95_error"))
    return _null_safe(base, F.broadcast(q) if few_groups else q, list(by)) if by else base.join(F.broadcast(q))


def without_training_profiles(train: DataFrame, scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scored rows whose feature profile (NULLs equal) does not occur in training."""
    known = train.select(*[F.col(c).alias(f"_t_{c}") for c in features]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in features])
    return scored.join(known, same, "left_anti")


def extreme_scopes(train: DataFrame, scored: DataFrame, target: str, multiplier: float = 1.5) -> DataFrame:
    """Every scored row under `all` and under `extreme` or `regular` by fences of the training target."""
    q = quantiles(train, [], target, [0.25, 0.75])
    iqr = F.col("qs")[1] - F.col("qs")[0]
    q = F.broadcast(q.select((F.col("qs")[0] - multiplier * iqr).alias("_lo"), (F.col("qs")[1] + multiplier * iqr).alias("_hi")))
    side = F.when((F.col(target) < F.col("_lo")) | (F.col(target) > F.col("_hi")), "extreme").otherwise("regular")
    return scored.join(q).withColumn("scope", F.explode(F.array(F.lit("all"), side))).drop("_lo", "_hi")


# --- choice -------------------------------------------------------------------------------------------------------

def cv_interval(fold_metrics: DataFrame, by: Sequence[str], metric: str, z: float = 1.96) -> DataFrame:
    """Mean, population deviation and mean ± z·std/√k of a fold metric."""
    half = z * F.stddev_pop(metric) / F.sqrt(F.count(metric))
    return fold_metrics.groupBy(*by).agg(
        F.count(metric).alias("folds"), F.avg(metric).alias("cv_mean"), F.stddev_pop(metric).alias("cv_std"),
        (F.avg(metric) - half).alias("cv_lower"), (F.avg(metric) + half).alias("cv_upper"))


def choose_binary(candidates: DataFrame, by: Sequence[str], margin: float, tolerance: float) -> DataFrame:
    """Pick per group: average precision above the dummy by more than `margin`; the two best compared when tied.

    Columns: model_id, average_precision, dummy_average_precision, brier, log_loss, cv_std, cv_lower,
    cv_upper, roc_auc, simplicity. One row per candidate, so the windows are as small as the catalog.
    """
    by = list(by)
    eligible = F.col("average_precision") - F.col("dummy_average_precision") > margin
    order = Window.partitionBy(*by, "_eligible").orderBy(F.col("average_precision").desc(), "model_id")
    ranked = candidates.withColumn("_eligible", eligible).withColumn(
        "_place", F.when(F.col("_eligible"), F.row_number().over(order)))
    fields = [c for c in candidates.columns if c not in by]
    at = lambda i: F.max(F.when(F.col("_place") == i, F.struct(*fields)))
    pair = ranked.groupBy(*by).agg(at(1).alias("a"), at(2).alias("b"), F.count_if("_eligible").alias("eligible"))
    a, b = F.col("a"), F.col("b")
    overlap = F.greatest(a["cv_lower"], b["cv_lower"]) <= F.least(a["cv_upper"], b["cv_upper"])
    tie = F.coalesce((a["average_precision"] - b["average_precision"] <= tolerance) & overlap, F.lit(False))
    winner, criterion = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The ladder of tie breaks with its direction.
    for name, sign in reversed([("brier", 1), ("log_loss", 1), ("cv_std", 1), ("roc_auc", -1), ("simplicity", 1)]):
        gap = (a[name] - b[name]) * sign
        differs = F.abs(gap) > 1e-12
        winner = F.when(differs, F.when(gap < 0, a["model_id"]).otherwise(b["model_id"])).otherwise(winner)
        criterion = F.when(differs, F.lit(name)).otherwise(criterion)
    by_id = F.least(a["model_id"], b["model_id"])
    return pair.select(*by, "eligible", tie.alias("practical_tie"),
                       F.when(tie, F.coalesce(winner, by_id)).otherwise(a["model_id"]).alias("selected"),
                       F.when(tie, F.coalesce(criterion, F.lit("model_id"))).when(a.isNotNull(), "average_precision").otherwise("none").alias("criterion"))


def choose_multiclass(candidates: DataFrame, by: Sequence[str], margin: float, tolerance: float) -> DataFrame:
    """Rank: all within `tolerance` of the best eligible macro F1 by balanced accuracy, weakest recall, CV spread, loss, simplicity."""
    by = list(by)
    eligible = F.col("macro_f1") - F.col("dummy_macro_f1") > margin
    whole = Window.partitionBy(*by)
    c = candidates.withColumn("eligible", eligible)
    c = c.withColumn("_best", F.max(F.when(F.col("eligible"), F.col("macro_f1"))).over(whole))
    c = c.withColumn("finalist", F.coalesce(F.col("eligible") & (F.col("_best") - F.col("macro_f1") <= tolerance), F.lit(False)))
    order = whole.orderBy(F.col("finalist").desc(), F.col("balanced_accuracy").desc(), F.col("minimum_recall").desc(), "cv_std",
                          F.col("log_loss").asc_nulls_last(), "simplicity", "model_id")
    place = F.row_number().over(order)
    return c.withColumn("selected", (place == 1) & F.col("finalist")).select(*by, "model_id", "macro_f1", "eligible", "finalist", "selected")


def choose_regression(candidates: DataFrame, by: Sequence[str], tolerance: float) -> DataFrame:
    """Rank: strict improvement over the dummy MAE, then within `tolerance` of the best by RMSE, median error, CV spread, R², name."""
    by = list(by)
    floor = F.greatest(F.lit(EPS) * F.greatest(F.lit(1.0), F.abs("dummy_mae")), F.lit(0.0))
    whole = Window.partitionBy(*by)
    c = candidates.withColumn("eligible", F.col("dummy_mae") - F.col("mae") > floor)
    c = c.withColumn("_best", F.min(F.when(F.col("eligible"), F.col("mae"))).over(whole))
    c = c.withColumn("finalist", F.coalesce(F.col("eligible") & (F.col("mae") <= F.col("_best") + tolerance), F.lit(False)))
    order = whole.orderBy(F.col("finalist").desc(), "rmse", "median_error", "cv_std", F.col("r2").desc(), "model_id")
    place = F.row_number().over(order)
    return c.withColumn("selected", (place == 1) & F.col("finalist")).select(
        *by, "model_id", "mae", "eligible", "finalist", "selected",
        guarded_ratio(100 * (F.col("dummy_mae") - F.col("mae")), F.col("dummy_mae")).alias("improvement_pct"))


def prior_baseline(train: DataFrame, rows: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """Score every row with the training prevalence of its group, of all training rows if the group is not among them."""
    prior = train.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("p"))
    overall = train.agg(F.avg(F.col(y).cast("double")).alias("_overall"))
    return _null_safe(rows.drop("p"), prior, list(by), "left").join(F.broadcast(overall)).withColumn("p", F.coalesce("p", "_overall")).drop("_overall")


def prior_by_fold(rows: DataFrame, by: Sequence[str], y: str = "y", fold: str = "fold") -> DataFrame:
    """`prior_baseline` of every fold from all other folds: sums of the whole less those of the fold."""
    value = F.col(y).cast("double")
    sums = lambda keys, s, n: rows.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(s), F.count(value).alias(n))
    left = _null_safe(rows.drop("p"), sums([*by, fold], "_s1", "_n1"), [*by, fold])
    left = _null_safe(left, sums(by, "_s2", "_n2"), list(by))
    left = _null_safe(left, sums([fold], "_s3", "_n3"), [fold]).join(F.broadcast(rows.agg(F.sum(value).alias("_s4"), F.count(value).alias("_n4"))))
    group = guarded_ratio(F.col("_s2") - F.col("_s1"), F.col("_n2") - F.col("_n1"))
    overall = guarded_ratio(F.col("_s4") - F.col("_s3"), F.col("_n4") - F.col("_n3"))
    return left.withColumn("p", F.coalesce(group, overall)).drop(*[f"_{c}{i}" for c in "sn" for i in range(1, 5)])


def median_baseline(train: DataFrame, rows: DataFrame, y: str = "y") -> DataFrame:
    """Predict the training median for every row (dummy regressor)."""
    m = F.broadcast(quantiles(train, [], y, [0.5]).select(F.col("qs")[0].alias("pred")))
    return rows.drop("pred").join(m)


def generalisation(validation: DataFrame, test: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Test minus validation for each metric, in long form."""
    key = list(by)
    v = validation.select(*key, *[F.col(m).alias(f"_v_{m}") for m in metrics])
    t = test.select(*key, *[F.col(m).alias(f"_t_{m}") for m in metrics])
    j = v.join(t, key) if key else v.join(F.broadcast(t))
    return j.select(*key, F.inline(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"_v_{m}").cast("double").alias("validation"), F.col(f"_t_{m}").cast("double").alias("test"),
        (F.col(f"_t_{m}") - F.col(f"_v_{m}")).cast("double").alias("delta")) for m in metrics])))


def weakest_class(per_class: DataFrame, by: Sequence[str]) -> DataFrame:
    """The class whose recall fell most from validation to test (then by name)."""
    return per_class.groupBy(*by).agg(
        F.min(F.struct(F.round("delta", 12).alias("_d"), F.col("class").alias("class"), F.col("delta").alias("delta"))).alias("_w")).select(
        *by, F.col("_w.class").alias("class"), F.col("_w.delta").alias("delta"))


# --- scoring output: projections, valid on batches and streams alike ------------------------------------------------

def binary_output(df: DataFrame, threshold: float, positive: str, negative: str, p: str = "p") -> DataFrame:
    """Label at the threshold and whether the probability is usable."""
    x = F.col(p)
    ok = x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)
    return df.withColumns({"label": F.when(ok, F.when(x >= threshold, positive).otherwise(negative)), "valid": ok})


def multiclass_output(df: DataFrame, classes: Sequence[str], probs: str = "probs", tolerance: float = 1e-6) -> DataFrame:
    """Class of the largest probability, that probability, and checks of range, length and sum."""
    v = F.col(probs)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    ok = (F.size(v) == len(classes)) & F.forall(v, lambda x: x.isNotNull() & (x >= 0) & (x <= 1)) & (F.abs(total - 1) <= tolerance)
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumns({"top_probability": F.array_max(v), "label": F.element_at(names, F.array_position(v, F.array_max(v)).cast("int")),
                           "valid": F.coalesce(ok, F.lit(False))})


def continuous_output(df: DataFrame, unit: str, pred: str = "pred") -> DataFrame:
    x = F.col(pred)
    return df.withColumns({"unit": F.lit(unit), "valid": x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))})
