"""Metrics of nested segments in one pass: whole, segment, subsegment, from sums that add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import guarded_ratio
from assayer.operators.evaluate import binary_rates, or_zero

# `grouping` tells which levels a row sums over: bit i from the right is set for the i-th level from the last. A NULL in a level
# whose bit is not set is a segment of rows without a value.


def binary_rollup(scored: DataFrame, levels: Sequence[str], threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """`levels…, grouping, rows, tp, fp, fn, tn` and the rates at the threshold, of every segment of every level and of all rows.

    Rows are combined per segment of all levels before they are shuffled; each level adds up those. Rows without a
    truth or score are counted in rows alone.
    """
    called, truth = F.col(p) >= threshold, F.col(y) == 1
    known = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(y).isNotNull()
    cells = scored.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(known & called & truth).alias("tp"), F.count_if(known & called & ~truth).alias("fp"),
        F.count_if(known & ~called & truth).alias("fn"), F.count_if(known & ~called & ~truth).alias("tn"))
    sums = cells.rollup(*levels).agg(F.grouping_id().alias("grouping"), *[F.sum(c).alias(c) for c in ("rows", "tp", "fp", "fn", "tn")])
    rates = binary_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return sums.withColumns(rates)


def _exact(c: Column) -> Column:
    """A double as a decimal: sums of these have no order."""
    return c.cast("decimal(38,9)")


def regression_rollup(scored: DataFrame, levels: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """`levels…, grouping, rows, mae, rmse, residual_mean, r2, max_error` of every segment of every level and of all rows.

    All come from five sums per segment, kept as decimals of nine digits after the point, so that levels add up exactly
    and the order of rows has no effect. Rows whose truth or prediction is missing or not finite are left out.
    """
    t, e = F.col(y).cast("double"), F.col(pred).cast("double") - F.col(y).cast("double")
    fine = F.coalesce(F.abs(t) < float("inf"), F.lit(False)) & F.coalesce(F.abs(e) < float("inf"), F.lit(False))
    rows = scored.where(fine).select(*levels, t.alias("_t"), e.alias("_e"))
    measures = {"_a": F.abs("_e"), "_q": F.col("_e") * F.col("_e"), "_s": F.col("_e"), "_y": F.col("_t"), "_z": F.col("_t") * F.col("_t")}
    cells = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs("_e")).alias("max_error"), *[F.sum(_exact(v)).alias(k) for k, v in measures.items()])
    sums = cells.rollup(*levels).agg(F.grouping_id().alias("grouping"), F.sum("rows").alias("rows"), F.max("max_error").alias("max_error"), *[F.sum(k).alias(k) for k in measures])
    mean = {k: F.col(k).cast("double") / F.col("rows") for k in measures}
    return sums.where("rows > 0").select(
        *levels, "grouping", "rows", mean["_a"].alias("mae"), F.sqrt(mean["_q"]).alias("rmse"), (-mean["_s"]).alias("residual_mean"),
        (1 - guarded_ratio(mean["_q"], mean["_z"] - mean["_y"] * mean["_y"])).alias("r2"), "max_error")


def multiclass_rollup(scored: DataFrame, levels: Sequence[str], classes: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """`levels…, grouping, rows, undeclared, accuracy, macro_f1, weighted_f1, balanced_accuracy, minimum_recall` of every segment.

    Cells of the confusion matrix are counted once per finest segment and added up for each level. A segment with a
    label or prediction that is missing or not declared has no metrics, only the number of such rows.
    """
    text = lambda c: F.col(c).cast("string")
    ok = F.coalesce(text(y).isin(*classes) & text(pred).isin(*classes), F.lit(False))
    cells = scored.groupBy(*levels, F.when(ok, text(y)).alias("_a"), F.when(ok, text(pred)).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sets = [[*[F.col(c) for c in levels[:k]], F.col("_a"), F.col("_p")] for k in range(len(levels), -1, -1)]
    nested = cells.groupingSets(sets, *[F.col(c) for c in levels], F.col("_a"), F.col("_p")).agg(F.grouping_id().alias("_g"), F.sum("_n").alias("_n")).withColumn(
        "grouping", F.shiftright("_g", 2)).drop("_g")
    by = [*levels, "grouping"]
    side = lambda c, s, d, t: F.struct(c.alias("class"), s.alias("support"), d.alias("called"), t.alias("tp"))
    zero, n = F.lit(0).cast("long"), F.col("_n")
    known = F.array(side(F.col("_a"), n, zero, F.when(F.col("_a") == F.col("_p"), n).otherwise(zero)), side(F.col("_p"), zero, n, zero),
                    *[side(F.lit(c), zero, zero, zero) for c in classes])
    rows = nested.select(*by, F.when(F.col("_a").isNull(), n).otherwise(zero).alias("undeclared"), F.inline(known))
    per = rows.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")], F.sum(F.when(F.col("class").isNull(), F.col("undeclared"))).alias("_u"))
    precision, recall = or_zero(F.col("tp"), F.col("called")), or_zero(F.col("tp"), F.col("support"))
    scored_classes = per.withColumns({"_r": recall, "_f": or_zero(2 * precision * recall, precision + recall)})
    real, total = F.col("class").isNotNull(), F.sum(F.when(F.col("class").isNotNull(), F.col("support")))
    seen = F.when(real & (F.col("support") > 0), F.col("_r"))
    # a cell of undeclared rows is told twice, as a label and as a prediction
    foreign = F.coalesce(F.sum("_u"), F.lit(0)) / 2
    measures = {"accuracy": F.sum(F.when(real, F.col("tp"))) / total, "macro_f1": F.avg(F.when(real, F.col("_f"))), "weighted_f1": F.sum(F.when(real, F.col("_f") * F.col("support"))) / total,
                "balanced_accuracy": F.avg(seen), "minimum_recall": F.min(F.when(real, F.col("_r")))}
    return scored_classes.groupBy(*by).agg(total.alias("rows"), foreign.cast("long").alias("undeclared"), *[m.alias(k) for k, m in measures.items()]).select(
        *by, "rows", "undeclared", *[F.when(F.col("undeclared") == 0, F.col(k)).alias(k) for k in measures])
