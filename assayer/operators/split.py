"""Deterministic splits and folds, and checks of partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import hash_rank, join_small, to_text
from assayer.functions.ranks import _null_safe
from assayer.operators.identity import row_fingerprint

PARTS = ("train", "validation", "test")


def _apportion(counts: DataFrame, share: str, draws: str, name: str) -> DataFrame:
    """Largest-remainder allocation of `draws` over the classes by `share`; one row per class, so windows are small."""
    whole = Window.partitionBy(F.lit(1))
    exact = F.col(share) / F.sum(share).over(whole) * F.col(draws)
    step = counts.withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    step = step.withColumn("_left", F.col(draws) - F.sum("_f").over(whole)).withColumn(
        "_o", F.row_number().over(whole.orderBy((F.round(F.col("_x") - F.col("_f"), 9)).desc(), "_class")))
    return step.withColumn(name, (F.col("_f") + F.when(F.col("_o") <= F.col("_left"), 1).otherwise(0)).cast("bigint")).drop(
        "_x", "_f", "_left", "_o")


def split_sizes(df: DataFrame, target: str | None, validation: float, test: float) -> DataFrame:
    """Rows per class and partition: held-out size rounded up, then its test part rounded up, classes by largest remainder."""
    key = to_text(target) if target else F.lit("all")
    counts = df.groupBy(key.alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(F.lit(1))
    total = F.sum("_n").over(whole)
    held = F.ceil(F.round(total * (validation + test), 6))
    sized = counts.withColumns({"_train": (total - held).cast("bigint"), "_held": held.cast("bigint")})
    sized = _apportion(sized, "_n", "_train", "train").withColumn("_rest", F.col("_n") - F.col("train"))
    tests = F.ceil(F.round(F.col("_held") * (test / (validation + test)), 6))
    sized = sized.withColumn("_val", (F.col("_held") - tests).cast("bigint"))
    sized = _apportion(sized, "_rest", "_val", "validation")
    return sized.select("_class", "_n", "train", "validation", (F.col("_rest") - F.col("validation")).alias("test"))


def split(df: DataFrame, keys: Sequence[str], target: str | None = None, validation: float = 0.2, test: float = 0.2,
          seed: str = "42") -> DataFrame:
    """Add `partition` (train, validation, test), stratified by the target if given, whatever the input order.

    A row's place comes from the hash of its key, ranked in two levels, so a class that holds most
    rows is spread over many tasks. Sizes are exact.
    """
    sizes = split_sizes(df, target, validation, test)
    tagged = df.withColumn("_class", to_text(target) if target else F.lit("all"))
    ranked = hash_rank(tagged, ["_class"], keys, seed, "_rank")
    placed = join_small(ranked, sizes.drop("_n", "test"), ["_class"])
    part = (F.when(F.col("_rank") <= F.col("train"), PARTS[0])
            .when(F.col("_rank") <= F.col("train") + F.col("validation"), PARTS[1]).otherwise(PARTS[2]))
    return placed.withColumn("partition", part).drop("_class", "_rank", "train", "validation")


def folds(df: DataFrame, keys: Sequence[str], k: int, target: str | None = None, seed: str = "42") -> DataFrame:
    """Add `fold` 0…k-1, stratified by the target if given."""
    tagged = df.withColumn("_class", to_text(target) if target else F.lit("all"))
    ranked = hash_rank(tagged, ["_class"], keys, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_class", "_rank")


def fold_classes(folded: DataFrame, target: str, k: int) -> DataFrame:
    """Class counts on the training and validation side of every fold; one aggregate over the rows."""
    counts = folded.groupBy(to_text(target).alias("class")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("fold") == i).alias(f"_f{i}") for i in range(k)])
    sides = [F.struct(F.lit(i).alias("fold"), F.lit(side).alias("side"), n.alias("rows")) for i in range(k)
             for side, n in (("train", F.col("_n") - F.col(f"_f{i}")), ("validation", F.col(f"_f{i}")))]
    return counts.select("class", F.inline(F.array(*sides)))


def partition_checks(source: DataFrame, parts: DataFrame, keys: Sequence[str], target: str | None = None,
                     tolerance: float = 0.02, names: Sequence[str] = PARTS) -> DataFrame:
    """Check table `check, ok, detail`: columns, disjointness, coverage, row content, classes and prevalence."""
    keys = list(keys)
    columns = [c for c in parts.columns if c != "partition"]
    lacking = sorted(set(source.columns) - set(columns))
    by_key = parts.groupBy(*keys).agg(F.count_distinct("partition").alias("_p"), F.count(F.lit(1)).alias("_n"))
    overlap = by_key.agg(F.count_if(F.col("_p") > 1).alias("n")).select(
        F.lit("disjoint").alias("check"), (F.col("n") == 0).alias("ok"), to_text("n").alias("detail"))
    src = source.select(F.lit(1).alias("_s"), F.lit(0).alias("_q"), *keys, row_fingerprint(source, source.columns).alias("_h"))
    prt = parts.select(F.lit(0).alias("_s"), F.lit(1).alias("_q"), *keys, row_fingerprint(parts, source.columns).alias("_h"))
    both = src.unionByName(prt).groupBy(*keys, "_h").agg(F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    content = both.agg(
        F.coalesce(F.sum(F.when(F.col("_q") == 0, F.col("_s"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("_s") == 0, F.col("_q"))), F.lit(0)).alias("foreign"),
        F.count_if((F.col("_s") > 0) & (F.col("_q") > 0) & (F.col("_s") != F.col("_q"))).alias("multiplicity"))
    say = lambda n: F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("ok"), to_text(n).alias("detail"))
    out = [overlap, content.select(F.inline(F.array(say("missing"), say("foreign"), say("multiplicity"))))]
    sized = parts.agg(*[F.count_if(F.col("partition") == p).alias(p) for p in names])
    out.append(sized.select(F.inline(F.array(*[
        F.struct(F.lit(f"rows in {p}").alias("check"), (F.col(p) > 0).alias("ok"), to_text(p).alias("detail")) for p in names]))))
    out.append(sized.select(F.lit("columns kept").alias("check"), F.lit(not lacking).alias("ok"), F.lit(",".join(lacking)).alias("detail")))
    if target:
        out.append(prevalence_checks(source, parts, target, tolerance, names))
    return reduce(DataFrame.unionByName, out)


def prevalence_checks(source: DataFrame, parts: DataFrame, target: str, tolerance: float, names: Sequence[str]) -> DataFrame:
    whole = source.groupBy(to_text(target).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    whole = whole.withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1))))
    counts = parts.groupBy(to_text(target).alias("_c")).agg(*[F.count_if(F.col("partition") == p).alias(p) for p in names])
    total = Window.partitionBy(F.lit(1))
    joined = _null_safe(whole, counts, ["_c"]).withColumns({f"_t_{p}": F.sum(p).over(total) for p in names})
    rows = []
    for p in names:
        gap = F.abs(F.col(p) / F.col(f"_t_{p}") - F.col("_share"))
        rows.append(F.struct(F.concat(F.lit(f"prevalence in {p} of "), F.coalesce("_c", F.lit("(missing)"))).alias("check"),
                             ((F.col(p) > 0) & (gap <= tolerance)).alias("ok"), to_text(p).alias("detail")))
    return joined.select(F.inline(F.array(*rows)))


def repeated_across(parts: DataFrame, features: Sequence[str], target: str | None = None,
                    names: Sequence[str] = PARTS) -> DataFrame:
    """Feature profiles (by content hash) present in more than one partition, with counts and target conflicts."""
    hashed = parts.select("partition", row_fingerprint(parts, features).alias("profile"),
                          *([F.coalesce(to_text(target), F.lit("(missing)")).alias("_t")] if target else []))
    aggs = [F.count_if(F.col("partition") == p).alias(p) for p in names]
    if target:
        aggs.append(F.count_distinct("_t").alias("targets"))
    present = reduce(lambda a, b: a + b, [(F.col(p) > 0).cast("int") for p in names])
    out = hashed.groupBy("profile").agg(*aggs).withColumn("partitions", present).where(F.col("partitions") > 1)
    return out.withColumn("conflict", F.col("targets") > 1) if target else out


def repeated_summary(repeated: DataFrame, names: Sequence[str] = PARTS) -> DataFrame:
    conflict = F.col("conflict") if "conflict" in repeated.columns else F.lit(False)
    return repeated.agg(
        F.count(F.lit(1)).alias("profiles"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"{p}_rows") for p in names],
        F.count_if(conflict).alias("conflicting_profiles"))


def assemble(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Union of partitions by column name with the name of the part each row came from."""
    return reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(name)) for name, df in parts])
