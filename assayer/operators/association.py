"""Associations between features: Pearson, Spearman, Cramér's V, uncertainty coefficient, eta squared, matrices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import clean, guarded_ratio, norm_text, quantiles, rows_of, running, spread, wide_rows

STRONG, REDUNDANT, STRUCTURAL = 0.80, 0.90, 0.99
FEW = 10_000  # ranks of so many values of a column are broadcast


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def masked_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are present; NULL without spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return guarded_ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson_pairs(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), chunk: int = 40) -> DataFrame:
    """Pairwise-complete Pearson of all column pairs: one aggregate per `chunk` pairs, no row is shuffled."""
    pairs = list(combinations(columns, 2))
    parts = []
    for start in range(0, len(pairs), chunk):
        some = pairs[start:start + chunk]
        used = sorted({c for p in some for c in p})
        base = spread(df.select(*by, *[clean(c).alias(c) for c in used]))
        aggs = [F.count(F.lit(1)).alias("row_count")]
        for i, (a, b) in enumerate(some):
            aggs += [F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"_n{i}"),
                     masked_corr(F.col(a), F.col(b)).alias(f"_r{i}")]
        wide = base.groupBy(*by).agg(*aggs)
        parts.append(rows_of(wide, [{
            "feature_a": F.lit(a), "feature_b": F.lit(b), "valid_rows": F.col(f"_n{i}"),
            "missing_rows": F.col("row_count") - F.col(f"_n{i}"), "pearson": F.col(f"_r{i}"),
        } for i, (a, b) in enumerate(some)], keep=by))
    return reduce(DataFrame.unionByName, parts)


def pair_counts(df: DataFrame, pairs: Sequence[tuple[Column, Column, str, str]]) -> DataFrame:
    """Complete pairs `feature_a, feature_b, x, y` collapsed to counts n before anything else happens.

    One aggregation over grouping sets, one set per pair: rows are multiplied inside generated code
    and combined before the shuffle. All values must share one type.
    """
    names: dict[str, Column] = {}
    for x, y, a, b in pairs:
        names.setdefault(a, x)
        names.setdefault(b, y)
    slot = {n: f"_c{i}" for i, n in enumerate(names)}
    seen: set[frozenset] = set()
    first = [p for p in pairs if not (frozenset(p[2:]) in seen or seen.add(frozenset(p[2:])))]
    turned = [p for p in pairs if not any(p is q for q in first)]  # the same two columns the other way round
    base = df.select(*[c.alias(slot[n]) for n, c in names.items()])
    parts = []
    for start in range(0, len(first), 30):
        some = first[start:start + 30]
        used = sorted({slot[n] for p in some for n in p[2:]})
        bits = {c: 1 << (len(used) - 1 - i) for i, c in enumerate(used)}
        which = {sum(v for c, v in bits.items() if c not in (slot[a], slot[b])): (a, b) for _, _, a, b in some}
        counts = base.groupingSets([[F.col(slot[a]), F.col(slot[b])] for _, _, a, b in some], *used).agg(
            F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
        choose = lambda f: F.coalesce(*[F.when(F.col("_g") == g, f(a, b)) for g, (a, b) in which.items()])
        parts.append(counts.select(
            choose(lambda a, b: F.lit(a)).alias("feature_a"), choose(lambda a, b: F.lit(b)).alias("feature_b"),
            choose(lambda a, b: F.col(slot[a])).alias("x"), choose(lambda a, b: F.col(slot[b])).alias("y"), "n"))
    out = reduce(DataFrame.unionByName, parts).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if turned:
        wanted = reduce(lambda p, q: p | q, [(F.col("feature_a") == b) & (F.col("feature_b") == a) for _, _, a, b in turned])
        out = out.unionByName(out.where(wanted).select(
            F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    return out


def _rank_columns(df: DataFrame, columns: Sequence[str], constant: Sequence[str]) -> DataFrame:
    """Rows with every column replaced by its average rank. Values are ranked once per column and joined back;
    a constant column has one rank and needs no join."""
    slot = {c: f"_v{i}" for i, c in enumerate(columns) if c not in constant}
    rows = df.select(*[F.col(c).alias(s) for c, s in slot.items()], *[F.lit(1.0).alias(c) for c in constant])
    for c in slot:
        values = rows.groupBy(slot[c]).agg(F.count(F.lit(1)).alias("_k"))
        ranks = running(values, [], slot[c], ["_k"]).select(
            F.col(slot[c]).alias("_key"), (F.col("run__k") - F.col("_k") + (F.col("_k") + 1) / F.lit(2.0)).alias("_rank"))
        rows = rows.join(ranks, F.col(slot[c]) == F.col("_key")).drop("_key", slot[c]).withColumnRenamed("_rank", c)
    return rows


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None,
                   pairs: Sequence[tuple[Column, Column, str, str]] | None = None) -> DataFrame:
    """Spearman with average ranks inside each pair's complete rows.

    Columns without a missing value share one ranking, so their pairs need one rank join per column and
    one correlation aggregate. All other pairs are ranked on their own complete rows. Which columns are
    complete is one aggregated row.
    """
    if pairs is not None:
        return _spearman_by_pair(df, pairs)
    df = spread(df.select(*[clean(c).alias(c) for c in columns]))
    facts = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), (F.min(c) == F.max(c)).alias("constant")).alias(c)
                     for c in columns]).first()
    whole = [c for c in columns if facts[c].nulls == 0]
    constant = [c for c in whole if facts[c].constant]
    rest = [(F.col(a), F.col(b), a, b) for a, b in combinations(columns, 2) if not (a in whole and b in whole)]
    parts = [_spearman_by_pair(df, rest)] if rest else []
    if len(whole) > 1:
        dense = pearson_pairs(_rank_columns(df, whole, constant), whole)
        parts.append(dense.select("feature_a", "feature_b", "valid_rows", F.col("pearson").alias("spearman")))
    return reduce(DataFrame.unionByName, parts)


def _spearman_by_pair(df: DataFrame, pairs: Sequence[tuple[Column, Column, str, str]]) -> DataFrame:
    """Ranks of one column of a pair are joined to the rows, which are then summed up per value of the other column.

    With a centred rank `a` of x, all that is needed of the rows of a y is their number and the sum of a; the rank of y is
    the running total of the numbers. A column of at most `FEW` values is taken for x, its ranks are broadcast, and all
    pairs of one y share an aggregate. Only pairs of two columns with more values collapse to (x, y) counts and are joined
    by value. About how many values a column has is the only thing read on the driver; no result depends on it.
    """
    names: dict[str, Column] = {}
    for x, y, a, b in pairs:
        names.setdefault(a, x)
        names.setdefault(b, y)
    base = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(names.values())])
    values = base.agg(*[F.approx_count_distinct(c).alias(c) for c in base.columns]).first()
    slot = {n: f"_c{i}" for i, n in enumerate(names)}
    many, stars = [], {}
    for pair in pairs:
        a, b = pair[2:]
        few = min((a, b), key=lambda n: values[slot[n]])
        if values[slot[few]] > FEW:
            many.append(pair)
        else:
            stars.setdefault(b if few == a else a, []).append((a, b, few))
    parts = [_spearman_of_many(df, many)] if many else []
    for other, star in stars.items():
        for start in range(0, len(star), 30):
            some = star[start:start + 30]
            found = _spearman_of_few(base, [slot[few] for _, _, few in some], slot[other])
            name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in some]), F.col("_f") + 1)
            parts.append(found.select(name(0).alias("feature_a"), name(1).alias("feature_b"), "valid_rows", "spearman"))
    return reduce(DataFrame.unionByName, parts)


def _centred_ranks(values: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """From counts `key…, x, n`: ranks `key…, x, n, _a` less their mean, and `key…, _n, _mid`: rows and mean rank."""
    totals = values.groupBy(*key).agg(F.sum("n").alias("_n")).withColumn("_mid", (F.col("_n") + 1) / F.lit(2.0))
    rank = F.col("run_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    ranks = running(values, key, "x", ["n"]).join(F.broadcast(totals), list(key)).select(*key, "x", "n", (rank - F.col("_mid")).alias("_a"))
    return ranks, totals


def _spearman_of_few(base: DataFrame, columns: Sequence[str], other: str) -> DataFrame:
    """`_f, valid_rows, spearman` of columns of few values, by their place, with one of any number of values."""
    long = base.where(F.col(other).isNotNull()).select(F.col(other).cast("double").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("_f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))).where("x is not null")
    ranks, totals = _centred_ranks(long.groupBy("_f", "x").agg(F.count(F.lit(1)).alias("n")), ["_f"])
    k = range(len(columns))
    per = long.join(F.broadcast(ranks.drop("n")), ["_f", "x"]).groupBy("y").agg(*[m for i in k for m in (
        F.count_if(F.col("_f") == i).alias(f"_k{i}"), F.sum(F.when(F.col("_f") == i, F.col("_a")).otherwise(0.0)).alias(f"_s{i}"))])
    mids = totals.agg(*[F.max(F.when(F.col("_f") == i, F.col("_mid"))).alias(f"_m{i}") for i in k])
    placed = running(per, [], "y", [f"_k{i}" for i in k]).join(F.broadcast(mids))
    at = [F.col(f"run__k{i}") - F.col(f"_k{i}") + (F.col(f"_k{i}") + 1) / F.lit(2.0) - F.col(f"_m{i}") for i in k]
    sums = placed.agg(*[m for i in k for m in (F.sum(F.col(f"_s{i}") * at[i]).alias(f"_p{i}"), F.sum(F.col(f"_k{i}") * at[i] * at[i]).alias(f"_q{i}"))])
    found = rows_of(sums, [{"_f": F.lit(i), "_p": F.col(f"_p{i}"), "_q": F.col(f"_q{i}")} for i in k])
    return _spearman_from(found, ranks, totals, ["_f"])


def _spearman_of_many(df: DataFrame, pairs: Sequence[tuple[Column, Column, str, str]]) -> DataFrame:
    """Rows collapse to (x, y) counts; only values are ordered, spread by range over many tasks."""
    key = ["feature_a", "feature_b"]
    counts = pair_counts(df, pairs)
    ranks, totals = _centred_ranks(counts.groupBy(*key, "x").agg(F.sum("n").alias("n")), key)
    per = counts.join(ranks.drop("n"), [*key, "x"]).groupBy(*key, "y").agg(F.sum("n").alias("_k"), F.sum(F.col("n") * F.col("_a")).alias("_s"))
    at = F.col("run__k") - F.col("_k") + (F.col("_k") + 1) / F.lit(2.0) - F.col("_mid")
    found = running(per, key, "y", ["_k"]).join(F.broadcast(totals), key).groupBy(*key).agg(
        F.sum(F.col("_s") * at).alias("_p"), F.sum(F.col("_k") * at * at).alias("_q"))
    return _spearman_from(found, ranks, totals, key)


def _spearman_from(found: DataFrame, ranks: DataFrame, totals: DataFrame, key: Sequence[str]) -> DataFrame:
    """The correlation from the products `_p` of both ranks, the squares `_q` of one and the ranks of the other."""
    squares = ranks.groupBy(*key).agg(F.sum(F.col("n") * F.col("_a") * F.col("_a")).alias("_r"))
    return found.join(F.broadcast(squares), list(key)).join(F.broadcast(totals), list(key)).select(
        *key, F.col("_n").alias("valid_rows"), guarded_ratio(F.col("_p"), F.sqrt("_r") * F.sqrt("_q")).alias("spearman"))


def numeric_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of all pairs with strength and redundancy flags."""
    j = pearson_pairs(df, columns).join(spearman_pairs(df, columns).drop("valid_rows"), ["feature_a", "feature_b"], "left")
    top = F.greatest(F.abs("pearson"), F.abs("spearman"))
    return j.withColumns({
        "max_association": F.coalesce(top, F.lit(0.0)), "strong": F.coalesce(top >= STRONG, F.lit(False)),
        "redundant": F.coalesce(F.abs("pearson") >= REDUNDANT, F.lit(False))})


def review_list(pairs: DataFrame) -> DataFrame:
    """Strong or redundant pairs in review order: redundant first, strongest first, then names."""
    ordered = pairs.where(F.col("strong") | F.col("redundant"))
    return ordered.orderBy(F.col("redundant").desc(), F.col("max_association").desc(), "feature_a", "feature_b")


def contingency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return pair_counts(spread(df.select(*columns)), [(norm_text(F.col(a).cast("string")), norm_text(F.col(b).cast("string")), a, b)
                            for a, b in combinations(columns, 2)])


def contingency_measures(counts: DataFrame, key: Sequence[str] = ("feature_a", "feature_b")) -> DataFrame:
    """Cramér's V and the uncertainty coefficient in both directions from long counts `key…, x, y, n`.

    chi² = N (Σ n²/(r c) - 1) covers the empty cells; nothing is pivoted, so the number of levels is free.
    """
    key = list(key)
    rows = counts.groupBy(*key, "x").agg(F.sum("n").alias("_r"))
    cols = counts.groupBy(*key, "y").agg(F.sum("n").alias("_c"))
    j = counts.join(rows, [*key, "x"]).join(cols, [*key, "y"])
    n, r, c = F.col("n"), F.col("_r"), F.col("_c")
    s = j.groupBy(*key).agg(
        F.sum("n").alias("valid_rows"), F.sum(n * n / (r * c)).alias("_k"), F.count_distinct("x").alias("levels_a"),
        F.count_distinct("y").alias("levels_b"), F.sum(n * F.ln(r)).alias("_lr"), F.sum(n * F.ln(c)).alias("_lc"),
        F.sum(n * F.ln(n)).alias("_ln"))
    total = F.col("valid_rows")
    h = lambda s_: F.ln(total) - F.col(s_) / total
    s = s.withColumns({"_hx": h("_lr"), "_hy": h("_lc"), "_hxy": h("_ln")})
    many = (F.col("levels_a") > 1) & (F.col("levels_b") > 1)
    v = F.when(many, F.sqrt(clamp(guarded_ratio(F.col("_k") - 1, F.least("levels_a", "levels_b") - 1))))
    u = lambda own, other: F.when(many, clamp(guarded_ratio(F.col(own) - (F.col("_hxy") - F.col(other)), F.col(own))))
    return s.select(*key, "valid_rows", "levels_a", "levels_b", v.alias("cramers_v"), u("_hx", "_hy").alias("u_a_given_b"),
                    u("_hy", "_hx").alias("u_b_given_a"))


def categorical_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = contingency_measures(contingency(df, columns))
    least, most = F.least("u_a_given_b", "u_b_given_a"), F.greatest("u_a_given_b", "u_b_given_a")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return m.withColumns({
        "strong": flag(F.col("cramers_v") >= STRONG), "structural": flag(most >= STRUCTURAL),
        "redundant": flag((F.col("cramers_v") >= REDUNDANT) & (least >= STRUCTURAL))})


def eta_squared(rows: DataFrame, key: Sequence[str], group: str, value: str, weight: str | None = None) -> DataFrame:
    """Between-group share of the variation of value: `key…, valid_rows, groups, eta_squared`.

    Centred on the overall mean first, then two partial aggregations; keys are feature names or pairs.
    """
    key = list(key)
    w = F.col(weight) if weight else F.lit(1.0)
    mean = F.broadcast(rows.groupBy(*key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("_m")))
    d = F.col(value) - F.col("_m")
    per = rows.join(mean, key).groupBy(*key, group).agg(
        F.sum(w).alias("_n"), F.sum(w * d).alias("_d"), F.sum(w * d * d).alias("_q"))
    return per.groupBy(*key).agg(
        F.sum("_n").cast("bigint").alias("valid_rows"), F.count(F.lit(1)).alias("groups"),
        clamp(guarded_ratio(F.sum(F.col("_d") * F.col("_d") / F.col("_n")), F.sum("_q"))).alias("eta_squared"))


def mixed_pairs(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Eta squared of every category and number pair.

    One aggregation over grouping sets, one per category, gives size, mean and variance of every number
    in every level; the rest works on levels.
    """
    slot = {c: f"_g{i}" for i, c in enumerate(categorical)}
    base = spread(df.select(*categorical, *numeric)).select(
        *[norm_text(F.col(c).cast("string")).alias(slot[c]) for c in categorical], *[clean(m).alias(m) for m in numeric])
    used = list(slot.values())
    stats = base.groupingSets([[F.col(g)] for g in used], *used).agg(
        F.grouping_id().alias("_id"), *[x for i, m in enumerate(numeric) for x in (
            F.count(m).alias(f"_n{i}"), F.avg(m).alias(f"_m{i}"), F.var_pop(m).alias(f"_v{i}"))])
    full = (1 << len(used)) - 1
    ids = {c: full - (1 << (len(used) - 1 - i)) for i, c in enumerate(categorical)}
    name = F.coalesce(*[F.when((F.col("_id") == i) & F.col(slot[c]).isNotNull(), F.lit(c)) for c, i in ids.items()])
    long = stats.select(name.alias("category"), F.inline(F.array(*[F.struct(
        F.lit(m).alias("number"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("m"), F.col(f"_v{i}").alias("v"))
        for i, m in enumerate(numeric)]))).where(F.col("category").isNotNull() & (F.col("n") > 0))
    key = ["category", "number"]
    mean = F.broadcast(long.groupBy(*key).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_m")))
    gap = F.col("m") - F.col("_m")
    between, within = F.sum(F.col("n") * gap * gap), F.sum(F.col("n") * F.col("v"))
    return long.join(mean, key).groupBy(*key).agg(
        F.sum("n").alias("valid_rows"), F.count(F.lit(1)).alias("groups"),
        clamp(guarded_ratio(between, between + within)).alias("eta_squared")).withColumn(
        "strong", F.coalesce(F.col("eta_squared") >= STRONG, F.lit(False)))


def product_interaction(df: DataFrame, left: str, right: str, compared: str) -> DataFrame:
    """Agreement of left*right with another column: correlations and absolute and relative differences."""
    base = df.select((clean(left) * clean(right)).alias("interaction"), clean(compared).alias("compared"))
    diff = F.abs(F.col("interaction") - F.col("compared"))
    other = F.abs("compared")
    s = base.agg(
        F.count(F.lit(1)).alias("row_count"), F.count(diff).alias("valid_rows"), masked_corr(F.col("interaction"), F.col("compared")).alias("pearson"),
        F.avg(diff).alias("mean_abs_difference"), F.avg(F.when(other > 0, diff / other)).alias("mean_relative_difference"))
    rank = spearman_pairs(base, ["interaction", "compared"]).select("spearman")
    median = quantiles(base, [], diff, [0.5]).select(F.col("qs")[0].alias("median_abs_difference"))
    return s.join(F.broadcast(rank)).join(F.broadcast(median)).withColumns({
        "interaction": F.lit(f"{left}*{right}"), "compared": F.lit(compared),
        "strong": F.greatest(F.abs("pearson"), F.abs("spearman")) >= STRONG, "redundant": F.abs("pearson") >= REDUNDANT})


def association_matrix(pairs: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """Symmetric wide matrix from pair rows, ones on the diagonal; the pivot columns are the given names."""
    mirrored = pairs.select(F.col("feature_a").alias("feature"), F.col("feature_b").alias("_o"), F.col(value).alias("_v")).unionByName(
        pairs.select(F.col("feature_b").alias("feature"), F.col("feature_a").alias("_o"), F.col(value).alias("_v")))
    return mirrored.groupBy("feature").agg(*[
        F.when(F.col("feature") == c, F.lit(1.0)).otherwise(F.max(F.when(F.col("_o") == c, F.col("_v")))).alias(c) for c in columns])


def feature_issues(df: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Requested columns that are absent or have at most one distinct value."""
    there = [c for c in requested if c in df.columns]
    one = lambda c: F.when(F.max(c).isNull(), 0).when(F.min(c) == F.max(c), 1).cast("bigint")
    counts = wide_rows(df, there, {"distinct_values": one})
    out = counts.where(F.col("distinct_values") <= 1).select(
        "feature", F.lit("Constant feature").alias("issue"), "distinct_values")
    absent = [(c, "Feature missing", 0) for c in requested if c not in df.columns]
    return out.unionByName(df.sparkSession.createDataFrame(absent, out.schema)) if absent else out


def functional_dependencies(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each (determinant, dependent): groups, violating groups and rows; NULL is a value.

    Rows collapse to distinct combinations with partial aggregation, so a frequent determinant is no hot group.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(missing)"))
    df = spread(df.select(*sorted({c for p in pairs for c in p})))
    counts = pair_counts(df, [(text(a), text(b), a, b) for a, b in pairs])
    per = counts.groupBy("feature_a", "feature_b", "x").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"))
    return per.groupBy(F.col("feature_a").alias("determinant"), F.col("feature_b").alias("dependent")).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_k") > 1).alias("violating_groups"),
        F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_n"))), F.lit(0)).alias("violating_rows")).withColumn(
        "holds", F.col("violating_groups") == 0)
