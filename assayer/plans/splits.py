"""Split, fold and partition-check queries over customer and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import profile as pr
from assayer.operators import split as sp
from assayer.plans.registry import R, query, rounded
from assayer.sources.tables import table


def hash_order(key: str) -> str:
    return f"md5('42|' || CAST({key} AS VARCHAR)), {key}"


def split_sql(src: str, key: str, klass: str, val: float = 0.2, test: float = 0.2) -> str:
    """Two-stage sizes with largest remainders, then rank by hash."""
    held = val + test
    return f"""
 c0 AS (SELECT {klass} AS k, count(*) AS n FROM {src} GROUP BY 1),
 c1 AS (SELECT *, sum(n) OVER () AS nn, CAST(ceil(round(sum(n) OVER () * {held}, 6)) AS BIGINT) AS h FROM c0),
 c2 AS (SELECT *, n / nn::DOUBLE * (nn - h) AS x FROM c1),
 c3 AS (SELECT *, floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, k) <= (nn - h) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS tr FROM c2),
 c4 AS (SELECT *, n - tr AS r, h - CAST(ceil(round(h * ({test} / {held}), 6)) AS BIGINT) AS vv FROM c3),
 c5 AS (SELECT *, r / sum(r) OVER () * vv AS x2 FROM c4),
 c6 AS (SELECT *, floor(x2) + CASE WHEN row_number() OVER (ORDER BY round(x2 - floor(x2), 9) DESC, k) <= vv - sum(floor(x2)) OVER () THEN 1 ELSE 0 END AS va FROM c5),
 rk AS (SELECT s.*, row_number() OVER (PARTITION BY {klass} ORDER BY {hash_order(key)}) AS rnk FROM {src} s),
 split AS (SELECT rk.*, CASE WHEN rnk <= tr THEN 'train' WHEN rnk <= tr + va THEN 'validation' ELSE 'test' END AS partition FROM rk JOIN c6 ON c6.k = {klass})"""


CUSTOMER_SPLIT = split_sql("customer", "c_custkey", "c_mktsegment")
PART_SPLIT = split_sql("part", "p_partkey", "'all'")


def customer_split(spark, sf):
    return sp.split(table(spark, sf, "customer"), ["c_custkey"], "c_mktsegment")


def part_split(spark, sf):
    return sp.split(table(spark, sf, "part"), ["p_partkey"])


@query("j01_stratified_split", f"WITH {CUSTOMER_SPLIT} SELECT c_custkey, c_mktsegment, partition FROM split")
def _(spark, sf):
    return customer_split(spark, sf).select("c_custkey", "c_mktsegment", "partition")


@query("j01_split_sizes", f"WITH {CUSTOMER_SPLIT} SELECT c_mktsegment AS class, count(*) FILTER (partition = 'train') AS train, count(*) FILTER (partition = 'validation') AS validation, count(*) FILTER (partition = 'test') AS test FROM split GROUP BY 1")
def _(spark, sf):
    return sp.split_sizes(table(spark, sf, "customer"), "c_mktsegment", 0.2, 0.2).select(
        F.col("_class").alias("class"), "train", "validation", "test")


@query("j02_shuffled_split", f"WITH {PART_SPLIT} SELECT p_partkey, partition FROM split")
def _(spark, sf):
    return part_split(spark, sf).select("p_partkey", "partition")


CHECKS = f"""
 sh AS (SELECT c_mktsegment AS k, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS share FROM customer GROUP BY 1), bad AS (SELECT * FROM split WHERE NOT (partition = 'test' AND c_nationkey = 3) UNION ALL SELECT * REPLACE ('train' AS partition) FROM split WHERE partition = 'test' AND c_nationkey = 4),
 pc AS (SELECT partition, c_mktsegment AS k, count(*) AS n, sum(count(*)) OVER (PARTITION BY partition) AS t FROM bad GROUP BY 1, 2),
 q AS (SELECT (SELECT count(*) FROM (SELECT c_custkey FROM bad GROUP BY 1 HAVING count(DISTINCT partition) > 1)) AS o, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM bad)) AS m,
   (SELECT count(*) FROM (SELECT c_custkey FROM bad GROUP BY 1 HAVING count(*) > 1)) AS d, (SELECT count(*) FROM bad WHERE partition = 'train') AS a, (SELECT count(*) FROM bad WHERE partition = 'validation') AS b, (SELECT count(*) FROM bad WHERE partition = 'test') AS c)
SELECT v."check", v.ok, v.detail FROM q, LATERAL (VALUES ('disjoint', o = 0, CAST(o AS VARCHAR)), ('missing', m = 0, CAST(m AS VARCHAR)), ('foreign', true, '0'), ('multiplicity', d = 0, CAST(d AS VARCHAR)),
 ('rows in train', a > 0, CAST(a AS VARCHAR)), ('rows in validation', b > 0, CAST(b AS VARCHAR)), ('rows in test', c > 0, CAST(c AS VARCHAR)), ('columns kept', true, '')) AS v("check", ok, detail)
UNION ALL SELECT 'prevalence in ' || partition || ' of ' || pc.k, abs(n / t::DOUBLE - share) <= 0.02, CAST(n AS VARCHAR) FROM pc JOIN sh USING (k)"""


@query("j03_partition_checks", f"WITH {CUSTOMER_SPLIT}, {CHECKS}")
def _(spark, sf):
    parts = customer_split(spark, sf)
    test = F.col("partition") == "test"
    bad = parts.where(~(test & (F.col("c_nationkey") == 3))).unionByName(
        parts.where(test & (F.col("c_nationkey") == 4)).withColumn("partition", F.lit("train")))
    return sp.partition_checks(table(spark, sf, "customer"), bad, ["c_custkey"], "c_mktsegment")


PROFILE = f"""WITH {PART_SPLIT}, pf AS (SELECT p_brand, p_size, count(*) FILTER (partition = 'train') AS train, count(*) FILTER (partition = 'validation') AS validation, count(*) FILTER (partition = 'test') AS test, count(DISTINCT p_type) AS targets FROM split GROUP BY 1, 2),
 rp AS (SELECT sha256(length(p_brand) || ':' || p_brand || '|' || length(CAST(p_size AS VARCHAR)) || ':' || CAST(p_size AS VARCHAR)) AS profile, train, validation, test, targets, CAST((train > 0)::INT + (validation > 0)::INT + (test > 0)::INT AS BIGINT) AS partitions FROM pf)"""


def profiles_across(spark, sf):
    return sp.repeated_across(part_split(spark, sf), ["p_brand", "p_size"], "p_type")


@query("j04_repeated_across", f"{PROFILE} SELECT *, targets > 1 AS conflict FROM rp WHERE partitions > 1")
def _(spark, sf):
    return rounded(profiles_across(spark, sf))


@query("j04_repeated_summary", f"""{PROFILE} SELECT count(*) AS profiles, CAST(sum(train) AS BIGINT) AS train_rows, CAST(sum(validation) AS BIGINT) AS validation_rows, CAST(sum(test) AS BIGINT) AS test_rows,
 count(*) FILTER (targets > 1) AS conflicting_profiles FROM rp WHERE partitions > 1""")
def _(spark, sf):
    return sp.repeated_summary(profiles_across(spark, sf))


@query("j05_partition_targets", f"""WITH {PART_SPLIT}
SELECT partition, count(*) AS finite_count, round(avg(p_retailprice), 4) + 0.0 AS mean, round(stddev_samp(p_retailprice), 4) + 0.0 AS std, round(min(p_retailprice), 4) + 0.0 AS minimum, round(quantile_cont(p_retailprice, 0.25), 4) + 0.0 AS q25,
 round(median(p_retailprice), 4) + 0.0 AS q50, round(quantile_cont(p_retailprice, 0.75), 4) + 0.0 AS q75, round(max(p_retailprice), 4) + 0.0 AS maximum FROM split GROUP BY 1""")
def _(spark, sf):
    t = pr.continuous_target(part_split(spark, sf), "p_retailprice", ["partition"])
    return rounded(t.select("partition", "finite_count", "mean", "std", "minimum", "q25", "q50", "q75", "maximum"), 4)


FOLDED = f"folded AS (SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hash_order('c_custkey')}) - 1) % 5 AS fold FROM customer)"


@query("j06_folds", f"WITH {FOLDED} SELECT c_custkey, fold FROM folded")
def _(spark, sf):
    return rounded(sp.folds(table(spark, sf, "customer"), ["c_custkey"], 5, "c_mktsegment").select("c_custkey", "fold"))


@query("j06_fold_classes", f"""WITH {FOLDED}, f AS (SELECT unnest(range(0, 5)) AS fold), c AS (SELECT c_mktsegment AS class, count(*) AS n FROM folded GROUP BY 1), v AS (SELECT c_mktsegment AS class, fold, count(*) AS n FROM folded GROUP BY 1, 2)
SELECT class, fold, 'train' AS side, c.n - coalesce(v.n, 0) AS rows FROM c, f LEFT JOIN v USING (class, fold) UNION ALL SELECT class, fold, 'validation', coalesce(v.n, 0) FROM c, f LEFT JOIN v USING (class, fold)""".replace("FROM c, f LEFT JOIN v", "FROM (SELECT * FROM c, f) AS c LEFT JOIN v"))
def _(spark, sf):
    folded = sp.folds(table(spark, sf, "customer"), ["c_custkey"], 5, "c_mktsegment")
    return rounded(sp.fold_classes(folded, "c_mktsegment", 5))


@query("j07_assembled_training", f"WITH {CUSTOMER_SPLIT} SELECT partition AS part, c_mktsegment, count(*) AS rows, round(avg(c_acctbal), 4) + 0.0 AS mean_balance FROM split WHERE partition <> 'test' GROUP BY 1, 2")
def _(spark, sf):
    parts = customer_split(spark, sf)
    both = sp.assemble(*[(p, parts.where(F.col("partition") == p)) for p in ("train", "validation")])
    return rounded(both.groupBy("part", "c_mktsegment").agg(F.count(F.lit(1)).alias("rows"), F.avg("c_acctbal").alias("mean_balance")), 4)
