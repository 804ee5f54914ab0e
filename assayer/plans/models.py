"""Model search, ablation and final-fit queries with Spark ML."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer.operators import evaluate as ev
from assayer.operators import modelsearch as ms
from assayer.operators import split as sp
from assayer.plans.registry import query, rounded
from assayer.plans.target import DIMS, labelled, vectors
from assayer.sources.tables import table, work_folder


def binary_rows(spark, sf):
    d = labelled(spark, sf).select("doc_id", "lang", "source", "n_chars", "words", F.col("quality").cast("double").alias("y"))
    return sp.folds(d, ["doc_id"], 3, "y")


@query("l16_binary_search")
def _(spark, sf):
    num, cat = ["n_chars", "words"], ["lang"]
    candidates = ms.grid("logistic", "logistic", num, {"regParam": [0.01, 0.1]}, cat) + ms.grid(
        "tree", "tree", num, {"maxDepth": [2, 4, 6], "minInstancesPerNode": [5, 10]}, cat, sample=1)
    oof = ms.search(binary_rows(spark, sf), candidates, "binary", 3)
    return rounded(ms.cv_summary(ms.cv_table(oof, "binary"), "average_precision"))


@query("l16_regression_search")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("y"))
    rows = sp.folds(li, ["l_orderkey", "l_linenumber", "l_partkey"], 3)
    candidates = [ms.Candidate("ridge", "ridge", ("l_quantity", "l_discount", "l_tax"), params={"regParam": 0.1}),
                  ms.Candidate("tree", "tree", ("l_quantity", "l_discount", "l_tax"), params={"maxDepth": 3})]
    oof = ms.search(rows, candidates, "regression", 3)
    return rounded(ms.cv_summary(ms.cv_table(oof, "regression"), "mae", higher_is_better=False), 2)


@query("l18_feature_ablation")
def _(spark, sf):
    rows = sp.folds(vectors(spark, sf).withColumn("y", F.col("label").cast("double")), ["vec_id"], 3, "label")
    base = ms.Candidate("logistic", "logistic", tuple(DIMS), params={"regParam": 0.01, "maxIter": 20})
    table_ = ms.ablation(rows, base, {"all": DIMS, "first_half": DIMS[:len(DIMS) // 2], "second_half": DIMS[len(DIMS) // 2:]}, "multiclass", 3, [str(i) for i in range(10)])
    return rounded(ms.cv_summary(table_, "macro_f1"))


@query("l21_final_evaluation")
def _(spark, sf):
    parts = sp.split(labelled(spark, sf).withColumn("y", F.col("quality").cast("double")), ["doc_id"], "quality")
    part = lambda p: parts.where(F.col("partition") == p).drop("partition")
    c = ms.Candidate("logistic", "logistic", ("n_chars", "words"), ("lang",), {"regParam": 0.01})
    out = ms.final_evaluation(part("train"), part("validation"), part("test"), c, "binary")
    return rounded(ev.ranking_metrics(out, ["model_id"]).drop("rows").join(ev.probability_losses(out, ["model_id"]), "model_id"))


def stored_model(spark, model):
    """The model after a round trip over the shared folder."""
    path = f"{work_folder(spark)}/model-{uuid.uuid4().hex}"
    ms.save_model(model, path)
    return ms.load_model(path)


LINEAR = """
 f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem WHERE l_linenumber <= 3),
 s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_linenumber = 7 AS bad FROM lineitem WHERE l_linenumber > 3)"""


@query("l20_saved_regression", f"""WITH {LINEAR}
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN NOT bad THEN round(a + b * l_quantity, 4) + 0.0 END AS pred, 'currency units' AS unit, NOT bad AS valid,
 CASE WHEN bad THEN 'not_finite:l_quantity' ELSE '' END AS problems FROM s, f""")
def _(spark, sf):
    """Price by quantity, fitted on the first three lines of each order, stored, loaded, and applied to the others."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    c = ms.Candidate("ridge", "ridge", ("l_quantity",), params={"solver": "normal"})
    model = stored_model(spark, ms.fit_labelled(li.where("l_linenumber <= 3"), c, "regression", "l_extendedprice"))
    new = li.where("l_linenumber > 3").drop("l_extendedprice").withColumn("l_quantity", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")))
    out = ms.score(model, new, "regression", ["l_orderkey", "l_linenumber"], unit="currency units")
    return rounded(out.withColumn("problems", F.array_join("problems", ",")), 4)


@query("l20_saved_tree", """
WITH s AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 10 = 3 THEN 'new' ELSE o_orderstatus END AS status, o_orderkey % 4 = 0 AS train FROM orders),
k AS (SELECT status, o_orderpriority AS c, count(*) AS n FROM s WHERE train AND status <> 'new' GROUP BY 1, 2), t AS (SELECT status, sum(n) AS n FROM k GROUP BY 1),
c AS (SELECT DISTINCT o_orderpriority AS c FROM orders), p AS (SELECT t.status, list(round(coalesce(k.n, 0) / t.n, 9) + 0.0 ORDER BY c.c) AS probs FROM t, c LEFT JOIN k ON k.status = t.status AND k.c = c.c GROUP BY 1),
m AS (SELECT *, list_max(probs) AS top FROM p)
SELECT status, probs[1] AS p1, probs[2] AS p2, probs[3] AS p3, probs[4] AS p4, probs[5] AS p5, list_extract((SELECT list(c ORDER BY c) FROM c), list_position(probs, top)) AS label, round(top, 9) + 0.0 AS top_probability, true AS valid, '' AS problems, count(*) AS rows
FROM s JOIN m USING (status) WHERE NOT train AND status <> 'new' GROUP BY ALL""")
def _(spark, sf):
    """Priority by status: a tree with a leaf per status, whose probabilities are the shares of the classes. Unknown statuses are told apart."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 10 == 3, "new").otherwise(F.col("o_orderstatus")).alias("status"))
    c = ms.Candidate("tree", "tree", (), ("status",), {"maxDepth": 5, "minInfoGain": 0.0, "minInstancesPerNode": 1})
    model = stored_model(spark, ms.fit_labelled(o.where("o_orderkey % 4 = 0 and status <> 'new'"), c, "multiclass", "o_orderpriority"))
    out = ms.score(model, o.where("o_orderkey % 4 <> 0").drop("o_orderpriority"), "multiclass", ["o_orderkey", "status"])
    shares = [(F.round(F.col("probs")[i], 9) + F.lit(0.0)).alias(f"p{i + 1}") for i in range(5)]
    return out.where("status <> 'new'").groupBy("status", *shares, "label", (F.round("top_probability", 9) + F.lit(0.0)).alias("top_probability"), "valid",
                                                F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("rows"))


@query("l21_saved_classifier")
def _(spark, sf):
    """Final fit on train and validation, stored and loaded; the test rows it scores, with their truth."""
    parts = sp.split(labelled(spark, sf).withColumn("grade", F.when(F.col("quality") == 1, "good").otherwise("poor")), ["doc_id"], "quality")
    c = ms.Candidate("logistic", "logistic", ("n_chars", "words"), ("lang",), {"regParam": 0.01})
    model = stored_model(spark, ms.fit_labelled(parts.where("partition <> 'test'"), c, "binary", "grade"))
    test = parts.where("partition = 'test'")
    out = ms.score(model, test.drop("grade"), "binary", ["doc_id"], threshold=0.5)
    return rounded(out.join(test.select("doc_id", "grade"), "doc_id").withColumn("problems", F.array_join("problems", ",")))
