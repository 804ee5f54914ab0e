"""Candidate search on training rows, ablation of feature sets and the final fit, with Spark ML.

Fits are Spark jobs; a few run at a time. All fold predictions become one keyed table, so the metrics of
every candidate and fold are one aggregate.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import evaluate as ev
from assayer.sources.tables import stored, work_folder

CLASSIFIERS = {"logistic": LogisticRegression, "tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "boosting": GBTClassifier}
REGRESSORS = {"ridge": LinearRegression, "tree": DecisionTreeRegressor, "forest": RandomForestRegressor, "boosting": GBTRegressor}


@dataclass(frozen=True)
class Candidate:
    """One model: family, settings and feature columns."""
    model_id: str
    family: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    params: Mapping[str, object] = field(default_factory=dict)


def grid(model_id: str, family: str, numeric: Sequence[str], space: Mapping[str, Sequence], categorical: Sequence[str] = (),
         sample: int | None = None, seed: int = 42) -> list[Candidate]:
    """All settings of a space, or `sample` of them drawn without repetition."""
    names = sorted(space)
    settings = [dict(zip(names, v)) for v in product(*[space[n] for n in names])]
    if sample is not None and sample < len(settings):
        settings = random.Random(seed).sample(settings, sample)
    return [Candidate(f"{model_id}_{i}", family, tuple(numeric), tuple(categorical), s) for i, s in enumerate(settings)]


def _stages(c: Candidate, kind: str) -> list:
    stages, inputs = [], []
    if c.numeric:
        stages += [VectorAssembler(inputCols=list(c.numeric), outputCol="_num", handleInvalid="error"),
                   StandardScaler(inputCol="_num", outputCol="_std", withMean=True)]
        inputs.append("_std")
    if c.categorical:
        stages.append(StringIndexer(inputCols=list(c.categorical), outputCols=[f"_i_{x}" for x in c.categorical], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{x}" for x in c.categorical], outputCols=[f"_o_{x}" for x in c.categorical], handleInvalid="keep"))
        inputs += [f"_o_{x}" for x in c.categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
    make = (REGRESSORS if kind == "regression" else CLASSIFIERS)[c.family]
    params = dict(c.params)
    if c.family == "ridge":
        params.setdefault("elasticNetParam", 0.0)
    model = make(featuresCol="_features", labelCol="y", **params)
    if kind == "multiclass" and c.family == "boosting":
        model = OneVsRest(classifier=model, featuresCol="_features", labelCol="y")
    return [*stages, model]


def fit(train: DataFrame, c: Candidate, kind: str):
    """Pipeline model on rows with a numeric label `y`.

    A linear model keeps a summary with the table that it was fitted on, and takes it along to every task that predicts,
    which fails if that table cannot be sent. Stored and loaded it is without one.
    """
    model = Pipeline(stages=_stages(c, kind)).fit(train)
    if not getattr(model.stages[-1], "hasSummary", False):
        return model
    path = f"{work_folder(train.sparkSession)}/fit-{uuid.uuid4().hex}"
    save_model(model, path)
    return load_model(path)


def predict(model, rows: DataFrame, c: Candidate, kind: str, keep: Sequence[str]) -> DataFrame:
    """`keep…, model_id, y, p | pred`; families without probabilities leave p NULL."""
    scored = model.transform(rows)
    if kind == "binary":
        out = F.element_at(vector_to_array("probability"), 2).alias("p")
    else:
        out = F.col("prediction").alias("pred")
    return scored.select(*keep, F.lit(c.model_id).alias("model_id"), F.col("y"), out)


def fit_labelled(train: DataFrame, c: Candidate, kind: str, label: str) -> PipelineModel:
    """Pipeline model that learns its classes with its weights: an indexer of `label` (classes in order of their names), then
    the stages of `fit`. A regression takes the label as a number. Rows without a label are not learned from."""
    rows = train.where(F.col(label).isNotNull())
    if kind == "regression":
        return fit(rows.withColumn("y", F.col(label).cast("double")), c, kind)
    named = rows.withColumn(label, F.col(label).cast("string"))
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"), *_stages(c, kind)]).fit(named)


def _labels(model: PipelineModel) -> StringIndexerModel | None:
    return next((s for s in model.stages if isinstance(s, StringIndexerModel) and s.getOrDefault("outputCol") == "y"), None)


def class_order(model: PipelineModel) -> list[str]:
    """The classes in the order of the model's probabilities, read from its fitted indexer; none for a regression."""
    indexer = _labels(model)
    return list(indexer.labels) if indexer is not None else []


def save_model(model: PipelineModel, path: str) -> None:
    """Write the fitted stages to a shared folder; a folder that holds a model already is an error."""
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_problems(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with `problems`: the inputs of the model that are null or not finite, and categories that it never saw.

    The inputs are read from the stages of the model, as are the known categories. An input that rows lack is an error.
    """
    numeric, known = [], {}
    for s in model.stages:
        if isinstance(s, StringIndexerModel) and s is not _labels(model):
            known.update(zip(s.getInputCols(), s.labelsArray, strict=True))
        elif s.hasParam("outputCol") and s.getOrDefault("outputCol") == "_num":
            numeric = s.getInputCols()
    missing = sorted({*numeric, *known} - set(rows.columns))
    if missing:
        raise ValueError(f"inputs of the model are missing: {missing}")
    bad = [F.when(F.coalesce(~(F.abs(F.col(x).cast("double")) < float("inf")), F.lit(True)), F.lit(f"not_finite:{x}")) for x in numeric]
    for x, labels in known.items():
        levels = F.array(*[F.lit(v) for v in labels]) if labels else F.array().cast("array<string>")
        bad.append(F.when(F.col(x).isNull(), F.lit(f"missing:{x}")).when(~F.array_contains(levels, F.col(x).cast("string")), F.lit(f"unknown:{x}")))
    return rows.withColumn("problems", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))


def score(model: PipelineModel, rows: DataFrame, kind: str, keep: Sequence[str], threshold: float = 0.5, unit: str = "") -> DataFrame:
    """`keep…, problems` and the output of a fitted or loaded model, whose rows need no label.

    binary: `p` of the second class, `label` at the threshold, `valid`. multiclass: `probs` in the class order of the model,
    `label`, `top_probability`, `valid`. regression: `pred`, `unit`, `valid`. Rows with a null or not finite input are not
    scored: their output is null and not valid. A category that the model never saw is scored as one of its own.
    """
    indexer = _labels(model)
    stages = PipelineModel([s for s in model.stages if s is not indexer])
    checked = feature_problems(rows, model)
    usable = ~F.exists("problems", lambda x: x.startswith("not_finite:") | x.startswith("missing:"))
    names = [f"_k{i}" for i in range(len(keep))]
    wanted = [f.name for f in checked.schema.fields if f.name not in ("_num", "_std", "_features")]
    kept = checked.select(*wanted, *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], usable.alias("_usable"))
    scored = stages.transform(kept.where("_usable"))
    if kind == "regression":
        new = [F.col("prediction").alias("pred")]
    elif "probability" not in scored.columns:
        raise ValueError("this family has no probabilities to score with")
    elif kind == "binary":
        new = [F.element_at(vector_to_array("probability"), 2).alias("p")]
    else:
        new = [vector_to_array("probability").alias("probs")]
    out = scored.select(*names, "problems", *new).unionByName(kept.where("not _usable").select(*names, "problems"), allowMissingColumns=True)
    if kind == "regression":
        out = ev.continuous_output(out, unit)
    elif kind == "binary":
        negative, positive = class_order(model)
        out = ev.binary_output(out, threshold, positive, negative)
    else:
        out = ev.multiclass_output(out, class_order(model))
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def search(train: DataFrame, candidates: Sequence[Candidate], kind: str, folds: int, parallelism: int = 4) -> DataFrame:
    """Out-of-fold predictions `fold, model_id, y, p | pred` of every candidate; `train` has y and fold 0…k-1.

    The folds are dealt once: fits and predictions start from the stored rows, which are kept in memory while the
    candidates are fitted. The predictions are stored too, as metrics read them more than once.
    """
    rows_ = stored(train, "folds")
    kept = rows_.select("*").persist()

    def run(task):
        c, f = task
        rows = kept.where(F.col("fold") != f)
        return predict(fit(rows, c, kind), rows_.where(F.col("fold") == f), c, kind, ["fold"])
    tasks = [(c, f) for c in candidates for f in range(folds)]
    pool = ThreadPool(min(parallelism, len(tasks)))
    try:
        parts = pool.map(inheritable_thread_target(train.sparkSession)(run), tasks)
    finally:
        pool.close()
        kept.unpersist()
    return stored(reduce(DataFrame.unionByName, parts), "predictions")


def cv_table(oof: DataFrame, kind: str, classes: Sequence[str] = ()) -> DataFrame:
    """One row per candidate and fold with its metrics."""
    by = ["model_id", "fold"]
    if kind == "binary":
        return ev.ranking_metrics(oof, by).drop("rows").join(ev.probability_losses(oof, by), by)
    if kind == "regression":
        return ev.regression_metrics(oof, by, few_groups=True)  # candidates and folds are declared
    whole = oof.select(*by, F.col("y").cast("int").cast("string").alias("y"), F.col("pred").cast("int").cast("string").alias("pred"))
    return ev.multiclass_metrics(ev.confusion(whole, by, classes), by)


def cv_summary(table: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Mean, spread, interval and rank of the candidates by one metric."""
    from pyspark.sql.window import Window
    s = ev.cv_interval(table, ["model_id"], metric)
    order = F.col("cv_mean").desc() if higher_is_better else F.col("cv_mean").asc()
    return s.withColumn("rank", F.row_number().over(Window.orderBy(order, "model_id")))


def ablation(train: DataFrame, base: Candidate, policies: Mapping[str, Sequence[str]], kind: str, folds: int,
             classes: Sequence[str] = ()) -> DataFrame:
    """Cross-validate one family over several feature sets; `model_id` is the policy."""
    candidates = [Candidate(name, base.family, tuple(cols), base.categorical, base.params) for name, cols in policies.items()]
    return cv_table(search(train, candidates, kind, folds), kind, classes)


def final_evaluation(train: DataFrame, validation: DataFrame, test: DataFrame, c: Candidate, kind: str,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Fit on train and validation together, predict test once."""
    model = fit(train.unionByName(validation), c, kind)
    return predict(model, test, c, kind, keep)
