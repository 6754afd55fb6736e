"""Classifiers on feature tables, with pyspark.ml: selection of transform and features, tuning, inference."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.traces import transform_features

MODELS = {"RF": RandomForestClassifier, "LR": LogisticRegression, "SVM": LinearSVC}


def clean(df: DataFrame, features: list[str]) -> DataFrame:
    """NaN, infinite and null features become 0."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c).cast("double")) for c in features})


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the hash of a key: the same rows on any number of partitions."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) / 10_000
    return df.filter(h >= test), df.filter(h < test)


def fit(train: DataFrame, features: list[str], label: str, model: str = "RF", **params) -> PipelineModel:
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {sorted(MODELS)}")
    stage = MODELS[model](labelCol=label, featuresCol="features", **({"seed": 42} if model == "RF" else {}), **params)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), stage]).fit(clean(train, features))


def feature_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def importance(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by importance: that of the forest, or the absolute coefficients."""
    names, last = model.stages[0].getInputCols(), model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: -x[1])


def evaluate(model: PipelineModel, df: DataFrame, features: list[str], label: str, metric: str = "roc_auc") -> float:
    scored = model.transform(clean(df, features))
    if metric == "roc_auc":
        return BinaryClassificationEvaluator(labelCol=label).evaluate(scored)
    if metric == "balanced":
        recall = scored.groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("r"))
        return recall.agg(F.avg("r")).first()[0]
    return MulticlassClassificationEvaluator(labelCol=label, metricName={"accuracy": "accuracy", "f1": "f1"}[metric]).evaluate(scored)


def best_transform(train: DataFrame, test: DataFrame, features: list[str], label: str, model: str = "RF") -> tuple[str, float]:
    scores = {k: evaluate(fit(transform_features(clean(train, features), features, k), features, label, model), transform_features(clean(test, features), features, k), features, label) for k in ("raw", "log", "sqrt", "square")}
    return max(scores.items(), key=lambda x: x[1])


def best_features(train: DataFrame, test: DataFrame, features: list[str], label: str, model: str = "RF") -> tuple[list[str], float]:
    """The top 3, top 5 or all features by importance, whichever scores best."""
    ranked = [f for f, _ in importance(fit(train, features, label, model))]
    tried = {n: evaluate(fit(train, ranked[:n], label, model), test, ranked[:n], label) for n in sorted({min(3, len(ranked)), min(5, len(ranked)), len(ranked)})}
    n = max(tried, key=tried.get)
    return ranked[:n], tried[n]


def tune(train: DataFrame, features: list[str], label: str, model: str, grid: dict[str, list], folds: int = 5) -> PipelineModel:
    stage = MODELS[model](labelCol=label, featuresCol="features")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(stage.getParam(name), values)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), stage])
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), numFolds=folds, seed=42, evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"))
    return cv.fit(clean(train, features)).bestModel


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prediction; a feature that the model needs and df lacks is an error."""
    names = model.stages[0].getInputCols()
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing features: {missing}")
    return model.transform(clean(df, names)).drop("features", "rawPrediction", "probability")


def pass_rates(predicted: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    """Per key: rows, those predicted 1, and their share, 0 where there are none."""
    kept = F.count_if(F.col(prediction) == 1)
    return predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), kept.alias("n_kept"), F.coalesce(F.try_divide(kept, F.count(F.lit(1))), F.lit(0.0)).alias("pass_rate"))


def filter_predicted(rows: DataFrame, keys: list[str], order: str, prediction: str = "prediction") -> DataFrame:
    """The rows predicted 1, renumbered within keys by filtered_index."""
    from tracewell.operators.labels import filtered_index

    return filtered_index(rows.filter(F.col(prediction) == 1), keys, order)


def gated_filter(rows: DataFrame, keys: list[str], order: str, model: PipelineModel | None, transform: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(kept rows, pass rates) by a classifier on its own features, transformed as in training; without a model all rows pass."""
    if model is None:
        scored = rows.withColumn("prediction", F.lit(1.0))
    else:
        names = feature_names(model)
        raw = clean(rows, names).withColumns({f"raw_{c}": F.col(c) for c in names})
        scored = predict(model, transform_features(raw, names, transform)).withColumns({c: F.col(f"raw_{c}") for c in names}).drop(*[f"raw_{c}" for c in names])
    return filter_predicted(scored, keys, order), pass_rates(scored, keys)
