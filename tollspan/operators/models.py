"""Accident classifiers as Spark ML pipelines."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.session import fresh_path

KINDS = ("forest", "boosting", "svm")


def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def balanced_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Weight n / (2 n_class) per row."""
    n = {r[target]: r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    weight = F.lit(None).cast("double")
    for cls, count in n.items():
        weight = F.when(F.col(target) == cls, F.lit(total / (2.0 * count))).otherwise(weight)
    return df.withColumn("weight", weight)


def _fourier(train: DataFrame, features: Sequence[str], width: int, gamma: float, seed: int) -> list:
    """Random Fourier columns that stand for a radial kernel over scaled features."""
    row = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]
    ).first()
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (width, len(features)))
    b = rng.uniform(0, 2 * math.pi, width)
    scaled = ", ".join(
        f"(`{c}` - ({float(row[f'm{i}'] or 0.0)!r}D)) / {float(row[f's{i}'] or 1.0)!r}D" for i, c in enumerate(features)
    )
    # the phase rides along as one more weight, of a feature that is always 1
    rows = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in (*w[j], b[j])) + ")" for j in range(width))
    names = [f"_k{j}" for j in range(width)]
    return [
        SQLTransformer(statement=f"SELECT *, array({scaled}, 1.0D) AS _z FROM __THIS__"),
        SQLTransformer(
            statement=f"SELECT *, transform(array({rows}), w -> {math.sqrt(2.0 / width)!r}D * "
            "cos(aggregate(zip_with(_z, w, (a, c) -> a * c), 0.0D, (s, v) -> s + v))) AS _k FROM __THIS__"
        ),
        SQLTransformer(statement=f"SELECT *, {', '.join(f'_k[{j}] AS {n}' for j, n in enumerate(names))} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol="x"),
    ]


def fit_model(train: DataFrame, features: Sequence[str], kind: str = "forest", params: dict | None = None, seed: int = 42) -> PipelineModel:
    """Forest with balanced classes, boosted trees with logistic loss, or a calibrated SVM."""
    p = params or {}
    features = list(features)
    data = _filled(train, features).withColumn("target", F.col("target").cast("double"))
    assemble = VectorAssembler(inputCols=features, outputCol="x")
    if kind == "forest":
        data = balanced_weights(data)
        model = RandomForestClassifier(
            featuresCol="x", labelCol="target", weightCol="weight", numTrees=int(p.get("n_trees", 100)),
            maxDepth=int(p.get("max_depth", 10)), seed=seed,
        )
        stages = [assemble, model]
    elif kind == "boosting":
        model = GBTClassifier(
            featuresCol="x", labelCol="target", maxIter=int(p.get("n_trees", 100)), maxDepth=int(p.get("max_depth", 5)),
            stepSize=float(p.get("rate", 0.1)), subsamplingRate=float(p.get("subsample", 1.0)),
            featureSubsetStrategy=str(p.get("column_sample", 1.0)), seed=seed,
        )
        stages = [assemble, model]
    elif kind == "svm":
        n = data.count()
        if p.get("kernel", "linear") == "rbf":
            gamma = float(p.get("gamma", 1.0 / len(features)))
            stages = _fourier(data, features, int(p.get("width", 64)), gamma, seed)
        else:
            stages = [
                VectorAssembler(inputCols=features, outputCol="raw"),
                StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True),
            ]
        stages += [
            LinearSVC(featuresCol="x", labelCol="target", regParam=1.0 / (float(p.get("c", 1.0)) * max(n, 1)),
                      maxIter=int(p.get("max_iter", 50)), rawPredictionCol="margin", predictionCol="side"),
            LogisticRegression(featuresCol="margin", labelCol="target", maxIter=int(p.get("max_iter", 50))),
        ]
    else:
        raise ValueError(f"kind must be one of {KINDS}")
    data = data.persist()
    model = _fitted(stages, data)
    data.unpersist()
    return model


def _fitted(stages: Sequence, data: DataFrame) -> PipelineModel:
    """The pipeline's model, without training summaries.

    A summary keeps the session, which cannot be sent to tasks once anything in it has been observed (a stream,
    for one); a model written and read again has none.
    """
    done = []
    for stage in stages:
        if isinstance(stage, Estimator):
            stage = stage.fit(data)
            if getattr(stage, "hasSummary", False):
                path = fresh_path(data.sparkSession, "model")
                stage.write().save(path)
                stage = type(stage).load(path)
        done.append(stage)
        data = stage.transform(data)
    return PipelineModel(done)


def with_score(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add `score`, the positive probability (or the margin of a model without one)."""
    out = model.transform(_filled(df, features))
    source = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("score", vector_to_array(source)[1]).select(*df.columns, "score")


def feature_importance(train: DataFrame, features: Sequence[str], n_trees: int = 100, max_depth: int = 10, seed: int = 42) -> DataFrame:
    """Importance of each feature in a class-balanced forest, highest first."""
    model = fit_model(train, features, "forest", {"n_trees": n_trees, "max_depth": max_depth}, seed)
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((c, float(v)) for c, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return train.sparkSession.createDataFrame(rows, "variable string, importance double")


def save_model(model: PipelineModel, folder: str, run_id: str) -> str:
    path = f"{folder.rstrip('/')}/{run_id}"
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
