"""Spark ML's own L-BFGS logistic regression, the model to compare with."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.functions.logistic import sigmoid, to_binary_label
from quorumfit.operators import evaluate
from quorumfit.sources.libsvm import to_ml_vectors


@dataclass
class BaselineModel:
    weights: np.ndarray
    intercept: float
    iterations: int
    converged: bool
    runtime_sec: float

    def weights_df(self, spark) -> DataFrame:
        """(j, weight), without the intercept."""
        return evaluate.weights_table(spark, self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``label`` and ``predicted``, both in 0/1, next to the input columns."""
        scored = evaluate.score(df, self.weights, self.intercept)
        positive = sigmoid(F.col("score")) > 0.5
        return (
            scored.withColumn("label", to_binary_label(F.col("y")))
            .withColumn("predicted", positive.cast("double")).drop("score")
        )


# Bytes of examples that one task can go through in every iteration.
TASK_BYTES = 16 << 20


def _few_tasks(df: DataFrame) -> DataFrame:
    """Small data in as few tasks as its size asks for: every iteration is a job, and its
    time is that of starting the tasks."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(1, -(-size // TASK_BYTES))
    return df.coalesce(tasks) if tasks < df.rdd.getNumPartitions() else df


def fit_lbfgs(
    df: DataFrame,
    reg: float = 0.01,
    max_iter: int = 100,
    tol: float = 1e-6,
    aggregation_depth: int = 2,
) -> BaselineModel:
    """Binary logistic regression with intercept on standardised features. Raise
    ``aggregation_depth`` with the number of tasks times the dimension."""
    started = time.time()
    ready = _few_tasks(to_ml_vectors(df).select("label", "features"))
    model = LogisticRegression(
        regParam=reg,
        elasticNetParam=0.0,
        maxIter=max_iter,
        tol=tol,
        fitIntercept=True,
        standardization=True,
        aggregationDepth=aggregation_depth,
    ).fit(ready)
    iterations = model.summary.totalIterations
    return BaselineModel(
        weights=model.coefficients.toArray(),
        intercept=float(model.intercept),
        iterations=iterations,
        converged=iterations < max_iter,
        runtime_sec=time.time() - started,
    )


