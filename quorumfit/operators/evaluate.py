"""Scoring and evaluation of linear models on example tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.functions import logistic as L
from quorumfit.functions import vectors as V

# Largest weight vector that is placed into the plan as a constant; larger ones are
# broadcast to the tasks.
CONSTANT_WEIGHTS_BYTES = 64 << 10


def score(
    df: DataFrame, weights: Sequence[float], intercept: float = 0.0,
    constant_bytes: int = CONSTANT_WEIGHTS_BYTES,
) -> DataFrame:
    """Add ``score`` = x . w + intercept to dense (``x``) or sparse (``idx``, ``val``)
    examples. Narrow at every width: small weights are a constant of the plan, larger ones
    are broadcast and looked up in Arrow batches.

    The result does not depend on the way: features that only the row or only the model has
    count as zero, and a row with null features has no score.
    """
    small = len(weights) * 8 <= constant_bytes
    if "x" in df.columns:
        value = V.dot(F.col("x"), list(weights)) if small else _gather(df, weights)("x")
    elif small:
        value = V.sparse_dot(F.col("idx"), F.col("val"), list(weights))
    else:
        value = _gather(df, weights)("idx", "val")
    return df.withColumn("score", value + F.lit(float(intercept)))


def _gather(df: DataFrame, weights: Sequence[float]):
    """Arrow function of the inner product with broadcast weights: of a dense row, or of
    the indices and values of a sparse one."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))

    def dot(*columns: pa.Array) -> pa.Array:
        w, rows = shared.value, columns[-1]
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(columns) == 2:
            at = columns[0].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            at = np.arange(len(values)) - np.repeat(starts[:-1], lengths)
        known = (at >= 0) & (at < len(w))
        terms = np.zeros(len(values))
        terms[known] = values[known] * w[at[known]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sums = np.bincount(owner, weights=terms, minlength=len(lengths)).astype(np.float64)
        missing = np.zeros(len(lengths), bool)
        for column in columns:
            missing |= pc.is_null(column).to_numpy(zero_copy_only=False)
        return pa.array(sums, mask=missing)

    if "x" in df.columns:
        @F.arrow_udf("double")
        def dense(x: pa.Array) -> pa.Array:
            return dot(x)

        return dense

    @F.arrow_udf("double")
    def sparse(idx: pa.Array, val: pa.Array) -> pa.Array:
        return dot(idx, val)

    return sparse


def weights_table(spark, weights: Sequence[float]) -> DataFrame:
    """Model as ``(j, weight)`` rows."""
    values = np.asarray(weights, dtype=np.float64)
    table = pa.table({"j": pa.array(np.arange(len(values)), pa.int32()), "weight": values})
    return spark.createDataFrame(table)


def predict(df: DataFrame, weights: Sequence[float], intercept: float = 0.0) -> DataFrame:
    """Add ``score``, ``probability`` and ``predicted`` (-1/+1)."""
    return (
        score(df, weights, intercept)
        .withColumn("probability", L.sigmoid(F.col("score")))
        .withColumn("predicted", L.predicted_class(F.col("probability")))
    )


def correct_predictions(pred: DataFrame, label: str = "y") -> DataFrame:
    return pred.filter(F.col(label) == F.col("predicted"))


def accuracy(pred: DataFrame, label: str = "y") -> DataFrame:
    """One row (correct, total, accuracy) in one pass."""
    hit = F.count_if(F.col(label) == F.col("predicted"))
    return pred.agg(hit.alias("correct"), F.count("*").alias("total")).withColumn(
        "accuracy", F.try_divide(F.col("correct"), F.col("total"))
    )


def label_distribution(df: DataFrame, label: str = "y") -> DataFrame:
    return df.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"))


def feature_dimension(df: DataFrame) -> DataFrame:
    """Dimension of the whole dataset, dense or sparse."""
    width = F.size("x") if "x" in df.columns else F.array_max("idx") + 1
    return df.agg(F.max(width).alias("features"))


def profile(df: DataFrame) -> DataFrame:
    """Row count and label counts of a dataset in one pass."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("y") == -1.0).alias("negative"),
        F.count_if(F.col("y") == 1.0).alias("positive"),
    )


def sample_predictions(pred: DataFrame, k: int = 5, order: str = "id") -> DataFrame:
    """First ``k`` rows by ``order``: a top-k per task, merged; no full sort."""
    return pred.select(order, "y", "score", "probability", "predicted").orderBy(order).limit(k)


def first_row(df: DataFrame, order: str = "id") -> DataFrame:
    return df.orderBy(order).limit(1)


def model_summary(model: DataFrame) -> DataFrame:
    """(norm, nonzero, total) of a ``(j, weight)`` table."""
    return model.agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.count_if(F.abs("weight") > V.NEAR_ZERO).cast("int").alias("nonzero"),
        F.count("*").cast("int").alias("total"),
    )
