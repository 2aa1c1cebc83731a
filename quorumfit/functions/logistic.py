"""Logistic-model expressions on label (-1/+1) and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(y: Column, low: float, low_label: float, domain: str) -> Column:
    wrong = F.raise_error(
        F.concat(F.lit(f"label must be {domain}: "), F.coalesce(y.cast("string"), F.lit("null")))
    )
    return (
        F.when(y == low, F.lit(low_label)).when(y == 1.0, F.lit(1.0)).otherwise(wrong.cast("double"))
    )


def to_binary_label(y: Column) -> Column:
    """-1/+1 to 0/1. Any other label, null included, is an error."""
    return _checked(y, -1.0, 0.0, "-1 or +1")


def to_signed_label(y: Column) -> Column:
    """0/1 to -1/+1. Any other label, null included, is an error."""
    return _checked(y, 0.0, -1.0, "0 or 1")


def sigmoid(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def predicted_class(probability: Column) -> Column:
    """+1 above one half, else -1; a tie goes to -1. Without a probability no class."""
    return F.when(probability > 0.5, F.lit(1.0)).when(probability.isNotNull(), F.lit(-1.0))


def logistic_loss(y: Column, score: Column) -> Column:
    """log(1 + exp(-y*score)), written so that large margins do not overflow."""
    margin = y * score
    return F.when(margin > 0, F.log1p(F.exp(-margin))).otherwise(
        -margin + F.log1p(F.exp(margin))
    )


def gradient_coefficient(y: Column, score: Column) -> Column:
    return -y / (1.0 + F.exp(y * score))


def logistic_gradient(y: Column, x: Column, score: Column) -> Column:
    factor = gradient_coefficient(y, score)
    return F.transform(x, lambda v: v * factor)
