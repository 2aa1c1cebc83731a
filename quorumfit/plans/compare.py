"""Combining run metrics and comparing algorithms."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.schemas import RUN_KEY
from quorumfit.functions.text import nonzero_percent, series_label

# Margins around the accuracy range.
LOW_MARGIN = 0.98
HIGH_MARGIN = 1.01


def union_metrics(frames: Iterable[DataFrame]) -> DataFrame:
    """One table of all runs; a run that occurs in several inputs is kept once.

    A run is its time and its run key. Of rows of one run the one with the most values
    stays, so an older export that lacks columns adds none.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    columns = stacked.columns
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    key = ["timestamp", *RUN_KEY]
    best = F.max_by(F.struct(*columns), F.struct(filled, F.to_json(F.struct(*columns))))
    return stacked.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(best.alias("run")).select("run.*")


def comparison_view(metrics: DataFrame) -> DataFrame:
    """Run metrics under the names of the comparison tables, with the series label and
    the share of non-zero weights."""
    version = F.regexp_replace("spark_version", "_", ".")
    algorithm = F.upper("algorithm")
    return metrics.select(
        version.alias("version"),
        algorithm.alias("algorithm"),
        F.upper("dataset").alias("dataset"),
        "partitions",
        F.col("runtime_sec").alias("runtime_s"),
        F.col("accuracy_percent").alias("accuracy_pct"),
        F.col("actual_iterations").alias("iterations"),
        F.col("model_norm").alias("l2_norm"),
        "non_zero_weights",
        "train_samples",
        "test_samples",
        "features",
        nonzero_percent(F.col("non_zero_weights"), F.col("features")).alias("pct_nonzero"),
        series_label(algorithm, version).alias("series"),
    )


def for_partitions(view: DataFrame, count: int) -> DataFrame:
    return view.filter(F.col("partitions") == count)


def partition_counts(view: DataFrame) -> DataFrame:
    return view.select("partitions").distinct().orderBy("partitions")


def comparison_table(view: DataFrame, measure: str) -> DataFrame:
    """Mean of ``measure`` and accuracy by partition count and series; the mean keeps
    the table stable when a run was repeated."""
    return view.groupBy("partitions", "series").agg(
        F.avg(measure).alias(measure), F.avg("accuracy_pct").alias("accuracy_pct")
    )


def comparison_pivot(view: DataFrame, measure: str, series: list[str]) -> DataFrame:
    """The comparison with one column pair per series. The series are named by the
    caller, so no extra pass looks them up."""
    return (
        view.groupBy("partitions")
        .pivot("series", series)
        .agg(F.avg(measure).alias(measure), F.avg("accuracy_pct").alias("accuracy_pct"))
    )


def accuracy_bounds(view: DataFrame) -> DataFrame:
    return view.agg(
        (F.min("accuracy_pct") * LOW_MARGIN).alias("low"),
        (F.max("accuracy_pct") * HIGH_MARGIN).alias("high"),
    )
