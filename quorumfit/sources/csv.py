"""CSV readers: headerless dense examples and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumfit.functions.logistic import to_signed_label
from quorumfit.schemas import METRICS
from quorumfit.sources.places import PLACE, numbered, with_places

HIGGS_FEATURES = 28


def read_dense_csv(spark: SparkSession, path: str, width: int = HIGGS_FEATURES) -> DataFrame:
    """Headerless rows of a 0/1 label and ``width`` doubles -> (id, y in -1/+1, x).

    The label is read as text because a file may start with a byte-order mark. An empty
    label, or one that is not 0 or 1, is an error. ``id`` is the number of the row in the
    files, however they are split; counting the rows of the splits is a pass over the labels.
    """
    names = [f"c{j}" for j in range(1, width + 1)]
    schema = T.StructType(
        [T.StructField("label", T.StringType())]
        + [T.StructField(name, T.DoubleType()) for name in names]
    )
    label = F.regexp_replace("label", "^﻿", "").cast("double")
    rows = with_places(spark.read.schema(schema).option("mode", "FAILFAST").csv(path))
    return numbered(rows, rows.select("label", *PLACE)).select(
        "id", to_signed_label(label).alias("y"), F.array(*names).alias("x")
    )


def read_metrics_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_metrics.csv`` below ``folder`` (files, or folders Spark wrote), each with
    a header row, plus the name they came from. Combined exports are left out so that
    combining twice does not double the rows. A header that does not name the metric columns
    in their order, or a cell of another type, is an error."""
    entry = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*_metrics\.csv)(/[^/]*)?$", 1)
    return (
        spark.read.schema(METRICS)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(f"{folder.rstrip('/')}/*_metrics.csv")
        .withColumn("source_file", entry)
        .filter(~F.col("source_file").startswith("combined"))
    )


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """The 20 metric columns with a header."""
    df.select(*METRICS.fieldNames()).write.mode("overwrite").option("header", True).csv(path)
