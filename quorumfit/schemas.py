"""Table schemas shared by readers, operators and writers."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("spark_version", T.StringType()),
        T.StructField("train_samples", T.LongType()),
        T.StructField("test_samples", T.LongType()),
        T.StructField("features", T.IntegerType()),
        T.StructField("partitions", T.IntegerType()),
        T.StructField("lambda", T.DoubleType()),
        T.StructField("max_iterations", T.IntegerType()),
        T.StructField("actual_iterations", T.IntegerType()),
        T.StructField("runtime_sec", T.DoubleType()),
        T.StructField("accuracy_percent", T.DoubleType()),
        T.StructField("model_norm", T.DoubleType()),
        T.StructField("non_zero_weights", T.IntegerType()),
        T.StructField("total_weights", T.IntegerType()),
        T.StructField("non_zero_percent", T.DoubleType()),
        T.StructField("convergence_status", T.StringType()),
        T.StructField("train_file", T.StringType()),
        T.StructField("test_file", T.StringType()),
    ]
)

# One run = one row; run_id numbers the runs of one RUN_KEY.
RUN_LOG = T.StructType(METRICS.fields + [T.StructField("run_id", T.IntegerType())])
RUN_KEY = ["spark_version", "dataset", "algorithm", "partitions"]

TRACE = T.StructType(
    [
        T.StructField("iteration", T.IntegerType()),
        T.StructField("primal", T.DoubleType()),
        T.StructField("primal_tol", T.DoubleType()),
        T.StructField("dual", T.DoubleType()),
        T.StructField("rho", T.DoubleType()),
        T.StructField("w_norm", T.DoubleType()),
        T.StructField("z_norm", T.DoubleType()),
        T.StructField("converged", T.BooleanType()),
    ]
)

MODEL = T.StructType(
    [T.StructField("j", T.IntegerType()), T.StructField("weight", T.DoubleType())]
)

# Rows packed per block. A dense chunk leaves `lens` and `idx` empty and holds
# its rows one after another in `val`; a sparse chunk keeps row lengths in `lens`.
# `n_values`, `dim` and `sparse` describe the chunk without reading its arrays.
CHUNK = T.StructType(
    [
        T.StructField("part_id", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("n_values", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("sparse", T.BooleanType()),
        T.StructField("y", T.ArrayType(T.DoubleType())),
        T.StructField("lens", T.ArrayType(T.IntegerType())),
        T.StructField("idx", T.ArrayType(T.IntegerType())),
        T.StructField("val", T.ArrayType(T.DoubleType())),
    ]
)

STATE = T.StructType(
    [
        T.StructField("part_id", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("u", T.ArrayType(T.DoubleType())),
    ]
)
