"""Queries that write files and read them back: LibSVM, CSV, weights, reports, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.operators import evaluate
from quorumfit.plans import compare, runs
from quorumfit.registry import fixtures as X
from quorumfit.registry.catalog import query
from quorumfit.schemas import METRICS, RUN_KEY, RUN_LOG
from quorumfit.session import fresh_path
from quorumfit.sources import libsvm
from quorumfit.plans.runs import ExampleSet
from quorumfit.sources.csv import read_dense_csv, read_metrics_csv, write_metrics_csv

r, sql_r = X.r, X.sql_r


def _by_feature(examples):
    """(y, j, n, total) of sparse examples; text files carry no row ids to compare."""
    return (
        examples.select("y", F.explode(F.arrays_zip("idx", "val")).alias("e"))
        .groupBy("y", F.col("e.idx").alias("j"))
        .agg(F.count("*").alias("n"), r(F.sum("e.val"), 4).alias("total"))
    )


BY_FEATURE = f"SELECT y, j, count(*) AS n, {sql_r('sum(v)', 4)} AS total FROM"


@query(f"WITH {X.EX} {BY_FEATURE} exj GROUP BY y, j")
def scan_libsvm(spark, sf_dir):
    dense = X.ex_emb(spark, sf_dir)
    path = fresh_path(spark, "libsvm")
    libsvm.write_libsvm(X.as_sparse(dense), path, base=1)
    return _by_feature(libsvm.read_libsvm(spark, path, X.width(dense)))


@query(f"WITH {X.EX_SPARSE} {BY_FEATURE} sp GROUP BY y, j")
def scan_libsvm_tolerant(spark, sf_dir):
    """0-based text with the base and dimension found from the data."""
    path = fresh_path(spark, "libsvm")
    libsvm.write_libsvm(X.ex_sparse(spark, sf_dir), path, base=0)
    return _by_feature(libsvm.read_libsvm_tolerant(spark, path).examples)


@query(
    f"""WITH {X.EX_SPARSE} SELECT CAST(base AS INTEGER) AS base, id, y, j, {sql_r('v')} AS v
    FROM sp, (VALUES (0), (1)) b(base)"""
)
def parse_libsvm_lines(spark, sf_dir):
    """Row by row: the same examples come back from 0-based and from 1-based lines."""
    rows = X.ex_sparse(spark, sf_dir)
    parsed = []
    for base in (0, 1):
        found = libsvm.parse_lines(X.libsvm_lines(rows, base))
        parsed.append(found.examples.withColumn("base", F.lit(found.index_base)))
    return (
        parsed[0]
        .unionByName(parsed[1])
        .select("base", "id", "y", F.explode(F.arrays_zip("idx", "val")).alias("e"))
        .select("base", "id", "y", F.col("e.idx").alias("j"), r("e.val").alias("v"))
    )


@query(
    f"""WITH {X.EX_SPARSE}, later AS (SELECT * FROM sp WHERE id % 3 > 0)
    SELECT 'higgs' AS dataset, 'train' AS side, * FROM ({BY_FEATURE} sp GROUP BY y, j)
    UNION ALL SELECT 'higgs', 'test', * FROM ({BY_FEATURE} later GROUP BY y, j)
    UNION ALL SELECT 'rcv1', 'train', * FROM ({BY_FEATURE} sp GROUP BY y, j)
    UNION ALL SELECT 'rcv1', 'test', * FROM ({BY_FEATURE} later GROUP BY y, j)"""
)
def load_by_dataset(spark, sf_dir):
    """The dataset name picks the reader: tolerant for one, standard for the other. No test
    row has the first feature; the index base found over both files keeps its places."""
    rows = X.ex_sparse(spark, sf_dir)
    width = rows.agg(F.max("size")).first()[0]
    loaded = []
    for name, base in (("higgs", 0), ("rcv1", 1)):
        folder = fresh_path(spark, name)
        libsvm.write_libsvm(rows, f"{folder}/train", base)
        libsvm.write_libsvm(rows.filter(F.col("id") % 3 > 0), f"{folder}/test", base)
        data = ExampleSet.load(spark, name, folder, "train", "test", num_features=width)
        for side, examples in (("train", data.train), ("test", data.test)):
            loaded.append(
                _by_feature(examples)
                .withColumn("dataset", F.lit(name)).withColumn("side", F.lit(side))
            )
    return reduce(DataFrame.unionByName, loaded)


@query(
    f"""WITH {X.EX}, folded AS (SELECT id, y, CAST(j % 28 AS INTEGER) AS j, sum(v) AS v
                               FROM exj GROUP BY ALL)
    {BY_FEATURE} folded GROUP BY y, j"""
)
def scan_dense_csv(spark, sf_dir):
    """Headerless label + 28 doubles; here the embedding folded onto 28 columns."""
    fold = [
        F.aggregate(F.filter("x", lambda v, j: j % 28 == k), F.lit(0.0), lambda a, v: a + v)
        for k in range(28)
    ]
    label = F.when(F.col("y") == 1.0, 1.0).otherwise(0.0)
    path = fresh_path(spark, "csv")
    X.ex_emb(spark, sf_dir).select(
        label.alias("c0"), *[c.alias(f"c{k + 1}") for k, c in enumerate(fold)]
    ).write.csv(path)
    return (
        read_dense_csv(spark, path)
        .select("y", F.posexplode("x").alias("j", "v"))
        .groupBy("y", "j")
        .agg(F.count("*").alias("n"), r(F.sum("v"), 4).alias("total"))
    )


def _metrics_folder(spark, sf_dir):
    """One export per algorithm and a combined one, as separate ``*_metrics.csv``."""
    folder = fresh_path(spark, "runs")
    rows = X.metrics(spark, sf_dir)
    for name in ("admm", "lbfgs"):
        write_metrics_csv(rows.filter(F.col("algorithm") == name), f"{folder}/{name}_metrics.csv")
    write_metrics_csv(rows, f"{folder}/combined_metrics.csv")
    return folder


@query(
    f"""WITH {X.METRICS} SELECT algorithm || '_metrics.csv' AS source_file, dataset, convergence_status,
    strftime("timestamp", '%Y') AS year, count(*) AS n, {sql_r('sum(runtime_sec)', 3)} AS runtime_sec,
    CAST(sum(train_samples) AS BIGINT) AS train_samples FROM metrics GROUP BY ALL"""
)
def scan_metrics_csv(spark, sf_dir):
    """Typed scan of all metrics files with their headers skipped; the combined export
    is left out."""
    rows = read_metrics_csv(spark, _metrics_folder(spark, sf_dir))
    return rows.groupBy(
        "source_file", "dataset", "convergence_status", F.date_format("timestamp", "yyyy").alias("year")
    ).agg(
        F.count("*").alias("n"),
        r(F.sum("runtime_sec"), 3).alias("runtime_sec"),
        F.sum("train_samples").alias("train_samples"),
    )


@query(
    f"""WITH {X.METRICS} SELECT algorithm || '_metrics.csv' AS source_file, count(*) AS n FROM metrics
    GROUP BY algorithm ORDER BY source_file"""
)
def metrics_files_in_order(spark, sf_dir):
    rows = read_metrics_csv(spark, _metrics_folder(spark, sf_dir))
    return rows.groupBy("source_file").agg(F.count("*").alias("n")).orderBy("source_file")


@query(
    f"""WITH {X.EX}, model AS (SELECT j, avg(v) AS weight FROM exj GROUP BY j)
    SELECT j, {sql_r('weight')} AS weight, {sql_r('weight')} AS line_weight FROM model"""
)
def weights_sink(spark, sf_dir):
    """Weights written as a table and as one comma-joined line, both read back."""
    model = (
        X.ex_emb(spark, sf_dir)
        .select(F.posexplode("x").alias("j", "v"))
        .groupBy("j")
        .agg(F.avg("v").alias("weight"))
    )
    path = fresh_path(spark, "weights")
    runs.write_weights(model, path)
    line = spark.read.text(f"{path}/line").select(
        F.posexplode(F.split("value", ",")).alias("j", "word")
    )
    return (
        runs.read_weights(spark, path)
        .join(line, "j")
        .select("j", r("weight").alias("weight"), r(F.col("word").cast("double")).alias("line_weight"))
    )


@query(
    f"""WITH {X.EX}, got AS (
      SELECT count(*) AS n, count(*) FILTER (WHERE y = -1) AS neg, count(*) FILTER (WHERE y = 1) AS pos,
             max(len(x)) AS d FROM ex),
    w AS (SELECT string_agg(CAST({X.SQL_WEIGHT} AS VARCHAR), ',' ORDER BY j) AS line,
                 sqrt(sum({X.SQL_WEIGHT} * {X.SQL_WEIGHT})) AS norm,
                 count(*) FILTER (WHERE abs({X.SQL_WEIGHT}) > 1e-6) AS nz
          FROM (SELECT DISTINCT j FROM exj))
    SELECT CAST(k AS INTEGER) AS line_no, line FROM (
      SELECT 1 AS k, 'Dataset: EMBEDDINGS' AS line UNION ALL
      SELECT 2, 'Loading training data from: all' UNION ALL
      SELECT 3, 'Loading test data from: all' UNION ALL
      SELECT 4, 'Using optimized samples with automatic rho updating (μ=10, τ^incr=2, τ^decr=2)' UNION ALL
      SELECT 5, 'Training: ' || n || ' samples, Testing: ' || n || ' samples, Features: ' || d FROM got
      UNION ALL
      SELECT 6, 'Training label distribution: Map(-1.0 -> ' || neg || ', 1.0 -> ' || pos || ')' FROM got
      UNION ALL SELECT 7, '' UNION ALL SELECT 8, repeat('=', 60) UNION ALL
      SELECT 9, 'STARTING ADMM TRAINING' UNION ALL SELECT 10, repeat('=', 60) UNION ALL
      SELECT 11, '' UNION ALL SELECT 12, repeat('=', 60) UNION ALL SELECT 13, 'ADMM RESULTS' UNION ALL
      SELECT 14, repeat('=', 60) UNION ALL
      SELECT 15, 'Training Dataset: all (' || n || ' samples)' FROM got UNION ALL
      SELECT 16, 'Test Dataset: all (' || n || ' samples)' FROM got UNION ALL
      SELECT 17, 'Features: ' || d FROM got UNION ALL
      SELECT 18, 'Runtime: ' || printf('%.1f', n / 8.0::DOUBLE) || ' seconds' FROM got UNION ALL
      SELECT 19, 'Accuracy: ' || printf('%.2f', 100.0::DOUBLE * pos / n) || '%' FROM got UNION ALL
      SELECT 20, 'Iterations: ' || (neg % 50) FROM got UNION ALL
      SELECT 21, 'Parameters: λ=0.01, Partitions=8' UNION ALL
      SELECT 22, 'Model L2 norm: ' || printf('%.6f', norm) || ', Non-zero weights: ' || nz || '/' || d
        FROM w, got UNION ALL
      SELECT 23, repeat('=', 60) UNION ALL SELECT 24, '' UNION ALL SELECT 25, 'MODEL WEIGHTS:' UNION ALL
      SELECT 26, line FROM w)"""
)
def report_sink(spark, sf_dir):
    """A run report over the examples, written as text and read back in order."""
    rows = X.ex_emb(spark, sf_dir)
    seen, dim = evaluate.profile(rows).first(), X.width(rows)
    weights = X.rule_weights(dim)
    shape = evaluate.model_summary(evaluate.weights_table(spark, weights)).first()
    values = {
        "dataset": "embeddings", "algorithm": "admm", "train_file": "all", "test_file": "all",
        "train_samples": seen["rows"], "test_samples": seen["rows"], "features": dim,
        "runtime_sec": seen["rows"] / 8.0, "accuracy_percent": 100.0 * seen["positive"] / seen["rows"],
        "actual_iterations": seen["negative"] % 50, "lambda": 0.01, "partitions": X.N_BLOCKS,
        "model_norm": shape["norm"], "non_zero_weights": shape["nonzero"],
        "total_weights": shape["total"],
    }
    labels = {-1.0: seen["negative"], 1.0: seen["positive"]}
    path = fresh_path(spark, "report")
    runs.write_report(runs.report_lines(spark, values, labels, weights), path)
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\n\z", ""), "\n")
    return whole.select(F.posexplode(lines).alias("k", "line")).select(
        (F.col("k") + 1).alias("line_no"), "line"
    )


@query(
    f"""WITH {X.METRICS}
    SELECT spark_version, dataset, algorithm, partitions, CAST(count(*) + 1 AS INTEGER) AS next_run_id
    FROM metrics GROUP BY spark_version, dataset, algorithm, partitions"""
)
def run_log(spark, sf_dir):
    """Runs appended to the partitioned log in two batches; next number of every key."""
    rows, path = X.metrics(spark, sf_dir), fresh_path(spark, "log")
    for half in (0, 1):
        runs.append_runs(rows.filter(F.col("test_samples") % 2 == half), path)
    return runs.next_run_ids(spark.read.schema(RUN_LOG).parquet(path))


@query(
    f"""WITH {X.METRICS} SELECT spark_version, dataset, algorithm, partitions, count(*) AS n,
    {sql_r('sum(accuracy_percent)', 2)} AS accuracy_sum
    FROM (SELECT DISTINCT spark_version, dataset, algorithm, partitions, "timestamp", train_file,
                 test_file, accuracy_percent, train_samples, test_samples, runtime_sec,
                 actual_iterations FROM metrics)
    GROUP BY spark_version, dataset, algorithm, partitions"""
)
def combined_metrics(spark, sf_dir):
    """Per-run exports and an overlapping earlier export, united without doubling any
    run, written as one export and read back."""
    folder = _metrics_folder(spark, sf_dir)
    current = read_metrics_csv(spark, folder).drop("source_file")
    earlier = spark.read.schema(METRICS).option("header", True).csv(f"{folder}/combined_metrics.csv")
    united = compare.union_metrics([current, earlier])
    out = f"{fresh_path(spark, 'united')}/combined_metrics.csv"
    write_metrics_csv(united, out)
    return (
        spark.read.schema(METRICS)
        .option("header", True)
        .csv(out)
        .groupBy(*RUN_KEY)
        .agg(F.count("*").alias("n"), r(F.sum("accuracy_percent"), 2).alias("accuracy_sum"))
    )
