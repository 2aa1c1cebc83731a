"""Experiment runs: load, fit, evaluate, report and record."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pyspark
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumfit.operators import evaluate
from quorumfit.operators.blocks import NestedBlocks
from quorumfit.plans.baseline import fit_lbfgs
from quorumfit.plans.estimator import ConsensusLogisticRegression
from quorumfit.functions.text import sample_size_tag
from quorumfit.schemas import METRICS, MODEL, RUN_KEY, RUN_LOG
from quorumfit.session import drop_path, fresh_path, hadoop_path
from quorumfit.sources.csv import write_metrics_csv
from quorumfit.sources.libsvm import layout, read_libsvm, scan_libsvm
from quorumfit.sources.registry import DATASETS, accepted, load_dataset, reader_of, resolve

# Defaults of the two algorithms and the partition counts of the sweep.
ADMM, LBFGS = "admm", "lbfgs"
DEFAULT_BLOCKS = 8
DEFAULT_LAMBDA = 0.01
DEFAULT_MAX_ITER = {ADMM: 50, LBFGS: 100}
SWEEP_PARTITIONS = (5, 8, 10, 15)
# Runs that a task orders when runs are appended to the log.
SLICE_ROWS = 1 << 18

# Wording of the run report.
RULE = "=" * 60
METHOD_NOTE = {
    ADMM: "Using optimized samples with automatic rho updating (μ=10, τ^incr=2, τ^decr=2)",
    LBFGS: "Using MLlib LogisticRegressionWithLBFGS for baseline comparison",
}


@dataclass
class ExampleSet:
    """Training and test examples with the names they are reported under."""

    dataset: str
    train: DataFrame
    test: DataFrame
    train_file: str = "train"
    test_file: str = "test"

    @classmethod
    def load(
        cls, spark: SparkSession, dataset: str, base_dir: str, train_file: str = "",
        test_file: str = "", **options,
    ) -> ExampleSet:
        """Load both files; ``options`` go to ``load_dataset``. The index base and the
        dimension are found once over both, so a feature has one place in either."""
        train, test = resolve(dataset, base_dir, train_file, test_file)
        reader = reader_of(dataset, options.get("reader"))
        known = DATASETS.get(dataset.lower())
        width = options.get("num_features") or (known.num_features if known else None)
        if reader == "tolerant":
            scans = [scan_libsvm(spark, path) for path in (train, test)]
            base, width = layout(scans, options.get("index_base", "auto"), width)
            sides = [
                accepted(scan.parsed(base, width), path, options.get("on_refused", "raise"))
                for scan, path in zip(scans, (train, test))
            ]
        else:
            if reader == "libsvm" and width is None:
                both = scan_libsvm(spark, [train, test])
                width = layout([both], 1, None)[1]
                both.release()
            sides = [
                load_dataset(spark, path, dataset, **options | {"num_features": width})
                for path in (train, test)
            ]
        return cls(
            dataset,
            *sides,
            train_file or train.rsplit("/", 1)[-1],
            test_file or test.rsplit("/", 1)[-1],
        )


@dataclass
class RunResult:
    weights: DataFrame  # (j, weight)
    metrics: DataFrame  # one row of METRICS
    report: DataFrame  # (line_no, line)
    samples: DataFrame  # first test predictions
    trace: DataFrame | None  # residuals per iteration (consensus fit only)
    row: dict


def version_tag() -> str:
    return "_".join(pyspark.__version__.split(".")[:2])


def run_experiment(
    data: ExampleSet,
    algorithm: str = ADMM,
    n_blocks: int = DEFAULT_BLOCKS,
    lam: float = DEFAULT_LAMBDA,
    max_iter: int | None = None,
    cache: bool = True,
    nested: NestedBlocks | None = None,
    **options,
) -> RunResult:
    """Profile, fit, evaluate and describe one run. ``options`` go to the fit. ``cache``
    keeps the parsed training rows between the profile and the fit; turn it off for
    data that is columnar already. ``nested`` has the blocks of the training rows."""
    if algorithm not in DEFAULT_MAX_ITER:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {sorted(DEFAULT_MAX_ITER)}")
    spark = data.train.sparkSession
    max_iter = DEFAULT_MAX_ITER[algorithm] if max_iter is None else max_iter
    own_cache = cache and not data.train.is_cached
    if own_cache:
        data.train.persist()
    seen = evaluate.profile(data.train).first()

    if algorithm == ADMM:
        model = ConsensusLogisticRegression(
            lam=lam, n_blocks=n_blocks, max_iter=max_iter, **options
        ).fit(data.train, nested=nested)
        scored, weights, trace = model.transform(data.test), model.weights_df, model.trace
        label, columns = "y", ["y", "score", "probability", "predicted"]
    else:
        model = fit_lbfgs(data.train, lam, max_iter, **options)
        scored, weights, trace = model.transform(data.test), model.weights_df(spark), None
        label, columns = "label", ["label", "predicted"]
    if own_cache:
        data.train.unpersist()
    outcome = evaluate.accuracy(scored, label).first()
    shape = evaluate.model_summary(weights).first()

    values = {
        "timestamp": datetime.now(),
        "dataset": data.dataset.lower(),
        "algorithm": algorithm,
        "spark_version": version_tag(),
        "train_samples": seen["rows"],
        "test_samples": outcome["total"],
        "features": len(model.weights),
        "partitions": n_blocks,
        "lambda": lam,
        "max_iterations": max_iter,
        "actual_iterations": model.iterations,
        "runtime_sec": round(model.runtime_sec, 3),
        "accuracy_percent": round(100.0 * (outcome["accuracy"] or 0.0), 2),
        "model_norm": round(shape["norm"], 6),
        "non_zero_weights": shape["nonzero"],
        "total_weights": shape["total"],
        "non_zero_percent": round(100.0 * shape["nonzero"] / shape["total"], 2),
        "convergence_status": "converged" if model.converged else "max_iterations",
        "train_file": data.train_file,
        "test_file": data.test_file,
    }
    low = -1.0 if algorithm == ADMM else 0.0
    labels = {low: seen["negative"], 1.0: seen["positive"]}
    return RunResult(
        weights=weights,
        metrics=spark.createDataFrame([values], METRICS),
        report=report_lines(spark, values, labels, model.weights),
        samples=scored.select("id", *columns).orderBy("id").limit(5),
        trace=trace,
        row=values,
    )


def report_lines(
    spark: SparkSession, run: Mapping, labels: Mapping[float, int], weights: Iterable[float]
) -> DataFrame:
    """The run report as (line_no, line)."""
    admm = run["algorithm"] == ADMM
    name = run["algorithm"].upper()
    penalty = "λ" if admm else "regParam"
    counts = ", ".join(f"{label} -> {n}" for label, n in labels.items())
    lines = [
        f"Dataset: {run['dataset'].upper()}",
        f"Loading training data from: {run['train_file']}",
        f"Loading test data from: {run['test_file']}",
        METHOD_NOTE[run["algorithm"]],
        f"Training: {run['train_samples']} samples, Testing: {run['test_samples']} samples, "
        f"Features: {run['features']}",
        f"Training label distribution: Map({counts})",
        "",
        RULE,
        f"STARTING {name} TRAINING",
        RULE,
        "",
        RULE,
        f"{name} RESULTS",
        RULE,
        f"Training Dataset: {run['train_file']} ({run['train_samples']} samples)",
        f"Test Dataset: {run['test_file']} ({run['test_samples']} samples)",
        f"Features: {run['features']}",
        f"Runtime: {run['runtime_sec']:.1f} seconds",
        f"Accuracy: {run['accuracy_percent']:.2f}%",
        f"Iterations: {run['actual_iterations']}",
        f"Parameters: {penalty}={run['lambda']}, Partitions={run['partitions']}",
        f"Model L2 norm: {run['model_norm']:.6f}, "
        f"Non-zero weights: {run['non_zero_weights']}/{run['total_weights']}",
        RULE,
        "",
        "MODEL WEIGHTS:",
        ",".join(repr(float(w)) for w in weights),
    ]
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")


def write_report(report: DataFrame, path: str) -> None:
    """One text file in line order; a report is a few dozen lines."""
    ordered = report.coalesce(1).sortWithinPartitions("line_no")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def weights_line(model: DataFrame) -> DataFrame:
    """The weights in feature order as one comma-joined line."""
    ordered = F.array_sort(F.collect_list(F.struct("j", "weight")))
    joined = F.array_join(F.transform(ordered, lambda e: e["weight"].cast("string")), ",")
    return model.agg(joined.alias("value"))


def write_weights(model: DataFrame, path: str) -> None:
    """Weights as a ``(j, weight)`` table in ``path/model`` and as one line in ``path/line``."""
    model.write.mode("overwrite").parquet(f"{path}/model")
    weights_line(model).write.mode("overwrite").text(f"{path}/line")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(f"{path}/model")


def next_run_ids(log: DataFrame) -> DataFrame:
    """Next run number of every run key in the log."""
    return log.groupBy(*RUN_KEY).agg(
        (F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("next_run_id")
    )


def append_run(metrics: DataFrame, path: str) -> int:
    """Append one run to the log table and return its number, counted per run key."""
    return append_runs(metrics, path)[0]


def append_runs(metrics: DataFrame, path: str) -> list[int]:
    """Append runs to the log table, numbered on from the last number of their run key by
    time; the first number of every key, in the order of the keys.

    Numbers are claimed before they are written, so writers that append at the same time
    get different ones; one that fails after its claim leaves a gap.
    """
    spark = metrics.sparkSession
    ordered_path = fresh_path(spark, "runs")
    try:
        ordered, slices = _ordered_runs(metrics, ordered_path)
        counts: dict[tuple, int] = {}
        for row in slices:
            key = tuple(row[c] for c in RUN_KEY)
            counts[key] = counts.get(key, 0) + row["n"]
        last = {}
        if _exists(spark, path):
            log = spark.read.schema(RUN_LOG).parquet(path)
            for row in log.groupBy(*RUN_KEY).agg(F.max("run_id").alias("last")).collect():
                last[tuple(row[c] for c in RUN_KEY)] = row["last"]
        firsts = {
            key: claim_numbers(spark, path, key, last.get(key, 0) + 1, count)
            for key, count in counts.items()
        }
        shifts, following = [], dict(firsts)
        for row in slices:
            key = tuple(row[c] for c in RUN_KEY)
            shifts.append((*key, row["_slice"], following[key] - row["first"]))
            following[key] += row["n"]
        schema = T.StructType([
            *(METRICS[c] for c in RUN_KEY),
            T.StructField("_slice", T.IntegerType()), T.StructField("_shift", T.LongType()),
        ])
        shift = spark.createDataFrame(shifts, schema)
        keyed = shift.select(F.struct("_slice", *RUN_KEY).alias("_key"), "_shift")
        same = [ordered[c].eqNullSafe(F.col(f"_key.{c}")) for c in ("_slice", *RUN_KEY)]
        numbered = (
            ordered.join(F.broadcast(keyed), reduce(Column.__and__, same))
            .withColumn("run_id", (F.col("_place") + F.col("_shift")).cast("int"))
            .select(*RUN_LOG.fieldNames())
        )
        numbered.write.mode("append").partitionBy("dataset", "algorithm").parquet(path)
    finally:
        drop_path(spark, ordered_path)
    return list(firsts.values())


def _ordered_runs(metrics: DataFrame, path: str) -> tuple[DataFrame, list[Row]]:
    """The runs as a table at ``path``, in order of run key and time, with their slice of it
    and place in that; and by slice and run key, in that order, the first place and how many
    there are.

    A run key has as many slices as its rows need, so no task sorts all runs of one; only
    rows that are equal throughout share one. The table is written once, as later passes
    must find the same slices.
    """
    spark = metrics.sparkSession
    order = [*RUN_KEY, "timestamp"]
    # Runs of one time are told apart by what they hold, so that they spread as well.
    tie = F.xxhash64(*METRICS.fieldNames())
    rows = metrics.select(*METRICS.fieldNames())
    slices = max(-(-rows.count() // SLICE_ROWS), 1)
    (
        rows.withColumn("_tie", tie)
        .repartitionByRange(slices, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_tie")
        .write.parquet(path)
    )
    ordered = spark.read.parquet(path)
    found = ordered.groupBy("_slice", *RUN_KEY).agg(
        F.min("_place").alias("first"), F.count("*").alias("n")
    )
    return ordered, found.orderBy("first").collect()


def claim_numbers(spark: SparkSession, path: str, key: tuple, start: int, count: int) -> int:
    """Claim ``count`` run numbers of a key and return the first, ``start`` or the next that
    nobody has.

    A claim is a file named by its first number that holds its count. It is written beside
    its place and moved there in a step that fails when the place is taken (a rename, which
    does not replace on HDFS; a hard link on a local disk). Who finds the place taken reads
    how far that claim goes and tries again behind it.
    """
    name = hashlib.sha256(repr(key).encode()).hexdigest()[:16]
    folder = f"{path}/_claims/{name}"
    draft, files = hadoop_path(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(str(count).encode()))
    out.close()
    local = files.getUri().getScheme() == "file"
    try:
        while True:
            place, _ = hadoop_path(spark, f"{folder}/{start}")
            if local:
                taken = not _linked(draft.toUri().getPath(), place.toUri().getPath())
            else:
                taken = files.exists(place) or not files.rename(draft, place)
            if not taken:
                return start
            start += int(spark.read.text(f"{folder}/{start}").first()[0])
    finally:
        files.delete(draft, False)


def _linked(draft: str, place: str) -> bool:
    try:
        os.link(draft, place)
    except FileExistsError:
        return False
    return True


def run_name(row: Mapping, run_id: int, train_tag: str, test_tag: str) -> str:
    """Common stem of a run's output files; it names the dataset as well."""
    return (
        f"{row['dataset']}_{row['spark_version']}_{train_tag}_{test_tag}_{row['algorithm']}"
        f"_{run_id}_{row['partitions']}part"
    )


def save_run(result: RunResult, folder: str) -> str:
    """Write a run below ``folder``: its row is appended to the log and numbered, and
    ``<name>_report``, ``<name>_metrics.csv`` and ``<name>_weights`` carry that number.
    Returns the name."""
    run_id = append_run(result.metrics, f"{folder}/log")
    tags = result.metrics.select(
        sample_size_tag(F.col("train_file"), "train"), sample_size_tag(F.col("test_file"), "test")
    ).first()
    name = run_name(result.row, run_id, *tags)
    write_report(result.report, f"{folder}/{name}_report")
    write_metrics_csv(result.metrics, f"{folder}/{name}_metrics.csv")
    write_weights(result.weights, f"{folder}/{name}_weights")
    return name


def _exists(spark: SparkSession, path: str) -> bool:
    target, files = hadoop_path(spark, path)
    return files.exists(target)


def fit_and_save(
    spark: SparkSession, path: str, n_blocks: int, out: str, num_features: int | None = None,
    lam: float = 0.1, max_iter: int = 50, **options,
) -> DataFrame:
    """Fit a LibSVM file and save the weights; for use from ``spark-submit``."""
    examples = read_libsvm(spark, path, num_features)
    model = ConsensusLogisticRegression(
        lam=lam, n_blocks=n_blocks, max_iter=max_iter, **options
    ).fit(examples, num_features=num_features)
    write_weights(model.weights_df, out)
    return model.weights_df


def run_grid(
    datasets: Iterable[ExampleSet],
    algorithms: Iterable[str] = (ADMM, LBFGS),
    partitions: Iterable[int] = SWEEP_PARTITIONS,
    options: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Every dataset x partition count x algorithm, one metrics row per run. Examples
    are cached once per dataset and shared by its runs; where rows have an ``id`` and there
    are several counts, the consensus fits share one packing and one exchange of the data,
    whose time is in none of their runtimes. ``options`` holds, by algorithm, what
    :func:`run_experiment` takes."""
    rows, spark = [], None
    algorithms, partitions = list(algorithms), list(partitions)
    for data in datasets:
        spark = data.train.sparkSession
        data.train.persist()
        data.test.persist()
        nested, names = None, data.train.columns
        if ADMM in algorithms and len(partitions) > 1 and "id" in names and "part_id" not in names:
            nested = NestedBlocks.prepare(data.train, partitions) if NestedBlocks.suits(partitions) else None
        for count in partitions:
            for algorithm in algorithms:
                own = (options or {}).get(algorithm, {})
                if algorithm == ADMM and "row_cap" not in own:
                    own = {**own, "nested": nested}
                rows.append(run_experiment(data, algorithm, count, **own).row)
        if nested is not None:
            nested.release()
        data.train.unpersist()
        data.test.unpersist()
    return spark.createDataFrame(rows, METRICS)
