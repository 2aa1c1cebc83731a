"""Experiment runs, their records and reports."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quorumfit.operators import blocks as B
from quorumfit.plans import batch, compare, runs
from quorumfit.registry import fixtures as X
from quorumfit.session import drop_path, fresh_path
from quorumfit.sources import libsvm
from quorumfit.sources.csv import read_metrics_csv


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    train, test = B.hash_split(X.ex_emb(spark, sf_dir).drop("part_id"), "id", 0.8)
    return runs.ExampleSet("higgs", train, test, "higgs_train15k.binary", "higgs_test10k.binary")


@pytest.fixture(scope="module", params=["admm", "lbfgs"])
def result(request, data):
    return runs.run_experiment(data, request.param)


def test_metrics_row(result):
    row = result.metrics.first()
    assert row["train_samples"] + row["test_samples"] == 500
    assert row["features"] == row["total_weights"] == 64
    assert row["accuracy_percent"] > (80 if row["algorithm"] == "lbfgs" else 40)
    assert row["actual_iterations"] < row["max_iterations"]
    assert row["convergence_status"] == "converged"
    assert result.samples.count() == 5


def test_report(spark, result):
    path = fresh_path(spark, "report")
    runs.write_report(result.report, path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert len(lines) == 26
    row = result.row
    assert lines[0] == "Dataset: HIGGS"
    assert lines[18] == f"Accuracy: {row['accuracy_percent']:.2f}%"
    norm = sum(float(w) ** 2 for w in lines[25].split(",")) ** 0.5
    assert f"{norm:.6f}" == f"{row['model_norm']:.6f}"


def test_run_log_numbers_runs_per_key(spark, result):
    path = fresh_path(spark, "log")
    assert [runs.append_run(result.metrics, path) for _ in range(3)] == [1, 2, 3]
    other = result.metrics.withColumn("dataset", F.lit("rcv1"))
    assert runs.append_run(other, path) == 1
    assert spark.read.parquet(path).count() == 4


def test_writers_at_the_same_time_get_different_numbers(spark, result, monkeypatch):
    """Both look at the log before either writes to it."""
    path, claim = fresh_path(spark, "log"), runs.claim_numbers
    runs.append_run(result.metrics, path)
    both_looked = threading.Barrier(2, timeout=60)

    def late(*arguments):
        both_looked.wait()
        return claim(*arguments)

    monkeypatch.setattr(runs, "claim_numbers", late)
    with ThreadPoolExecutor(2) as pool:
        numbers = list(pool.map(lambda _: runs.append_run(result.metrics, path), range(2)))
    assert sorted(numbers) == [2, 3]
    assert sorted(r[0] for r in spark.read.parquet(path).select("run_id").collect()) == [1, 2, 3]


def test_claims_of_several_numbers(spark):
    path, key = fresh_path(spark, "log"), ("4_1", "higgs", "admm", 8)
    claim = lambda start, count: runs.claim_numbers(spark, path, key, start, count)
    assert [claim(1, 5), claim(1, 2), claim(1, 1), claim(9, 3), claim(6, 1)] == [1, 6, 8, 9, 12]
    assert runs.claim_numbers(spark, path, ("4_1", "rcv1", "admm", 8), 1, 1) == 1


def test_runs_of_one_key_are_numbered_in_slices(spark, sf_dir, monkeypatch):
    """Every second run shares its time with the one before; one key has a null."""
    monkeypatch.setattr(runs, "SLICE_ROWS", 100)
    hours = (F.col("train_samples") / 2).cast("int") * 3600
    rows = X.metrics(spark, sf_dir).withColumn("timestamp", F.timestamp_seconds(hours)).withColumn(
        "dataset", F.lit("higgs")).withColumn("algorithm", F.lit("admm")).withColumn("spark_version", F.lit("4_0"))
    rows = rows.withColumn("partitions", F.when(F.col("train_samples") % 10 > 0, 8)).cache()
    total, scratch = rows.count(), fresh_path(spark, "runs")
    assert total > 1000
    _, slices = runs._ordered_runs(rows, scratch)
    drop_path(spark, scratch)
    assert sum(s["n"] for s in slices) == total
    assert max(s["n"] for s in slices) < total / 4
    path = fresh_path(spark, "log")
    assert runs.append_runs(rows, path) == [1, 1]
    assert runs.append_runs(rows, path) == [1 + rows.filter("partitions IS NULL").count(), 1 + rows.filter("partitions = 8").count()]
    log = spark.read.parquet(path).select("partitions", "run_id", "timestamp", "train_samples").collect()
    for key in (None, 8):
        own = sorted((r for r in log if r["partitions"] == key), key=lambda r: r["run_id"])
        assert [r["run_id"] for r in own] == list(range(1, len(own) + 1))
        for half in (own[: len(own) // 2], own[len(own) // 2 :]):
            times = [r["timestamp"] for r in half]
            assert times == sorted(times) and len({r["train_samples"] for r in half}) == len(half)
    rows.unpersist()


def test_batch_entry(spark, sf_dir, tmp_path):
    rows = X.as_sparse(X.ex_pair(spark, sf_dir))
    libsvm.write_libsvm(rows, f"{tmp_path}/in", base=1)
    batch.main([f"{tmp_path}/in", "4", f"{tmp_path}/out", "--max-iter", "3", "--num-features", "2"])
    assert runs.read_weights(spark, f"{tmp_path}/out").count() == 2
    with pytest.raises(SystemExit):
        batch.main([f"{tmp_path}/in", "0", f"{tmp_path}/out"])


def test_run_name(result):
    name = runs.run_name(result.row, 3, "15k", "10k")
    assert name.startswith("higgs_") and name.endswith("_15k_10k_%s_3_8part" % result.row["algorithm"])


def test_unknown_algorithm(data):
    with pytest.raises(ValueError, match="unknown algorithm"):
        runs.run_experiment(data, "sgd")


def test_load_and_run_from_files(spark, sf_dir, tmp_path):
    rows = X.as_sparse(X.ex_emb(spark, sf_dir))
    for name in ("a", "b"):
        libsvm.write_libsvm(rows, f"{tmp_path}/{name}", base=1)
    data = runs.ExampleSet.load(
        spark, "mine", str(tmp_path), "a", "b", reader="libsvm", num_features=64
    )
    sparse = runs.run_experiment(data, "lbfgs", max_iter=20).row
    assert sparse["train_samples"] == 500 and sparse["train_file"] == "a"


def test_grid(data):
    options = {"admm": {"max_iter": 2}, "lbfgs": {"max_iter": 5}}
    grid = runs.run_grid([data], partitions=[2, 3], options=options).collect()
    assert [(r["partitions"], r["algorithm"]) for r in grid] == [
        (2, "admm"), (2, "lbfgs"), (3, "admm"), (3, "lbfgs"),
    ]


def test_union_keeps_repeated_rows_once(result):
    both = compare.union_metrics([result.metrics.drop("test_file"), result.metrics, result.metrics])
    assert [r["test_file"] for r in both.collect()] == ["higgs_test10k.binary"]


def test_saved_runs_are_numbered(spark, result, tmp_path):
    names = [runs.save_run(result, str(tmp_path)) for _ in range(2)]
    stem = "15k_10k_%s" % result.row["algorithm"]
    assert [n.split(stem)[1] for n in names] == ["_1_8part", "_2_8part"]
    assert len(spark.read.text(f"{tmp_path}/{names[1]}_report").collect()) == 26
    assert runs.read_weights(spark, f"{tmp_path}/{names[1]}_weights").count() == 64
    assert read_metrics_csv(spark, str(tmp_path)).count() == 2


def test_scratch_paths_only(spark, tmp_path):
    with pytest.raises(ValueError, match="not a scratch path"):
        drop_path(spark, str(tmp_path))
