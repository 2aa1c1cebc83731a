"""No row, label or feature is lost or changed without an error, at any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumfit.functions import logistic as L
from quorumfit.operators import blocks as B
from quorumfit.operators import evaluate, steps
from quorumfit.plans.baseline import fit_lbfgs
from quorumfit.plans.estimator import ConsensusLogisticRegression
from quorumfit.plans.runs import ExampleSet
from quorumfit.registry import fixtures as X
from quorumfit.sources.csv import read_dense_csv, read_metrics_csv, write_metrics_csv
from quorumfit.sources.registry import load_dataset


def _scores(df, weights, limit):
    rows = evaluate.score(df, weights, 0.5, constant_bytes=limit).orderBy("id").collect()
    return [r["score"] for r in rows]


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("width", [3, 70])
def test_one_scoring_rule(spark, limit, width):
    weights = [1.0] * width
    sparse = spark.createDataFrame(
        [(1, [0, 90], [2.0, 5.0]), (2, None, None), (3, [], []), (4, [2], [3.0])],
        "id int, idx array<int>, val array<double>",
    )
    assert _scores(sparse, weights, limit) == [2.5, None, 0.5, 3.5]
    dense = spark.createDataFrame(
        [(1, [2.0] * 100), (2, [2.0]), (3, None), (4, [])], "id int, x array<double>"
    )
    assert _scores(dense, weights, limit) == [2.0 * width + 0.5, 2.5, None, 0.5]


def test_no_score_no_class(spark):
    df = spark.createDataFrame([(None,), (0.5,), (0.6,)], "p double")
    got = [r[0] for r in df.select(L.predicted_class(F.col("p"))).collect()]
    assert got == [None, -1.0, 1.0]


@pytest.mark.parametrize("label", [None, 0.5, 2.0])
def test_labels_outside_their_domain_are_errors(spark, label):
    df = spark.createDataFrame([(label,)], "y double")
    for convert in (L.to_binary_label, L.to_signed_label):
        with pytest.raises(Exception, match="label must be"):
            df.select(convert(F.col("y"))).collect()


def test_baseline_checks_labels(spark):
    rows = spark.createDataFrame([(0.0, [1.0]), (1.0, [2.0])], "y double, x array<double>")
    with pytest.raises(Exception, match="label must be"):
        fit_lbfgs(rows)


def test_empty_csv_label_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",1.0,2.0\n")
    with pytest.raises(Exception, match="label must be"):
        read_dense_csv(spark, str(tmp_path), 2).collect()


def test_refused_lines_are_counted(spark, tmp_path):
    (tmp_path / "a").write_text("1 1:2.0\nx 1:2.0\n-1 1:abc\n-1 2:1.0\n")
    with pytest.raises(ValueError, match="2 lines"):
        load_dataset(spark, str(tmp_path / "a"), "mine", reader="tolerant")
    kept = load_dataset(spark, str(tmp_path / "a"), "mine", reader="tolerant", on_refused="accept")
    assert kept.count() == 2


def test_one_layout_for_both_files(spark, tmp_path):
    (tmp_path / "train").write_text("1 0:2.0 2:1.0\n")
    (tmp_path / "test").write_text("-1 1:3.0\n")
    data = ExampleSet.load(spark, "mine", str(tmp_path), "train", "test", reader="tolerant")
    assert [(r["size"], r["idx"]) for r in (data.train.first(), data.test.first())] == [
        (3, [0, 2]), (3, [1]),
    ]


def test_split_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k long")
    train, test = B.hash_split(df, "k", 0.5)
    assert train.count() + test.count() == 3


def test_keys_in_steps_of_the_block_count(spark):
    df = spark.range(0, 4000, 8)
    sizes = [r["count"] for r in B.assign_blocks(df, 8, "id").groupBy("part_id").count().collect()]
    assert len(sizes) == 8 and min(sizes) > 30


def test_metrics_files_are_strict(spark, sf_dir, tmp_path):
    rows = X.metrics(spark, sf_dir).limit(3)
    write_metrics_csv(rows, f"{tmp_path}/a_metrics.csv")
    assert read_metrics_csv(spark, str(tmp_path)).count() == 3
    swapped = rows.select("dataset", "timestamp", *rows.columns[2:])
    swapped.write.option("header", True).csv(f"{tmp_path}/b/b_metrics.csv")
    with pytest.raises(Exception):
        read_metrics_csv(spark, f"{tmp_path}/b").collect()
    bad = rows.withColumn("partitions", F.lit("fifteen"))
    bad.write.option("header", True).csv(f"{tmp_path}/c/c_metrics.csv")
    with pytest.raises(Exception):
        read_metrics_csv(spark, f"{tmp_path}/c").collect()


def test_chunks_stay_large_with_thousands_of_blocks(spark):
    rows = spark.range(0, 60_000, 1, 2).select(
        (F.col("id") % 5000).cast("int").alias("part_id"), F.lit(1.0).alias("y"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("x"),
    )
    chunks = B.pack_chunks(rows)
    assert chunks.count() == 10_000  # one for each block and task
    assert chunks.agg(F.sum("n")).first()[0] == 60_000


def test_capping_in_rounds_keeps_the_first_rows(spark):
    rows = spark.range(3000).withColumn("part_id", (F.col("id") % 2).cast("int"))
    kept = [r["id"] for r in B.cap_rows(rows, 20, "id").orderBy("id").collect()]
    assert kept == list(range(40))


def test_summary_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(steps, "SLICE", 16)
    rng = np.random.default_rng(2)
    w, u = rng.normal(size=(300, 50)) + 1e6, rng.normal(size=(300, 50))
    state = spark.createDataFrame(
        [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(w, u))],
        "part_id int, w array<double>, u array<double>",
    ).repartition(40)
    summary = steps.state_summary(state)
    assert "SinglePartition" not in summary._jdf.queryExecution().executedPlan().toString()
    found = steps.summary_by_feature(summary).orderBy("j").toPandas()
    assert list(found["j"]) == list(range(50))
    assert np.allclose(found["w_avg"], w.mean(0)) and np.allclose(found["u_avg"], u.mean(0))
    assert np.allclose(found["w_spread"], ((w - w.mean(0)) ** 2).sum(0), rtol=1e-9)
    assert np.allclose(found["w_sq"], (w**2).sum(0))


def test_baseline_scores_after_a_fit_across_tasks(spark, sf_dir):
    rows = X.ex_pair(spark, sf_dir)
    model = ConsensusLogisticRegression(placement="across", max_iter=1).fit(rows)
    assert fit_lbfgs(rows, max_iter=5).transform(rows).where("predicted IS NULL").count() == 0
    assert model.state.count() == 8
    model.release()
    with pytest.raises(Exception):
        model.state.collect()


def test_a_failed_fit_leaves_no_tables(spark, sf_dir):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    broken = X.ex_pair(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v * float("nan")))
    with pytest.raises(ValueError, match="NaN"):
        ConsensusLogisticRegression(max_iter=1).fit(broken)
    assert not {n for n in set(os.listdir(folder)) - before if "search" not in n}
