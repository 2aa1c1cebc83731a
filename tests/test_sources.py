"""Readers on the awkward lines of the LibSVM format, CSV with a byte-order mark, and
the dataset registry."""

import pytest
from pyspark.sql import functions as F

from quorumfit.functions import vectors as V
from quorumfit.operators import blocks as B
from quorumfit.plans import runs
from quorumfit.sources import libsvm, registry
from quorumfit.sources.csv import read_dense_csv, read_metrics_csv, write_metrics_csv

LINES = [
    "1 0:5.0 1:6.0 3:2.5",  # 0-based
    "-1 1:1.0 2:2.0",
    "1",  # no features
    "-1 5:1.0 2:4.0",  # unsorted
    "1 2:1.0 2:9.0",  # duplicate index
    "1 -1:3.0",  # negative index
    "1 2:abc",  # bad number
    "1  2:1.0",  # double space
    "x 1:1.0",  # bad label
    "   ",
    "1 2:1.0:3",  # not a pair
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "id long, line string")
    return libsvm.parse_lines(lines)


def test_base_and_dimension(parsed):
    assert (parsed.index_base, parsed.num_features) == (0, 6)


def test_good_lines(parsed):
    rows = {r["id"]: (r["y"], r["idx"], r["val"]) for r in parsed.examples.collect()}
    assert rows == {
        0: (1.0, [0, 1, 3], [5.0, 6.0, 2.5]),
        1: (-1.0, [1, 2], [1.0, 2.0]),
        2: (1.0, [], []),
        3: (-1.0, [2, 5], [4.0, 1.0]),
        4: (1.0, [2], [9.0]),
        7: (1.0, [2], [1.0]),
    }


def test_refused_lines(parsed):
    reasons = {r["id"]: r["reason"] for r in parsed.rejected.collect()}
    assert reasons == {
        5: "index out of range", 6: "bad feature", 8: "bad label", 10: "bad feature",
    }


def test_scatter(parsed):
    dense = parsed.examples.select("id", V.scatter(F.col("idx"), F.col("val"), F.col("size")).alias("x"))
    rows = {r["id"]: r["x"] for r in dense.collect()}
    assert rows[0] == [5.0, 6.0, 0.0, 2.5, 0.0, 0.0]
    assert rows[2] == [0.0] * 6
    assert rows[3] == [0.0, 0.0, 4.0, 0.0, 0.0, 1.0]


def test_one_based_and_given_dimension(spark):
    lines = spark.createDataFrame([(0, "1 1:1.0 3:2.0"), (1, "1 9:1.0")], "id long, line string")
    found = libsvm.parse_lines(lines, "auto", 4)
    assert found.index_base == 1
    assert [r["idx"] for r in found.examples.collect()] == [[0, 2]]
    assert [r["id"] for r in found.rejected.collect()] == [1]


def test_no_pass_over_the_data_when_all_is_given(spark):
    lines = spark.createDataFrame([(0, "1 1:1.0")], "id long, line string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("parse", "parse")
    libsvm.parse_lines(lines, 1, 4)
    assert not tracker.getJobIdsForGroup("parse")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_vectors_round_trip(spark):
    rows = [(1, 1.0, 5, [0, 3], [1.0, 2.0]), (2, -1.0, 5, [], [])]
    df = spark.createDataFrame(rows, "id long, y double, size int, idx array<int>, val array<double>")
    back = libsvm.from_ml_vectors(libsvm.to_ml_vectors(df), "y", "features")
    assert sorted((r["y"], r["size"], r["idx"], r["val"]) for r in back.collect()) == sorted(
        r[1:] for r in rows
    )


def test_csv_with_byte_order_mark(spark, tmp_path):
    rows = [[1.0] + [float(j) for j in range(28)], [0.0] + [0.5] * 28]
    body = "\n".join(",".join(f"{v:.18e}" for v in row) for row in rows)
    (tmp_path / "h.csv").write_bytes(b"\xef\xbb\xbf" + body.encode())
    got = {r["y"]: r["x"] for r in read_dense_csv(spark, str(tmp_path / "h.csv")).collect()}
    assert got == {1.0: rows[0][1:], -1.0: rows[1][1:]}


def test_registry():
    train, test = registry.resolve("HIGGS", "/data", test_file="/else/t.binary")
    assert (train, test) == ("/data/higgs_train15k.binary", "/else/t.binary")
    with pytest.raises(ValueError, match="unknown dataset"):
        registry.resolve("other", "/data")
    assert registry.resolve("other", "/d/", "a", "s3://b/c") == ("/d/a", "s3://b/c")


def test_labels_and_rows_are_checked(spark):
    bad_label = spark.createDataFrame([(0, 0.0, [1.0])], "part_id int, y double, x array<double>")
    with pytest.raises(Exception, match="labels must be"):
        B.pack_chunks(bad_label).collect()
    ragged = spark.createDataFrame(
        [(0, 1.0, [1.0]), (0, 1.0, [1.0, 2.0])], "part_id int, y double, x array<double>"
    ).coalesce(1)
    with pytest.raises(Exception, match="one width"):
        B.pack_chunks(ragged).collect()


def test_metrics_files(spark, tmp_path):
    row = dict.fromkeys(runs.METRICS.fieldNames())
    row |= {"dataset": "higgs", "algorithm": "admm", "partitions": 8}
    one = spark.createDataFrame([row], runs.METRICS)
    for name in ("a_metrics.csv", "combined_metrics.csv"):
        write_metrics_csv(one, f"{tmp_path}/{name}")
    # a plain file, as other tools write it
    (tmp_path / "b_metrics.csv").write_text(
        ",".join(runs.METRICS.fieldNames()) + "\n2025-01-01T10:00:00.123,rcv1,lbfgs" + "," * 17 + "\n"
    )
    got = read_metrics_csv(spark, str(tmp_path)).collect()
    assert sorted((r["source_file"], r["dataset"]) for r in got) == [
        ("a_metrics.csv", "higgs"), ("b_metrics.csv", "rcv1"),
    ]


def _at_two_split_sizes(spark, read):
    """What ``read`` gives with files in one split and in many."""
    found = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read()
            found.append((rows.rdd.getNumPartitions(), sorted(map(str, rows.collect()))))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (few, one), (many, two) = found
    assert many > 2 * few and one == two
    return one


@pytest.mark.parametrize("kind", ["libsvm", "tolerant", "csv"])
def test_ids_do_not_depend_on_the_splits(spark, tmp_path, kind):
    """Blocks and sides of rows stay when the same files are split otherwise."""
    lines = [f"{1 if k % 3 else -1} 1:{k}.5 2:{k % 7}.25" for k in range(900)]
    if kind == "csv":
        lines = [f"{k % 2},{k}.5,{k % 7}.25" for k in range(900)]
    for name, part in (("b", lines[:500]), ("a", lines[500:800]), ("c", lines[800:])):
        (tmp_path / f"{name}.txt").write_text("\n".join(part) + "\n")
    (tmp_path / "d.txt").write_text("\n" * 5000)  # blank lines only

    def read():
        if kind == "csv":
            rows = read_dense_csv(spark, str(tmp_path), 2).withColumn("v", F.get("x", F.lit(0)))
        elif kind == "tolerant":
            rows = libsvm.read_libsvm_tolerant(spark, str(tmp_path)).examples
            rows = rows.withColumn("v", F.get("val", F.lit(0)))
        else:
            rows = libsvm.read_libsvm(spark, str(tmp_path), 2).withColumn("v", F.get("val", F.lit(0)))
        train, test = B.hash_split(B.assign_blocks(rows, 5, "id"), "id", 0.8)
        sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
        return sides.select("id", "v", "part_id", "side")

    got = _at_two_split_sizes(spark, read)
    order = [*range(500, 800), *range(500), *range(800, 900)]
    rows = sorted((r["id"], r["v"]) for r in read().collect())
    assert rows == [(k, n + 0.5) for k, n in enumerate(order)] and len(got) == 900


def test_text_is_read_once(spark, tmp_path):
    """Base, dimension, numbers and examples come from one scan of the text."""
    (tmp_path / "t.txt").write_text("1 0:2.0 5:1.0\n\n-1 3:1.0\nx 1:1\n")
    parsed = libsvm.read_libsvm_tolerant(spark, str(tmp_path))
    (tmp_path / "t.txt").unlink()
    rows = [(r["id"], r["y"], r["idx"]) for r in parsed.examples.orderBy("id").collect()]
    assert rows == [(0, 1.0, [0, 5]), (2, -1.0, [3])] and parsed.num_features == 6
    assert [(r["id"], r["line"]) for r in parsed.rejected.collect()] == [(3, "x 1:1")]
    plan = parsed.examples._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan parquet" in plan
    parsed.release()


def test_empty_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("")
    parsed = libsvm.read_libsvm_tolerant(spark, str(tmp_path))
    assert parsed.examples.count() == 0 and (parsed.index_base, parsed.num_features) == (1, 1)
    assert read_dense_csv(spark, str(tmp_path), 2).count() == 0
