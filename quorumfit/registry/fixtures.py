"""Tables derived from the given ones: examples, block states, LibSVM text and run
metrics. Each has a Spark form and the SQL of the same derivation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumfit.functions import text

N_BLOCKS = 8
LINE_WEIGHTS = [0.5, -0.25, 0.1, -0.2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(value: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def sql_r(value: str, digits: int = 6) -> str:
    return f"(round({value}, {digits}) + 0.0::DOUBLE)"


# --- examples -------------------------------------------------------------------


def ex_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, x, part_id) from ``embeddings``: label 0 against the rest."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") == 0, 1.0).otherwise(-1.0).alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.pmod("vec_id", F.lit(N_BLOCKS)).cast("int").alias("part_id"),
    )


EX = """
ex AS (SELECT vec_id AS id, CAST(CASE WHEN label = 0 THEN 1 ELSE -1 END AS DOUBLE) AS y,
              CAST(embedding AS DOUBLE[]) AS x, CAST(vec_id % 8 AS INTEGER) AS part_id
       FROM embeddings),
exj AS (SELECT id, y, part_id, CAST(unnest(range(len(x))) AS INTEGER) AS j, unnest(x) AS v
        FROM ex)"""

# Weight of feature j, the same rule on both sides.
SQL_WEIGHT = "(((j % 7) - 3) / 10.0)::DOUBLE"
SCORED = (
    EX
    + f""",
scored AS (SELECT id, part_id, y, sum(v * {SQL_WEIGHT}) AS s FROM exj GROUP BY id, part_id, y)"""
)


def rule_weights(dim: int) -> list[float]:
    return [((j % 7) - 3) / 10.0 for j in range(dim)]


def width(df: DataFrame) -> int:
    return df.agg(F.max(F.size("x"))).first()[0]


def ex_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, x, part_id) from ``lineitem``; the volume fixture."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_extendedprice") > 35000, 1.0).otherwise(-1.0).alias("y"),
        F.array(
            F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(1.0)
        ).alias("x"),
        F.pmod("l_orderkey", F.lit(N_BLOCKS)).cast("int").alias("part_id"),
    )


EX_LINE = """
ex AS (SELECT l_orderkey AS id, CAST(l_orderkey % 8 AS INTEGER) AS part_id,
              CAST(CASE WHEN l_extendedprice > 35000 THEN 1 ELSE -1 END AS DOUBLE) AS y,
              l_quantity / 50 AS x0, l_discount * 10 AS x1, l_tax * 10 AS x2, 1.0::DOUBLE AS x3
       FROM lineitem),
scored AS (SELECT *, 0.5::DOUBLE * x0 - 0.25::DOUBLE * x1 + 0.1::DOUBLE * x2
                     - 0.2::DOUBLE * x3 AS s FROM ex)"""


def ex_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, x, part_id) with two features: the sums of the even and odd coordinates
    of the embedding."""
    half = lambda k: F.aggregate(
        F.filter("x", lambda v, j: j % 2 == k), F.lit(0.0), lambda a, v: a + v
    )
    return ex_emb(spark, sf_dir).withColumn("x", F.array(half(0), half(1)))


EX_PAIR = (
    EX
    + """,
pair AS (SELECT id, part_id, y, sum(CASE WHEN j % 2 = 0 THEN v ELSE 0 END) AS a,
                sum(CASE WHEN j % 2 = 1 THEN v ELSE 0 END) AS b
         FROM exj GROUP BY id, part_id, y)"""
)


def ex_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, x, part_id) with two features of ``lineitem``: the quantity, which tells much
    of the price, and the tax, which tells nothing."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_extendedprice") > 35000, 1.0).otherwise(-1.0).alias("y"),
        F.array(F.col("l_quantity") / 50 - 0.5, F.col("l_tax") * 10 - 0.4).alias("x"),
        F.pmod("l_orderkey", F.lit(N_BLOCKS)).cast("int").alias("part_id"),
    )


EX_PRICE = """
price AS (SELECT l_orderkey AS id, CAST(CASE WHEN l_extendedprice > 35000 THEN 1 ELSE -1 END AS DOUBLE) AS y,
                 l_quantity / 50 - 0.5::DOUBLE AS a, l_tax * 10 - 0.4::DOUBLE AS b,
                 CAST(l_orderkey % 8 AS INTEGER) AS part_id FROM lineitem)"""


def ex_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, size, idx, val, part_id): all coordinates, coordinate j at place
    3 * j + id % 3, so that a third of the places of a row is filled."""
    dense = ex_emb(spark, sf_dir)
    place = lambda v, j: (3 * j + F.col("id") % 3).cast("int")
    return dense.select(
        "id",
        "y",
        (3 * F.size("x")).alias("size"),
        F.transform("x", place).alias("idx"),
        F.col("x").alias("val"),
        "part_id",
    )


EX_SPARSE = EX + """,
sp AS (SELECT id, y, part_id, CAST(3 * j + id % 3 AS INTEGER) AS j, v FROM exj)"""


def as_sparse(dense: DataFrame) -> DataFrame:
    return dense.select(
        "id",
        "y",
        F.size("x").alias("size"),
        F.sequence(F.lit(0), F.size("x") - 1).alias("idx"),
        F.col("x").alias("val"),
    )


def libsvm_lines(sparse: DataFrame, base: int) -> DataFrame:
    """(id, line)."""
    return sparse.select(
        "id", text.libsvm_line(F.col("y"), F.col("idx"), F.col("val"), base).alias("line")
    )


# --- block states ---------------------------------------------------------------


def block_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_id, n, w, u): w = mean x of the block, u = mean x of its positives - w."""
    rows = ex_emb(spark, sf_dir).withColumn("v", array_to_vector("x"))
    positive = (F.col("y") == 1.0).cast("double")
    means = rows.groupBy("part_id").agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.mean(F.col("v"))).alias("w"),
        vector_to_array(Summarizer.mean(F.col("v"), positive)).alias("p"),
    )
    return means.select(
        "part_id", "n", "w", F.zip_with("p", "w", lambda p, w: p - w).alias("u")
    )


def overall_mean(spark: SparkSession, sf_dir: str) -> list[float]:
    """z of the step checks: mean x over all rows."""
    rows = ex_emb(spark, sf_dir)
    return rows.agg(vector_to_array(Summarizer.mean(array_to_vector("x")))).first()[0]


STATE = EX + """,
state AS (SELECT part_id, j, count(*) AS n, avg(v) AS w,
                 avg(CASE WHEN y = 1 THEN v END) - avg(v) AS u
          FROM exj GROUP BY part_id, j),
zed AS (SELECT j, avg(v) AS z FROM exj GROUP BY j),
nb AS (SELECT CAST(count(DISTINCT part_id) AS BIGINT) AS n_blocks FROM ex)"""


# --- run metrics ----------------------------------------------------------------


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics, one run per row of ``orders``."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    higgs, admm = key % 2 == 1, cust % 2 == 0
    width = F.when(higgs, 28).otherwise(47236)
    nonzero = width - (key % 20).cast("int")
    limit = F.when(admm, 50).otherwise(100)
    steps = (10 + key % 41).cast("int")
    dataset = F.when(higgs, "higgs").otherwise("rcv1")
    return table(spark, sf_dir, "orders").select(
        F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + key).alias("timestamp"),
        dataset.alias("dataset"),
        F.when(admm, "admm").otherwise("lbfgs").alias("algorithm"),
        F.when(key % 3 == 0, "2_4").otherwise("4_0").alias("spark_version"),
        (15000 + key).alias("train_samples"),
        (10000 + cust).alias("test_samples"),
        width.alias("features"),
        F.get(F.array(F.lit(5), F.lit(8), F.lit(10), F.lit(15)), (cust % 4).cast("int")).alias(
            "partitions"
        ),
        F.lit(0.01).alias("lambda"),
        limit.alias("max_iterations"),
        steps.alias("actual_iterations"),
        (F.floor("o_totalprice") / 8.0).alias("runtime_sec"),
        (60.0 + (key % 4000) / 100.0).alias("accuracy_percent"),
        (F.floor("o_totalprice") / 1024.0).alias("model_norm"),
        nonzero.alias("non_zero_weights"),
        width.alias("total_weights"),
        text.nonzero_percent(nonzero, width).alias("non_zero_percent"),
        text.convergence_status(steps < limit).alias("convergence_status"),
        F.concat(dataset, F.lit("_train"), (10 + key % 10).cast("string"), F.lit("k.binary")).alias(
            "train_file"
        ),
        F.when(
            key % 5 == 0, F.concat(dataset, F.lit("_holdout.binary"))
        ).otherwise(F.concat(F.lit("/data/"), dataset, F.lit("_test10k.binary"))).alias("test_file"),
    )


METRICS = """
metrics AS (
  SELECT *, CAST(non_zero_weights AS DOUBLE) / total_weights * 100 AS non_zero_percent,
         CASE WHEN actual_iterations < max_iterations THEN 'converged'
              ELSE 'max_iterations' END AS convergence_status,
         dataset || '_train' || (10 + o_orderkey % 10) || 'k.binary' AS train_file,
         CASE WHEN o_orderkey % 5 = 0 THEN dataset || '_holdout.binary'
              ELSE '/data/' || dataset || '_test10k.binary' END AS test_file
  FROM (
    SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_milliseconds(o_orderkey) AS "timestamp",
           CASE WHEN o_orderkey % 2 = 1 THEN 'higgs' ELSE 'rcv1' END AS dataset,
           CASE WHEN o_custkey % 2 = 0 THEN 'admm' ELSE 'lbfgs' END AS algorithm,
           CASE WHEN o_orderkey % 3 = 0 THEN '2_4' ELSE '4_0' END AS spark_version,
           15000 + o_orderkey AS train_samples, 10000 + o_custkey AS test_samples,
           CAST(CASE WHEN o_orderkey % 2 = 1 THEN 28 ELSE 47236 END AS INTEGER) AS features,
           CAST([5, 8, 10, 15][o_custkey % 4 + 1] AS INTEGER) AS partitions,
           0.01::DOUBLE AS lambda,
           CAST(CASE WHEN o_custkey % 2 = 0 THEN 50 ELSE 100 END AS INTEGER) AS max_iterations,
           CAST(10 + o_orderkey % 41 AS INTEGER) AS actual_iterations,
           floor(o_totalprice) / 8.0::DOUBLE AS runtime_sec,
           60.0::DOUBLE + (o_orderkey % 4000) / 100.0::DOUBLE AS accuracy_percent,
           floor(o_totalprice) / 1024.0::DOUBLE AS model_norm,
           CAST(CASE WHEN o_orderkey % 2 = 1 THEN 28 ELSE 47236 END - o_orderkey % 20
                AS INTEGER) AS non_zero_weights,
           CAST(CASE WHEN o_orderkey % 2 = 1 THEN 28 ELSE 47236 END AS INTEGER) AS total_weights
    FROM orders)),
cmp AS (
  SELECT replace(spark_version, '_', '.') AS version, upper(algorithm) AS algorithm,
         upper(dataset) AS dataset, partitions, runtime_sec AS runtime_s,
         accuracy_percent AS accuracy_pct, actual_iterations AS iterations,
         model_norm AS l2_norm, non_zero_weights, train_samples, test_samples, features,
         CAST(non_zero_weights AS DOUBLE) / features * 100 AS pct_nonzero,
         upper(algorithm) || ' v' || replace(spark_version, '_', '.') AS series
  FROM metrics)"""
