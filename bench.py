"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Fits are timed by the fit call alone, as the published numbers are, after the examples
were loaded and cached. The first, untimed fit starts the Python workers. Consensus fits
have an intercept, as the baseline has; ``consensus_plain`` has none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quorumfit.operators import evaluate  # noqa: E402
from quorumfit.operators.blocks import hash_split  # noqa: E402
from quorumfit.plans.baseline import fit_lbfgs  # noqa: E402
from quorumfit.plans.estimator import ConsensusLogisticRegression  # noqa: E402
from quorumfit.registry import QUERIES  # noqa: E402
from quorumfit.registry import fixtures as X  # noqa: E402
from quorumfit.session import local_session  # noqa: E402
from quorumfit.sources.libsvm import from_ml_vectors  # noqa: E402

TEXT_WIDTH = 47236
TABLE_QUERIES = ["block_loss_gradient", "accuracy", "consensus_scores", "runtime_comparison",
                 "combined_metrics", "parse_libsvm_lines", "row_cap"]


def ex_text(spark, sf_dir):
    """Whole documents as hashed, length-normalised word counts; English or not."""
    docs = X.table(spark, sf_dir, "documents").select(
        "text", F.when(F.col("lang") == "en", 1.0).otherwise(-1.0).alias("y")
    )
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+").transform(docs)
    counts = HashingTF(inputCol="words", outputCol="tf", numFeatures=TEXT_WIDTH).transform(words)
    unit = Normalizer(inputCol="tf", outputCol="unit").transform(counts)
    return from_ml_vectors(unit, "y", "unit")


def ex_products(spark, sf_dir, rows=15_000):
    """About 15,000 line items with 28 features: six columns, their products, a constant."""
    lines = X.table(spark, sf_dir, "lineitem")
    share = int(rows / max(lines.count(), rows) * 1_000_000)
    kept = lines.where(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1_000_000)) <= share)
    base = [
        F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10,
        F.col("l_linenumber") / 7, F.pmod("l_partkey", F.lit(97)) / 97, F.pmod("l_suppkey", F.lit(89)) / 89,
    ]
    products = [a * b for i, a in enumerate(base) for b in base[i:]]
    return kept.select(
        F.xxhash64("l_orderkey", "l_linenumber").alias("id"),
        F.when(F.col("l_extendedprice") > 35000, 1.0).otherwise(-1.0).alias("y"),
        F.array(*base, *products, F.lit(1.0)).alias("x"),
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    sets = {
        "embeddings": X.ex_emb(spark, sf_dir).drop("part_id"),
        "lineitem": X.ex_line(spark, sf_dir).drop("part_id"),
        "documents": ex_text(spark, sf_dir),
        "products": ex_products(spark, sf_dir),
    }
    sides = {}
    for name, data in sets.items():
        if "id" not in data.columns:
            data = data.withColumn("id", F.monotonically_increasing_id())
        sides[name] = [side.persist() for side in hash_split(data, "id", 0.8)]
        for side in sides[name]:
            side.count()
    ConsensusLogisticRegression(max_iter=2).fit(sides["embeddings"][0])
    fit_lbfgs(sides["embeddings"][0], max_iter=2)

    seconds: dict[str, float] = {}
    details: dict[str, dict] = {}
    fits = [(a, n, {}) for n in sets for a in ("consensus", "lbfgs")]
    fits += [
        ("consensus_settled", "embeddings", {"criterion": "both", "penalty": "spectral"}),
        ("consensus_across", "lineitem", {"placement": "across", "max_iter": 2}),
        ("consensus_plain", "embeddings", {"fit_intercept": False}),
    ]
    for algorithm, name, options in fits:
        width = TEXT_WIDTH if name == "documents" else None
        train, test = sides[name]
        began = time.time()
        if algorithm == "lbfgs":
            model, label = fit_lbfgs(train), "label"
        else:
            options = {"fit_intercept": True} | options
            model, label = ConsensusLogisticRegression(**options).fit(train, num_features=width), "y"
        key = f"{algorithm}_{name}"
        seconds[key] = round(time.time() - began, 3)
        details[key] = {
            "iterations": model.iterations,
            "sec_per_iteration": round(seconds[key] / model.iterations, 3),
            "held_out_accuracy": round(
                evaluate.accuracy(model.transform(test), label).first()["accuracy"], 4
            ),
        }
    for name in TABLE_QUERIES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "fits": details,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
