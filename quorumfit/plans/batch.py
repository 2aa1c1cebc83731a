"""Batch entry: fit a LibSVM file and save its weights.

    spark-submit quorumfit/plans/batch.py PATH BLOCKS OUT [--lam 0.1] [--max-iter 50] ...
"""

from __future__ import annotations

import argparse
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

from quorumfit.plans.runs import fit_and_save  # noqa: E402


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="batch", description=__doc__.splitlines()[0])
    out.add_argument("path", help="LibSVM text, 1-based")
    out.add_argument("blocks", type=int, help="number of blocks")
    out.add_argument("out", help="folder for the weights")
    out.add_argument("--num-features", type=int, help="dimension; found from the data if not given")
    out.add_argument("--lam", type=float, default=0.1, help="penalty on the weights")
    out.add_argument("--max-iter", type=int, default=50)
    out.add_argument("--criterion", choices=["primal", "both"], default="primal")
    out.add_argument("--penalty", choices=["balance", "spectral"], default="balance")
    out.add_argument("--fit-intercept", action="store_true")
    return out


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    if given.blocks < 1:
        parser().error("blocks must be 1 or more")
    spark = SparkSession.builder.appName("fit").getOrCreate()
    weights = fit_and_save(
        spark, given.path, given.blocks, given.out, given.num_features, given.lam, given.max_iter,
        criterion=given.criterion, penalty=given.penalty, fit_intercept=given.fit_intercept,
    )
    print(f"{weights.count()} weights in {given.out}")


if __name__ == "__main__":
    main()
