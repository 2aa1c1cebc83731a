"""Every registered query of the operators at the smallest scale, next to its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import check_oracles  # noqa: E402
import corpus_pipeline  # noqa: E402
from quorumfit.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    good, note = check_oracles.compare(spark, check_oracles.connect(sf_dir), name, sf_dir)
    assert good, note


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5
