"""Every registered query at the smallest scale, next to its SQL where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402
from quorumfit.registry import ORACLES, QUERIES  # noqa: E402



@pytest.fixture(scope="module")
def con(sf_dir):
    return check_oracles.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    good, note = check_oracles.compare(spark, con, name, sf_dir)
    assert good, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
