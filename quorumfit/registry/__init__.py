"""All registered queries."""

from quorumfit.registry import experiments, expressions, fitting, storage  # noqa: F401
from quorumfit.registry.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
