"""Vector arithmetic on array<double> columns, as native expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this width a dot product is written out term by term, so it stays inside
# whole-stage codegen; wider vectors use higher-order functions.
UNROLL_LIMIT = 64
NEAR_ZERO = 1e-6


def vector_literal(values: Sequence[float]) -> Column:
    """A constant array<double>. Wide vectors travel as one JSON literal, which the
    optimizer folds into an array constant, rather than as one expression each."""
    numbers = [float(v) for v in values]
    if not all(math.isfinite(v) for v in numbers):
        raise ValueError("vector has non-finite values")
    if not numbers:
        return F.array().cast("array<double>")
    if len(numbers) <= UNROLL_LIMIT:
        return F.array(*[F.lit(v) for v in numbers])
    return F.from_json(F.lit("[" + ",".join(map(repr, numbers)) + "]"), "array<double>")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def scale(a: Column, factor: Column | float) -> Column:
    k = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(a, lambda p: p * k)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, p: acc + p)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, p: acc + p * p)


def l2_norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def nonzero_count(a: Column, eps: float = NEAR_ZERO) -> Column:
    return F.size(F.filter(a, lambda p: F.abs(p) > F.lit(eps)))


def dot(x: Column, w: Column | Sequence[float]) -> Column:
    """Inner product of dense vectors; constant weights of small width are unrolled.

    One rule at every width: what only one side has counts as zero; a null vector or a null
    within the common width gives null.
    """
    if isinstance(w, Column):
        common = F.least(F.size(x), F.size(w))
        cut = lambda v: F.slice(v, F.lit(1), common)
        return F.when(
            x.isNotNull() & w.isNotNull(), total(F.zip_with(cut(x), cut(w), lambda p, q: p * q))
        )
    if len(w) > UNROLL_LIMIT:
        return dot(x, vector_literal(w))
    terms = F.lit(0.0)
    for j, weight in enumerate(w):
        value = F.when(F.size(x) > j, F.get(x, F.lit(j))).otherwise(F.lit(0.0))
        terms = terms + value * F.lit(float(weight))
    return F.when(x.isNotNull(), terms)


def sparse_dot(idx: Column, val: Column, w: Column | Sequence[float]) -> Column:
    """Inner product of a sparse row (0-based ascending indices) with dense weights. A
    feature that the weights do not have counts as zero."""
    weights = w if isinstance(w, Column) else vector_literal(w)
    term = lambda i, v: v * F.coalesce(F.get(weights, i), F.lit(0.0))
    return total(F.zip_with(idx, val, term))


def scatter(idx: Column, val: Column, size: Column | int) -> Column:
    """Sparse to dense for ascending unique indices: each value is preceded by the
    zeros of its gap, so the work is linear in the width."""
    width = size if isinstance(size, Column) else F.lit(int(size))
    zero = F.lit(0.0)
    before = F.concat(F.array(F.lit(-1)), F.slice(idx, F.lit(1), F.greatest(F.size(idx) - 1, F.lit(0))))
    gaps = F.zip_with(idx, F.slice(before, F.lit(1), F.size(idx)), lambda i, p: i - p - 1)
    pieces = F.zip_with(gaps, val, lambda g, v: F.concat(F.array_repeat(zero, g), F.array(v)))
    last = F.coalesce(F.try_element_at(idx, F.lit(-1)), F.lit(-1))
    return F.concat(F.flatten(pieces), F.array_repeat(zero, width - last - 1))
