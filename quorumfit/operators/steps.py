"""The steps of consensus fitting as DataFrame expressions.

``state`` has one row per block: (part_id, n, w, u). The global steps work on the
summary that :func:`state_summary` computes in a single aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumfit.functions import vectors as V

START_SCALE = 0.01
# Coordinates that one task adds up over all blocks.
SLICE = 4096
_HASH_RANGE = 1 << 30


def initial_state(blocks: DataFrame, dim: int, seed: int | None = None) -> DataFrame:
    """State of every non-empty block: u = 0 and w = 0, or with a seed w uniform in
    [0, 0.01) drawn from a hash of (seed, block, coordinate), so a retried task draws
    the same numbers."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    if seed is None:
        w = zeros
    else:
        w = F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col("part_id"), j), F.lit(_HASH_RANGE))
            / F.lit(float(_HASH_RANGE))
            * F.lit(START_SCALE),
        )
    return blocks.withColumn("w", w).withColumn("u", zeros)


def join_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Give every row the state of its block."""
    return rows.join(state, "part_id")


def with_consensus(df: DataFrame, z: Sequence[float], rho: float) -> DataFrame:
    """Attach the global vector and penalty to every row as constants."""
    return df.withColumn("z", V.vector_literal(z)).withColumn("rho", F.lit(float(rho)))


def state_summary(state: DataFrame) -> DataFrame:
    """Sums over all blocks, by slices of ``SLICE`` coordinates, in one aggregation.

    (slice, n_blocks, w_avg, u_avg, w_sq, w_spread): per coordinate the means of w and u,
    the sum of w_i^2 and of (w_i - w_avg)^2. Tasks combine their blocks first and slices are
    reduced by different tasks, so none merges whole vectors of all others. The spread makes
    the primal residual available without a second pass:
    sum ||w_i - z||^2 = sum(w_spread) + n_blocks * ||w_avg - z||^2.
    """
    last = F.floor((F.size("w") - 1) / SLICE).cast("int")
    cut = lambda k, c: F.slice(c, k * SLICE + 1, F.lit(SLICE))
    pieces = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("slice"), cut(k, "w").alias("w"), cut(k, "u").alias("u")),
    )
    sliced = state.select(F.explode(pieces).alias("e")).select("e.*")
    w_stats = Summarizer.metrics("mean", "variance", "normL2", "count").summary(
        array_to_vector("w")
    )
    found = sliced.groupBy("slice").agg(
        w_stats.alias("ws"), Summarizer.mean(array_to_vector("u")).alias("um")
    )
    n = F.col("ws.count")
    return found.select(
        "slice",
        n.alias("n_blocks"),
        vector_to_array("ws.mean").alias("w_avg"),
        vector_to_array("um").alias("u_avg"),
        F.transform(vector_to_array("ws.normL2"), lambda v: v * v).alias("w_sq"),
        F.transform(vector_to_array("ws.variance"), lambda v: v * (n - 1)).alias("w_spread"),
    )


def state_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """w and u of a gathered state as matrices, blocks by dimension."""
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return tuple(flat(c).reshape(table.num_rows, -1) for c in ("w", "u"))


def gathered_summary(table: pa.Table) -> tuple[np.ndarray, ...]:
    """w_avg, u_avg, w_sq and w_spread of :func:`state_summary` from a gathered state."""
    w, u = state_arrays(table)
    w_avg = w.mean(axis=0)
    return w_avg, u.mean(axis=0), (w * w).sum(axis=0), ((w - w_avg) ** 2).sum(axis=0)


def summary_by_feature(summary: DataFrame) -> DataFrame:
    """The summary as one row per feature: (j, w_avg, u_avg, n_blocks, w_sq, w_spread)."""
    columns = ["w_avg", "u_avg", "w_sq", "w_spread"]
    return summary.select(
        "slice", "n_blocks", F.posexplode(F.arrays_zip(*columns)).alias("k", "e")
    ).select((F.col("slice") * SLICE + F.col("k")).alias("j"), "n_blocks", *[f"e.{c}" for c in columns])


# The functions below hold for columns and for plain numbers or arrays alike.


def shrinkage(rho, n_blocks, lam):
    return n_blocks * rho / (n_blocks * rho + 2.0 * lam)


def consensus(w_avg, u_avg, rho, n_blocks, lam):
    """z = N*rho / (N*rho + 2*lambda) * (w_avg + u_avg)."""
    return (w_avg + u_avg) * shrinkage(rho, n_blocks, lam)


def soft_threshold(value, by):
    """Towards zero by ``by``, and zero within it; of a number, an array or a column."""
    if isinstance(value, Column):
        return F.signum(value) * F.greatest(F.abs(value) - by, F.lit(0.0))
    return np.sign(value) * np.maximum(np.abs(value) - by, 0.0)


def elastic_consensus(w_avg, u_avg, rho, n_blocks, lam, l1_ratio):
    """argmin of lam * (l1_ratio * |z| + (1 - l1_ratio) * z^2) + N*rho/2 * (z - w_avg - u_avg)^2
    by coordinate: a soft threshold, then the shrinkage of the squared part."""
    pulled = soft_threshold(w_avg + u_avg, lam * l1_ratio / (n_blocks * rho))
    return pulled * shrinkage(rho, n_blocks, lam * (1.0 - l1_ratio))


def primal_residual(w_spread, gap_sq, n_blocks):
    """sqrt(sum of ||w_i - z||^2), with gap_sq = ||w_avg - z||^2."""
    return (w_spread + n_blocks * gap_sq) ** 0.5


def dual_residual(rho, n_blocks, step_sq):
    """rho * sqrt(N) * ||z - z_prev||, with step_sq the squared norm."""
    return rho * (n_blocks * step_sq) ** 0.5


def primal_tolerance(n_blocks, largest_norm, eps_abs=1e-3, eps_rel=1e-3):
    """Tolerance on the primal residual; ``largest_norm`` is the larger one of
    sqrt(sum ||w_i||^2) and ||z||."""
    return n_blocks**0.5 * eps_abs + largest_norm * eps_rel


# Fixed values of residual balancing.
BALANCE_RATIO = 10.0
BALANCE_FACTOR = 2.0


def next_penalty(rho: float, primal: float, dual: float) -> float:
    """Raise rho when the primal residual dominates, lower it when the dual one does."""
    if primal > BALANCE_RATIO * dual:
        return rho * BALANCE_FACTOR
    if dual > BALANCE_RATIO * primal:
        return rho / BALANCE_FACTOR
    return rho


def next_penalty_column(rho: Column, primal: Column, dual: Column) -> Column:
    """:func:`next_penalty` for whole tables of residuals."""
    return (
        F.when(primal > BALANCE_RATIO * dual, rho * BALANCE_FACTOR)
        .when(dual > BALANCE_RATIO * primal, rho / BALANCE_FACTOR)
        .otherwise(rho)
    )


# Fixed values of the spectral penalty: two moves count as correlated above this cosine, and
# the penalty of iteration k changes by a factor of 1 + SPECTRAL_CHANGE / k^2 at most.
SPECTRAL_COSINE = 0.2
SPECTRAL_CHANGE = 100.0


def spectral_curvature(move_sq: float, cross: float, change_sq: float) -> float | None:
    """Curvature along a move of the weights, from the squared length of the move, of the
    change of the gradient, and their product: the minimum-gradient estimate, or the
    steepest-descent one less half of it where the two differ much. None where move and
    change are hardly correlated, as the estimate says nothing then."""
    if not cross > SPECTRAL_COSINE * (move_sq * change_sq) ** 0.5:
        return None
    steepest, least = change_sq / cross, cross / move_sq
    return least if 2.0 * least > steepest else steepest - 0.5 * least


def curvatures(before, after, z_before, z_after, rho_before: float, rho_after: float) -> list:
    """Curvature of every block's loss between two solutions (w, u), matrices of blocks by
    dimension. At a solution the gradient of the block's loss is -rho * (w - z + u)."""
    move = after[0] - before[0]
    change = rho_before * (before[0] - z_before + before[1]) - rho_after * (after[0] - z_after + after[1])
    return [spectral_curvature(float(m @ m), float(m @ c), float(c @ c)) for m, c in zip(move, change)]


def block_curvatures(
    before: DataFrame, after: DataFrame, z_before: np.ndarray, z_after: np.ndarray,
    rho_before: float, rho_after: float,
) -> DataFrame:
    """(part_id, curvature): of every block's loss between two of its solutions; null where
    it cannot be told.

    ``before`` and ``after`` are states as solved with the given z and penalty, so no pass
    over the data is needed. The vectors z are broadcast.
    """
    sc = before.sparkSession.sparkContext
    shared = sc.broadcast((z_before, z_after))

    def found(batches):
        for batch in batches:
            w0, u0, w1, u1 = (
                batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for c in ("w0", "u0", "w1", "u1")
            )
            each = curvatures((w0, u0), (w1, u1), *shared.value, rho_before, rho_after)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part_id"), pa.array(each, pa.float64())], ["part_id", "curvature"]
            )

    named = lambda df, k: df.select("part_id", F.col("w").alias(f"w{k}"), F.col("u").alias(f"u{k}"))
    joined = named(before, 0).join(named(after, 1), "part_id")
    return joined.mapInArrow(found, "part_id int, curvature double")


def spectral_penalty(rho: float, iteration: int, block: float | None, shared: float | None) -> float:
    """The geometric mean of the curvature of the blocks' losses and of a block's share of
    the regulariser, either one where the other is not known, within the change allowed."""
    known = [v for v in (block, shared) if v is not None and v > 0.0]
    if not known:
        return rho
    limit = 1.0 + SPECTRAL_CHANGE / iteration**2
    return float(min(max(np.prod(known) ** (1.0 / len(known)), rho / limit), rho * limit))


def dual_step(state: DataFrame, z: Column) -> DataFrame:
    """u_i <- u_i + w_i - z."""
    return state.withColumn("u", V.subtract(V.add(F.col("u"), F.col("w")), z))


def augmented_term(w: Column, z: Column, u: Column, rho: Column) -> Column:
    """(rho / 2) * ||w - z + u||^2."""
    return rho / 2.0 * V.squared_norm(V.add(V.subtract(w, z), u))


def augmented_gradient(w: Column, z: Column, u: Column, rho: Column) -> Column:
    return V.scale(V.add(V.subtract(w, z), u), rho)
