"""Consensus logistic regression over blocks of rows."""

from __future__ import annotations

import time
from contextlib import ExitStack
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.operators import blocks as B
from quorumfit.operators import evaluate, local_solve, steps
from quorumfit.plans.recovery import Journal, Progress
from quorumfit.plans.updater import SquaredL2
from quorumfit.schemas import CHUNK, STATE, TRACE
from quorumfit.session import drop_path, fresh_path, hadoop_path

# Bytes of all blocks' states up to which a round returns them rather than writes them.
GATHER_BYTES = 32 << 20
# Bytes of task memory per stored value: a dense value once, a sparse one with its index, and
# the row number and product that whole rows in the hands of a ``local_update`` need.
DENSE_VALUE_BYTES = 8
SPARSE_VALUE_BYTES = 28
# And per row: its label, and the length of a sparse one.
DENSE_ROW_BYTES = 8
SPARSE_ROW_BYTES = 12


_STATE_COLUMNS = ["part_id", "n", "w", "u", "slot", "evaluations"]


@dataclass
class ConsensusModel:
    weights: np.ndarray
    intercept: float
    iterations: int
    converged: bool
    runtime_sec: float
    placement: str
    trace: DataFrame
    state: DataFrame | None
    state_path: str | None

    def release(self) -> None:
        """Give up ``state`` and delete the table behind it, if there is one; the weights stay."""
        if self.state_path is not None:
            target, files = hadoop_path(self.trace.sparkSession, self.state_path)
            files.delete(target, True)
        self.state = None

    @property
    def weights_df(self) -> DataFrame:
        """(j, weight), without the intercept."""
        return evaluate.weights_table(self.trace.sparkSession, self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        return evaluate.predict(df, self.weights, self.intercept)


def _with_last_dual_step(state: DataFrame, z: np.ndarray) -> DataFrame:
    """(part_id, n, w, u) with the pending u + w - z applied; z is broadcast, as it may be
    too wide for a constant of the plan."""
    shared = state.sparkSession.sparkContext.broadcast(z)

    def step(batches):
        for batch in batches:
            w, u = (
                batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for c in ("w", "u")
            )
            moved = (u + w - shared.value).ravel()
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part_id", "n", "w")),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(moved))],
                ["part_id", "n", "w", "u"],
            )

    return state.select("part_id", "n", "w", "u").mapInArrow(step, STATE)


@dataclass
class ConsensusLogisticRegression:
    """argmin_z sum over blocks of (mean loss of the block) + lam * ||z||^2.

    With equal blocks this is ridge logistic regression with regParam 2*lam/n_blocks;
    ``weighting="rows"`` weighs blocks by their share of rows, which makes the result
    independent of the block count (regParam 2*lam).

    The default stop rule is the primal residual alone after ``min_iter`` iterations;
    ``criterion="both"`` also waits for z to settle. ``penalty="balance"`` adapts rho by the
    residuals; ``"spectral"`` sets it every ``spectral_every`` iterations from the curvature
    of the blocks' losses between two of their solutions (Barzilai-Borwein estimates that
    count only where weights and gradients move together), which settles in far fewer
    iterations when the first rho is off. ``rescale_dual`` keeps rho*u fixed when rho adapts.
    ``placement`` is ``auto`` (by the measured size of the largest
    block against ``block_budget``), ``task`` or ``across``. A strategy with a
    ``local_update`` needs ``task`` to be asked for, whatever the size of the data.
    """

    lam: float = 0.01
    n_blocks: int = 8
    max_iter: int = 50
    min_iter: int = 10
    rho: float = 1.0
    eps_abs: float = 1e-3
    eps_rel: float = 1e-3
    criterion: str = "primal"
    penalty: str = "balance"
    spectral_every: int = 2
    rescale_dual: bool = True
    weighting: str = "blocks"
    fit_intercept: bool = False
    row_cap: int | None = None
    seed: int | None = None
    local_max_iter: int = 50
    local_tol: float = 1e-4
    local_memory: int = 5
    placement: str = "auto"
    block_budget: int = 512 << 20
    storage: StorageLevel = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)
    updater: SquaredL2 | None = None

    def fit(
        self, df: DataFrame, key: str | None = None, num_features: int | None = None,
        checkpoint: str | None = None, resume: bool = False, nested: B.NestedBlocks | None = None,
    ) -> ConsensusModel:
        """Fit on ``(y, x)`` or ``(y, idx, val)``. Rows go to blocks by an existing
        ``part_id``, by ``key`` or ``id``, or row by row. Caches and scratch tables are gone
        when it returns or fails, but for the state table of the model.

        With ``checkpoint``, a folder in shared storage, every round leaves a manifest and
        the states' table there. ``resume=True`` goes on from the newest manifest, in this
        session or another one, with the same trace as a fit that was never stopped; blocks,
        rows and dimension must be the same. A folder without a manifest is a new fit.

        ``nested`` has the blocks of ``df`` for several counts, ``n_blocks`` among them; the
        fit then neither packs nor exchanges the data, and leaves it as it is.
        """
        if self.penalty not in ("balance", "spectral"):
            raise ValueError("penalty is 'balance' or 'spectral'")
        if resume and checkpoint is None:
            raise ValueError("resume needs the checkpoint folder")
        journal = Journal(df.sparkSession, checkpoint) if checkpoint else None
        progress = journal.latest() if journal else None
        if progress is not None and not resume:
            raise ValueError(f"{checkpoint} holds a fit; pass resume=True or another folder")
        if progress is not None:
            journal.tidy(progress)
        with ExitStack() as cleanup:
            return self._fit(df, key, num_features, cleanup, journal, progress, nested)

    def _fit(
        self, df: DataFrame, key: str | None, num_features: int | None, cleanup: ExitStack,
        journal: Journal | None, progress: Progress | None, nested: B.NestedBlocks | None,
    ) -> ConsensusModel:
        started = time.time()
        spark = df.sparkSession
        sc = spark.sparkContext
        updater = self.updater or SquaredL2(
            self.lam, self.eps_abs, self.eps_rel, self.criterion, self.fit_intercept
        )
        if updater.local_update is not None and self.placement != "task":
            raise ValueError("a custom local_update works on whole blocks: set placement='task'")
        if nested is not None:
            chunks, chunks_path = nested.chunks_of(self.n_blocks), None
        else:
            chunks, chunks_path = self._chunks(df, key, cleanup, journal, progress)
        found = B.chunk_profile(chunks).first()
        if not found["rows"]:
            raise ValueError("no training rows")
        n_blocks, width = found["n_blocks"], self._width(found, num_features)
        dim = width + int(self.fit_intercept)
        layout = {"blocks": n_blocks, "rows": found["rows"], "dim": dim, "weighting": self.weighting}
        if progress is not None and progress.layout != layout:
            raise ValueError(f"the stopped fit had {progress.layout}, this one has {layout}")
        problem = local_solve.LocalProblem(
            dim, found["rows"], self.fit_intercept, self.weighting == "rows",
            self.local_memory, self.local_max_iter, self.local_tol,
            updater.loss, updater.dual_update,
        )
        per_value = SPARSE_VALUE_BYTES if found["sparse"] else DENSE_VALUE_BYTES
        per_row = SPARSE_ROW_BYTES if found["sparse"] else DENSE_ROW_BYTES
        largest = found["max_values"] * per_value + found["max_rows"] * per_row
        in_task = self.placement == "task" or (
            self.placement == "auto" and largest <= self.block_budget
        )
        if found["first_id"] < 0:
            raise ValueError("part_id must not be negative")
        n_ids = found["last_id"] + 1
        tables: set[str] = set()
        cleanup.callback(lambda: [drop_path(spark, path) for path in tables])

        # States of a bounded size come back from a round as they are; others, and all states of
        # a fit that may be resumed, are tables.
        gathered = journal is None and n_blocks * dim * 16 <= GATHER_BYTES

        def new_state() -> str:
            if journal is not None:
                return journal.path("state")
            path = fresh_path(spark, "state")
            tables.add(path)
            return path

        def forget(path: str | None) -> None:
            if journal is not None:
                journal.delete(path)
            elif path is not None:
                drop_path(spark, path)
                tables.discard(path)

        def kept(solved: DataFrame) -> tuple[DataFrame, pa.Table | None, str | None]:
            """A state, its rows if they are gathered, and its path if it is a table."""
            if gathered:
                rows = solved.select(*_STATE_COLUMNS).toArrow()
                return spark.createDataFrame(rows, local_solve.SOLVED), rows, None
            path = new_state()
            solved.write.parquet(path)
            return self._read_state(spark, path), None, path

        rows: pa.Table | None = None
        if progress is None:
            sizes = B.block_sizes(chunks).select("part_id", "n")
            if nested is not None:
                sizes = nested.slots_of(sizes, self.n_blocks)
            else:
                sizes = B.spread_slots(sizes, n_ids)
            start = steps.initial_state(sizes, dim, self.seed).withColumn("evaluations", F.lit(0))
            state, rows, state_path = kept(start)
            z, rho, dual_scale = np.zeros(dim), self.rho, 1.0
            trace: list[tuple] = []
            before, converged = None, False
        else:
            state_path, rho, dual_scale = progress.state_path, progress.rho, progress.dual_scale
            state = self._read_state(spark, state_path)
            z = np.array(progress.z)
            trace = [tuple(row) for row in progress.trace]
            before = {k: np.array(v) if isinstance(v, list) else v for k, v in progress.before.items()}
            converged = progress.converged

        tasks = chunks.rdd.getNumPartitions()
        data = chunks
        if in_task and nested is not None:
            data = nested.located_of(self.n_blocks)
        elif in_task:
            data = B.co_locate(chunks, n_ids, n_blocks).persist(self.storage)
            cleanup.callback(data.unpersist)
        elif n_blocks * dim * 8 > local_solve.BROADCAST_BYTES:
            counts = state.select("part_id", "n")
            data = B.salt_chunks(chunks, counts, n_blocks, found["rows"], tasks)
            data = data.persist(self.storage)
            cleanup.callback(data.unpersist)

        for iteration in range(len(trace) + 1, self.max_iter + 1):
            if converged:
                break
            z_bc = sc.broadcast(z)
            if self.penalty == "spectral":
                # An error of the gradient moves w by error / rho: as rho falls, so must it.
                problem = replace(problem, tol=self.local_tol * min(1.0, rho / self.rho))
            previous, old_rows, old_path = state, rows, state_path
            first = iteration == 1
            if in_task:
                state, rows, state_path = kept(local_solve.solve_in_task(
                    data, state, problem, z_bc, rho, dual_scale, first, updater.local_update,
                ))
            elif gathered and problem.searches_fit(n_blocks):
                rows = local_solve.solve_gathered(
                    data, state, problem, z_bc, rho, n_blocks, dual_scale, first, tasks
                )
                state = spark.createDataFrame(rows, local_solve.SOLVED)
            else:
                state_path, rows = local_solve.solve_across_tasks(
                    data, state, problem, z_bc, rho, n_blocks, dual_scale, first, tasks, new_state(),
                ), None
                state = self._read_state(spark, state_path)
            if rows is not None:
                w_avg, u_avg, w_sq, w_spread = steps.gathered_summary(rows)
            else:
                slices = sorted(steps.state_summary(state).collect(), key=lambda s: s["slice"])
                w_avg, u_avg, w_sq, w_spread = (
                    np.concatenate([s[c] for s in slices])
                    for c in ("w_avg", "u_avg", "w_sq", "w_spread")
                )
            z_bc.destroy()
            if iteration == 1 and data is not chunks and nested is None:
                chunks.unpersist()

            z_prev = z
            z = updater.z_update(w_avg, u_avg, rho, n_blocks)
            if not np.isfinite(z).all():
                raise ValueError("the fit left the finite numbers; check the features for NaN")
            gap, move = w_avg - z, z - z_prev
            primal = steps.primal_residual(w_spread.sum(), gap @ gap, n_blocks)
            dual = steps.dual_residual(rho, n_blocks, move @ move)
            w_norm, z_norm = w_sq.sum() ** 0.5, float(np.linalg.norm(z))
            tolerance = updater.tolerance(n_blocks, w_norm, z_norm)
            converged = iteration >= self.min_iter and bool(
                updater.converged(primal, dual, tolerance, rho)
            )
            trace.append(
                (iteration, float(primal), float(tolerance), float(dual), float(rho),
                 float(w_norm), z_norm, converged)
            )
            now = {}
            if self.penalty == "spectral":
                now = {"solved_z": z_prev, "rho": rho, "z": z, "pull": n_blocks * rho * (w_avg + u_avg - z)}
            following = rho
            if not converged and self.penalty == "balance":
                following = updater.next_rho(rho, primal, dual)
            elif not converged and before and iteration % self.spectral_every == 0:
                both = (previous, state) if rows is None or old_rows is None else (old_rows, rows)
                following = self._spectral(*both, before, now, iteration, n_blocks)
            dual_scale = rho / following if self.rescale_dual else 1.0
            rho, before = following, now
            if journal is not None:
                journal.save(Progress(
                    layout, iteration, z.tolist(), rho, dual_scale,
                    {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in before.items()},
                    [list(row) for row in trace], state_path, chunks_path, converged,
                ))
            forget(old_path)

        tables.discard(state_path)
        return ConsensusModel(
            weights=z[:width],
            intercept=float(z[-1]) if self.fit_intercept else 0.0,
            iterations=len(trace),
            converged=converged,
            runtime_sec=time.time() - started,
            placement="task" if in_task else "across",
            trace=spark.createDataFrame(trace, TRACE),
            state=_with_last_dual_step(state, z),
            state_path=state_path,
        )

    @staticmethod
    def _spectral(previous, state, before: dict, now: dict, iteration: int, n_blocks: int) -> float:
        """Next rho from how gradients changed with the weights since the round before: of the
        blocks' losses, and of the regulariser, whose pull at z the averages give. Both states
        are tables, or both gathered."""
        at = (before["solved_z"], now["solved_z"], before["rho"], now["rho"])
        if isinstance(state, pa.Table):
            order = lambda rows: steps.state_arrays(rows.sort_by("part_id"))
            known = [c for c in steps.curvatures(order(previous), order(state), *at) if c is not None]
            blocks = float(np.exp(np.mean(np.log(known)))) if known else None
        else:
            curvatures = steps.block_curvatures(previous, state, *at)
            blocks = curvatures.agg(F.exp(F.avg(F.log("curvature")))).first()[0]
        move, change = now["z"] - before["z"], now["pull"] - before["pull"]
        shared = steps.spectral_curvature(
            float(move @ move), float(move @ change), float(change @ change)
        )
        return steps.spectral_penalty(
            now["rho"], iteration, blocks, None if shared is None else shared / n_blocks
        )

    def _chunks(
        self, df: DataFrame, key: str | None, cleanup: ExitStack, journal: Journal | None,
        progress: Progress | None,
    ) -> tuple[DataFrame, str | None]:
        """Chunks, and where they are kept when a resumed fit must find the same ones."""
        if progress is not None and progress.chunks_path is not None:
            return df.sparkSession.read.schema(CHUNK).parquet(progress.chunks_path), progress.chunks_path
        key = key or ("id" if "id" in df.columns else None)
        if "part_id" not in df.columns:
            placed = B.assign_blocks(df, self.n_blocks, key)
            by_position = key is None
        else:
            placed, by_position = df, False
        if self.row_cap is not None:
            if key is None:
                raise ValueError("row_cap needs a key that orders the rows")
            placed = B.cap_rows(placed, self.row_cap, key)
        chunks = B.pack_chunks(placed)
        if not by_position:
            cleanup.callback(chunks.unpersist)
            return chunks.persist(self.storage), None
        # Positions are stable only within one run of a task, so they are fixed in a
        # table rather than recomputed after a lost executor.
        if journal is not None:
            path = journal.path("chunks")
        else:
            path = fresh_path(df.sparkSession, "chunks")
            cleanup.callback(drop_path, df.sparkSession, path)
        chunks.write.parquet(path)
        return df.sparkSession.read.schema(CHUNK).parquet(path), path

    @staticmethod
    def _width(found, num_features: int | None) -> int:
        width = num_features if num_features is not None else found["high"]
        dense = found["dense_low"] is not None
        if found["high"] > width or (dense and found["dense_low"] != width):
            raise ValueError(
                f"rows have dimension {found['dense_low']}..{found['high']}, expected {width}"
            )
        return width

    @staticmethod
    def _read_state(spark, path: str) -> DataFrame:
        return spark.read.schema(local_solve.SOLVED).parquet(path)
