"""The per-block subproblem

    argmin_w  scale_i * mean loss over block i  +  (rho/2) * ||w - z + u_i||^2

solved on the executors by L-BFGS, warm-started from the block's previous w.

Two placements give the same minimiser. ``solve_in_task`` takes blocks whose size was
checked to fit one task: one co-grouped pass per consensus iteration.
``solve_across_tasks`` takes blocks of any size: a search step is one distributed
aggregation over the chunks, and no block is ever gathered in one place. The line search
works in score space: with s = X.w and r = X.d of a direction, the scores at any step t are
s + t.r, so one pass over the data gives the losses of a whole ladder of steps, and the
gradients of its first ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.operators.blocks import salt_count
from quorumfit.session import drop_path, fresh_path

FLUSH_BYTES = 64 << 20
BROADCAST_BYTES = 64 << 20
# Values that an evaluation takes up at a time: its arrays by row and by value stay small.
SLICE_VALUES = 1 << 16
# Steps of a line search that one pass tries, each half of the one before, and how many of
# them at most come with their gradient.
LADDER, LADDER_GRADIENTS = 4, 3

SOLVED = "part_id int, n bigint, w array<double>, u array<double>, slot int, evaluations int"
PARTIAL = "part_id int, n bigint, sums array<double>"
SEARCH = (
    "part_id int, n bigint, slot int, z_minus_u array<double>, u array<double>, w array<double>, "
    "f double, g array<double>, d array<double>, t double, s_hist array<double>, y_hist array<double>, "
    "steps int, evaluations int, done boolean"
)


def logistic_sums(y: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of logistic losses and their derivatives by score, without overflow: both come
    from exp(-|margin|)."""
    margin = y * scores
    small = np.exp(-np.abs(margin))
    value = np.maximum(-margin, 0.0) + np.log1p(small)
    return float(value.sum()), -y * np.where(margin >= 0.0, small, 1.0) / (1.0 + small)


def dual_update(u: np.ndarray, w: np.ndarray, z: np.ndarray) -> np.ndarray:
    return u + w - z


class Rows:
    """Rows of one or more chunks, dense or sparse, as flat arrays."""

    def __init__(self, y, lens, idx, val, dim: int, intercept: bool = False):
        self.y, self.dim, self.intercept = y, dim, intercept
        self.width = dim - 1 if intercept else dim
        if len(lens):
            self.lens, self.idx, self.val, self.x = lens, idx, val, None
        else:
            self.x = val.reshape(len(y), self.width)

    def scores(self, w: np.ndarray) -> np.ndarray:
        if self.x is not None:
            s = self.x @ w[: self.width]
        else:
            row = np.repeat(np.arange(len(self.y)), self.lens)
            s = np.bincount(row, weights=self.val * w[self.idx], minlength=len(self.y))
        return s + w[-1] if self.intercept else s

    def pull_back(self, c: np.ndarray) -> np.ndarray:
        if self.x is not None:
            g = self.x.T @ c
        else:
            g = np.bincount(self.idx, weights=self.val * np.repeat(c, self.lens), minlength=self.width)
        return np.append(g, c.sum()) if self.intercept else g

    def loss_gradient(self, w: np.ndarray, loss: Callable) -> tuple[float, np.ndarray]:
        value, by_score = loss(self.y, self.scores(w))
        return value, self.pull_back(by_score)


def sliced(y, lens, idx, val, dim: int, intercept: bool = False) -> Iterator[Rows]:
    """The rows of a chunk in slices of about ``SLICE_VALUES`` labels and values, or of four
    times the dimension, which are views of the chunk's arrays."""
    size = max(SLICE_VALUES, 4 * dim)
    if len(lens):
        ends = np.r_[0, np.cumsum(lens, dtype=np.int64)]
        before = ends + np.arange(len(ends))
        bounds = np.unique(np.r_[np.searchsorted(before, np.arange(0, before[-1], size)), len(y)])
        for a, b in zip(bounds[:-1], bounds[1:]):
            at = slice(ends[a], ends[b])
            yield Rows(y[a:b], lens[a:b], idx[at], val[at], dim, intercept)
    else:
        width = dim - int(intercept)
        step = max(size // (width + 1), 1)
        for a in range(0, len(y), step):
            yield Rows(y[a : a + step], lens, idx, val[a * width : (a + step) * width], dim, intercept)


def chunk_slices(batch: pa.RecordBatch, k: int, dim: int, intercept: bool = False) -> Iterator[Rows]:
    """The rows of chunk ``k`` of a batch, in slices."""
    cells = (
        batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("y", "lens", "idx", "val")
    )
    return sliced(*cells, dim, intercept)


class Block:
    """All rows of a block in slices of its chunks as they came: the block is held once, and
    an evaluation adds the arrays of one slice."""

    def __init__(self, chunks: pa.Table, dim: int, intercept: bool = False):
        self.slices = [
            rows
            for batch in chunks.to_batches()
            for k in range(batch.num_rows)
            for rows in chunk_slices(batch, k, dim, intercept)
        ]

    def loss_gradient(self, w: np.ndarray, loss: Callable) -> tuple[float, np.ndarray]:
        values, total = [], np.zeros(len(w))
        for rows in self.slices:
            value, grad = rows.loss_gradient(w, loss)
            values.append(value)
            total += grad
        return float(np.sum(values)), total


@dataclass
class Search:
    """L-BFGS with a backtracking step, driven from outside: evaluate the objective at
    ``trial()``, report it to ``observe()``, until ``done``."""

    x: np.ndarray
    memory: int = 5
    max_steps: int = 50
    tol: float = 1e-4
    f: float | None = None
    g: np.ndarray | None = None
    d: np.ndarray | None = None
    t: float = 1.0
    s_hist: list = field(default_factory=list)
    y_hist: list = field(default_factory=list)
    steps: int = 0
    evaluations: int = 0
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.x if self.f is None else self.x + self.t * self.d

    def accepts(self, f: float) -> bool:
        # At rounding level the decrease test is decided by noise, so allow for it.
        slope = self.g @ self.d
        return not f > self.f + 1e-4 * self.t * slope + 1e-15 * abs(self.f)  # so for NaN

    def observe_ladder(self, values: list[float], gradients: list[np.ndarray]) -> None:
        """Report the objective at steps t, t/2, t/4, ... and the gradients of the first of
        them. Stops at the first step that is accepted; when its gradient is not among the
        given ones, or no step is accepted, the next ladder begins there."""
        for k, value in enumerate(values):
            if self.f is not None and not self.accepts(value):
                self.evaluations += 1
                self.t *= 0.5
                self.done = self.t < 1e-10
                if self.done:
                    return
                continue
            if k < len(gradients):
                self.observe(value, gradients[k])
            return

    def observe(self, f: float, g: np.ndarray) -> None:
        self.evaluations += 1
        if self.f is not None:
            if not self.accepts(f):
                self.t *= 0.5
                self.done = self.t < 1e-10
                return
            move = self.t * self.d
            change = g - self.g
            if move @ change > 1e-14 * (change @ change):
                self.s_hist = [*self.s_hist, move][-self.memory :]
                self.y_hist = [*self.y_hist, change][-self.memory :]
            self.x = self.x + move
            self.steps += 1
        self.f, self.g = f, g
        size = float(np.linalg.norm(g))
        self.done = size <= max(self.tol * abs(f), 1e-8) or self.steps >= self.max_steps
        self.d = -self._scaled(g)
        self.t = 1.0 if self.s_hist else min(1.0, 1.0 / max(size, 1e-12))

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        """Two-loop product of the inverse-curvature estimate with g."""
        q = g.copy()
        passed = []
        for s, y in zip(reversed(self.s_hist), reversed(self.y_hist)):
            a = (s @ q) / (s @ y)
            q -= a * y
            passed.append((a, s, y))
        if passed:
            _, s, y = passed[0]
            q *= (s @ y) / (y @ y)
        for a, s, y in reversed(passed):
            q += (a - (y @ q) / (s @ y)) * s
        return q


@dataclass(frozen=True)
class LocalProblem:
    """What a block needs besides its rows: sizes, the solver's limits and the loss."""

    dim: int
    total_rows: int
    intercept: bool = False
    by_rows: bool = False
    memory: int = 5
    max_steps: int = 50
    tol: float = 1e-4
    loss: Callable = logistic_sums
    dual_update: Callable = dual_update

    def weight(self, n: int) -> float:
        """Factor on the summed loss of a block with n rows: its mean, or its share of
        the mean over all rows."""
        return 1.0 / (self.total_rows if self.by_rows else n)

    def start(self, w: np.ndarray) -> Search:
        return Search(w, self.memory, self.max_steps, self.tol)

    def observe(self, search: Search, n: int, loss: float, grad, target, rho: float) -> None:
        """Add the augmented term around ``target`` = z - u and advance the search."""
        gap = search.trial() - target
        k = self.weight(n)
        search.observe(k * loss + 0.5 * rho * (gap @ gap), k * grad + rho * gap)

    def observe_ladder(self, search: Search, n: int, sums, target, rho: float) -> None:
        """The same for the ``sums`` of :func:`ladder_sums`: losses of a ladder, then the
        gradients of its first steps one after another."""
        steps = LADDER if search.f is not None else 1
        losses, gradients = sums[:LADDER], sums[LADDER:].reshape(-1, self.dim)
        k = self.weight(n)
        gaps = [
            (search.x if search.f is None else search.x + search.t * 0.5**i * search.d) - target
            for i in range(steps)
        ]
        search.observe_ladder(
            [k * f + 0.5 * rho * (gap @ gap) for f, gap in zip(losses, gaps)],
            [k * g + rho * gap for g, gap in zip(gradients, gaps)],
        )

    def searches_fit(self, n_blocks: int) -> bool:
        """Whether the searches of all blocks fit a bounded message."""
        return n_blocks * self.dim * 8 * (2 * self.memory + 6) <= BROADCAST_BYTES

    def ladder_gradients(self, n_blocks: int) -> int:
        """Gradients a ladder carries: several while all blocks' fit a bounded message."""
        room = BROADCAST_BYTES // (8 * n_blocks * self.dim)
        return int(min(max(room, 1), LADDER_GRADIENTS))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _vector(values) -> np.ndarray:
    return np.array(values.values.to_numpy(zero_copy_only=False), dtype=np.float64)


def solve_in_task(
    located: DataFrame, state: DataFrame, problem: LocalProblem, z_bc, rho: float,
    dual_scale: float = 1.0, first: bool = False, local_update: Callable | None = None,
) -> DataFrame:
    """One co-group per block. ``located`` comes from ``co_locate``; only the state side
    moves. The pending dual step u + w - z is applied here (not on the ``first`` call),
    so an iteration writes the state once; ``dual_scale`` keeps rho*u when rho changed."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        z = z_bc.value
        n = right.column("n")[0].as_py()
        w, u = _vector(right.column("w")[0]), _vector(right.column("u")[0])
        if not first:
            u = problem.dual_update(u, w, z) * dual_scale
        if local_update is not None:
            rows = Rows(
                _flat(left, "y"), _flat(left, "lens"), _flat(left, "idx"), _flat(left, "val"),
                problem.dim, problem.intercept,
            )
            w, evaluations = local_update(rows, w, u, z, rho), 0
        else:
            rows, search = Block(left, problem.dim, problem.intercept), problem.start(w)
            while not search.done:
                loss, grad = rows.loss_gradient(search.trial(), problem.loss)
                problem.observe(search, n, loss, grad, z - u, rho)
            w, evaluations = search.x, search.evaluations
        return pa.table(
            {
                "part_id": right.column("part_id")[:1],
                "n": right.column("n")[:1],
                "w": pa.array([w], pa.list_(pa.float64())),
                "u": pa.array([u], pa.list_(pa.float64())),
                "slot": right.column("slot")[:1],
                "evaluations": pa.array([evaluations], pa.int32()),
            }
        )

    # Fresh column identities, in case the state was derived from the same rows.
    state = state.toDF(*state.columns)
    return located.groupBy("slot").cogroup(state.groupBy("slot")).applyInArrow(solve, SOLVED)


def _chunk_sums(
    chunks: DataFrame, points: DataFrame | dict, problem: LocalProblem, n_blocks: int,
    evaluate: Callable, width: int, tasks: int,
) -> DataFrame:
    """(part_id, n, sums): ``evaluate(rows, point)``, an array of ``width`` numbers, summed
    over the chunks of every block that has a point.

    Every task adds up its own chunks first. Points are ``(part_id, n, point)``. While blocks
    x point is below a bound they are broadcast as arrays and looked up, so they are not
    copied into chunk rows; beyond it the chunks must come from ``salt_chunks``, and the
    points are copied once per slice of their block and joined there, so the data side stays
    where it is. Chunks of blocks without a point are left out. ``tasks`` is the number of
    tasks over the chunks.
    """
    dim, intercept = problem.dim, problem.intercept
    if "salt" in chunks.columns:
        slices = salt_count(F.col("n"), problem.total_rows, tasks)
        copies = points.select(
            "part_id", "point", F.explode(F.sequence(F.lit(0), slices - 1)).alias("salt")
        )
        joined, shared = chunks.join(copies, ["part_id", "salt"]).drop("salt"), None
    elif isinstance(points, dict) or n_blocks * dim * 8 <= BROADCAST_BYTES:
        if not isinstance(points, dict):
            points = {r["part_id"]: np.array(r["point"]) for r in points.select("part_id", "point").collect()}
        joined, shared = chunks, chunks.sparkSession.sparkContext.broadcast(points)
    else:
        raise ValueError("weights of this size need chunks from salt_chunks")
    columns = ["part_id", "n", "y", "lens", "idx", "val", *(["point"] if shared is None else [])]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def release() -> pa.RecordBatch:
            parts = list(held)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(parts, pa.int32()),
                    pa.array([held[p][0] for p in parts], pa.int64()),
                    pa.array([held[p][1] for p in parts], pa.list_(pa.float64())),
                ],
                names=["part_id", "n", "sums"],
            )
            held.clear()
            return batch

        for batch in batches:
            part = batch.column("part_id").to_pylist()
            for k in range(batch.num_rows):
                if shared is not None and part[k] not in shared.value:
                    continue
                if shared is None:
                    point = batch.column("point")[k].values.to_numpy(zero_copy_only=False)
                else:
                    point = shared.value[part[k]]
                slot = held.setdefault(part[k], [0, np.zeros(width)])
                for rows in chunk_slices(batch, k, dim, intercept):
                    slot[0] += len(rows.y)
                    slot[1] += evaluate(rows, point)
                if len(held) * width * 8 > FLUSH_BYTES:
                    yield release()
        if held:
            yield release()

    partial = joined.select(*columns).mapInArrow(sums, PARTIAL)
    if tasks > 64:
        # Two levels, so that no task adds up the vectors of all others.
        salts = int(np.ceil(np.sqrt(tasks)))
        partial = _sum_partials(
            partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))),
            ["part_id", "salt"],
        )
    return _sum_partials(partial, ["part_id"])


def block_loss_gradient(
    chunks: DataFrame, weights: DataFrame, problem: LocalProblem, n_blocks: int,
    tasks: int = 1,
) -> DataFrame:
    """(part_id, n, loss, grad): summed loss and gradient of every block at its weights
    ``(part_id, n, w)``, in one pass over the chunks."""
    loss = problem.loss

    def evaluate(rows: Rows, w: np.ndarray) -> np.ndarray:
        value, grad = rows.loss_gradient(w, loss)
        return np.append(value, grad)

    points = weights.withColumnRenamed("w", "point")
    sums = _chunk_sums(chunks, points, problem, n_blocks, evaluate, 1 + problem.dim, tasks)
    return sums.select(
        "part_id", "n", F.get("sums", F.lit(0)).alias("loss"),
        F.slice("sums", 2, problem.dim).alias("grad"),
    )


def ladder_sums(
    chunks: DataFrame, points: DataFrame | dict, problem: LocalProblem, n_blocks: int,
    tasks: int = 1,
) -> DataFrame:
    """(part_id, n, sums): of every block the losses at w + t.d, w + t/2.d, ... (``LADDER``
    of them), then the gradients of the first ones, in one pass over the chunks.

    A point is w, d and t one after another; without a direction it is w alone, and only its
    loss and gradient are computed. X.w and X.d are multiplied once for the whole ladder.
    """
    dim, loss, given = problem.dim, problem.loss, problem.ladder_gradients(n_blocks)

    def evaluate(rows: Rows, point: np.ndarray) -> np.ndarray:
        out = np.zeros(LADDER + given * dim)
        scores, along, steps = rows.scores(point[:dim]), 0.0, [0.0]
        if len(point) > dim:
            along = rows.scores(point[dim : 2 * dim])
            steps = [point[-1] * 0.5**k for k in range(LADDER)]
        for k, t in enumerate(steps):
            out[k], by_score = loss(rows.y, scores + t * along)
            if k < given:
                at = LADDER + k * dim
                out[at : at + dim] = rows.pull_back(by_score)
        return out

    return _chunk_sums(chunks, points, problem, n_blocks, evaluate, LADDER + given * dim, tasks)


def _sum_partials(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Vector sums by key; the partial sums of a task are combined before the shuffle."""
    return (
        partial.groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            Summarizer.sum(array_to_vector("sums")).alias("sums"),
        )
        .withColumn("sums", vector_to_array("sums"))
    )


def _search_record(batch: pa.RecordBatch, k: int, target, u, s: Search) -> dict:
    flat = lambda vectors: np.concatenate(vectors) if vectors else np.zeros(0)
    same = {c: batch.column(c)[k].as_py() for c in ("part_id", "n", "slot")}
    return same | {
        "z_minus_u": target, "u": u, "w": s.x, "f": s.f, "g": s.g, "d": s.d, "t": s.t, "s_hist": flat(s.s_hist), "y_hist": flat(s.y_hist),
        "steps": s.steps, "evaluations": s.evaluations, "done": s.done,
    }


def _search_batch(records: list[dict]) -> pa.RecordBatch:
    vector = pa.list_(pa.float64())
    kinds = {
        "part_id": pa.int32(), "n": pa.int64(), "slot": pa.int32(), "z_minus_u": vector,
        "u": vector, "w": vector, "f": pa.float64(), "g": vector, "d": vector, "t": pa.float64(), "s_hist": vector,
        "y_hist": vector, "steps": pa.int32(), "evaluations": pa.int32(), "done": pa.bool_(),
    }
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in records], kind) for c, kind in kinds.items()],
        names=list(kinds),
    )


def _read_search(batch: pa.RecordBatch, k: int, problem: LocalProblem) -> Search:
    get = lambda c: batch.column(c)[k]
    s_hist, y_hist = _vector(get("s_hist")), _vector(get("y_hist"))
    split = lambda flat: list(flat.reshape(-1, problem.dim)) if len(flat) else []
    search = problem.start(_vector(get("w")))
    search.f, search.t = get("f").as_py(), get("t").as_py()
    if search.f is not None:
        search.g, search.d = _vector(get("g")), _vector(get("d"))
    search.s_hist, search.y_hist = split(s_hist), split(y_hist)
    search.steps, search.evaluations = get("steps").as_py(), get("evaluations").as_py()
    search.done = get("done").as_py()
    return search


def solve_across_tasks(
    chunks: DataFrame, state: DataFrame, problem: LocalProblem, z_bc, rho: float,
    n_blocks: int, dual_scale: float = 1.0, first: bool = False, tasks: int = 1,
    target: str | None = None,
) -> str:
    """All blocks advance together, one pass over the data a search step, until every
    block's search is done. Returns the path of the solved state table, ``target`` if given.

    While the searches of all blocks fit a bounded message they are advanced between the
    passes as the weights they broadcast are; beyond it the search of a block is a table
    row, and blocks that are done stay in the table of their last round.
    """
    target = target or fresh_path(chunks.sparkSession, "state")
    if problem.searches_fit(n_blocks):
        solved = solve_gathered(chunks, state, problem, z_bc, rho, n_blocks, dual_scale, first, tasks)
        chunks.sparkSession.createDataFrame(solved, SOLVED).write.parquet(target)
    else:
        _solve_in_tables(chunks, state, problem, z_bc, rho, n_blocks, dual_scale, first, tasks, target)
    return target


def solve_gathered(
    chunks: DataFrame, state: DataFrame, problem: LocalProblem, z_bc, rho: float,
    n_blocks: int, dual_scale: float = 1.0, first: bool = False, tasks: int = 1,
) -> pa.Table:
    """The solved state when the searches of all blocks are small enough for one place."""
    z, begun = z_bc.value, {}
    for row in state.select("part_id", "n", "slot", "w", "u").collect():
        w, u = np.array(row["w"]), np.array(row["u"])
        if not first:
            u = problem.dual_update(u, w, z) * dual_scale
        begun[row["part_id"]] = (row["n"], row["slot"], u, problem.start(w))
    while True:
        points = {
            part: s.x if s.f is None else np.concatenate([s.x, s.d, [s.t]])
            for part, (_, _, _, s) in begun.items() if not s.done
        }
        if not points:
            break
        found = ladder_sums(chunks, points, problem, n_blocks, tasks).toArrow()
        for k, part in enumerate(found.column("part_id").to_pylist()):
            n, _, u, search = begun[part]
            problem.observe_ladder(search, n, _vector(found.column("sums")[k]), z - u, rho)
    vectors = lambda values: pa.array(values, pa.list_(pa.float64()))
    return pa.table({
        "part_id": pa.array(list(begun), pa.int32()),
        "n": pa.array([n for n, *_ in begun.values()], pa.int64()),
        "w": vectors([s.x for *_, s in begun.values()]),
        "u": vectors([u for _, _, u, _ in begun.values()]),
        "slot": pa.array([slot for _, slot, _, _ in begun.values()], pa.int32()),
        "evaluations": pa.array([s.evaluations for *_, s in begun.values()], pa.int32()),
    })


def _solve_in_tables(
    chunks, state, problem, z_bc, rho, n_blocks, dual_scale, first, tasks, target
) -> None:
    """Searches as rows of a table that every round writes anew."""
    spark = chunks.sparkSession

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = z_bc.value
        for batch in batches:
            records = []
            for k in range(batch.num_rows):
                w, u = _vector(batch.column("w")[k]), _vector(batch.column("u")[k])
                if not first:
                    u = problem.dual_update(u, w, z) * dual_scale
                records.append(_search_record(batch, k, z - u, u, problem.start(w)))
            if records:
                yield _search_batch(records)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for k in range(batch.num_rows):
                search = _read_search(batch, k, problem)
                target, u = _vector(batch.column("z_minus_u")[k]), _vector(batch.column("u")[k])
                if not search.done:
                    sums = _vector(batch.column("sums")[k])
                    problem.observe_ladder(search, batch.column("n")[k].as_py(), sums, target, rho)
                records.append(_search_record(batch, k, target, u, search))
            if records:
                yield _search_batch(records)

    def write(rows: DataFrame) -> DataFrame:
        """Write a round, split by done, and read its open blocks."""
        rounds.append(f"{base}/round={len(rounds)}")
        rows.write.partitionBy("done").parquet(rounds[-1])
        return spark.read.schema(SEARCH).parquet(rounds[-1]).filter(~F.col("done"))

    base, rounds = fresh_path(spark, "search"), []
    search = write(state.select("part_id", "n", "slot", "w", "u").mapInArrow(begin, SEARCH))
    while not search.isEmpty():
        point = F.when(F.col("f").isNull(), F.col("w")).otherwise(F.concat("w", "d", F.array("t")))
        open_blocks = search.select("part_id", "n", point.alias("point"))
        sums = ladder_sums(chunks, open_blocks, problem, n_blocks, tasks)
        step = search.join(sums.select("part_id", "sums"), "part_id", "left")
        search = write(step.select(*search.columns, "sums").mapInArrow(advance, SEARCH))
        drop_path(spark, f"{rounds[-2]}/done=false")
    spark.read.schema(SEARCH).parquet(base).select(
        "part_id", "n", "w", "u", "slot", "evaluations"
    ).write.parquet(target)
    drop_path(spark, base)
