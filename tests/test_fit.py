"""Invariants of the consensus fit."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from quorumfit.functions import vectors as V
from quorumfit.operators import blocks as B
from quorumfit.operators import evaluate
from quorumfit.operators import local_solve as LS
from quorumfit.operators import steps
from quorumfit.plans.estimator import ConsensusLogisticRegression
from quorumfit.plans.updater import ElasticNet, SquaredL2
from quorumfit.registry import fixtures as X
from quorumfit.sources.libsvm import to_ml_vectors

TIGHT = dict(
    eps_abs=1e-6, eps_rel=1e-6, criterion="both", max_iter=100, local_tol=1e-10, lam=0.5, rho=0.25
)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return X.ex_emb(spark, sf_dir).drop("part_id").cache()


@pytest.fixture(scope="module")
def default_fit(rows):
    return ConsensusLogisticRegression().fit(rows)


def ridge(rows, reg):
    ready = to_ml_vectors(rows).select("label", "features")
    return LogisticRegression(
        regParam=reg, standardization=False, fitIntercept=False, maxIter=200, tol=1e-10
    ).fit(ready)


@pytest.fixture(scope="module")
def pairs(spark, sf_dir):
    """496 rows of two features: 62 rows in each of 8 blocks."""
    return X.ex_pair(spark, sf_dir).drop("part_id").filter("id < 496").cache()


def test_equal_blocks_solve_ridge(pairs):
    even = pairs.withColumn("part_id", (F.col("id") % 8).cast("int"))
    model = ConsensusLogisticRegression(**TIGHT).fit(even)
    expected = ridge(even, 2 * 0.5 / 8).coefficients.toArray()
    assert model.converged
    assert np.abs(model.weights - expected).max() < 1e-5


def test_weighting_by_rows_is_independent_of_the_block_count(pairs):
    uneven = pairs.withColumn("part_id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 3).cast("int"))
    model = ConsensusLogisticRegression(weighting="rows", **TIGHT).fit(uneven)
    expected = ridge(pairs, 2 * 0.5).coefficients.toArray()
    assert np.abs(model.weights - expected).max() < 1e-5


@pytest.fixture(scope="module")
def short_fit(rows):
    return ConsensusLogisticRegression(max_iter=2).fit(rows)


def test_placements_agree(rows, short_fit):
    """Blocks over the budget are solved without gathering them, with the same result."""
    across = ConsensusLogisticRegression(block_budget=1000, max_iter=2).fit(rows)
    assert (across.placement, short_fit.placement) == ("across", "task")
    assert np.abs(across.weights - short_fit.weights).max() < 1e-9


def test_salted_layout_agrees(rows, short_fit, monkeypatch):
    monkeypatch.setattr(LS, "BROADCAST_BYTES", 1)
    model = ConsensusLogisticRegression(placement="across", max_iter=2).fit(rows)
    assert np.abs(model.weights - short_fit.weights).max() < 1e-9


def test_stop_rule_and_trace(default_fit):
    trace = default_fit.trace.orderBy("iteration").collect()
    assert default_fit.iterations == len(trace) >= 10
    assert default_fit.converged and trace[-1]["primal"] <= trace[-1]["primal_tol"]
    assert not any(t["converged"] for t in trace[:-1])
    for before, after in zip(trace, trace[1:]):
        assert after["rho"] == steps.next_penalty(before["rho"], before["primal"], before["dual"])


def test_iteration_cap_is_reported(short_fit):
    assert (short_fit.iterations, short_fit.converged) == (2, False)


def test_one_block(rows):
    model = ConsensusLogisticRegression(n_blocks=1, max_iter=3).fit(rows)
    assert model.iterations == 3 and np.isfinite(model.weights).all()


def test_row_order_does_not_matter(rows, short_fit):
    shuffled = rows.orderBy(F.xxhash64("id"))
    model = ConsensusLogisticRegression(max_iter=2).fit(shuffled)
    assert np.abs(model.weights - short_fit.weights).max() < 1e-9


def test_seeded_start_repeats(rows):
    fits = [ConsensusLogisticRegression(seed=7, max_iter=2).fit(rows) for _ in range(2)]
    assert np.abs(fits[0].weights - fits[1].weights).max() < 1e-12


def test_empty_blocks_do_not_count(rows):
    gaps = rows.withColumn("part_id", (F.col("id") % 2 * 5).cast("int"))
    model = ConsensusLogisticRegression(n_blocks=8, max_iter=2).fit(gaps)
    assert sorted(r["part_id"] for r in model.state.collect()) == [0, 5]


def test_block_ids_beyond_the_block_count(rows, short_fit):
    """Given block ids need not be 0..n_blocks-1."""
    far = B.assign_blocks(rows, 8, "id").withColumn("part_id", F.col("part_id") * 1000 + 7)
    model = ConsensusLogisticRegression(max_iter=2).fit(far)
    assert np.abs(model.weights - short_fit.weights).max() < 1e-9


def test_hot_block_gets_its_share_of_tasks(spark):
    rows = spark.range(0, 6000, 1, 60).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 10).cast("int").alias("part_id"),
        F.lit(1.0).alias("y"), F.array(F.lit(1.0)).alias("x"),
    )
    sizes = rows.groupBy("part_id").agg(F.count("*").alias("n"))
    salted = B.salt_chunks(B.pack_chunks(rows), sizes, 11, 6000, 60)
    slices = salted.groupBy("part_id").agg(F.countDistinct("salt").alias("k"), F.sum("n").alias("n"))
    got = {r["part_id"]: (r["k"], r["n"]) for r in slices.collect()}
    assert got[0] == (20, 2000)
    assert sum(n for _, n in got.values()) == 6000


def test_rows_without_a_key(rows):
    model = ConsensusLogisticRegression(max_iter=2).fit(rows.drop("id"))
    assert model.state.agg(F.sum("n")).first()[0] == rows.count()


def test_hot_block(spark, sf_dir):
    """One block with a third of all rows, on both placements."""
    lines = X.ex_line(spark, sf_dir)
    hot = lines.withColumn("part_id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int"))
    fits = [
        ConsensusLogisticRegression(n_blocks=50, placement=p, max_iter=1).fit(hot)
        for p in ("task", "across")
    ]
    assert fits[0].state.agg(F.sum("n")).first()[0] == lines.count()
    assert np.abs(fits[0].weights - fits[1].weights).max() < 1e-9


def test_sparse_equals_dense(rows, short_fit):
    model = ConsensusLogisticRegression(max_iter=2).fit(X.as_sparse(rows))
    assert np.abs(model.weights - short_fit.weights).max() < 1e-9
    scored = model.transform(X.as_sparse(rows)).select("id", "score")
    gap = scored.join(short_fit.transform(rows).select("id", F.col("score").alias("s")), "id")
    assert gap.agg(F.max(F.abs(F.col("score") - F.col("s")))).first()[0] < 1e-9


def test_given_dimension_is_checked(rows):
    with pytest.raises(ValueError, match="dimension"):
        ConsensusLogisticRegression().fit(rows, num_features=10)
    wide = ConsensusLogisticRegression(max_iter=1).fit(X.as_sparse(rows), num_features=70)
    assert len(wide.weights) == 70 and not wide.weights[64:].any()


def test_intercept(pairs):
    tight = TIGHT | {"lam": 0.05}
    model = ConsensusLogisticRegression(fit_intercept=True, **tight).fit(pairs)
    ready = to_ml_vectors(pairs).select("label", "features")
    expected = LogisticRegression(
        regParam=2 * 0.05 / 8, standardization=False, fitIntercept=True, maxIter=200, tol=1e-10
    ).fit(ready)
    assert abs(model.intercept - expected.intercept) < 2e-3
    assert np.abs(model.weights - expected.coefficients.toArray()).max() < 2e-3


def test_row_cap(rows):
    model = ConsensusLogisticRegression(row_cap=10, max_iter=1).fit(rows)
    assert {r["n"] for r in model.state.collect()} == {10}


class FixedPenalty(SquaredL2):
    """A strategy whose penalty does not adapt."""

    def next_rho(self, rho, primal, dual):
        return rho


def test_own_update_strategy(rows):
    def gradient_step(rows, w, u, z, rho):
        _, grad = rows.loss_gradient(w, LS.logistic_sums)
        return w - 0.1 * (grad / len(rows.y) + rho * (w - z + u))

    updater = FixedPenalty(0.01)
    updater.local_update = gradient_step
    model = ConsensusLogisticRegression(updater=updater, placement="task", max_iter=3).fit(rows)
    assert {t["rho"] for t in model.trace.collect()} == {1.0}
    assert model.weights.any()
    for placement in ("across", "auto"):
        with pytest.raises(ValueError, match="local_update"):
            ConsensusLogisticRegression(updater=updater, placement=placement).fit(rows)


def test_state_invariant(default_fit):
    """After a step with rescaled duals, w and u of every block are finite and one per block."""
    state = default_fit.state.collect()
    assert len(state) == 8
    assert all(np.isfinite(s["w"]).all() and np.isfinite(s["u"]).all() for s in state)


def test_data_side_is_not_shuffled_again(spark, rows):
    chunks = B.pack_chunks(B.assign_blocks(rows, 8, "id"))
    located = B.co_locate(chunks, 8).persist()
    located.count()
    sizes = B.spread_slots(B.block_sizes(chunks).select("part_id", "n"), 8)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/plan-state"
    steps.initial_state(sizes, 64).withColumn("evaluations", F.lit(0)).write.parquet(path)
    state = spark.read.parquet(path)
    z = spark.sparkContext.broadcast(np.zeros(64))
    solved = LS.solve_in_task(located, state, LS.LocalProblem(64, 500), z, 1.0, first=True)
    plan = solved._jdf.queryExecution().executedPlan().toString()
    before_cache = plan.split("InMemoryRelation")[0]
    assert "Exchange" not in before_cache and "Sort" not in before_cache
    located.unpersist()


def test_scoring_reads_its_columns_only(spark, sf_dir):
    pred = evaluate.predict(X.ex_line(spark, sf_dir), X.LINE_WEIGHTS).filter("id < 100")
    plan = evaluate.accuracy(pred)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1]
    assert "l_partkey" not in schema and "l_shipdate" not in schema
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,100)]" in plan
    assert plan.count("Exchange") == 1  # the partial counts
    assert "Python" not in plan and "ArrowEval" not in plan


def test_nan_is_reported(rows):
    broken = rows.withColumn("x", F.when(F.col("id") == 3, F.transform("x", lambda v: v * float("nan"))).otherwise(F.col("x")))
    with pytest.raises(ValueError, match="NaN"):
        ConsensusLogisticRegression(max_iter=1).fit(broken)


def test_blocks_get_partitions_of_their_own(rows):
    located = B.co_locate(B.pack_chunks(B.assign_blocks(rows, 8, "id")), 8)
    per_task = located.groupBy(F.spark_partition_id()).agg(F.countDistinct("part_id").alias("k"))
    assert [r["k"] for r in per_task.collect()] == [1] * 8


def test_search_reaches_the_minimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 5)), rng.choice([-1.0, 1.0], 200)
    rows = LS.Rows(y, [], [], x.ravel(), 5)
    problem = LS.LocalProblem(5, 200, tol=1e-12)
    search, target = problem.start(np.zeros(5)), np.full(5, 0.3)
    while not search.done:
        loss, grad = rows.loss_gradient(search.trial(), problem.loss)
        problem.observe(search, 200, loss, grad, target, 0.5)
    s = x @ search.x
    residual = x.T @ (-y / (1 + np.exp(y * s))) / 200 + 0.5 * (search.x - target)
    assert np.linalg.norm(residual) < 1e-7


def test_loss_does_not_overflow():
    loss, by_score = LS.logistic_sums(np.array([1.0, -1.0]), np.array([-1e4, -1e4]))
    assert loss == pytest.approx(1e4) and by_score.tolist() == [-1.0, 0.0]


def test_vector_literal_rejects_non_finite():
    with pytest.raises(ValueError, match="non-finite"):
        V.vector_literal([1.0, float("nan")])


def test_ladder_takes_the_steps_of_the_plain_search():
    rng = np.random.default_rng(3)
    x, y = 30 * rng.normal(size=(80, 4)), rng.choice([-1.0, 1.0], 80)
    rows, problem = LS.Rows(y, [], [], x.ravel(), 4), LS.LocalProblem(4, 80, tol=1e-10)
    target = rng.normal(size=4)
    plain, ladder = problem.start(np.zeros(4)), problem.start(np.zeros(4))
    while not plain.done:
        loss, grad = rows.loss_gradient(plain.trial(), problem.loss)
        problem.observe(plain, 80, loss, grad, target, 0.01)
    passes = 0
    while not ladder.done:
        passes += 1
        steps_tried = [0.0] if ladder.f is None else [ladder.t * 0.5**k for k in range(LS.LADDER)]
        sums = np.zeros(LS.LADDER + LS.LADDER_GRADIENTS * 4)
        for k, t in enumerate(steps_tried):
            at = ladder.x if ladder.f is None else ladder.x + t * ladder.d
            sums[k], grad = rows.loss_gradient(at, problem.loss)
            if k < LS.LADDER_GRADIENTS:
                sums[LS.LADDER + 4 * k : LS.LADDER + 4 * k + 4] = grad
        problem.observe_ladder(ladder, 80, sums, target, 0.01)
    assert np.abs(plain.x - ladder.x).max() < 1e-8
    assert passes < plain.evaluations


def test_one_pass_over_the_data_a_step(rows, monkeypatch):
    begun, passes = [], []
    start, sums = LS.LocalProblem.start, LS.ladder_sums
    monkeypatch.setattr(LS.LocalProblem, "start", lambda p, w: begun.append(start(p, w)) or begun[-1])
    monkeypatch.setattr(LS, "ladder_sums", lambda *a: passes.append(1) or sums(*a))
    ConsensusLogisticRegression(placement="across", max_iter=1, rho=0.01).fit(rows)
    assert len(begun) == 8 and max(s.steps for s in begun) > 2
    assert len(passes) <= max(s.steps for s in begun) + 1


def test_spectral_penalty_settles(rows):
    """Where balancing has not settled after 50 iterations, the spectral penalty has."""
    even = rows.filter("id < 496").withColumn("part_id", (F.col("id") % 8).cast("int"))
    model = ConsensusLogisticRegression(criterion="both", penalty="spectral").fit(even)
    assert model.converged and model.iterations <= 20
    expected = ridge(even, 2 * 0.01 / 8).coefficients.toArray()
    assert np.abs(model.weights - expected).max() < 0.02 * np.abs(expected).max()


def test_spectral_curvature_of_a_quadratic():
    move, hessian = np.array([1.0, -2.0, 0.5]), np.diag([3.0, 3.0, 3.0])
    change = hessian @ move
    assert steps.spectral_curvature(move @ move, move @ change, change @ change) == pytest.approx(3.0)
    assert steps.spectral_curvature(1.0, 0.1, 1.0) is None
    assert steps.spectral_curvature(0.0, 0.0, 0.0) is None
    assert steps.spectral_penalty(2.0, 10, None, None) == 2.0
    assert steps.spectral_penalty(2.0, 10, 1e9, None) == 4.0


def test_lasso_is_exactly_zero_under_a_high_price(rows):
    model = ConsensusLogisticRegression(
        updater=ElasticNet(0.5), penalty="spectral", max_iter=12
    ).fit(rows)
    assert not model.weights.any()
    with pytest.raises(ValueError, match="l1_ratio"):
        ElasticNet(0.5, 1.5)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("placement, penalty", [("task", "spectral"), ("across", "balance")])
def test_a_stopped_fit_goes_on(spark, rows, monkeypatch, tmp_path, placement, penalty):
    options = dict(placement=placement, penalty=penalty, max_iter=5)
    whole = ConsensusLogisticRegression(**options).fit(rows)
    folder, summary, rounds = f"{tmp_path}/journal", steps.state_summary, []

    def failing(state):
        rounds.append(1)
        if len(rounds) == 4:
            raise Stopped
        return summary(state)

    monkeypatch.setattr(steps, "state_summary", failing)
    with pytest.raises(Stopped):
        ConsensusLogisticRegression(**options).fit(rows, checkpoint=folder)
    with pytest.raises(ValueError, match="resume"):
        ConsensusLogisticRegression(**options).fit(rows, checkpoint=folder)
    with pytest.raises(ValueError, match="stopped fit"):
        ConsensusLogisticRegression(**options).fit(rows.filter("id > 5"), checkpoint=folder, resume=True)
    model = ConsensusLogisticRegression(**options).fit(rows, checkpoint=folder, resume=True)
    assert len(rounds) == 4 + 2 and model.iterations == 5
    for a, b in zip(whole.trace.orderBy("iteration").collect(), model.trace.orderBy("iteration").collect()):
        assert a["iteration"] == b["iteration"] and a["converged"] == b["converged"]
        assert [a[c] for c in ("primal", "dual", "rho", "z_norm")] == pytest.approx(
            [b[c] for c in ("primal", "dual", "rho", "z_norm")], rel=1e-7)
    assert np.abs(model.weights - whole.weights).max() < 1e-7
    assert len(list((tmp_path / "journal").glob("state-*"))) == 1


def test_rows_without_a_key_keep_their_chunks(rows, tmp_path):
    folder, bare = f"{tmp_path}/journal", rows.drop("id")
    ConsensusLogisticRegression(max_iter=2).fit(bare, checkpoint=folder)
    model = ConsensusLogisticRegression(max_iter=4).fit(bare.repartition(3), checkpoint=folder, resume=True)
    assert model.iterations == 4 and len(list((tmp_path / "journal").glob("chunks-*"))) == 1


def test_a_sweep_exchanges_its_data_once(rows):
    """Blocks of every count are those of a fit of its own, and no fit moves the data."""
    nested = B.NestedBlocks.prepare(rows, [2, 3, 4])
    try:
        for count in (2, 3, 4):
            alone = ConsensusLogisticRegression(n_blocks=count, max_iter=2).fit(rows)
            for placement in ("task", "across"):
                model = ConsensusLogisticRegression(n_blocks=count, max_iter=2, placement=placement).fit(rows, nested=nested)
                assert np.abs(model.weights - alone.weights).max() < 1e-9
            sizes = lambda m: sorted((r["part_id"], r["n"]) for r in m.state.select("part_id", "n").collect())
            assert sizes(model) == sizes(alone)
            located = nested.located_of(count)
            state = nested.slots_of(B.block_sizes(nested.chunks_of(count)).select("part_id", "n"), count)
            state = rows.sparkSession.createDataFrame(
                steps.initial_state(state, 64).withColumn("evaluations", F.lit(0)).toArrow()
            )
            z = rows.sparkSession.sparkContext.broadcast(np.zeros(64))
            solved = LS.solve_in_task(located, state, LS.LocalProblem(64, 500), z, 1.0, first=True)
            plan = solved._jdf.queryExecution().executedPlan().toString()
            data_side = plan[: plan.index("InMemoryRelation")]
            assert "Exchange" not in data_side and "Sort" not in data_side
    finally:
        nested.release()
    with pytest.raises(ValueError, match="key"):
        B.NestedBlocks.prepare(rows.drop("id"), [2, 3])
    assert not B.NestedBlocks.suits([7, 11, 13, 17]) and B.NestedBlocks.suits([5, 8, 10, 15])


def _row_batches(n_batches, sparse=False):
    """Batches of 4,000 rows in 8 blocks, about 130 or 180 kB each; some sparse rows are empty."""
    rng = np.random.default_rng(7)
    for _ in range(n_batches):
        lens = rng.integers(0, 4, 4000) if sparse else np.full(4000, 2)
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)], pa.int32()), pa.array(a))
        cells = {"part_id": pa.array(rng.integers(0, 8, 4000), pa.int32()), "y": pa.array(rng.choice([-1.0, 1.0], 4000))}
        if sparse:
            cells["idx"] = lists(rng.integers(0, 9, lens.sum()).astype(np.int32))
        cells["val" if sparse else "x"] = lists(rng.normal(size=lens.sum()))
        yield pa.RecordBatch.from_arrays(list(cells.values()), list(cells))


@pytest.mark.parametrize("sparse", [False, True])
def test_packing_holds_its_rows_once(monkeypatch, sparse):
    monkeypatch.setattr(B, "GATHER_BYTES", 8 << 20)
    monkeypatch.setattr(B, "PIECE_BYTES", 1 << 20, raising=False)
    before, held, rows = pa.total_allocated_bytes(), [], 0
    for chunks in B._pack(_row_batches(150, sparse)):
        held.append(pa.total_allocated_bytes() - before)
        rows += sum(chunks.column("n").to_pylist())
    assert rows == 600_000
    assert max(held) < 2 * B.GATHER_BYTES


@pytest.mark.parametrize("sparse, intercept", [(False, False), (False, True), (True, False), (True, True)])
def test_a_block_is_held_once_and_summed_in_slices(sparse, intercept):
    chunks = pa.Table.from_batches(B._pack(_row_batches(200, sparse)))
    dim = (9 if sparse else 2) + intercept
    w = np.linspace(-1, 1, dim)
    tracemalloc.start()
    block = LS.Block(chunks, dim, intercept)
    value, grad = block.loss_gradient(w, LS.logistic_sums)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < chunks.nbytes / 2
    whole = LS.Rows(*(LS._flat(chunks, c) for c in ("y", "lens", "idx", "val")), dim, intercept)
    assert sum(len(r.y) for r in block.slices) == len(whole.y) == 800_000
    expected, slope = whole.loss_gradient(w, LS.logistic_sums)
    assert abs(value - expected) < 1e-12 * expected and np.allclose(grad, slope, rtol=1e-9)


def test_a_task_gets_no_block_that_holds_more_than_the_budget(spark):
    """Sparse rows of which nine in ten are empty: their lengths are most of what is held."""
    rows = spark.range(800).select(
        (F.col("id") % 8).cast("int").alias("part_id"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("y"),
        F.expr("IF(id % 80 < 8, array(1), array())").cast("array<int>").alias("idx"),
        F.expr("IF(id % 80 < 8, array(0.5D), array())").cast("array<double>").alias("val"),
    )
    chunks = B.pack_chunks(rows).toArrow()
    held = sum(LS._flat(chunks, c).nbytes for c in ("y", "lens", "idx", "val"))
    model = ConsensusLogisticRegression(block_budget=held // 8 - 1, max_iter=1).fit(rows)
    assert held == 800 * 12 + 80 * 12 and model.placement == "across"
