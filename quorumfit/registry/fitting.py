"""Queries over block states, the consensus steps and the fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quorumfit.functions import vectors as V
from quorumfit.operators import blocks as B
from quorumfit.operators import evaluate
from quorumfit.operators import local_solve as LS
from quorumfit.operators import steps
from quorumfit.plans.estimator import ConsensusLogisticRegression
from quorumfit.plans.updater import ElasticNet
from quorumfit.registry import fixtures as X
from quorumfit.registry.catalog import query
from quorumfit.session import fresh_path

r, sql_r = X.r, X.sql_r
LAM, RHO = 0.01, 1.0
Z_SQL = f"(w_sum + u_sum) / n_blocks * (n_blocks * {RHO} / (n_blocks * {RHO} + 2 * {LAM}))"

SUMS = (
    X.STATE
    + f""",
sums AS (SELECT j, sum(w) AS w_sum, sum(u) AS u_sum FROM state GROUP BY j),
stepped AS (SELECT j, n_blocks, {Z_SQL} AS z FROM sums, nb)"""
)


# --- data and state -------------------------------------------------------------


@query(
    f"""WITH {X.STATE} SELECT e.id, {sql_r('sum(e.v * s.w)')} AS score FROM exj e
    JOIN state s ON e.part_id = s.part_id AND e.j = s.j GROUP BY e.id"""
)
def block_state_join(spark, sf_dir):
    """Every row meets the state of its block."""
    joined = steps.join_state(X.ex_emb(spark, sf_dir), X.block_state(spark, sf_dir))
    return joined.select("id", r(V.dot(F.col("x"), F.col("w"))).alias("score"))


@query(
    f"""WITH {X.STATE} SELECT part_id, {sql_r('sum((w - z) * (w - z))')} AS gap, {RHO}::DOUBLE AS rho
    FROM state JOIN zed USING (j) GROUP BY part_id"""
)
def consensus_to_blocks(spark, sf_dir):
    """The global vector and penalty reach every block."""
    state = X.block_state(spark, sf_dir)
    sent = steps.with_consensus(state, X.overall_mean(spark, sf_dir), RHO)
    gap = V.squared_norm(V.subtract(F.col("w"), F.col("z")))
    return sent.select("part_id", r(gap).alias("gap"), "rho")


@query(
    f"""WITH {SUMS} SELECT j, {sql_r('w_sum')} AS w_sum, {sql_r('u_sum')} AS u_sum,
    (SELECT {sql_r('sum(w * w)')} FROM state) AS w_sq, n_blocks FROM sums, nb"""
)
def state_sums(spark, sf_dir):
    """Sum of w, of u and of ||w||^2 over the blocks in one aggregation."""
    summary = steps.summary_by_feature(steps.state_summary(X.block_state(spark, sf_dir)))
    n = F.col("n_blocks")
    total = F.sum("w_sq").over(Window.partitionBy("n_blocks"))
    return summary.select(
        "j",
        r(F.col("w_avg") * n).alias("w_sum"),
        r(F.col("u_avg") * n).alias("u_sum"),
        r(total).alias("w_sq"),
        "n_blocks",
    )


def _lines_gradient(spark, sf_dir, rows, weights, dim, tasks=1, salted=False):
    chunks = B.pack_chunks(rows)
    sizes = rows.groupBy("part_id").agg(F.count("*").alias("n"))
    n_rows = rows.count()
    if salted:
        chunks = B.salt_chunks(chunks, sizes, X.N_BLOCKS, n_rows, tasks)
    at = sizes.withColumn("w", V.vector_literal(weights))
    problem = LS.LocalProblem(dim, n_rows)
    sums = LS.block_loss_gradient(chunks, at, problem, X.N_BLOCKS, tasks)
    return sums.select(
        "part_id",
        "n",
        r(F.col("loss") / F.col("n")).alias("loss"),
        F.posexplode("grad").alias("j", "g"),
    ).select("part_id", "n", "loss", "j", r(F.col("g") / F.col("n")).alias("g"))


@query(
    f"""WITH {X.EX_LINE}, parts AS (
      SELECT part_id, count(*) AS n, avg(ln(1 + exp(-y * s))) AS loss,
             [avg(-y * x0 / (1 + exp(y * s))), avg(-y * x1 / (1 + exp(y * s))),
              avg(-y * x2 / (1 + exp(y * s))), avg(-y * x3 / (1 + exp(y * s)))] AS g
      FROM scored GROUP BY part_id)
    SELECT part_id, n, {sql_r('loss')} AS loss, CAST(j AS INTEGER) AS j, {sql_r('g[j + 1]')} AS g
    FROM parts, range(4) t(j)"""
)
def block_loss_gradient(spark, sf_dir):
    """Mean loss and gradient of every block of line items at fixed weights."""
    return _lines_gradient(spark, sf_dir, X.ex_line(spark, sf_dir), X.LINE_WEIGHTS, 4)


@query(
    f"""WITH {X.EX_SPARSE}, scored AS (
      SELECT id, part_id, y, sum(v * {X.SQL_WEIGHT}) AS s FROM sp GROUP BY ALL),
    parts AS (SELECT part_id, count(*) AS n, avg(ln(1 + exp(-y * s))) AS loss
              FROM scored GROUP BY part_id)
    SELECT p.part_id, p.n, {sql_r('p.loss')} AS loss, sp.j,
           {sql_r('sum(-sp.y * sp.v / (1 + exp(sp.y * s.s))) / p.n')} AS g
    FROM sp JOIN scored s ON sp.id = s.id JOIN parts p ON p.part_id = sp.part_id
    GROUP BY p.part_id, p.n, p.loss, sp.j"""
)
def block_loss_gradient_sparse(spark, sf_dir):
    """The same on sparse rows, with salted two-level sums and joined weights."""
    rows = X.ex_sparse(spark, sf_dir)
    dim = rows.agg(F.max("size")).first()[0]
    return _lines_gradient(spark, sf_dir, rows, X.rule_weights(dim), dim, 100, True)


@query(
    f"""WITH {X.STATE} SELECT part_id, j, {sql_r(f'{RHO} * (w - z + u)')} AS grad,
    {sql_r(f'{RHO} / 2 * sum((w - z + u) * (w - z + u)) OVER (PARTITION BY part_id)')} AS term
    FROM state JOIN zed USING (j)"""
)
def augmented_term(spark, sf_dir):
    sent = steps.with_consensus(
        X.block_state(spark, sf_dir), X.overall_mean(spark, sf_dir), RHO
    )
    w, z, u, rho = F.col("w"), F.col("z"), F.col("u"), F.col("rho")
    return sent.select(
        "part_id",
        r(steps.augmented_term(w, z, u, rho)).alias("term"),
        F.posexplode(steps.augmented_gradient(w, z, u, rho)).alias("j", "grad"),
    ).select("part_id", "j", r("grad").alias("grad"), "term")


# --- consensus steps ------------------------------------------------------------


@query(f"WITH {X.EX} SELECT DISTINCT part_id, j, 0.0::DOUBLE AS w, 0.0::DOUBLE AS u FROM exj")
def initial_state(spark, sf_dir):
    rows = X.ex_emb(spark, sf_dir)
    sizes = B.block_sizes(B.pack_chunks(rows))
    state = steps.initial_state(sizes, X.width(rows))
    return state.select("part_id", F.posexplode(F.arrays_zip("w", "u")).alias("j", "e")).select(
        "part_id", "j", "e.w", "e.u"
    )


@query(
    f"""WITH {X.EX} SELECT part_id, count(DISTINCT j) AS coordinates, count(DISTINCT j) AS in_range,
    count(DISTINCT j) AS different FROM exj GROUP BY part_id"""
)
def initial_state_seeded(spark, sf_dir):
    """Random start: every coordinate of every block drawn from [0, 0.01), no two alike."""
    rows = X.ex_emb(spark, sf_dir)
    sizes = B.block_sizes(B.pack_chunks(rows))
    return (
        steps.initial_state(sizes, X.width(rows), seed=42)
        .select("part_id", F.explode("w").alias("w"))
        .groupBy("part_id")
        .agg(
            F.count("*").alias("coordinates"),
            F.count_if((F.col("w") >= 0) & (F.col("w") < steps.START_SCALE)).alias("in_range"),
            F.countDistinct("w").alias("different"),
        )
    )


def _stepped(spark, sf_dir):
    """(j, w_avg, u_avg, n_blocks, w_sq, w_spread, z)."""
    summary = steps.summary_by_feature(steps.state_summary(X.block_state(spark, sf_dir)))
    z = steps.consensus(F.col("w_avg"), F.col("u_avg"), F.lit(RHO), F.col("n_blocks"), LAM)
    return summary.withColumn("z", z)


@query(f"WITH {SUMS} SELECT j, {sql_r('z')} AS z FROM stepped")
def consensus_step(spark, sf_dir):
    return _stepped(spark, sf_dir).select("j", r("z").alias("z"))


@query(
    f"""WITH {X.STATE} SELECT part_id, j, {sql_r('u + w - z')} AS u
    FROM state JOIN zed USING (j)"""
)
def dual_step(spark, sf_dir):
    z = V.vector_literal(X.overall_mean(spark, sf_dir))
    return (
        steps.dual_step(X.block_state(spark, sf_dir), z)
        .select("part_id", F.posexplode("u").alias("j", "u"))
        .select("part_id", "j", r("u").alias("u"))
    )


def _residuals(spark, sf_dir):
    """Residuals after one consensus step from z_prev = overall mean."""
    previous = V.vector_literal(X.overall_mean(spark, sf_dir))
    gap, move = F.col("w_avg") - F.col("z"), F.col("z") - F.get(previous, F.col("j"))
    totals = _stepped(spark, sf_dir).agg(
        F.first("n_blocks").alias("n_blocks"),
        F.sum("w_sq").alias("w_sq"),
        F.sum("w_spread").alias("w_spread"),
        F.sum(gap * gap).alias("gap_sq"),
        F.sum(move * move).alias("step_sq"),
        F.sum(F.col("z") * F.col("z")).alias("z_sq"),
    )
    n = F.col("n_blocks")
    return totals.select(
        "n_blocks",
        steps.primal_residual(F.col("w_spread"), F.col("gap_sq"), n).alias("primal"),
        steps.dual_residual(F.lit(RHO), n, F.col("step_sq")).alias("dual"),
        F.sqrt("w_sq").alias("w_norm"),
        F.sqrt("z_sq").alias("z_norm"),
    )


RESIDUALS = (
    SUMS
    + f""",
residuals AS (
  SELECT n_blocks,
    (SELECT sqrt(sum((w - z) * (w - z))) FROM state JOIN stepped USING (j)) AS primal,
    (SELECT {RHO} * sqrt(max(s.n_blocks) * sum((s.z - zed.z) * (s.z - zed.z)))
     FROM stepped s JOIN zed USING (j)) AS dual,
    (SELECT sqrt(sum(w * w)) FROM state) AS w_norm,
    (SELECT sqrt(sum(z * z)) FROM stepped) AS z_norm
  FROM nb)"""
)


@query(f"WITH {RESIDUALS} SELECT {sql_r('primal')} AS primal FROM residuals")
def primal_residual(spark, sf_dir):
    """From the one-pass spread, equal to the direct sum over the blocks."""
    return _residuals(spark, sf_dir).select(r("primal").alias("primal"))


@query(f"WITH {RESIDUALS} SELECT {sql_r('dual')} AS dual FROM residuals")
def dual_residual(spark, sf_dir):
    return _residuals(spark, sf_dir).select(r("dual").alias("dual"))


@query(
    f"""WITH {RESIDUALS}, ruled AS (
      SELECT primal, sqrt(n_blocks) * 0.001 + 0.001 * greatest(w_norm, z_norm) AS tol FROM residuals)
    SELECT {sql_r('tol')} AS primal_tol, primal <= tol AS converged FROM ruled"""
)
def stop_rule(spark, sf_dir):
    tol = steps.primal_tolerance(F.col("n_blocks"), F.greatest("w_norm", "z_norm"))
    return _residuals(spark, sf_dir).select(
        r(tol).alias("primal_tol"), (F.col("primal") <= tol).alias("converged")
    )


@query(
    """SELECT o_orderkey, CASE WHEN primal > 10 * dual THEN rho * 2 WHEN dual > 10 * primal THEN rho / 2
    ELSE rho END AS next_rho FROM (
      SELECT o_orderkey, o_totalprice AS primal, (o_custkey % 1000 * 1000)::DOUBLE AS dual,
             power(2.0::DOUBLE, o_orderkey % 7) AS rho FROM orders)"""
)
def penalty_update(spark, sf_dir):
    """Residual balancing over a table of residuals."""
    primal, dual = F.col("o_totalprice"), (F.col("o_custkey") % 1000 * 1000).cast("double")
    rho = F.pow(F.lit(2.0), F.col("o_orderkey") % 7)
    return X.table(spark, sf_dir, "orders").select(
        "o_orderkey", steps.next_penalty_column(rho, primal, dual).alias("next_rho")
    )


PULLED = "((w_sum + u_sum) / n_blocks)"


@query(
    f"""WITH {SUMS} SELECT j, {sql_r(f"sign({PULLED}) * greatest(abs({PULLED}) - 0.05 * 0.75 / (n_blocks * {RHO}), 0) "
                                     f"* (n_blocks * {RHO} / (n_blocks * {RHO} + 2 * 0.05 * 0.25))")} AS z
    FROM sums, nb"""
)
def consensus_step_elastic(spark, sf_dir):
    """The global step of an elastic-net penalty: soft threshold and shrinkage."""
    summary = steps.summary_by_feature(steps.state_summary(X.block_state(spark, sf_dir)))
    z = steps.elastic_consensus(
        F.col("w_avg"), F.col("u_avg"), F.lit(RHO), F.col("n_blocks"), 0.05, 0.75
    )
    return summary.select("j", r(z).alias("z"))


ESTIMATE_SQL = """CASE WHEN c > 0.2 * sqrt(m * g) THEN
    CASE WHEN 2 * c / m > g / c THEN c / m ELSE g / c - 0.5 * c / m END END"""


@query(
    f"""WITH {X.STATE}, moved AS (
      SELECT part_id, sum(u * u) AS m, sum(u * (w + u - z)) AS c, sum((w + u - z) * (w + u - z)) AS g
      FROM state JOIN zed USING (j) GROUP BY part_id)
    SELECT part_id, {sql_r(ESTIMATE_SQL)} AS curvature FROM moved"""
)
def block_curvature(spark, sf_dir):
    """Spectral estimate of every block between two states: w, and w + u with no pull left."""
    before = X.block_state(spark, sf_dir)
    to = V.add(F.col("w"), F.col("u"))
    after = before.select("part_id", to.alias("w"), V.scale(to, F.lit(-1.0)).alias("u"))
    z = np.array(X.overall_mean(spark, sf_dir))
    found = steps.block_curvatures(before, after, z, np.zeros(len(z)), RHO, 2 * RHO)
    return found.select("part_id", r("curvature").alias("curvature"))


# --- fits -----------------------------------------------------------------------


def newton_sql(
    source: str, keys: str, penalty: str, gap: tuple[str, str], rounds: int = 10, prefix: str = ""
) -> str:
    """CTEs of Newton's method for two weights (p, q), one solution per ``keys`` group of
    ``source`` (y, a, b and the columns used in ``gap``): mean logistic loss plus
    penalty/2 * (gap_p^2 + gap_q^2), where ``gap`` gives each weight's offset."""
    w, d = f"{prefix}w", f"{prefix}d"
    out = [f"{w}0 AS (SELECT DISTINCT {keys}, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q FROM {source})"]
    for k in range(rounds):
        out.append(
            f"""{d}{k} AS (SELECT {keys}, p, q, any_value(p - ({gap[0]})) AS gp,
              any_value(q - ({gap[1]})) AS gq, {penalty} AS c,
              avg(-y * a / (1 + exp(y * (a * p + b * q)))) AS ga,
              avg(-y * b / (1 + exp(y * (a * p + b * q)))) AS gb,
              avg(a * a * h) AS haa, avg(a * b * h) AS hab, avg(b * b * h) AS hbb
            FROM (SELECT s.*, p, q, 1 / (1 + exp(-(a * p + b * q))) / (1 + exp(a * p + b * q)) AS h
                  FROM {source} s JOIN {w}{k} USING ({keys}))
            GROUP BY {keys}, p, q),
            {w}{k + 1} AS (SELECT {keys},
              p - ((hbb + c) * (ga + c * gp) - hab * (gb + c * gq))
                  / ((haa + c) * (hbb + c) - hab * hab) AS p,
              q - ((haa + c) * (gb + c * gq) - hab * (ga + c * gp))
                  / ((haa + c) * (hbb + c) - hab * hab) AS q
            FROM {d}{k})"""
        )
    return ",\n".join(out)


def _local_problem(spark, sf_dir):
    rows = X.ex_pair(spark, sf_dir)
    chunks = B.pack_chunks(rows)
    sizes = B.spread_slots(B.block_sizes(chunks), X.N_BLOCKS)
    u = F.array(F.col("part_id") / 10.0, F.col("part_id") / -20.0)
    state = steps.initial_state(sizes, 2).withColumn("u", u).withColumn("evaluations", F.lit(0))
    problem = LS.LocalProblem(2, rows.count(), tol=1e-12)
    return chunks, state, problem, spark.sparkContext.broadcast(_Z)


_Z = np.array([0.1, -0.2])
LOCAL_SQL = f"""WITH {X.EX_PAIR},
    {newton_sql('pair', 'part_id', '0.5', ('0.1 - part_id / 10.0', '-0.2 + part_id / 20.0'))}
    SELECT part_id, {sql_r('p', 5)} AS w0, {sql_r('q', 5)} AS w1 FROM w10"""


def _two_weights(state):
    return state.select(
        "part_id",
        r(F.get("w", F.lit(0)), 5).alias("w0"),
        r(F.get("w", F.lit(1)), 5).alias("w1"),
    )


@query(LOCAL_SQL)
def local_solve(spark, sf_dir):
    """Minimiser of every block's subproblem, one co-grouped pass."""
    chunks, state, problem, z = _local_problem(spark, sf_dir)
    located = B.co_locate(chunks, X.N_BLOCKS)
    return _two_weights(LS.solve_in_task(located, state, problem, z, 0.5, first=True))


@query(LOCAL_SQL)
def local_solve_across_tasks(spark, sf_dir):
    """The same minimisers for blocks that no single task holds."""
    chunks, state, problem, z = _local_problem(spark, sf_dir)
    chunks = chunks.persist()
    path = LS.solve_across_tasks(chunks, state, problem, z, 0.5, X.N_BLOCKS, first=True)
    chunks.unpersist()
    return _two_weights(spark.read.schema(LS.SEARCH).parquet(path))


FIT_LAM = 0.5
FIT_SQL = f"""WITH {X.EX_PAIR}, sized AS (
      SELECT y, a, b, 0 AS one, count(*) OVER (PARTITION BY part_id) AS n_i,
             (SELECT count(DISTINCT part_id) FROM pair) AS n_blocks FROM pair),
    weighed AS (SELECT *, (SELECT count(*) FROM pair) / (n_i * n_blocks)::DOUBLE AS k FROM sized),
    {newton_sql('weighed', 'one', f'2 * {FIT_LAM} / any_value(n_blocks)', ('0', '0'))
     .replace('avg(-y * a', 'avg(k * -y * a').replace('avg(-y * b', 'avg(k * -y * b')
     .replace('avg(a * a * h)', 'avg(k * a * a * h)').replace('avg(a * b * h)', 'avg(k * a * b * h)')
     .replace('avg(b * b * h)', 'avg(k * b * b * h)')}
    SELECT CAST(j AS INTEGER) AS j, {sql_r('CASE WHEN j = 0 THEN p ELSE q END', 4)} AS weight
    FROM w10, range(2) t(j)"""


FIT_CTES = FIT_SQL[: FIT_SQL.rindex("SELECT CAST(j AS INTEGER)")]


def _settled_fit(spark, sf_dir):
    return ConsensusLogisticRegression(
        lam=FIT_LAM, rho=0.25, eps_abs=1e-6, eps_rel=1e-6, criterion="both", max_iter=200,
        local_tol=1e-10,
    ).fit(X.ex_pair(spark, sf_dir))


@query(FIT_SQL)
def consensus_fit(spark, sf_dir):
    """The whole loop, run until z settles, against the minimiser of the joint objective
    sum over blocks of mean loss + lambda * ||z||^2."""
    return _settled_fit(spark, sf_dir).weights_df.select("j", r("weight", 4).alias("weight"))


@query(FIT_SQL)
def consensus_fit_spectral(spark, sf_dir):
    """The same minimiser with the spectral penalty, from a penalty far off."""
    model = ConsensusLogisticRegression(
        lam=FIT_LAM, rho=50.0, eps_abs=1e-6, eps_rel=1e-6, criterion="both", max_iter=200,
        penalty="spectral", local_tol=1e-10,
    ).fit(X.ex_pair(spark, sf_dir))
    return model.weights_df.select("j", r("weight", 4).alias("weight"))


def descent_sql(source: str, l1: float, l2: float, rounds: int = 12) -> str:
    """CTEs of coordinate descent for two weights: (1/N) * sum over blocks of mean logistic
    loss + l1 * |w| + l2 * w^2, one Newton step of one weight after the other. ``best`` has
    the weights."""
    out = [
        f"""counted AS MATERIALIZED (
          SELECT y, a, b, (SELECT count(*) FROM {source}) / (count(*) OVER (PARTITION BY part_id)
                 * (SELECT count(DISTINCT part_id) FROM {source}))::DOUBLE AS k FROM {source}),
        at0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS p, 0.0::DOUBLE AS q)"""
    ]
    for turn in range(2 * rounds):
        w, x = ("p", "a") if turn % 2 == 0 else ("q", "b")
        moved = f"sign(t) * greatest(abs(t) - {l1}, 0) / (h + 2 * {l2}) AS {w}"
        other = "q" if w == "p" else "p"
        out.append(
            f"""at{turn + 1} AS MATERIALIZED (
              SELECT {moved}, {other} FROM (
                SELECT any_value(p) AS p, any_value(q) AS q, avg(k * {x} * {x} * s) AS h,
                       avg(k * {x} * {x} * s) * any_value({w}) + avg(k * y * {x} / (1 + exp(y * (a * p + b * q)))) AS t
                FROM (SELECT *, 1 / (1 + exp(-(a * p + b * q))) / (1 + exp(a * p + b * q)) AS s
                      FROM counted, at{turn})))"""
        )
    out.append(f"best AS (SELECT p, q FROM at{2 * rounds})")
    return ",\n".join(out)


LASSO_LAM = 0.08


def _penalised(rows, l1_ratio):
    """(j, weight, nonzero) of a settled elastic-net fit."""
    options = dict(eps_abs=1e-7, eps_rel=1e-7, criterion="both")
    model = ConsensusLogisticRegression(
        rho=0.05, max_iter=200, penalty="spectral", local_tol=1e-10,
        updater=ElasticNet(LASSO_LAM, l1_ratio, **options),
    ).fit(rows)
    count = evaluate.model_summary(model.weights_df).first()["nonzero"]
    return model.weights_df.select(
        "j", r("weight", 4).alias("weight"), F.lit(count).cast("int").alias("nonzero")
    )


def _penalised_sql(ctes, source, l1, l2):
    return f"""WITH {ctes}, {descent_sql(source, l1, l2)}
    SELECT CAST(j AS INTEGER) AS j, {sql_r('CASE WHEN j = 0 THEN p ELSE q END', 4)} AS weight,
           CAST((p <> 0)::INT + (q <> 0)::INT AS INTEGER) AS nonzero FROM best, range(2) t(j)"""


@query(_penalised_sql(X.EX_PRICE, "price", LASSO_LAM / X.N_BLOCKS, 0.0))
def lasso_fit(spark, sf_dir):
    """L1 penalty: the weight of the feature that tells nothing is exactly zero."""
    return _penalised(X.ex_price(spark, sf_dir), 1.0)


@query(_penalised_sql(X.EX_PAIR, "pair", LASSO_LAM / 2 / X.N_BLOCKS, LASSO_LAM / 2 / X.N_BLOCKS))
def elastic_net_fit(spark, sf_dir):
    return _penalised(X.ex_pair(spark, sf_dir), 0.5)


@query(
    f"""{FIT_CTES} SELECT id, y, CASE WHEN 1 / (1 + exp(-(a * p + b * q))) > 0.5 THEN 1.0::DOUBLE
    ELSE -1.0::DOUBLE END AS predicted FROM pair, w10"""
)
def consensus_predictions(spark, sf_dir):
    """Fit until z settles and classify every row."""
    model = _settled_fit(spark, sf_dir)
    return model.transform(X.ex_pair(spark, sf_dir)).select("id", "y", "predicted")


@query(
    f"""{FIT_CTES}, pulls AS (
      SELECT part_id, count(*) AS n, avg(y * a / (1 + exp(y * (a * p + b * q)))) AS pa,
             avg(y * b / (1 + exp(y * (a * p + b * q)))) AS pb FROM pair, w10 GROUP BY part_id)
    SELECT part_id, n, CAST(j AS INTEGER) AS j, {sql_r('CASE WHEN j = 0 THEN p ELSE q END', 3)} AS w,
           {sql_r('CASE WHEN j = 0 THEN pa ELSE pb END', 3)} AS pull
    FROM pulls, w10, range(2) t(j)"""
)
def consensus_state(spark, sf_dir):
    """Final block states: every w is the consensus, and rho * u is the pull of the block,
    minus the gradient of its mean loss there, whatever path rho took."""
    model = _settled_fit(spark, sf_dir)
    rho = model.trace.agg(F.max_by("rho", "iteration")).first()[0]
    return model.state.select("part_id", "n", F.posexplode(F.arrays_zip("w", "u")).alias("j", "e")).select(
        "part_id", "n", "j", r("e.w", 3).alias("w"), r(F.col("e.u") * rho, 3).alias("pull")
    )


def trace_sql(rounds: int, lam: float, rho: float, eps: float = 1e-3) -> str:
    """CTEs of whole iterations on ``pair``, one after another: Newton solves of all blocks,
    averages, the global step, residuals, the balanced penalty, and duals rescaled to it.
    ``round{k}`` has the trace of iteration k."""
    out = [
        f"""globals0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS zp, 0.0::DOUBLE AS zq, {rho}::DOUBLE AS rho),
        state1 AS MATERIALIZED (SELECT DISTINCT part_id, 0.0::DOUBLE AS up, 0.0::DOUBLE AS uq FROM pair)"""
    ]
    for k in range(1, rounds + 1):
        newton = newton_sql(f"source{k}", "part_id", "any_value(rho)", ("zp - up", "zq - uq"), prefix=f"r{k}")
        out.append(
            f"""source{k} AS MATERIALIZED (
              SELECT * FROM pair JOIN state{k} USING (part_id), globals{k - 1}),
            {newton.replace(' AS (SELECT', ' AS MATERIALIZED (SELECT')},
            solved{k} AS MATERIALIZED (SELECT * FROM r{k}w10 JOIN state{k} USING (part_id)),
            summed{k} AS MATERIALIZED (
              SELECT count(*) AS n, avg(p + up) AS ap, avg(q + uq) AS aq, sum(p * p + q * q) AS w_sq FROM solved{k}),
            stepped{k} AS MATERIALIZED (
              SELECT n, w_sq, rho, zp AS old_p, zq AS old_q, ap * n * rho / (n * rho + 2 * {lam}) AS zp,
                     aq * n * rho / (n * rho + 2 * {lam}) AS zq FROM summed{k}, globals{k - 1}),
            measured{k} AS MATERIALIZED (
              SELECT any_value(t.zp) AS zp, any_value(t.zq) AS zq, any_value(t.rho) AS rho,
                     sqrt(any_value(w_sq)) AS w_norm, sqrt(any_value(t.zp * t.zp + t.zq * t.zq)) AS z_norm,
                     sqrt(sum((p - t.zp) ** 2 + (q - t.zq) ** 2)) AS primal, any_value(n) AS n,
                     any_value(t.rho * sqrt(n * ((t.zp - old_p) ** 2 + (t.zq - old_q) ** 2))) AS dual
              FROM solved{k}, stepped{k} t),
            round{k} AS MATERIALIZED (
              SELECT {k} AS iteration, *, sqrt(n) * {eps} + {eps} * greatest(w_norm, z_norm) AS primal_tol
              FROM measured{k}),
            globals{k} AS MATERIALIZED (
              SELECT zp, zq, CASE WHEN primal > 10 * dual THEN rho * 2 WHEN dual > 10 * primal THEN rho / 2
                                  ELSE rho END AS rho FROM round{k}),
            state{k + 1} AS MATERIALIZED (
              SELECT part_id, (up + p - g.zp) * t.rho / g.rho AS up, (uq + q - g.zq) * t.rho / g.rho AS uq
              FROM solved{k}, globals{k} g, stepped{k} t)"""
        )
    return ",\n".join(out)


TRACE_ROUNDS, TRACE_RHO = 4, 8.0


TRACE_SQL = f"""WITH {X.EX_PAIR.replace('pair AS (', 'pair AS MATERIALIZED (')},
    {trace_sql(TRACE_ROUNDS, FIT_LAM, TRACE_RHO)}
    SELECT CAST(iteration AS INTEGER) AS iteration, {sql_r('primal')} AS primal, {sql_r('primal_tol')} AS primal_tol,
           {sql_r('dual')} AS dual, rho, {sql_r('w_norm')} AS w_norm, {sql_r('z_norm')} AS z_norm, FALSE AS converged
    FROM ({" UNION ALL ".join(f"SELECT * FROM round{k}" for k in range(1, TRACE_ROUNDS + 1))})"""


def _trace(model):
    return model.trace.select(
        "iteration", *[r(c).alias(c) for c in ("primal", "primal_tol", "dual")], "rho",
        r("w_norm").alias("w_norm"), r("z_norm").alias("z_norm"), "converged",
    )


def _trace_fit(rounds):
    return ConsensusLogisticRegression(
        lam=FIT_LAM, rho=TRACE_RHO, max_iter=rounds, min_iter=TRACE_ROUNDS + 1, local_tol=1e-12
    )


@query(TRACE_SQL)
def consensus_trace(spark, sf_dir):
    """Residuals, tolerance and penalty of whole iterations, each from the one before."""
    return _trace(_trace_fit(TRACE_ROUNDS).fit(X.ex_pair(spark, sf_dir)))


@query(TRACE_SQL)
def consensus_trace_resumed(spark, sf_dir):
    """The same iterations by a fit that stopped after the second and was resumed."""
    folder, rows = fresh_path(spark, "journal"), X.ex_pair(spark, sf_dir)
    _trace_fit(2).fit(rows, checkpoint=folder)
    return _trace(_trace_fit(TRACE_ROUNDS).fit(rows, checkpoint=folder, resume=True))
