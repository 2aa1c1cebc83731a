"""Queries over whole experiment runs and their comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumfit.operators import blocks as B
from quorumfit.plans import compare, runs
from quorumfit.plans.baseline import fit_lbfgs
from quorumfit.registry import fixtures as X
from quorumfit.registry.catalog import query
from quorumfit.registry.fitting import newton_sql
from quorumfit.session import fresh_path
from quorumfit.sources import libsvm

r, sql_r = X.r, X.sql_r
PAIR_LAM = 0.25
# Options under which the fit runs until its weights settle, and its result does not
# depend on which rows share a block.
SETTLED = dict(
    weighting="rows", criterion="both", eps_abs=1e-6, eps_rel=1e-6, local_tol=1e-10, rho=0.02
)
SPLIT_SQL = (
    X.EX_PAIR
    + """,
sides AS (SELECT *, (id % 2147483647) * 2654435761 % 1000 < 800 AS training FROM pair),
train AS (SELECT y, a, b, 0 AS one FROM sides WHERE training),
test AS (SELECT y, a, b FROM sides WHERE NOT training),
counts AS (SELECT (SELECT count(*) FROM train) AS train_samples,
                  (SELECT count(*) FROM test) AS test_samples)"""
)


def _pair_split(spark, sf_dir):
    rows = X.ex_pair(spark, sf_dir).drop("part_id")
    train, test = B.hash_split(rows, "id", 0.8)
    return runs.ExampleSet("pair", train, test)


RUN_COLUMNS = ["dataset", "algorithm", "train_samples", "test_samples", "features", "partitions",
               "non_zero_weights", "total_weights", "accuracy_percent"]


def _run_sql(algorithm, features):
    return f"""SELECT 'pair' AS dataset, '{algorithm}' AS algorithm, any_value(train_samples) AS train_samples,
    any_value(test_samples) AS test_samples, {features}::INTEGER AS features, 8::INTEGER AS partitions,
    {features}::INTEGER AS non_zero_weights, {features}::INTEGER AS total_weights,
    {sql_r('100.0::DOUBLE * avg(hit)', 2)} AS accuracy_percent, any_value(norm) AS model_norm
    FROM scored, counts"""


@query(
    f"""WITH {SPLIT_SQL}, {newton_sql('train', 'one', f'{2 * PAIR_LAM}', ('0', '0'))},
    scored AS (SELECT {sql_r('sqrt(p * p + q * q)', 4)} AS norm,
                      CASE WHEN y = CASE WHEN 1 / (1 + exp(-(a * p + b * q))) > 0.5 THEN 1 ELSE -1 END
                           THEN 1 ELSE 0 END AS hit FROM test, w10)
    {_run_sql('admm', 2)}"""
)
def run_consensus(spark, sf_dir):
    """Split, profile, fit, evaluate: one metrics row."""
    data = _pair_split(spark, sf_dir)
    result = runs.run_experiment(data, "admm", lam=PAIR_LAM, max_iter=200, **SETTLED)
    return result.metrics.select(*RUN_COLUMNS, r("model_norm", 4).alias("model_norm"))


def _lbfgs_sql(source, rounds=10):
    """Newton CTEs of the baseline on two standardised features with a free intercept;
    ``best`` has the weights p, q of the raw features and the intercept r."""
    out = [
        f"""base AS (SELECT y, a, b FROM {source}),
        scale AS (SELECT stddev_samp(a) AS da, stddev_samp(b) AS db FROM base),
        spread AS (SELECT y, a / da AS a, b / db AS b FROM base, scale),
        v0 AS (SELECT 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS r)"""
    ]
    for k in range(rounds):
        out.append(
            f"""m{k} AS (
              SELECT p, q, r, avg(e * a) + 0.01 * p AS g0, avg(e * b) + 0.01 * q AS g1, avg(e) AS g2,
                     avg(h * a * a) + 0.01 AS aa, avg(h * a * b) AS ab, avg(h * a) AS ac,
                     avg(h * b * b) + 0.01 AS bb, avg(h * b) AS bc, avg(h) AS cc
              FROM (SELECT *, -y / (1 + exp(y * s)) AS e, 1 / (1 + exp(-s)) / (1 + exp(s)) AS h
                    FROM (SELECT spread.*, v.*, a * p + b * q + r AS s FROM spread, v{k} v))
              GROUP BY p, q, r),
            v{k + 1} AS (
              SELECT p - (g0 * (bb * cc - bc * bc) - ab * (g1 * cc - bc * g2) + ac * (g1 * bc - bb * g2)) / det AS p,
                     q - (aa * (g1 * cc - bc * g2) - g0 * (ab * cc - bc * ac) + ac * (ab * g2 - g1 * ac)) / det AS q,
                     r - (aa * (bb * g2 - g1 * bc) - ab * (ab * g2 - g1 * ac) + g0 * (ab * bc - bb * ac)) / det AS r
              FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac)
                           AS det FROM m{k}))"""
        )
    out.append(f"best AS (SELECT p / da AS p, q / db AS q, r FROM v{rounds}, scale)")
    return ",\n".join(out)


@query(
    f"""WITH {SPLIT_SQL}, {_lbfgs_sql('train')},
    scored AS (SELECT {sql_r('sqrt(p * p + q * q)', 4)} AS norm,
                      CASE WHEN y = CASE WHEN 1 / (1 + exp(-(a * p + b * q + r))) > 0.5 THEN 1 ELSE -1 END
                           THEN 1 ELSE 0 END AS hit FROM test, best)
    {_run_sql('lbfgs', 2)}"""
)
def run_lbfgs(spark, sf_dir):
    result = runs.run_experiment(_pair_split(spark, sf_dir), "lbfgs", tol=1e-12)
    return result.metrics.select(*RUN_COLUMNS, r("model_norm", 4).alias("model_norm"))


@query(
    f"""WITH {X.EX_PAIR}, {_lbfgs_sql('pair')}
    SELECT CAST(j AS INTEGER) AS j, {sql_r('CASE WHEN j = 0 THEN p ELSE q END', 4)} AS weight,
           {sql_r('r', 4)} AS intercept FROM best, range(2) t(j)"""
)
def lbfgs_fit(spark, sf_dir):
    """The L-BFGS baseline on both features: standardised, free intercept."""
    model = fit_lbfgs(X.ex_pair(spark, sf_dir), tol=1e-12)
    return model.weights_df(spark).select(
        "j", r("weight", 4).alias("weight"), r(F.lit(model.intercept), 4).alias("intercept")
    )


@query(
    f"""WITH {X.EX_PAIR}, {_lbfgs_sql('pair')}
    SELECT id, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
           CASE WHEN 1 / (1 + exp(-(a * p + b * q + r))) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS predicted
    FROM pair, best"""
)
def lbfgs_scores(spark, sf_dir):
    """Baseline classes in 0/1."""
    rows = X.ex_pair(spark, sf_dir)
    return fit_lbfgs(rows, tol=1e-12).transform(rows).select("id", "label", "predicted")


@query(
    f"""WITH {X.EX_PAIR}, rows AS (SELECT y, a, b, 0 AS one FROM pair),
    {newton_sql('rows', 'one', '0.2', ('0', '0'))}
    SELECT CAST(j AS INTEGER) AS j, {sql_r('CASE WHEN j = 0 THEN p ELSE q END', 4)} AS weight
    FROM w10, range(2) t(j)"""
)
def fit_and_save(spark, sf_dir):
    """Fit a LibSVM file with the batch defaults (lambda 0.1) and save its weights."""
    source, out = fresh_path(spark, "libsvm"), fresh_path(spark, "model")
    libsvm.write_libsvm(X.as_sparse(X.ex_pair(spark, sf_dir)), source, base=1)
    runs.fit_and_save(spark, source, X.N_BLOCKS, out, num_features=2, max_iter=200, **SETTLED)
    return runs.read_weights(spark, out).select("j", r("weight", 4).alias("weight"))


def _sweep_sql(algorithm, p, q, bias):
    """Runs of one algorithm at every partition count; the optimum is the same at each."""
    score = f"a * {p} + b * {q} + {bias}"
    return f"""SELECT 'pair' AS dataset, '{algorithm}' AS algorithm, any_value(train_samples) AS train_samples,
    any_value(test_samples) AS test_samples, 2::INTEGER AS features, CAST(n AS INTEGER) AS partitions,
    2::INTEGER AS non_zero_weights, 2::INTEGER AS total_weights,
    {sql_r('100.0::DOUBLE * avg(hit)', 2)} AS accuracy_percent, {sql_r('any_value(norm)', 3)} AS model_norm
    FROM (SELECT sqrt({p} * {p} + {q} * {q}) AS norm,
                 CASE WHEN y = CASE WHEN 1 / (1 + exp(-({score}))) > 0.5 THEN 1 ELSE -1 END
                      THEN 1 ELSE 0 END AS hit FROM test, best, settled), counts,
         (VALUES (5), (8), (10), (15)) grid(n)
    GROUP BY n"""


GRID_OPTIONS = {
    "admm": SETTLED | dict(lam=PAIR_LAM, max_iter=200, eps_abs=1e-5, eps_rel=1e-5),
    "lbfgs": dict(tol=1e-12),
}


@query(
    f"""WITH {SPLIT_SQL}, {_lbfgs_sql('train')},
    {newton_sql('train', 'one', f'{2 * PAIR_LAM}', ('0', '0'), prefix='s')},
    settled AS (SELECT p AS sp, q AS sq FROM sw10)
    {_sweep_sql('admm', 'sp', 'sq', '0')} UNION ALL {_sweep_sql('lbfgs', 'p', 'q', 'r')}"""
)
def partition_sweep(spark, sf_dir):
    """Both algorithms at every partition count."""
    grid = runs.run_grid([_pair_split(spark, sf_dir)], options=GRID_OPTIONS)
    return grid.select(*RUN_COLUMNS, r("model_norm", 3).alias("model_norm"))


@query(
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH {ctes}, {_lbfgs_sql('train')},
        {newton_sql('train', 'one', f'{2 * PAIR_LAM}', ('0', '0'), prefix='s')},
        settled AS (SELECT p AS sp, q AS sq FROM sw10)
        SELECT * REPLACE ('{name}' AS dataset) FROM (
          {_sweep_sql('admm', 'sp', 'sq', '0')} UNION ALL {_sweep_sql('lbfgs', 'p', 'q', 'r')})
        WHERE partitions = 8)"""
        for name, ctes in (
            ("pair", SPLIT_SQL),
            ("price", (X.EX_PRICE + SPLIT_SQL[len(X.EX_PAIR):]).replace("FROM pair)", "FROM price)")),
        )
    )
)
def dataset_sweep(spark, sf_dir):
    """Both algorithms, run until they settle, on a dense and on a sparse dataset."""
    train, test = B.hash_split(X.as_sparse(X.ex_price(spark, sf_dir)), "id", 0.8)
    sets = [_pair_split(spark, sf_dir), runs.ExampleSet("price", train, test)]
    grid = runs.run_grid(sets, partitions=[X.N_BLOCKS], options=GRID_OPTIONS)
    return grid.select(*RUN_COLUMNS, r("model_norm", 3).alias("model_norm"))


def _view(spark, sf_dir):
    return compare.comparison_view(X.metrics(spark, sf_dir))


@query(
    f"""WITH {X.METRICS} SELECT series, version, algorithm, dataset, count(*) AS n,
    {sql_r('sum(pct_nonzero)', 4)} AS pct_nonzero FROM cmp GROUP BY ALL"""
)
def comparison_columns(spark, sf_dir):
    """Run metrics renamed and derived for the comparison tables."""
    return (
        _view(spark, sf_dir)
        .groupBy("series", "version", "algorithm", "dataset")
        .agg(F.count("*").alias("n"), r(F.sum("pct_nonzero"), 4).alias("pct_nonzero"))
    )


@query(
    f"""WITH {X.METRICS} SELECT series, count(*) AS n, {sql_r('sum(runtime_s)', 3)} AS runtime_s FROM cmp
    WHERE partitions = 8 GROUP BY series"""
)
def metrics_for_partitions(spark, sf_dir):
    return (
        compare.for_partitions(_view(spark, sf_dir), 8)
        .groupBy("series")
        .agg(F.count("*").alias("n"), r(F.sum("runtime_s"), 3).alias("runtime_s"))
    )


@query(f"WITH {X.METRICS} SELECT DISTINCT partitions FROM cmp ORDER BY partitions")
def partition_counts(spark, sf_dir):
    return compare.partition_counts(_view(spark, sf_dir))


@query(
    f"""WITH {X.METRICS} SELECT {sql_r('min(accuracy_pct) * 0.98')} AS low,
    {sql_r('max(accuracy_pct) * 1.01')} AS high FROM cmp"""
)
def accuracy_bounds(spark, sf_dir):
    return compare.accuracy_bounds(_view(spark, sf_dir)).select(r("low").alias("low"), r("high").alias("high"))


def _comparison(spark, sf_dir, measure):
    table = compare.comparison_table(_view(spark, sf_dir), measure)
    return table.select(
        "partitions", "series", r(measure, 4).alias(measure), r("accuracy_pct", 4).alias("accuracy_pct")
    )


def _comparison_sql(measure):
    return f"""WITH {X.METRICS} SELECT partitions, series, {sql_r(f'avg({measure})', 4)} AS {measure},
    {sql_r('avg(accuracy_pct)', 4)} AS accuracy_pct FROM cmp GROUP BY partitions, series"""


@query(_comparison_sql("runtime_s"))
def runtime_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir, "runtime_s")


@query(_comparison_sql("iterations"))
def iterations_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir, "iterations")


@query(_comparison_sql("pct_nonzero"))
def nonzero_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir, "pct_nonzero")


SERIES = ["ADMM v2.4", "ADMM v4.0", "LBFGS v2.4", "LBFGS v4.0"]


@query(
    f"WITH {X.METRICS} SELECT partitions, "
    + ", ".join(
        f"""{sql_r(f"avg({m}) FILTER (WHERE series = '{s}')", 4)} AS "{s}_{m}" """
        for s in SERIES
        for m in ("runtime_s", "accuracy_pct")
    )
    + " FROM cmp GROUP BY partitions"
)
def runtime_pivot(spark, sf_dir):
    """One column pair per series."""
    wide = compare.comparison_pivot(_view(spark, sf_dir), "runtime_s", SERIES)
    return wide.select(
        "partitions", *[r(F.col(f"`{c}`"), 4).alias(c) for c in wide.columns if c != "partitions"]
    )
