"""Queries over projections, filters, evaluation and ordering."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quorumfit.functions import logistic as L
from quorumfit.functions import text
from quorumfit.functions import vectors as V
from quorumfit.operators import blocks as B
from quorumfit.operators import evaluate
from quorumfit.registry import fixtures as X
from quorumfit.registry.catalog import query
from quorumfit.sources import libsvm

r, sql_r = X.r, X.sql_r
MIXED_SQL = "(((o_orderkey % 2147483647) * 2654435761) >> 20)"


@query(f"WITH {X.EX} SELECT id, y, j, {sql_r('v')} AS v FROM exj")
def example_projection(spark, sf_dir):
    """Example rows to (label, dense vector): through an ML vector and back."""
    ml = X.ex_emb(spark, sf_dir).select("id", "y", array_to_vector("x").alias("features"))
    return ml.select("id", "y", F.posexplode(vector_to_array("features")).alias("j", "v")).select(
        "id", "y", "j", r("v").alias("v")
    )


@query(
    f"""WITH {X.EX} SELECT id, CASE WHEN y = -1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label,
    y AS signed FROM ex"""
)
def label_remap(spark, sf_dir):
    label = L.to_binary_label(F.col("y"))
    return X.ex_emb(spark, sf_dir).select(
        "id", label.alias("label"), L.to_signed_label(label).alias("signed")
    )


def _scored(spark, sf_dir):
    rows = X.ex_emb(spark, sf_dir)
    return evaluate.score(rows, X.rule_weights(X.width(rows)))


@query(f"WITH {X.SCORED} SELECT id, {sql_r('s')} AS score FROM scored")
def linear_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", r("score").alias("score"))


@query(
    f"""WITH {X.EX_SPARSE} SELECT id, {sql_r(f'sum(v * {X.SQL_WEIGHT})')} AS score,
    {sql_r(f'sum(v * {X.SQL_WEIGHT})')} AS looked_up FROM sp GROUP BY id"""
)
def sparse_score(spark, sf_dir):
    """Both ways to score sparse rows: constant weights and a broadcast that is looked up."""
    rows = X.ex_sparse(spark, sf_dir)
    return _both_ways(rows, X.rule_weights(rows.agg(F.max("size")).first()[0]))


def _both_ways(rows, weights):
    constant = evaluate.score(rows, weights)
    both = evaluate.score(constant.withColumnRenamed("score", "constant"), weights, constant_bytes=0)
    return both.select("id", r("constant").alias("score"), r("score").alias("looked_up"))


@query(
    f"""WITH {X.EX_SPARSE}, kinds AS (
      SELECT id, sum(v * {X.SQL_WEIGHT}) FILTER (WHERE j < 100) AS s FROM sp GROUP BY id
      UNION ALL
      SELECT -1 - id, sum(v * {X.SQL_WEIGHT}) FILTER (WHERE j < 100) FROM exj GROUP BY id)
    SELECT id, {sql_r('coalesce(s, 0)')} AS score, {sql_r('coalesce(s, 0)')} AS looked_up FROM kinds"""
)
def score_out_of_range(spark, sf_dir):
    """Rows with features that the model lacks, and models wider than the rows: the same
    scores in all four ways, sparse (as ids) and dense (as -1 - id)."""
    weights = X.rule_weights(100)
    dense = X.ex_emb(spark, sf_dir).withColumn("id", -1 - F.col("id"))
    return _both_ways(X.ex_sparse(spark, sf_dir), weights).unionByName(_both_ways(dense, weights))


@query(f"WITH {X.SCORED} SELECT id, {sql_r('1 / (1 + exp(-s))')} AS probability FROM scored")
def sigmoid_probability(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", r(L.sigmoid(F.col("score"))).alias("probability"))


@query(
    f"""WITH {X.SCORED} SELECT id, CASE WHEN 1 / (1 + exp(-s)) > 0.5 THEN 1.0::DOUBLE
    ELSE -1.0::DOUBLE END AS predicted FROM scored"""
)
def predicted_class(spark, sf_dir):
    p = L.sigmoid(F.col("score"))
    return _scored(spark, sf_dir).select("id", L.predicted_class(p).alias("predicted"))


@query(f"WITH {X.SCORED} SELECT id, {sql_r('ln(1 + exp(-y * s))')} AS loss FROM scored")
def logistic_loss(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "id", r(L.logistic_loss(F.col("y"), F.col("score"))).alias("loss")
    )


@query(
    f"""WITH {X.SCORED} SELECT e.id, e.j, {sql_r('-e.y * e.v / (1 + exp(e.y * s))')} AS g
    FROM exj e JOIN scored USING (id)"""
)
def logistic_gradient(spark, sf_dir):
    g = L.logistic_gradient(F.col("y"), F.col("x"), F.col("score"))
    return (
        _scored(spark, sf_dir)
        .select("id", F.posexplode(g).alias("j", "g"))
        .select("id", "j", r("g").alias("g"))
    )


@query(
    f"""WITH {X.EX_SPARSE}, tagged AS (
      SELECT id, CASE WHEN id % 10 = 3 THEN 'index out of range'
                      WHEN id % 10 = 7 THEN 'bad feature' ELSE 'kept' END AS status
      FROM ex)
    SELECT status, count(*) AS n FROM tagged GROUP BY status"""
)
def index_base_shift(spark, sf_dir):
    """0-based text: the base is found once for the dataset; lines with a negative index
    or a bad number are refused with their reason and counted."""
    lines = X.libsvm_lines(X.ex_sparse(spark, sf_dir), 0).withColumn(
        "line",
        F.concat(
            "line",
            F.when(F.col("id") % 10 == 3, " -1:3.0").when(F.col("id") % 10 == 7, " 2:abc").otherwise(""),
        ),
    )
    parsed = libsvm.parse_lines(lines)
    kept = parsed.examples.select(F.lit("kept").alias("status"))
    return (
        kept.unionByName(parsed.rejected.select(F.col("reason").alias("status")))
        .groupBy("status")
        .agg(F.count("*").alias("n"))
    )


@query(
    f"""WITH {X.EX_SPARSE},
    places AS (SELECT id, CAST(unnest(range(3 * len(x))) AS INTEGER) AS j FROM ex)
    SELECT e.id, e.j, {sql_r('coalesce(sp.v, 0) * CASE WHEN e.j = m.first THEN 2 ELSE 1 END')} AS v
    FROM places e LEFT JOIN sp ON e.id = sp.id AND e.j = sp.j
    JOIN (SELECT id, min(j) AS first FROM sp GROUP BY id) m ON e.id = m.id"""
)
def dense_scatter(spark, sf_dir):
    """Sparse text to dense rows. The first feature is written twice, the second time
    doubled; the last write wins."""
    sparse = X.ex_sparse(spark, sf_dir)
    again = F.concat(
        F.lit(" "), (F.get("idx", F.lit(0)) + 1).cast("string"), F.lit(":"),
        (F.get("val", F.lit(0)) * 2).cast("string"),
    )
    lines = sparse.select(
        "id", F.concat(text.libsvm_line(F.col("y"), F.col("idx"), F.col("val"), 1), again).alias("line")
    )
    width = sparse.agg(F.max("size")).first()[0]
    dense = libsvm.parse_lines(lines, 1, width).examples.withColumn(
        "x", V.scatter(F.col("idx"), F.col("val"), F.col("size"))
    )
    return dense.select("id", F.posexplode("x").alias("j", "v")).select("id", "j", r("v").alias("v"))


@query(
    f"""WITH {X.EX_SPARSE} SELECT id, y AS label, CAST(count(*) OVER (PARTITION BY id) + 1 AS INTEGER)
    AS n_tokens, CAST(row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS INTEGER) AS pos,
    CAST(j + 1 AS INTEGER) AS i, {sql_r('v')} AS v FROM sp"""
)
def tokenize_line(spark, sf_dir):
    lines = X.libsvm_lines(X.ex_sparse(spark, sf_dir), 1)
    words = text.staged(lines, ["id"], words=text.tokens(F.col("line")))
    return words.select(
        "id",
        text.label_of(F.col("words")).alias("label"),
        F.size("words").alias("n_tokens"),
        F.explode(text.feature_entries(F.col("words"))).alias("e"),
    ).select("id", "label", "n_tokens", "e.pos", "e.i", r("e.v").alias("v"))


@query(
    f"""WITH {X.STATE} SELECT part_id, j, {sql_r('w + u')} AS added, {sql_r('w - u')} AS subtracted,
    {sql_r('w * 2.5')} AS scaled FROM state"""
)
def vector_arithmetic(spark, sf_dir):
    w, u = F.col("w"), F.col("u")
    parts = F.arrays_zip(
        V.add(w, u).alias("added"), V.subtract(w, u).alias("subtracted"), V.scale(w, 2.5).alias("scaled")
    )
    return (
        X.block_state(spark, sf_dir)
        .select("part_id", F.posexplode(parts).alias("j", "e"))
        .select("part_id", "j", *[r(f"e.{c}").alias(c) for c in ("added", "subtracted", "scaled")])
    )


@query(f"WITH {X.EX} SELECT id, {sql_r('sqrt(sum(v * v))')} AS norm FROM exj GROUP BY id")
def vector_norm(spark, sf_dir):
    return X.ex_emb(spark, sf_dir).select("id", r(V.l2_norm(F.col("x"))).alias("norm"))


@query(
    f"""WITH {X.EX} SELECT id, CAST(sum(CASE WHEN abs(v * 1e-5) > 1e-6 THEN 1 ELSE 0 END) AS INTEGER)
    AS nonzero FROM exj GROUP BY id"""
)
def nonzero_count(spark, sf_dir):
    """Values near zero do not count."""
    return X.ex_emb(spark, sf_dir).select(
        "id", V.nonzero_count(V.scale(F.col("x"), 1e-5)).alias("nonzero")
    )


@query(
    f"""WITH {X.METRICS} SELECT o_orderkey, {sql_r('non_zero_percent')} AS non_zero_percent,
    convergence_status FROM metrics"""
)
def nonzero_percent_and_status(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    width = F.when(key % 2 == 1, 28).otherwise(47236)
    limit = F.when(cust % 2 == 0, 50).otherwise(100)
    return orders.select(
        "o_orderkey",
        r(text.nonzero_percent(width - key % 20, width)).alias("non_zero_percent"),
        text.convergence_status(10 + key % 41 < limit).alias("convergence_status"),
    )


@query(
    f"""WITH {X.METRICS} SELECT train_tag, test_tag, count(*) AS n FROM (
      SELECT regexp_extract(train_file, 'train([0-9]+k?)', 1) AS train_tag,
             CASE WHEN test_file LIKE '%test%' THEN '10k' ELSE test_file END AS test_tag
      FROM metrics) GROUP BY ALL"""
)
def sample_size_tag(spark, sf_dir):
    """Size tag of file names, with and without a folder; names without a tag stay whole."""
    return (
        X.metrics(spark, sf_dir)
        .select(
            text.sample_size_tag(F.col("train_file"), "train").alias("train_tag"),
            text.sample_size_tag(F.col("test_file"), "test").alias("test_tag"),
        )
        .groupBy("train_tag", "test_tag")
        .agg(F.count("*").alias("n"))
    )


@query(
    f"""WITH {X.EX} SELECT id, printf('%.1f', norm) AS d1, printf('%.2f', norm) AS d2,
    printf('%.3f', norm) AS d3, printf('%.6f', norm) AS d6
    FROM (SELECT id, sqrt(sum(v * v)) * 100 AS norm FROM exj GROUP BY id)"""
)
def number_format(spark, sf_dir):
    norm = V.l2_norm(F.col("x")) * 100
    return X.ex_emb(spark, sf_dir).select(
        "id", *[text.fixed(norm, d).alias(f"d{d}") for d in (1, 2, 3, 6)]
    )


@query(
    f"""WITH {X.METRICS} SELECT upper(dataset) AS tag, lower(upper(algorithm)) AS algorithm,
    count(*) AS n FROM metrics GROUP BY ALL"""
)
def text_case(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.upper("dataset"), F.lit(" "))
    return (
        X.metrics(spark, sf_dir)
        .groupBy(F.trim(padded).alias("tag"), F.lower(F.upper("algorithm")).alias("algorithm"))
        .agg(F.count("*").alias("n"))
    )


# --- evaluation -----------------------------------------------------------------


def _predicted_line(spark, sf_dir):
    return evaluate.predict(X.ex_line(spark, sf_dir), X.LINE_WEIGHTS)


@query(
    f"""WITH {X.EX_LINE} SELECT y, count(*) AS n FROM scored
    WHERE y = CASE WHEN 1 / (1 + exp(-s)) > 0.5 THEN 1 ELSE -1 END GROUP BY y"""
)
def correct_predictions(spark, sf_dir):
    hits = evaluate.correct_predictions(_predicted_line(spark, sf_dir))
    return hits.groupBy("y").agg(F.count("*").alias("n"))


@query(
    f"""WITH {X.EX_LINE} SELECT CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total,
    {sql_r('avg(hit)')} AS accuracy FROM (
      SELECT CASE WHEN y = CASE WHEN 1 / (1 + exp(-s)) > 0.5 THEN 1 ELSE -1 END THEN 1 ELSE 0 END AS hit FROM scored)"""
)
def accuracy(spark, sf_dir):
    return evaluate.accuracy(_predicted_line(spark, sf_dir)).withColumn("accuracy", r("accuracy"))


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query(
    f"""WITH {X.EX_LINE} SELECT count(*) AS rows, count(*) FILTER (WHERE y = -1) AS negative,
    count(*) FILTER (WHERE y = 1) AS positive FROM ex"""
)
def dataset_profile(spark, sf_dir):
    return evaluate.profile(X.ex_line(spark, sf_dir))


@query(f"WITH {X.EX_LINE} SELECT y, count(*) AS n FROM ex GROUP BY y")
def label_distribution(spark, sf_dir):
    return evaluate.label_distribution(X.ex_line(spark, sf_dir))


@query(
    f"""WITH {X.EX_SPARSE} SELECT 'dense' AS kind, CAST(max(len(x)) AS INTEGER) AS features FROM ex
    UNION ALL SELECT 'sparse', CAST(max(j) + 1 AS INTEGER) FROM sp"""
)
def feature_dimension(spark, sf_dir):
    dense = evaluate.feature_dimension(X.ex_emb(spark, sf_dir))
    sparse = evaluate.feature_dimension(X.ex_sparse(spark, sf_dir))
    kinds = [f.select(F.lit(k).alias("kind"), "features") for k, f in (("dense", dense), ("sparse", sparse))]
    return kinds[0].unionByName(kinds[1])


PREDICTION_COLUMNS = f"""id, y, {sql_r('s')} AS score, {sql_r('1 / (1 + exp(-s))')} AS probability,
    CASE WHEN 1 / (1 + exp(-s)) > 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS predicted"""


def _predictions(spark, sf_dir):
    rows = X.ex_emb(spark, sf_dir)
    return evaluate.predict(rows, X.rule_weights(X.width(rows)))


@query(f"WITH {X.SCORED} SELECT {PREDICTION_COLUMNS} FROM scored")
def consensus_scores(spark, sf_dir):
    return _predictions(spark, sf_dir).select(
        "id", "y", r("score").alias("score"), r("probability").alias("probability"), "predicted"
    )


@query(f"WITH {X.SCORED} SELECT {PREDICTION_COLUMNS} FROM scored ORDER BY id LIMIT 5")
def sample_predictions(spark, sf_dir):
    return (
        evaluate.sample_predictions(_predictions(spark, sf_dir))
        .withColumn("score", r("score"))
        .withColumn("probability", r("probability"))
    )


@query(f"WITH {X.EX} SELECT id, y, CAST(len(x) AS INTEGER) AS width FROM ex ORDER BY id LIMIT 1")
def first_row(spark, sf_dir):
    return evaluate.first_row(X.ex_emb(spark, sf_dir)).select("id", "y", F.size("x").alias("width"))


@query(
    f"""WITH {X.EX}, model AS (SELECT j, avg(v) AS weight FROM exj GROUP BY j)
    SELECT {sql_r('sqrt(sum(weight * weight))')} AS norm,
    CAST(sum(CASE WHEN abs(weight) > 1e-6 THEN 1 ELSE 0 END) AS INTEGER) AS nonzero,
    CAST(count(*) AS INTEGER) AS total FROM model"""
)
def model_summary(spark, sf_dir):
    model = (
        X.ex_emb(spark, sf_dir)
        .select(F.posexplode("x").alias("j", "v"))
        .groupBy("j")
        .agg(F.avg("v").alias("weight"))
    )
    return evaluate.model_summary(model).withColumn("norm", r("norm"))


# --- blocks and order -----------------------------------------------------------


@query(
    f"""WITH {X.EX_SPARSE} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS INTEGER)
    AS k, CAST(j + 1 AS INTEGER) AS i FROM sp"""
)
def sorted_features(spark, sf_dir):
    """Features written in descending order come back ascending."""
    backwards = X.ex_sparse(spark, sf_dir).withColumn("idx", F.reverse("idx")).withColumn(
        "val", F.reverse("val")
    )
    entries = text.sort_entries(text.feature_entries(text.tokens(F.col("line"))))
    return (
        X.libsvm_lines(backwards, 1)
        .select("id", F.posexplode(entries).alias("k", "e"))
        .select("id", "k", "e.i")
    )


@query(
    f"""SELECT CAST({MIXED_SQL} % 8 AS INTEGER) AS part_id, count(*) AS n, min(o_orderkey) AS low
    FROM orders GROUP BY ALL"""
)
def block_assignment(spark, sf_dir):
    rows = B.assign_blocks(X.table(spark, sf_dir, "orders"), X.N_BLOCKS, "o_orderkey")
    return rows.groupBy("part_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"))


@query(
    """SELECT CASE WHEN coalesce((key % 2147483647) * 2654435761 % 1000 < 800, true) THEN 'train'
      ELSE 'test' END AS side, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 > 0 THEN o_orderkey END AS key FROM orders)
    GROUP BY ALL"""
)
def hash_split(spark, sf_dir):
    """Both sides of a split by a key that a tenth of the rows lack: no row is lost."""
    keyed = X.table(spark, sf_dir, "orders").withColumn(
        "key", F.when(F.col("o_custkey") % 10 > 0, F.col("o_orderkey"))
    )
    sides = B.hash_split(keyed, "key", 0.8)
    train, test = [s.select(F.lit(k).alias("side"), "o_orderkey") for k, s in zip(("train", "test"), sides)]
    return (
        train.unionByName(test)
        .groupBy("side")
        .agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))
    )


@query("""SELECT o_orderkey, 1::BIGINT AS times, TRUE AS same_again, TRUE AS share_holds FROM orders""")
def random_split(spark, sf_dir):
    """Every row lands on exactly one side, on the same one when asked again, and the sides
    have their shares (within 0.05, five deviations at 1,500 rows)."""
    def sides():
        train, test = B.random_split(X.table(spark, sf_dir, "orders").select("o_orderkey"), 0.8, 42)
        return train.withColumn("side", F.lit(1)).unionByName(test.withColumn("side", F.lit(0)))

    first, again = sides(), sides().withColumnRenamed("side", "side_again")
    share = first.agg(F.avg("side")).first()[0]
    return first.join(again, "o_orderkey").groupBy("o_orderkey").agg(
        F.count("*").alias("times"), F.bool_and(F.col("side") == F.col("side_again")).alias("same_again")
    ).withColumn("share_holds", F.lit(abs(share - 0.8) < 0.05))


@query(
    f"""SELECT CAST({MIXED_SQL} % 8 AS INTEGER) AS part_id, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY {MIXED_SQL} % 8 ORDER BY o_orderkey) <= 100"""
)
def row_cap(spark, sf_dir):
    """First rows of every block, the optional training cap."""
    rows = B.assign_blocks(X.table(spark, sf_dir, "orders").select("o_orderkey"), 8, "o_orderkey")
    return B.cap_rows(rows, 100, "o_orderkey").select("part_id", "o_orderkey")


@query(
    f"""WITH {X.EX_SPARSE} SELECT part_id * 3 AS part_id, count(DISTINCT id) AS n, count(*) AS n_values
    FROM sp GROUP BY part_id"""
)
def nonempty_blocks(spark, sf_dir):
    """Packed sparse rows of block numbers with gaps: only blocks with rows appear."""
    rows = X.ex_sparse(spark, sf_dir).withColumn("part_id", F.col("part_id") * 3)
    return B.block_sizes(B.pack_chunks(rows)).select("part_id", "n", "n_values")
