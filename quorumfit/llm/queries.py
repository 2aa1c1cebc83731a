"""Registered queries of this subpackage and the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumfit.llm import (
    centroids, exact_dedup, hard_negatives, host_quality, html_text, language_id, licenses,
    mixing, near_dup, pii, piece_lattice, secrets, sharding,
)
from quorumfit.llm.tables import table

_WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@_query(f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query()
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.train(docs))


@_query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    marked = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    return language_id.identify(marked, model, keep=["doc_id", "held_out"])


@_query()
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@_query()
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


@_query()
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_lattice.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_tokens", "ids", "round_trip")


@_query(f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws
  FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, ws[i:least(i + 4, len(ws))] AS s FROM places),
sizes AS (SELECT w.doc_id, count(s.doc_id) AS n FROM words w LEFT JOIN shingles s USING (doc_id) GROUP BY w.doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN classes USING (doc_id)
""")
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    rules, limit = host_quality.RULES, 0.9
    fails = ", ".join(f"sum(CASE WHEN {r} THEN 1 ELSE 0 END)::DOUBLE AS {n}" for n, r in rules.items())
    moments = ", ".join(
        f"sum({n}) / sum(docs) AS {n}_m, sum({n} * {n} / docs) / sum(docs) - (sum({n}) / sum(docs)) ** 2 AS {n}_v"
        for n in rules
    )
    weights = ", ".join(
        f"CASE WHEN {n}_v > 1e-12 THEN least(greatest({n}_m * (1 - {n}_m) / {n}_v - 1, 1), 1000) "
        f"ELSE 1000 END AS {n}_w" for n in rules
    )
    worst = ", ".join(f"({n} + {n}_w * {n}_m) / (docs + {n}_w)" for n in rules)
    failed = f"({rules['short']} OR {rules['repeated']})"
    return f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
listed AS (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM texts),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM listed),
counts AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2,
         lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w3 FROM words),
often AS (
  SELECT doc_id, i FROM windows WHERE w3 IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, range(3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
twice AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (
  SELECT t.doc_id, t.source, coalesce(c.n_words, 0) AS n_words,
         CAST(coalesce(c.word_chars, 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(t.t, '[#*$%&|<>]')) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN counts c USING (doc_id) LEFT JOIN twice d USING (doc_id)
  LEFT JOIN covered r USING (doc_id)),
hosts AS (SELECT source, count(*) AS docs, {fails} FROM m GROUP BY source),
moments AS (SELECT {moments} FROM hosts),
rated AS (SELECT source, greatest({worst}) > {limit} AS host_failed
          FROM hosts, (SELECT *, {weights} FROM moments))
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {failed} AS base_failed, host_failed, NOT {failed} AND NOT host_failed AS kept
FROM m JOIN rated ON m.source IS NOT DISTINCT FROM rated.source"""


@_query(_quality_sql())
def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(table(spark, sf_dir, "documents"))


@_query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


@_query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.train(docs))


@_query()
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def _cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
gaps{t} AS (
  SELECT p.vec_id, c.c, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance
  FROM parts p JOIN c{t} c ON p.j = c.j GROUP BY p.vec_id, c.c),
near{t} AS (
  SELECT * FROM gaps{t} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)""")
        if t < rounds:
            steps.append(f"""
sums{t} AS (
  SELECT n.c, p.j, sum(p.x)::BIGINT AS s, count(*) AS n
  FROM near{t} n JOIN parts p USING (vec_id) GROUP BY n.c, p.j),
c{t + 1} AS (
  SELECT o.c, o.j, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, o.x)::BIGINT AS x
  FROM c{t} o LEFT JOIN sums{t} s ON o.c = s.c AND o.j = s.j)""")
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims}
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dims}),
parts AS (
  SELECT vec_id, unnest(range({dims})) AS j,
         CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
starts AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c
  FROM kept QUALIFY c < {k}),
c0 AS (SELECT c, j, x FROM starts JOIN parts USING (vec_id)),
{",".join(steps)},
hashed AS (SELECT c, sha256(string_agg(x, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance,
       sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256,
       count(*) OVER (PARTITION BY c) AS cluster_rows
FROM near{rounds} JOIN hashed USING (c)"""


@_query(_cluster_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@_query("""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings
  WHERE label IS NOT NULL
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
parts AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS j,
         CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         sum(a.x * b.x)::BIGINT AS score
  FROM parts a JOIN parts b ON a.j = b.j AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))
