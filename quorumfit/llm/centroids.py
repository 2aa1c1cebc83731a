"""Centroid clustering on integers with an incrementally kept matrix of dot products."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.llm.integer_vectors import check_range, integers, matrix, product, whole
from quorumfit.llm.tables import dropped, written

_STATE = (
    "vec_id long, q array<long>, norm long, dots array<long>, cluster int, distance long"
)
_SUMS = "cluster int, n long, sums array<long>"


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _assigned(old: np.ndarray | None, new: np.ndarray):
    """Bring the dot products from the old centroids to the new ones and assign again.

    Only the components in which a centroid moved are multiplied. Without ``old`` there
    are no products yet and all of them are made.
    """
    dims, norms = new.shape[1], (new * new).sum(axis=1)
    moved = [] if old is None else [
        (j, np.flatnonzero(step), step[np.flatnonzero(step)]) for j, step in enumerate(new - old)
    ]

    def run(batches):
        for batch in batches:
            q, norm = matrix(batch.column("q"), dims), batch.column("norm").to_numpy()
            if old is None:
                dots = product(q, new.T)
            else:
                dots = matrix(batch.column("dots"), len(new)).copy()
                for j, at, step in moved:
                    if len(at):
                        dots[:, j] += product(q[:, at], step)
            gaps = norms - 2 * dots
            cluster = gaps.argmin(axis=1)
            distance = norm + gaps[np.arange(len(gaps)), cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), batch.column("norm"), _lists(dots),
                 pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "q", "norm", "dots", "cluster", "distance"],
            )
    return run


def _cluster_sums(k: int, dims: int):
    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            member = (cluster == np.arange(k)[:, None]).astype(np.int64)
            n += member.sum(axis=1)
            sums += product(member, matrix(batch.column("q"), dims))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(n[used]), _lists(sums[used])],
            ["cluster", "n", "sums"],
        )
    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at floor(sum / count) of their vectors; tasks add up their own rows first."""
    k, dims = centroids.shape
    sums = state.select("cluster", "q").mapInArrow(_cluster_sums(k, dims), _SUMS)
    by_component = sums.select("cluster", "n", F.posexplode("sums").alias("j", "s"))
    found = by_component.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for row in found.collect():
        out[row["cluster"], row["j"]] = row["s"] // row["n"]
    return out


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:"
) -> DataFrame:
    """Cluster of every whole vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, cluster_rows.

    Components become floor(256 * x). Centroids start at the ``k`` vectors of smallest
    sha256(salt + vec_id); each round assigns every vector to the nearest centroid and moves
    non-empty centroids to the floored means of their vectors; after the last one vectors
    are assigned once more. A table in the shared folder holds every vector's integer dot
    products with all centroids: a round adds, for the components in which a centroid moved,
    component times step, and the distances follow as |x|^2 - 2 x.c + |c|^2, all in exact
    integers. The table of a round replaces that of the round before. The driver holds the
    ``k`` centroids and ``k`` by ``dims`` sums.

    Vectors that are null, of another length, or with a null or non-finite component take no
    part and have no row. Equal distances go to the smaller cluster number. Rows of one
    vec_id that repeat are vectors of their own, and all are starts when the hash is among
    the smallest (in order of their components); a null vec_id comes last among the starts.
    With fewer than ``k`` vectors each is a start. Components whose squared distance would
    not fit a long are an error. Other columns are ignored, whatever their names. An empty
    table gives an empty table.
    """
    given = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("v")
    )
    points = given.where(whole(F.col("v")) & (F.size("v") == dims)).select(
        "vec_id", integers(F.col("v")).alias("q")
    )
    points = written(
        points.withColumn(
            "norm", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + F.try_multiply(x, x))
        ),
        "points",
    )
    reach = points.agg(F.max(F.array_max(F.transform("q", F.abs))).alias("most")).first()["most"]
    if reach is None:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
            "centroid_sha256 string, cluster_rows long"
        )
    check_range(reach, dims, "embedding")
    named = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    starts = points.orderBy(named.asc_nulls_last(), "q").limit(k).collect()
    centroids, old, state = np.array([row["q"] for row in starts], np.int64), None, points
    for turn in range(rounds + 1):
        step = written(state.mapInArrow(_assigned(old, centroids), _STATE), "dots")
        dropped(state)
        state, old = step, centroids
        if turn < rounds:
            centroids = _moved(state, centroids)
    by_cluster = state.groupBy("cluster").agg(
        F.sum("distance").alias("inertia"), F.count("*").alias("rows")
    ).collect()
    total = sum(row["inertia"] for row in by_cluster)
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = vectors.sparkSession.createDataFrame(
        [(r["cluster"], r["inertia"], total, sha(r["cluster"]), r["rows"]) for r in by_cluster],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_rows long",
    )
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_rows"
    )
