"""Centroid clustering and hard negatives against plain versions, and odd vectors."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorumfit.llm import centroids, hard_negatives
from quorumfit.llm.integer_vectors import product

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, row long"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 1) for i, v, lab in rows], SCHEMA)


def _ints(v):
    return [int(np.floor(256.0 * float(np.float32(x)))) for x in v]


def _whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def _plain_clusters(rows, k, rounds, dims):
    kept = [(i, _ints(v)) for i, v, _ in rows if _whole(v) and len(v) == dims]
    sha = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    cents = [q for _, q in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    gap = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c))
    for turn in range(rounds + 1):
        near = [min(range(len(cents)), key=lambda j: (gap(q, cents[j]), j)) for _, q in kept]
        if turn == rounds:
            break
        for j in set(near):
            own = [q for (_, q), n in zip(kept, near) if n == j]
            cents[j] = [sum(c) // len(own) for c in zip(*own)]
    cost = [gap(q, cents[n]) for (_, q), n in zip(kept, near)]
    return sorted(
        ((-1 if i is None else i), n, d, sum(x for x, m in zip(cost, near) if m == n), sum(cost),
         hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest())
        for (i, _), n, d in zip(kept, near, cost)
    )


def _plain_negatives(rows, every, first):
    dims = max((len(v) for _, v, _ in rows if v), default=0)
    kept = []
    for i, v, lab in rows:
        if lab is not None and _whole(v):
            lab = (lab + 1) % 10 if i is not None and i % 7 == 0 else lab
            kept.append((i, lab, _ints(v) + [0] * (dims - len(v))))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, lab, q in kept:
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, o)), j, m) for j, m, o in kept]
        for pos, pid, _ in sorted((s for s in scored if s[2] == lab and s[1] != i), key=key)[:first]:
            fits = [s for s in scored if s[2] != lab and 80 * pos <= 100 * s[0] <= 100 * pos]
            for rank, (neg, nid, _) in enumerate(sorted(fits, key=key)[:first], 1):
                out.append((i, -1 if pid is None else pid, rank, -1 if nid is None else nid, pos, neg))
    return sorted(out)


def _mined(df, **options):
    got = hard_negatives.mine(df, **options).fillna(-1).collect()
    return sorted(tuple(r) for r in got)


def _clustered(df, **options):
    got = centroids.cluster(df, **options).fillna(-1).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
    return sorted(tuple(r) for r in got.collect())


def _random(n, dims, spread, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + spread * rng.normal(size=(7, dims))[rng.integers(0, 7, n)]
    x[n // 2 : n // 2 + n // 5] = x[0]
    labels = rng.integers(0, 10, n)
    return [(k, [float(np.float32(c)) for c in v], int(m)) for k, (v, m) in enumerate(zip(x, labels))]


ODD = [
    (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 2.0], 1), (2, [0.9, 0.6], 1), (3, [1.0, 0.6], 2), (4, [1.0, 0.5], 2),
    (5, None, 1), (6, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1),
    (10, [1.0, 0.5], None), (None, [1.0, 0.5], 1), (None, [1.0, 0.4], 2), (11, [], 1), (12, [2.0], 2),
    (13, [1.0, 0.5], 2), (20, [-1.0, -0.5], 1), (7, [1.0, 0.5], 1), (14, [0.8, 0.5], 9),
]


@pytest.mark.parametrize("n, k, rounds", [(300, 12, 5), (5, 12, 2), (60, 60, 3)])
def test_clusters_equal_a_plain_version(spark, n, k, rounds):
    rows = _random(n, 6, 3.0)
    df = _frame(spark, rows).repartition(5)
    assert _clustered(df, k=k, rounds=rounds, dims=6) == _plain_clusters(rows, k, rounds, 6)


def test_odd_vectors_for_clusters(spark):
    assert _clustered(_frame(spark, ODD), k=3, rounds=2, dims=2) == _plain_clusters(ODD, 3, 2, 2)
    assert centroids.cluster(_frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="too large"):
        centroids.cluster(_frame(spark, [(1, [1e30, 1.0], 1)]), dims=2)


def test_negatives_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL", 50)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 200)
    for dims, spread in ((3, 4.0), (16, 1.0)):
        rows = _random(400, dims, spread, dims)
        assert _mined(_frame(spark, rows).repartition(4), every=10) == _plain_negatives(rows, 10, 5)


def test_odd_vectors_for_negatives(spark):
    assert _mined(_frame(spark, ODD), every=2) == _plain_negatives(ODD, 2, 5)
    assert hard_negatives.mine(_frame(spark, [])).count() == 0
    assert hard_negatives.mine(_frame(spark, [(1, [1.0], 1)])).count() == 0
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(_frame(spark, [(100, [1e30, 1.0], 1)]))


def test_search_prunes_far_boxes():
    """On clustered points most leaves are never read, and the answer stays exact."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 3)) * 2000)[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 3)) * 20
    x = np.floor(x).astype(np.int64)
    order, leaves, low, high = hard_negatives.packed(x)
    assert sorted(order) == list(range(4000)) and leaves.max() <= hard_negatives.LEAF
    tree = hard_negatives.Tree(order.tolist(), np.zeros(4000, int), x[order], leaves, low, high)
    reads = []
    full = tree.q
    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return np.asarray(super().__getitem__(key))
    tree.q = full.view(Counted)
    floor, roof = np.array([[hard_negatives.NEVER + 1, 0]]), np.array([[-hard_negatives.NEVER, 1000]])
    wanted = lambda rows, span: np.ones((len(rows), span.stop - span.start), bool)
    for k in range(50):
        a = x[k]
        found, vectors = tree.search(a[None, :], wanted, floor, roof, 5)
        scores = x @ a
        for w in (0, 1):
            fit = [(-int(s), i) for i, s in enumerate(scores) if w == 0 or 0 <= s <= 1000]
            got = [(-int(s), int(order[v])) for s, v in zip(found[0, w], vectors[0, w]) if v >= 0]
            assert got == sorted(fit)[:5]
    assert sum(reads) < 0.6 * 50 * 4000


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=90),
       st.lists(st.integers(-9, 9), min_size=3, max_size=3))
def test_box_intervals_hold(points, anchor):
    x = np.array(points, np.int64)
    order, leaves, low, high = hard_negatives.packed(x)
    tree = hard_negatives.Tree(order.tolist(), np.zeros(len(x), int), x[order], leaves, low, high)
    least, most = tree.bounds(np.array([anchor]))
    at = 0
    for k, n in enumerate(leaves):
        scores = x[order[at : at + n]] @ np.array(anchor)
        assert least[0, k] <= scores.min() and scores.max() <= most[0, k]
        at += n


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[(1 << 29) + 1, 3]]), np.array([[(1 << 29) + 3], [5]])
    assert product(a, b)[0, 0] == ((1 << 29) + 1) * ((1 << 29) + 3) + 15
