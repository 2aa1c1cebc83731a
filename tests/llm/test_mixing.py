"""Mixing: targets against a plain water-fill, sums, limits and reruns."""

import numpy as np
import pytest

from quorumfit.llm import mixing


def _targets(sizes, share=1.5, limit=2.0, weights=(3.0, 1.0, 2.0)):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode())
    names += [None] if None in sizes else []
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    pool, full = share * sum(sizes.values()), set()
    while True:
        open_names = [n for n in names if n not in full]
        left = pool - sum(limit * sizes[n] for n in full)
        total = sum(weight[n] for n in open_names)
        level = left / total if total else 0
        more = {n for n in open_names if weight[n] * level >= limit * sizes[n]}
        if not more:
            return {n: limit * sizes[n] if n in full else weight[n] * level for n in names}
        full |= more


@pytest.fixture(scope="module")
def mix(spark, docs):
    return mixing.mix(docs).toPandas()


def test_targets_sums_and_limits(mix, plain):
    assert sorted(mix.doc_id) == sorted(plain.doc_id)
    sizes = mix.groupby("source")["size"].sum().to_dict()
    want = _targets(sizes)
    for source, rows in mix.groupby("source"):
        assert rows.target.iloc[0] == pytest.approx(want[source])
        assert rows.source_size.iloc[0] == sizes[source]
        assert abs(rows.taken.sum() - want[source]) <= rows["size"].max()
    assert (mix.taken <= 2 * mix["size"]).all() and (mix.taken % mix["size"].clip(1) == 0).all()


def test_reruns_agree_however_rows_are_spread(docs, mix, monkeypatch):
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, again[key].values)) == sorted(map(tuple, mix[key].values))


def test_a_tree_of_rounds_keeps_the_sums(docs, mix, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 2)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    deep = mixing.mix(docs).toPandas()
    assert sorted(deep.doc_id) == sorted(mix.doc_id)
    for _, rows in deep.groupby("source"):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= rows["size"].max()


def test_pivot_keeps_sums_and_means():
    sizes, p = np.arange(1.0, 41.0), np.full(40, 0.3)
    ends = []
    for seed in range(2000):
        out, left = mixing.pivot(np.arange(40), sizes, p, seed)
        assert (sizes * out).sum() == pytest.approx((sizes * p).sum())
        assert all(v in (0.0, 1.0) for k, v in enumerate(out) if k != left)
        ends.append(out)
    assert abs(np.mean(ends, axis=0) - 0.3).max() < 0.05


def test_odd_rows(odd, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == odd.count() and got.source.isna().any()
    assert (got[got["size"] == 0].taken == 0).all()
    assert mixing.mix(none).count() == 0
    assert mixing.take_mix(odd).columns == odd.columns
