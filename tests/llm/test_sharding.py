"""Sharding: differencing against a plain version, balance, whole groups, slots, reruns."""

import zlib

import numpy as np
import pandas as pd
import pytest

from quorumfit.llm import sharding


def _plain(sizes, ways):
    """Differencing on lists of sets, by sorting everything in every step."""
    parts = [(k, [(s, {k})] + [(0, set())] * (ways - 1)) for k, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (_, a), (_, b) = parts.pop(0), parts.pop(0)
        both = sorted(((x + y, m | n) for (x, m), (y, n) in zip(a, reversed(b))), key=lambda c: -c[0])
        parts.append((made, both))
        made += 1
    return sorted(s for s, _ in parts[0][1])


@pytest.mark.parametrize("ways", [2, 3, 7])
def test_differencing_equals_a_plain_version(ways):
    rng = np.random.default_rng(5)
    for n in (1, 2, ways, 30):
        sizes = rng.choice(10_000, n, replace=False) + 1
        classes = np.concatenate(sharding.differenced(list(sizes.reshape(-1, 1)), ways))
        sums = np.bincount(classes, weights=sizes, minlength=ways)
        assert sorted(sums) == _plain(sizes.tolist(), ways)


def test_known_example():
    classes = np.concatenate(sharding.differenced(list(np.array([[8], [7], [6], [5], [4]])), 2))
    assert sorted(np.bincount(classes, weights=[8, 7, 6, 5, 4])) == [14, 16]


def _check(got: pd.DataFrame, plain: pd.DataFrame, shards: int):
    text = plain.text.fillna("")
    size = text.map(lambda t: len(t.encode())) + 16
    crc = text.map(lambda t: zlib.crc32(t.encode()))
    want = sorted(zip(plain.doc_id.fillna(-1).astype(int), size, crc))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32)) == want
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert got.shard.between(0, shards - 1).all() and set(got.law) == {"bytes"}
    assert got.grown_shard.isna().all()


@pytest.fixture(scope="module")
def got(docs):
    return sharding.assign_shards(docs).toPandas()


def test_whole_table(got, plain):
    _check(got, plain, 40)
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 40
    for shard in sums[sums > 1.05 * sums.min()].index:
        assert got[got.shard == shard].text_crc32.nunique() == 1


def test_reruns_agree_however_rows_are_spread(docs, got):
    again = sharding.assign_shards(docs.repartition(7)).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, again[key].values)) == sorted(map(tuple, got[key].values))


def test_a_tree_of_small_blocks_is_level(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAD", 2)
    monkeypatch.setattr(sharding, "BUNDLES", 32)
    monkeypatch.setattr(sharding, "BLOCK", 40)
    monkeypatch.setattr(sharding, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    rows = [(k, "z" * int(n)) if k % 9 else (k, "hot " * 60) for k, n in enumerate(rng.integers(1, 900, 3000))]
    rows = [(k, f"{k} {t}" if k % 9 else t) for k, t in rows]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    _check(got, pd.DataFrame(rows, columns=["doc_id", "text"]), 4)
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() < 0.01 * sums.mean()


def test_a_group_above_the_mean_has_a_shard_to_itself(spark):
    rows = [(k, "copy " * 50) for k in range(400)] + [(1000 + k, f"text {k} " * 9) for k in range(600)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    hot = got[got.doc_id < 1000].shard.unique()
    assert len(hot) == 1 and (got[got.shard == hot[0]].doc_id < 1000).all()
    rest = got[got.shard != hot[0]].groupby("shard")["size"].sum()
    assert len(rest) == 7 and rest.max() - rest.min() < 0.02 * rest.mean()


def test_odd_rows(spark, odd, none):
    frame = odd.withColumnsRenamed({"lang": "shard", "source": "gid", "key": "n"})
    _check(sharding.assign_shards(frame).toPandas(), odd.toPandas(), 40)
    assert sharding.assign_shards(none).count() == 0
    empty = spark.createDataFrame([(None, None)] * 2500, "doc_id long, text string")
    got = sharding.assign_shards(empty).toPandas()
    assert sorted(got.slot) == list(range(2500)) and got.shard.nunique() == 1
