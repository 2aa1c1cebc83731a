"""Exact and near deduplication against plain comparisons."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from quorumfit.llm import components, exact_dedup, near_dup


def _exact(rows):
    best, size = {}, {}
    for i, t in rows:
        n = brute.lower(t)
        best[n] = max(best.get(n, -1), -1 if i is None else i)
        size[n] = size.get(n, 0) + 1
    found = [(i, None if best[n] < 0 else best[n], size[n]) for i, t in rows for n in [brute.lower(t)]]
    return sorted(found, key=str)


def _shown(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in df.collect()), key=str)


def test_exact_groups_of_odd_rows(odd):
    got = exact_dedup.exact_groups(odd)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _shown(got) == _exact(rows)
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert {5, 6, 7, 11} <= kept and not {4, 10} & kept
    stays = exact_dedup.drop_exact_copies(odd)
    assert stays.columns == odd.columns


def test_clashing_identifiers_are_told_apart(docs):
    def few(chunk):
        return F.pmod(F.xxhash64(chunk), F.lit(3))

    assert _shown(exact_dedup.exact_groups(docs, few)) == _shown(exact_dedup.exact_groups(docs))


def test_chunks_make_up_the_text(docs):
    norm = exact_dedup.normal_text(F.col("text"))
    chunks = F.regexp_extract_all(norm, F.lit(exact_dedup.CHUNK), F.lit(0))
    assert docs.where(F.array_join(chunks, "") != norm).count() == 0


def test_no_python_in_exact_plan(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(320)]
    edges += [(500 + k, 501 + k) for k in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in list(root)}


def _near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_duplicates_of_the_table(docs, plain):
    assert _near(near_dup.near_duplicates(docs)) == brute.near_classes(
        list(zip(plain.doc_id, plain.text))
    )


def test_chains_of_edits_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 500)
    rng, rows = random.Random(5), []
    for base in range(3):
        words = [f"w{base}_{k}" for k in range(120)]
        for copy in range(40):
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            if copy % 10 == 0:
                words = [f"w{base}_{k}" for k in range(120)]
            rows.append((1000 - len(rows), " ".join(words)))
    got = _near(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute.near_classes(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dup.near_duplicates(odd).collect()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == odd.count()
    assert [by_id[k].n_shingles for k in (1, 2, 3, 8, 10)] == [0, 0, 0, 1, 1]
    assert all(by_id[k].component_id == k for k in (1, 2, 3, 6, 7, 8, 9, 12))
    assert by_id[5].component_id == 4 and by_id[11].component_id == 10
    assert {r.component_id for r in got if r.doc_id is None} == {4, None}
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.drop_near_duplicates(odd).columns == odd.columns


def test_signature_agreement_is_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    other = np.concatenate([base[:850], rng.integers(0, 2**63, 150).astype(np.uint64)])
    same = near_dup.signature(base, 2000) == near_dup.signature(other, 2000)
    assert abs(same.mean() - 850 / 1150) < 0.05
