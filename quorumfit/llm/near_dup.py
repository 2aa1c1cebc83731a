"""Near-duplicate classes by circulant MinHash, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.llm.components import connected_components
from quorumfit.llm.tables import attach_groups, packed, repeated, salted, unpacked, written
from quorumfit.llm.words import slices, word_hashes, words_of

SHINGLE = 5
BANDS = 26
ROWS = 5
#: Shingles of one block of documents in the verification.
BLOCK = 400_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _permute(x: np.ndarray, factor: int, shift: int) -> np.ndarray:
    """A permutation of the 64-bit numbers: every step can be undone."""
    x = x ^ (x >> np.uint64(shift))
    x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of one set: coordinate k is the least value of the second
    permutation, shifted by k places of the circle of 64-bit numbers, over the set as the
    first permutation places it."""
    placed = _permute(shingles.copy(), 0xD6E8FEB86659FD93, 32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint64) * _STEP
    best = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, placed.size, 512):
        block = _permute(placed[at : at + 512, None] + shifts, 0xBF58476D1CE4E5B9, 29)
        np.minimum(best, block.min(0), out=best)
    return best


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct 64-bit hashes of the five-word shingles of each text, sorted."""
    words = words_of(texts)
    hashed = word_hashes(words.distinct)[words.codes]
    for start, end in zip(words.starts[:-1], words.starts[1:]):
        n = int(end - start)
        if n == 0:
            yield np.empty(0, np.uint64)
            continue
        width = min(SHINGLE, n)
        total = np.full(n - width + 1, n if n < SHINGLE else SHINGLE, np.uint64)
        for k in range(width):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[start + k : end - width + 1 + k]
        yield np.unique(_permute(total, 0x94D049BB133111EB, 31))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sizes, keys, bands = [], [], []
            for shingles in shingle_sets(part.column("text")):
                sizes.append(shingles.size)
                if not shingles.size:
                    keys.append(None)
                    bands.append(None)
                    continue
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                mixed = signature(shingles, BANDS * ROWS).reshape(BANDS, ROWS)
                band = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    band = _permute(band * _STEP + mixed[:, k], 0xBF58476D1CE4E5B9, 30)
                bands.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "key", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"))]
            kept = [part.column(c) for c in ("doc_id", "component", "block", "blocks")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sets, pa.list_(pa.int64()))],
                ["doc_id", "component", "block", "blocks", "shingles"],
            )


def _verify(percent: int):
    """Links between the documents of one or two blocks, thinned to a spanning forest."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, side, sets = (frame[c].to_numpy() for c in ("doc_id", "side", "shingles"))
        across = side.min() != side.max()
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(ids.size), sizes)
        code, distinct = pd.factorize(np.concatenate(sets))
        common = np.bincount(code, minlength=distinct.size)[code] > 1
        owner, code = owner[common], code[common]
        begin_doc = np.searchsorted(owner, np.arange(ids.size + 1))
        order = np.argsort(code, kind="stable")
        holders = owner[order]
        begin_code = np.searchsorted(code[order], np.arange(distinct.size + 1))
        root = list(range(ids.size))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        edges = []
        for i in range(ids.size):
            mine = code[begin_doc[i] : begin_doc[i + 1]]
            if not mine.size:
                continue
            runs = [holders[begin_code[c] : begin_code[c + 1]] for c in mine]
            shared = np.bincount(np.concatenate(runs), minlength=ids.size)[i + 1 :]
            near = 100 * shared >= percent * (sizes[i + 1 :] + sizes[i] - shared)
            if across:  # pairs of one block meet in that block's own task
                near &= side[i + 1 :] != side[i]
            for j in np.flatnonzero(near & (shared > 0)) + i + 1:
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((ids[i], ids[j]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Class of every row: doc_id, n_shingles, component_id, kept.

    Texts with 100 * intersection >= percent * union of their five-word shingles are
    linked; component_id is the smallest doc_id that links reach. One scan makes, for each
    row, the size and a 128-bit key of its set and 26 bands of 5 circulant MinHash values
    (a link of 0.85 shares no band in 3 of 10 million cases). Rows of equal sets meet by
    key and go on as their smallest doc_id. Bands chain these into candidate clusters;
    inside a cluster every two documents are compared on their full sets, whether they
    share a band or not. Clusters are cut into blocks of about ``BLOCK`` shingles and a
    task compares two blocks, so memory is bounded; it returns a spanning forest of the
    links, never the pairs.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than five words
    is one shingle; without words (or null) the set is empty and the row its own class.
    Rows that repeat a doc_id share its verdict; rows without doc_id take the class of
    equal sets that have one and stay only if there is none. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = written(
        rows.mapInArrow(
            _describe, "doc_id long, n_shingles long, key binary, bands array<long>"
        ),
        "sketches",
    )
    sets = facts.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("members")
    )
    groups = written(sets.where("rep IS NOT NULL"), "sets")
    banded = (
        facts.where("key IS NOT NULL").join(
            groups.select(F.col("rep").alias("doc_id"), F.col("key")), ["doc_id", "key"], "left_semi")
        .select("doc_id", F.explode("bands").alias("band"))
    )
    banded = written(banded.distinct(), "bands")
    leaders = banded.groupBy("band").agg(
        F.min("doc_id").alias("leader"), F.count("*").alias("size")
    ).where("size > 1").drop("size")
    near = (
        salted(banded, F.col("doc_id")).join(repeated(leaders), ["band", "_salt"])
        .select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    )
    clusters = written(connected_components(near), "clusters")
    links = _links(rows, facts, clusters, percent)
    classes = written(connected_components(links), "classes")
    several = (
        groups.join(classes.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
        .where("members > 1 OR component <> rep").select("key", "component")
    )
    joined = attach_groups(
        facts.drop("bands"), several, ["key"], F.coalesce(F.col("doc_id"), F.lit(0))
    )
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _links(rows: DataFrame, facts: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) inside candidate clusters, a forest for every two blocks."""
    sizes = facts.select("doc_id", "n_shingles").groupBy("doc_id").agg(
        F.max("n_shingles").alias("n")
    )
    members = clusters.join(sizes, clusters["id"] == sizes["doc_id"]).select(
        "doc_id", "component", "n"
    )
    weights = members.groupBy("component").agg(
        F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")
    )
    dealt = members.join(weights, "component").withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    )
    wanted = written(dealt.select("doc_id", "component", "block", "blocks"), "members")
    shape = "doc_id long, component long, block int, blocks int, shingles array<long>"
    sets = rows.join(wanted, "doc_id").mapInArrow(_sets, shape)
    paired = sets.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        "component",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "doc_id", F.col("block").alias("side"), "shingles",
    )
    return paired.groupBy("component", "low", "high").applyInPandas(
        _verify(percent), "a long, b long"
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each class, with all its columns.

    The smallest doc_id of a class stays. Rows are judged one by one: rows that share their
    doc_id with others, and rows without one, are judged under numbers above every doc_id,
    so each stays if its text is near no other, and goes if it is near one with a doc_id of
    its own. Texts without words are near nothing and stay. Columns may have any names.
    """
    rows = packed(docs).withColumn("id", F.col("row")["doc_id"].cast("long"))
    facts = rows.agg(
        F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.max("id").alias("last")
    ).first()
    if facts["rows"] > facts["ids"]:
        many = rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
        spread = F.xxhash64(F.col("row")["text"])
        marked = attach_groups(rows, many, ["id"], spread)
        spare = F.monotonically_increasing_id() + F.lit((facts["last"] or 0) + 1)
        odd = F.col("id").isNull() | F.col("count").isNotNull()
        # Spare numbers hold only for one reading of the rows, so they are written.
        rows = written(marked.select("row", F.when(odd, spare).otherwise(F.col("id")).alias("id")), "numbered")
    texts = rows.select(F.col("id").alias("doc_id"), F.col("row")["text"].alias("text"))
    kept = near_duplicates(texts, percent).where("kept").select(F.col("doc_id").alias("kept_id"))
    return unpacked(rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi"), docs)
