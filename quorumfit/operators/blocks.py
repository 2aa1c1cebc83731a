"""Splitting rows into blocks, and packing blocks into chunks for vectorised work.

A block is a logical group named by ``part_id``; where its rows lie is a separate
matter. Packing turns the rows of a scan task into one chunk per block without a
shuffle, so a block may span any number of chunks and tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quorumfit.schemas import CHUNK

# Fixed values of the reproducible split: an odd multiplier and two moduli that keep
# the product inside 64 bits for every id.
SPLIT_MODULUS = 2147483647
SPLIT_MULTIPLIER = 2654435761
SPLIT_BUCKETS = 1000

# Bytes of rows that a task holds before it packs them, and that it sorts or writes at a time.
GATHER_BYTES = 16 << 20
PIECE_BYTES = 4 << 20


def assign_blocks(df: DataFrame, n_blocks: int, key: str | None = None) -> DataFrame:
    """Add ``part_id`` in 0..n_blocks-1: by the hash of the key, or row by row when there
    is no key. Integer keys are mixed by the multiplier of the split, so that keys in steps
    of n_blocks spread like any others; rows without a key form block 0."""
    if key is None:
        slot = F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks))
    elif isinstance(df.schema[key].dataType, T.IntegralType):
        mixed = F.pmod(F.col(key), F.lit(SPLIT_MODULUS)) * F.lit(SPLIT_MULTIPLIER)
        slot = F.coalesce(F.pmod(F.shiftright(mixed, 20), F.lit(n_blocks)), F.lit(0))
    else:
        slot = F.pmod(F.xxhash64(key), F.lit(n_blocks))
    return df.withColumn("part_id", slot.cast("int"))


def random_split(df: DataFrame, ratio: float = 0.8, seed: int = 42) -> list[DataFrame]:
    return df.randomSplit([ratio, 1.0 - ratio], seed=seed)


def hash_split(df: DataFrame, key: str, ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train/test split that depends on the integer key alone, so it is the same on
    every run, layout and retry. Rows without a key are training rows."""
    bucket = F.pmod(
        F.pmod(F.col(key), F.lit(SPLIT_MODULUS)) * F.lit(SPLIT_MULTIPLIER), F.lit(SPLIT_BUCKETS)
    )
    inside = F.coalesce(bucket < int(round(ratio * SPLIT_BUCKETS)), F.lit(True))
    return df.filter(inside), df.filter(~inside)


def cap_rows(df: DataFrame, cap: int, order: str, salts: int = 1024) -> DataFrame:
    """First ``cap`` rows of every block by ``order`` (a unique column).

    Ranking rounds over ever fewer slices of a block (``salts``, then a 32nd of them, down
    to one): the first leaves no task a whole block, the others rank 32 * ``cap`` rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    while True:
        window = Window.partitionBy("part_id", "_salt").orderBy(order)
        salted = (
            salted.withColumn("_rank", F.row_number().over(window))
            .filter(F.col("_rank") <= cap)
            .drop("_rank")
        )
        if salts == 1:
            return salted.drop("_salt")
        salts = -(-salts // 32)
        salted = salted.withColumn("_salt", F.pmod("_salt", F.lit(salts)).cast("int"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a task joined up to ``PIECE_BYTES``."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PIECE_BYTES:
            table, held, size = pa.Table.from_batches(held), [], 0
            yield from table.combine_chunks().to_batches()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _Piece:
    """Rows of a batch sorted by block, as flat arrays, and where each block's begin."""

    def __init__(self, batch: pa.RecordBatch):
        part = batch.column("part_id").to_numpy(zero_copy_only=False)
        order = np.argsort(part, kind="stable")
        batch = batch.take(pa.array(order))
        part = part[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        self.place = {block: k for k, block in enumerate(part[starts].tolist())}
        self.bounds = np.r_[starts, len(part)]
        self.y = batch.column("y").to_numpy(zero_copy_only=False)
        if not np.all(np.abs(self.y) == 1.0):
            raise ValueError("labels must be -1 or +1")
        self.sparse = "idx" in batch.schema.names
        rows = batch.column("val" if self.sparse else "x")
        values = rows.flatten()
        self.lens = rows.value_lengths().to_numpy(zero_copy_only=False)
        if rows.null_count or values.null_count:
            raise ValueError("features must not be null")
        self.val = values.to_numpy(zero_copy_only=False)
        self.idx = None
        if self.sparse:
            self.idx = batch.column("idx").flatten().to_numpy(zero_copy_only=False)
        self.value_bounds = np.r_[0, np.cumsum(self.lens)][self.bounds]
        self.nbytes = batch.nbytes

    def rows_of(self, k: int) -> slice:
        return slice(self.bounds[k], self.bounds[k + 1])

    def values_of(self, k: int) -> slice:
        return slice(self.value_bounds[k], self.value_bounds[k + 1])


_CHUNK_ARROW = pa.schema(
    [
        ("part_id", pa.int32()),
        ("n", pa.int64()),
        ("n_values", pa.int64()),
        ("dim", pa.int32()),
        ("sparse", pa.bool_()),
        ("y", pa.list_(pa.float64())),
        ("lens", pa.list_(pa.int32())),
        ("idx", pa.list_(pa.int32())),
        ("val", pa.list_(pa.float64())),
    ]
)


def _chunk_batch(blocks: list[tuple[int, list[tuple[_Piece, int]]]]) -> pa.RecordBatch:
    """A chunk row for each (block, its places in the pieces)."""
    sparse = blocks[0][1][0][0].sparse

    def lists(name: str, cut, kind: pa.DataType) -> pa.ListArray:
        parts = [[getattr(p, name)[cut(p, k)] for p, k in found] for _, found in blocks]
        sizes = [sum(map(len, own)) for own in parts]
        flat = np.concatenate([a for own in parts for a in own])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, kind))

    y, val = lists("y", _Piece.rows_of, pa.float64()), lists("val", _Piece.values_of, pa.float64())
    if sparse:
        lens, idx = lists("lens", _Piece.rows_of, pa.int32()), lists("idx", _Piece.values_of, pa.int32())
        dims = [max(int(p.idx[p.values_of(k)].max(initial=-1)) for p, k in found) + 1 for _, found in blocks]
    else:
        nothing = pa.array(np.zeros(len(blocks) + 1), pa.int32())
        lens = idx = pa.ListArray.from_arrays(nothing, pa.array([], pa.int32()))
        dims = [int(found[0][0].lens[0]) for _, found in blocks]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block for block, _ in blocks], pa.int32()),
            y.value_lengths().cast(pa.int64()),
            val.value_lengths().cast(pa.int64()),
            pa.array(dims, pa.int32()),
            pa.array([sparse] * len(blocks)),
            y, lens, idx, val,
        ],
        schema=_CHUNK_ARROW,
    )


def _chunk_rows(pieces: list[_Piece]) -> Iterator[pa.RecordBatch]:
    """One chunk per block of the pieces, some blocks at a time."""
    if not pieces[0].sparse and any(np.any(p.lens != pieces[0].lens[0]) for p in pieces):
        raise ValueError("dense rows must have one width")
    places: dict[int, list[tuple[_Piece, int]]] = {}
    for piece in pieces:
        for block, k in piece.place.items():
            places.setdefault(block, []).append((piece, k))
    ready, size = [], 0
    for block in sorted(places):
        ready.append((block, places[block]))
        size += sum(p.nbytes * len(p.y[p.rows_of(k)]) // len(p.y) for p, k in places[block])
        if size >= PIECE_BYTES:
            yield _chunk_batch(ready)
            ready, size = [], 0
    if ready:
        yield _chunk_batch(ready)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task up to ``GATHER_BYTES`` are held once, in sorted pieces, so that a chunk
    has what a task holds of its block, however many blocks there are."""
    held, size = [], 0
    for batch in _joined(batches):
        held.append(_Piece(batch))
        size += held[-1].nbytes
        if size >= GATHER_BYTES:
            yield from _chunk_rows(held)
            held, size = [], 0
    if held:
        yield from _chunk_rows(held)


def pack_chunks(examples: DataFrame) -> DataFrame:
    """Pack ``(part_id, y, x)`` or ``(part_id, y, idx, val)`` into chunk rows.

    Narrow: no shuffle. A task gathers rows up to ``GATHER_BYTES`` before it packs them, so a
    chunk is no larger than that and, in a task with less, holds all rows of its block.
    """
    y = F.col("y").cast("double").alias("y")
    if "x" in examples.columns:
        features = [F.col("x").cast("array<double>").alias("x")]
    else:
        features = [
            F.col("idx").cast("array<int>").alias("idx"),
            F.col("val").cast("array<double>").alias("val"),
        ]
    return examples.select("part_id", y, *features).mapInArrow(_pack, CHUNK)


def block_sizes(chunks: DataFrame) -> DataFrame:
    """One row per non-empty block: rows, stored feature values, and the smallest dense
    and largest dimension over its chunks. Reads the chunk descriptions only."""
    return chunks.groupBy("part_id").agg(
        F.sum("n").alias("n"),
        F.sum("n_values").alias("n_values"),
        F.max("dim").alias("high"),
        F.min(F.when(~F.col("sparse"), F.col("dim"))).alias("dense_low"),
        F.max("sparse").alias("sparse"),
    )


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """One row over all blocks: counts, the largest block and the dimension bounds."""
    return block_sizes(chunks).agg(
        F.count("*").alias("n_blocks"),
        F.min("part_id").alias("first_id"),
        F.max("part_id").alias("last_id"),
        F.sum("n").alias("rows"),
        F.max("n").alias("max_rows"),
        F.max("n_values").alias("max_values"),
        F.max("high").alias("high"),
        F.min("dense_low").alias("dense_low"),
        F.max("sparse").alias("sparse"),
    )


SPREAD_LIMIT = 1024


def spread_slots(df: DataFrame, n_ids: int) -> DataFrame:
    """Add ``slot``, a renaming of ``part_id`` in 0..n_ids-1 whose hash puts every block
    of a small block count into a partition of its own; hashing small ids directly
    leaves some partitions with several blocks and others with none."""
    if n_ids > SPREAD_LIMIT:
        return df.withColumn("slot", F.col("part_id"))
    homes = (
        df.sparkSession.range(n_ids * 64)
        .select(F.col("id").cast("int").alias("slot"))
        .groupBy(F.pmod(F.hash("slot"), F.lit(n_ids)).alias("home"))
        .agg(F.min("slot").alias("slot"))
        .collect()
    )
    by_home = {row["home"]: row["slot"] for row in homes}
    if len(by_home) < n_ids:
        return df.withColumn("slot", F.col("part_id"))
    names = F.array(*[F.lit(by_home[i]) for i in range(n_ids)])
    return df.withColumn("slot", F.get(names, F.col("part_id")))


def co_locate(chunks: DataFrame, n_ids: int, n_blocks: int | None = None) -> DataFrame:
    """Bring all chunks of a block into one partition, ordered by block, once. Only for
    blocks whose size was checked; cached, this partitioning and order are reused by
    every later co-group on ``slot``. Many blocks share a bounded number of partitions
    and are still solved one at a time."""
    tasks = n_ids
    if n_ids > SPREAD_LIMIT:
        cores = chunks.sparkSession.sparkContext.defaultParallelism
        tasks = min(n_blocks or n_ids, max(SPREAD_LIMIT, 4 * cores))
    placed = spread_slots(chunks, n_ids)
    return placed.repartition(tasks, "slot").sortWithinPartitions("slot")


def salt_count(n, rows: int, tasks: int):
    """Number of slices of a block with ``n`` of all ``rows``: its share of the tasks."""
    return F.greatest(F.ceil(n * F.lit(tasks) / F.lit(rows)), F.lit(1)).cast("int")


def salt_chunks(chunks: DataFrame, sizes: DataFrame, n_blocks: int, rows: int, tasks: int) -> DataFrame:
    """Spread every block's chunks over as many partitions as its share of the rows
    warrants, so a block with a third of the data gets a third of the tasks. The slice
    follows the scan task of a chunk, which a retry repeats."""
    counts = sizes.select("part_id", salt_count(F.col("n"), rows, tasks).alias("salts"))
    if n_blocks <= 1_000_000:  # at most 8 MB
        counts = F.broadcast(counts)
    salted = chunks.withColumn("task", F.spark_partition_id()).join(counts, "part_id")
    return (
        salted.withColumn("salt", F.pmod("task", "salts"))
        .drop("task", "salts")
        .repartition(tasks, "part_id", "salt")
    )


@dataclass
class NestedBlocks:
    """The blocks of several block counts, from one packing and one exchange.

    Rows are packed by fine blocks, as many as the least common multiple of the counts, so a
    block of any count is a union of fine ones: hash mod 120 taken mod 8 is hash mod 8. The
    packed chunks are exchanged once, a copy for each count, into partitions by (count,
    block), and kept. The fits of a sweep then differ in the partitions they read.
    """

    chunks: DataFrame
    located: DataFrame
    counts: tuple[int, ...]

    @classmethod
    def prepare(
        cls, df: DataFrame, counts: Iterable[int], key: str | None = None,
        storage: StorageLevel = StorageLevel.MEMORY_AND_DISK,
    ) -> NestedBlocks:
        key = key or ("id" if "id" in df.columns else None)
        if key is None:
            raise ValueError("nested blocks need a key that names the rows")
        counts = tuple(dict.fromkeys(counts))
        if not cls.suits(counts):
            raise ValueError(f"more than {SPREAD_LIMIT} blocks; sweep the counts one by one")
        chunks = pack_chunks(assign_blocks(df, lcm(*counts), key)).persist(storage)
        copies = F.array(*[
            F.struct(F.lit(n).alias("count"), F.pmod("part_id", F.lit(n)).alias("block"), F.lit(first).alias("first"))
            for n, first in zip(counts, cls._firsts(counts))
        ])
        placed = chunks.withColumn("copy", F.explode(copies)).select(
            "copy.count", F.col("copy.block").alias("part_id"),
            (F.col("copy.first") + F.col("copy.block")).alias("place"),
            *[c for c in chunks.columns if c != "part_id"],
        )
        slots = spread_slots(placed.withColumnsRenamed({"part_id": "block", "place": "part_id"}), sum(counts))
        located = (
            slots.withColumnsRenamed({"part_id": "place", "block": "part_id"}).drop("place")
            .repartition(sum(counts), "slot").sortWithinPartitions("slot").persist(storage)
        )
        return cls(chunks, located, counts)

    @staticmethod
    def suits(counts: Iterable[int]) -> bool:
        """Whether fine blocks, and copies of the data, are few enough to be worth it."""
        counts = set(counts)
        return lcm(*counts) <= SPREAD_LIMIT and sum(counts) <= SPREAD_LIMIT and len(counts) <= 8

    @staticmethod
    def _firsts(counts: tuple[int, ...]) -> list[int]:
        return [sum(counts[:k]) for k in range(len(counts))]

    def chunks_of(self, count: int) -> DataFrame:
        """Chunks by the blocks of a count, where they were read."""
        return self.chunks.withColumn("part_id", F.pmod("part_id", F.lit(count)))

    def located_of(self, count: int) -> DataFrame:
        """Chunks in the partitions of the blocks of a count; nothing moves."""
        return self.located.where(F.col("count") == count).drop("count")

    def slots_of(self, sizes: DataFrame, count: int) -> DataFrame:
        """``sizes`` (part_id, ...) of a count with the slots of its blocks."""
        first = self._firsts(self.counts)[self.counts.index(count)]
        moved = sizes.withColumn("part_id", F.col("part_id") + first)
        return spread_slots(moved, sum(self.counts)).withColumn("part_id", F.col("part_id") - first)

    def release(self) -> None:
        self.located.unpersist()
        self.chunks.unpersist()
