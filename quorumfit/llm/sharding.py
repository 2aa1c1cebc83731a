"""Shards of near-equal bytes by Karmarkar-Karp differencing of groups of equal texts."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumfit.llm.tables import dropped, written

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: A group larger than 1/HEAD of a mean shard is placed by itself, so there are at most
#: HEAD times as many of them as shards.
HEAD = 64
#: The other groups become bundles of TIERS sizes, each half of the one before; a tier has
#: BUNDLES bundles, made in blocks of about BLOCK groups that meet FAN_IN at a time.
TIERS, BUNDLES, BLOCK, FAN_IN = 8, 640, 4_000, 64
#: Rows numbered by one window, and copies of one row made by one array.
PART, CHUNK = 5_000, 1_000
#: Groups of more rows than this share of all are looked up in a broadcast table of at most
#: so many rows.
HOT_GROUPS = 1_000


def differenced(items: list[np.ndarray], ways: int) -> list[np.ndarray]:
    """Class 0 to ways-1 of every part of every item, by multi-way differencing.

    An item is a partial partition: the sizes of at most ``ways`` parts. The two items of
    the largest spread are combined again and again, the largest part of the one with the
    smallest of the other, until one item is left; parts that met share a class. Ties go
    to the item given, or made, first.
    """
    first = np.cumsum([0, *map(len, items)])
    met = np.arange(first[-1])
    spread = lambda sums: int(sums[0]) - (int(sums[-1]) if len(sums) == ways else 0)
    held, heap = {}, []
    for k, sums in enumerate(items):
        order = np.argsort(-sums, kind="stable")
        held[k] = sums[order], first[k] + order
        heap.append((-spread(held[k][0]), k))
    heapq.heapify(heap)
    made = len(items)
    while len(heap) > 1:
        (a, a_at), (b, b_at) = (held.pop(heapq.heappop(heap)[1]) for _ in range(2))
        over = max(0, len(a) + len(b) - ways)
        alone_a, alone_b = len(a) - over, len(b) - over
        met[b_at[alone_b:][::-1]] = a_at[alone_a:]
        sums = np.concatenate([a[:alone_a], a[alone_a:] + b[alone_b:][::-1], b[:alone_b]])
        order = np.argsort(-sums, kind="stable")
        held[made] = sums[order], np.concatenate([a_at, b_at[:alone_b]])[order]
        heapq.heappush(heap, (-spread(held[made][0]), made))
        made += 1
    while not np.array_equal(met[met], met):
        met = met[met]
    classes = np.full(len(met), -1)
    for _, last in held.values():
        classes[last] = np.arange(len(last))
    return np.split(classes[met], first[1:-1])


def _bundle(frame: pd.DataFrame) -> pd.DataFrame:
    """Groups of a block into bundles."""
    frame = frame.sort_values(["bytes", "gid"], ascending=[False, True], ignore_index=True)
    singles = list(frame["bytes"].to_numpy(np.int64).reshape(-1, 1))
    frame["class"] = np.concatenate(differenced(singles, BUNDLES))
    return frame[["tier", "block", "gid", "bytes", "class"]]


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """Bundles of several blocks into the bundles of one; ``up`` is the class there."""
    frame = frame.sort_values(["block", "class"], ignore_index=True)
    items = [rows["bytes"].to_numpy(np.int64) for _, rows in frame.groupby("block")]
    frame["up"] = np.concatenate(differenced(items, BUNDLES))
    return frame[["tier", "block", "class", "bytes", "up"]]


def _deal(shards: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(
            ["bytes", "tier", "class", "gid"], ascending=[False, True, True, True], ignore_index=True
        )
        singles = list(frame["bytes"].to_numpy(np.int64).reshape(-1, 1))
        frame["shard"] = np.concatenate(differenced(singles, shards))
        return frame[["tier", "class", "gid", "shard"]]
    return run


def group_shards(groups: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(gid, shard) of every group (gid, bytes): a tree of differencing steps.

    The few groups that are large against a shard stay whole; the many small ones are dealt
    by hash into tiers and blocks, each block becomes bundles by differencing, and blocks
    meet FAN_IN at a time until a tier is one set of bundles. Large groups and bundles, at
    most ``HEAD * shards + TIERS * BUNDLES`` sizes, are differenced into shards. Tiers halve
    in size, so the last bundles are fine enough to level what the large ones leave.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    h = F.xxhash64("gid", F.lit(seed))
    tier = F.lit(TIERS - 1)
    for t in reversed(range(TIERS - 1)):
        tier = F.when(h.bitwiseAND(1 << t) != 0, t).otherwise(tier)
    is_head = F.col("bytes") * F.lit(float(HEAD * shards)) > F.lit(float(total))
    tail = groups.where(~is_head).withColumn("tier", tier)
    blocks = {
        row["tier"]: -(-row["count"] // BLOCK) for row in tail.groupBy("tier").count().collect()
    }
    of_tier = F.element_at(F.array(*[F.lit(blocks.get(t, 1)) for t in range(TIERS)]), F.col("tier") + 1)
    dealt = tail.withColumn("block", F.pmod(F.shiftright(h, TIERS), of_tier).cast("long"))
    bundled = written(
        dealt.groupBy("tier", "block").applyInPandas(
            _bundle, "tier int, block long, gid binary, bytes long, class int"
        ),
        "bundles",
    )
    made, levels = [bundled], []
    nodes = bundled.groupBy("tier", "block", "class").agg(F.sum("bytes").alias("bytes"))
    left = max(blocks.values(), default=1)
    while left > 1:
        step = written(
            nodes.groupBy("tier", F.floor(F.col("block") / FAN_IN)).applyInPandas(
                _meet, "tier int, block long, class int, bytes long, up int"
            ),
            "meets",
        )
        levels.append(step)
        nodes = step.groupBy(
            "tier", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("up").alias("class")
        ).agg(F.sum("bytes").alias("bytes"))
        left = -(-left // FAN_IN)
    none = F.lit(None).cast("binary")
    heads = groups.where(is_head).select(
        F.lit(-1).alias("tier"), F.lit(-1).alias("class"), "gid", "bytes"
    )
    tops = nodes.select("tier", "class", none.alias("gid"), "bytes")
    root = written(
        heads.unionByName(tops).withColumn("root", F.lit(0)).groupBy("root").applyInPandas(
            _deal(shards), "tier int, class int, gid binary, shard int"
        ),
        "root",
    )
    where = root.where("tier >= 0").select("tier", F.lit(0).cast("long").alias("block"), "class", "shard")
    for step in reversed(levels):
        above = where.select(
            F.col("tier"), F.col("block").alias("_parent"), F.col("class").alias("up"), "shard"
        )
        where = (
            step.withColumn("_parent", F.floor(F.col("block") / FAN_IN))
            .join(above, ["tier", "_parent", "up"]).select("tier", "block", "class", "shard")
        )
    placed = bundled.join(where, ["tier", "block", "class"]).select("gid", "shard")
    out = written(root.where("tier < 0").select("gid", "shard").unionByName(placed), "placed")
    dropped(*made, *levels, root)
    return out


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot,
    grown_shard, group_rows.

    Law ``bytes``: the bytes of the shards are as equal as whole groups allow. A group is
    the rows of one text (SHA-256 of its UTF-8 bytes) and never parts; a group above the
    mean shard has a shard to itself. Size is the bytes of the text plus 16. ``slot``
    numbers the rows of a shard without gaps; ``grown_shard`` is null, as this law keeps no
    row in place when shards are added.

    Null text counts as empty and shares its group. Rows of one doc_id and text that repeat
    are rows of their own with following slots, also without doc_id. Very long texts are
    read where they are and only their size, checksum and hash move. Ties of size go by
    hash, so reruns agree. Other columns of ``docs`` are ignored, whatever their names. An
    empty table gives an empty table, and fewer groups than shards leave shards empty.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("gid"),
    )
    members = written(
        rows.groupBy("gid", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "members"
    )
    groups = written(
        members.groupBy("gid").agg(
            F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("group_rows")
        ),
        "groups",
    )
    homes = group_shards(groups, shards, seed).join(groups.drop("bytes"), "gid")
    homes = written(homes, "homes")
    total = groups.agg(F.sum("group_rows")).first()[0] or 0
    is_hot = F.col("group_rows") * F.lit(HOT_GROUPS) > F.lit(total)
    hot = F.broadcast(homes.where(is_hot))
    housed = written(
        members.join(hot, "gid").unionByName(
            members.join(hot.select("gid"), "gid", "left_anti").join(homes.where(~is_hot), "gid")
        ),
        "housed",
    )
    counts = {r["shard"]: r["n"] for r in housed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    parts = F.array(*[F.lit(-(-counts.get(s, 1) // PART)) for s in range(shards)])
    housed = housed.withColumn(
        "part", F.pmod(F.xxhash64("gid", "doc_id"), F.element_at(parts, F.col("shard") + 1))
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = housed.groupBy("shard", "part").agg(F.sum("n").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "gid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    numbered = (
        housed.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(offsets, ["shard", "part"])
        .withColumn("start", F.col("start") + F.col("offset"))
    )
    chunk = numbered.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))
    )
    last = F.least(F.col("n"), F.col("chunk") + CHUNK) - 1
    out = chunk.withColumn("k", F.explode(F.sequence(F.col("chunk"), last)))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "group_rows",
    )
