"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumfit.llm.tables import attach_groups, packed, unpacked, written

BLOCK = 2_000
FAN_IN = 64
#: Rows of one key made by one array.
REPEATS = 1_000
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5,
                   limit: float = 2.0) -> DataFrame:
    """source, source_size, target of every source, from rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share``
    times all words; a target stops at ``limit`` times its source and the excess is shared
    again by weight, until none is above. Each round is one aggregation over the sources.
    """
    totals = written(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"
    )
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(
        totals.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked"
    )
    before = ranged.groupBy("_part").count().withColumn(
        "_before",
        F.coalesce(F.sum("count").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    turn = F.pmod(rank, F.lit(len(weights))).cast("int")
    weighed = written(
        ranged.join(before.select("_part", "_before"), "_part")
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
        .select("source", "source_size", "weight"),
        "weights",
    )
    pool = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    most = F.col("source_size") * limit
    while True:
        capped = F.col("weight") * level >= most if full >= 0 else F.lit(False)
        row = weighed.agg(
            F.sum(F.when(capped, most).otherwise(0.0)).alias("used"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(capped).alias("full"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full, level = row["full"], (pool - row["used"]) / row["weight"]
    return weighed.select(
        "source", "source_size", F.least(F.col("weight") * level, most).alias("target")
    )


def _draw(seed: int, a: int, b: int) -> float:
    return xxhash.xxh64_intdigest(f"{seed}:{a}:{b}") / 2.0**64


def pivot(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round probabilities in pairs; returns them and the place of the one left open, or -1.

    Each step moves words between two open documents until one is taken or left out. Every
    probability keeps its mean and the sum of size times probability does not change.
    """
    p, open_at = p.copy(), -1
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        up = min(sizes[a] * (1 - p[a]), sizes[b] * p[b])
        down = min(sizes[a] * p[a], sizes[b] * (1 - p[b]))
        move = up if _draw(seed, ids[a], ids[b]) * (up + down) < down else -down
        p[a], p[b] = _settled(p[a] + move / sizes[a]), _settled(p[b] - move / sizes[b])
        still = [k for k in (a, b) if 0.0 < p[k] < 1.0]
        open_at = still[0] if still else -1
    return p, open_at


def _settled(value: float) -> float:
    return 0.0 if value < 1e-9 else 1.0 if value > 1 - 1e-9 else value


_SHAPE = "row long, row_2 long, source string, size long, base long, p double, block long, open boolean"


def _round_block(seed: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "row", "row_2"], ascending=[False, True, True], ignore_index=True)
        p, open_at = pivot(
            frame["row"].to_numpy(), frame["size"].to_numpy(float), frame["p"].to_numpy(), seed
        )
        frame["p"], frame["open"] = p, False
        if open_at >= 0:
            frame.loc[open_at, "open"] = True
        return frame
    return run


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, limit: float = 2.0,
        seed: int = 7) -> DataFrame:
    """Copies of every row in the mix: doc_id, source, size, source_size, target, copies, taken.

    A source's documents are due target/source_size copies each. The whole part is given;
    the fractions are rounded by pivotal sampling: documents of a source are dealt by hash
    into blocks of about 2,000, fractions in a block move between pairs of documents until
    all but one are whole, and the open ones meet 64 blocks at a time in a tree of rounds,
    each a table in the shared folder. The last one of a source is drawn. The words of a
    source keep their sum in every move, so they miss the target by one document at most.

    Draws are hashes of ids, so reruns agree however rows are spread. Null text has size 0
    and is not taken; null sources form one source, the last. Rows of one doc_id that
    repeat are told apart by source, text and number (``text_hash`` and ``again`` of the
    result). Very long texts are counted where they are. Other columns are ignored,
    whatever their names. An empty table gives an empty table.
    """
    each = docs.select(
        docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _text_hash(docs["text"]).alias("text_hash"),
    )
    key = ["doc_id", "source", "size", "text_hash"]
    counted = each.groupBy(*key).agg(F.count("*").alias("n"))
    chunk = F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(REPEATS).cast("long"))
    part = counted.select(*key, "n", F.explode(chunk).alias("first"))
    last = F.least(F.col("n"), F.col("first") + REPEATS - 1)
    sized = written(
        part.select(*key, F.explode(F.sequence("first", last)).alias("again"))
        .withColumn("row", F.xxhash64(*key, "again"))
        .withColumn("row_2", F.xxhash64(F.lit(2), *key, "again")),
        "sized",
    )
    targets = written(source_targets(sized, weights, share, limit), "targets")
    counts = sized.groupBy("source").count().withColumnRenamed("count", "rows")
    facts = targets.alias("t").join(
        counts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))
    ).select(
        F.col("t.source").isNull().alias("_none"), F.coalesce("t.source", F.lit("")).alias("_name"),
        "source_size", "target", F.ceil(F.col("rows") / BLOCK).alias("blocks"),
    )
    named = sized.withColumn("_none", F.col("source").isNull()).withColumn(
        "_name", F.coalesce("source", F.lit(""))
    )
    due = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = written(
        attach_groups(named, facts, ["_none", "_name"], F.col("row"))
        .withColumn("base", F.floor(due + 1e-9))
        .withColumn("p", F.greatest(due - F.col("base"), F.lit(0.0)))
        .withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.col("blocks")))
        .select("doc_id", "text_hash", "again", "row", "row_2", "source", "size", "source_size", "target", "base", "p", "block"),
        "dealt",
    )
    level = dealt.select(
        "row", "row_2", "source", "size", "base", "p", "block", F.lit(True).alias("open")
    )
    rounded, depth = [], 0
    blocks = int(dealt.agg(F.max("block")).first()[0] or 0) + 1
    while True:
        step = written(
            level.groupBy("source", "block").applyInPandas(_round_block(seed + depth), _SHAPE),
            "rounds",
        )
        rounded.append(step.where("NOT open"))
        left = step.where("open")
        if blocks == 1:
            last = F.xxhash64("row", F.lit(seed)).bitwiseAND((1 << 52) - 1) / float(1 << 52)
            rounded.append(left.withColumn("p", F.when(last < F.col("p"), 1.0).otherwise(0.0)))
            break
        level = left.withColumn("block", F.floor(F.col("block") / FAN_IN))
        blocks, depth = -(-blocks // FAN_IN), depth + 1
    decided = rounded[0]
    for more in rounded[1:]:
        decided = decided.union(more)
    copies = decided.select("row", "row_2", (F.col("base") + F.col("p")).cast("long").alias("copies"))
    return dealt.join(copies, ["row", "row_2"]).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "text_hash", "again",
    )


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows of one doc_id, source and text that repeat share out the copies of their number,
    so the words taken are those of :func:`mix`. Columns may have any names.
    """
    taken = written(
        mix(docs, **options).select("doc_id", "source", "text_hash", "again", "copies"), "taken"
    )
    key = ["doc_id", "source", "text_hash"]
    fields = {"doc_id": "doc_id", "source": "source"}
    rows = packed(docs).select(
        "row", *[F.col("row")[f].alias(f"own_{c}") for c, f in fields.items()],
        _text_hash(F.col("row")["text"]).alias("own_text_hash"),
    )
    same = [F.col(f"own_{c}").eqNullSafe(F.col(c)) for c in key]
    repeated = taken.where("again > 1").select(*key).distinct()
    if repeated.isEmpty():
        found = rows.join(taken.where("copies > 0"), reduce(Column.__and__, same))
    else:
        repeated = written(repeated, "repeated")
        number = F.row_number().over(Window.partitionBy(*[f"own_{c}" for c in key]).orderBy(F.lit(1)))
        alone = rows.join(repeated, reduce(Column.__and__, same), "left_anti").withColumn("number", F.lit(1))
        several = rows.join(repeated, reduce(Column.__and__, same), "left_semi").withColumn("number", number)
        found = alone.unionByName(several).join(
            taken.where("copies > 0"), reduce(Column.__and__, same) & (F.col("number") == F.col("again"))
        )
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unpacked(copies, docs)
