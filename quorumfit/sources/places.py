"""Row numbers of file rows that do not depend on how the files are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Splits whose offsets are broadcast, 16 bytes each; more (above 100 TB) are joined.
BROADCAST_SPLITS = 1_000_000
PLACE = ["_file", "_start", "_at"]


def with_places(scan: DataFrame) -> DataFrame:
    """A file scan and where its rows were read: file, start of the split, and a number
    that grows along the split. Ask for it before anything filters or moves the rows."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )


def split_shifts(placed: DataFrame) -> DataFrame:
    """(_split, _shift): what to add to ``_at`` of the rows of a split to number all rows
    from 0 in the order of paths and of lines.

    One row a split, a few dozen bytes for 128 MB of text. The rows before a split are
    summed over the splits of its file, and over whole files.
    """
    splits = placed.groupBy("_file", "_start").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    back = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    in_file = F.sum("_rows").over(back(Window.partitionBy("_file").orderBy("_start")))
    files = splits.groupBy("_file").agg(F.sum("_rows").alias("_rows")).select(
        "_file", F.sum("_rows").over(back(Window.orderBy("_file"))).alias("_before")
    )
    shift = F.coalesce("_in_file", F.lit(0)) + F.coalesce("_before", F.lit(0)) - F.col("_first")
    return (
        splits.withColumn("_in_file", in_file).join(files, "_file")
        .select(_split_key().alias("_split"), shift.alias("_shift"))
    )


def _split_key():
    return F.xxhash64("_file", "_start")


def numbered(placed: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Replace the places by ``id``, the number of the row among all rows of the files.

    ``counted`` has the places of the same rows where they are cheaper to count. The counts
    are one pass; ids are a broadcast look-up by split, so the rows are not moved.
    """
    shifts = split_shifts(placed if counted is None else counted)
    found = shifts.limit(BROADCAST_SPLITS + 1).collect()
    if len(found) <= BROADCAST_SPLITS:
        if len({row["_split"] for row in found}) < len(found):
            raise ValueError("two splits have one hash; read fewer files at once")
        rows = [tuple(row) for row in found]
        shifts = F.broadcast(placed.sparkSession.createDataFrame(rows, "_split long, _shift long"))
    return (
        placed.withColumn("_split", _split_key()).join(shifts, "_split")
        .withColumn("id", F.col("_at") + F.col("_shift"))
        .drop(*PLACE, "_split", "_shift")
    )
