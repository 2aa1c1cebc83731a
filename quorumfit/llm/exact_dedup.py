"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumfit.llm.tables import attach_groups, packed, unpacked, written

#: A chunk ends after a vowel, a separator and a letter of the first half of the alphabet,
#: 512 characters after its start at the earliest and 4,096 at the latest.
CHUNK = r"(?s).{512,4096}?(?<=[aeiou][ .,;\n][a-m])|.{1,4096}"


def normal_text(text: Column) -> Column:
    """Text with A-Z lower-cased and nothing else changed; null is empty."""
    return F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_groups(docs: DataFrame, identify=chunk_id) -> DataFrame:
    """Class of equal texts of every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are cut where their content says so. The distinct chunks are compared by their
    text under each identifier, and texts are equal when their ordered identifier lists
    are. So a chunk moves once per task that has it, and documents move as short lists.
    Identifiers shared by different chunks (``identify`` is a 64-bit hash) are told apart
    by SHA-256 of the chunk in the documents concerned.

    The largest doc_id of a class stays. Null text is empty text and equals other empty
    text. Repeated rows of one doc_id count as rows and share their verdict; a null doc_id
    stays only when its whole class has none. Other columns of ``docs`` are ignored. An
    empty table gives an empty table. No Python runs on the executors.
    """
    texts = docs.select("doc_id", normal_text(F.col("text")).alias("norm"))
    chunked = texts.select(
        "doc_id", "norm", F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks")
    )
    recipes = written(
        chunked.select(
            "doc_id",
            F.transform("chunks", identify).alias("recipe"),
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        ),
        "recipes",
    )
    placed = chunked.select("doc_id", F.posexplode("chunks").alias("pos", "chunk")).select(
        "doc_id", "pos", "chunk", identify(F.col("chunk")).alias("h")
    )
    distinct = placed.select("h", "chunk").distinct()
    shared = written(distinct.groupBy("h").count().where("count > 1").select("h"), "clashes")
    if shared.isEmpty():
        keyed = recipes.withColumn("apart", F.lit(""))
    else:
        apart = (
            placed.join(shared, "h", "left_semi").distinct()
            .groupBy("doc_id")
            .agg(F.sort_array(F.collect_set(
                F.struct("pos", F.sha2(F.col("chunk").cast("binary"), 256).alias("sha"))
            )).cast("string").alias("apart"))
        )
        keyed = recipes.join(apart, "doc_id", "left").fillna("", ["apart"])
    keyed = keyed.select("doc_id", "text_sha256", "recipe", "apart")
    groups = (
        keyed.groupBy("recipe", "apart")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    spread = F.coalesce(F.col("doc_id"), F.lit(0))
    joined = attach_groups(keyed, groups, ["recipe", "apart"], spread)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with all their columns.

    The verdict is on doc_id and text together, so a doc_id that has several texts keeps
    each of them that is no copy. Of rows that repeat a doc_id and its text one stays; a
    text all of whose rows lack a doc_id keeps one of them. Columns may have any names.
    """
    groups = exact_groups(docs).where("kept")
    verdict = written(
        groups.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("again")), "kept"
    )
    rows = packed(docs).withColumn(
        "sha", F.sha2(normal_text(F.col("row")["text"]).cast("binary"), 256)
    ).withColumn("id", F.col("row")["doc_id"])

    def among(of: DataFrame) -> DataFrame:
        same = (F.col("sha") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("doc_id"))
        return rows.join(of.select("doc_id", "text_sha256"), same, "left_semi")

    repeated = verdict.where("again > 1")
    if repeated.isEmpty():
        return unpacked(among(verdict), docs)
    one = Window.partitionBy("id", "sha").orderBy(F.lit(1))
    first = among(repeated).withColumn("turn", F.row_number().over(one)).where("turn = 1")
    return unpacked(among(verdict.where("again = 1")), docs).unionByName(unpacked(first, docs))
