"""From raw documents to encoded training text: five stages over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumfit.llm import exact_dedup, language_id, mixing, near_dup, piece_lattice
from quorumfit.llm.tables import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language models reject: no letters, or like no language.

    The models learn from the labelled rows of ``docs`` themselves. Null or letterless text
    goes; rows without lang take no part in the fit and are judged like the others. When no
    row has a lang there is nothing to judge by and all rows with letters stay.
    """
    model = language_id.train(docs)
    judged = language_id.identify(docs, model, keep=docs.columns, prefix="_language_")
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return judged.where("NOT _language_rejected").select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text; the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at a similarity of 0.8 or more;
    the smallest doc_id stays."""
    return near_dup.drop_near_duplicates(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.take_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents but the text, and n_tokens, ids, text_hash and round_trip;
    these four begin with underscores where a column of the documents has their name."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    prefix = ""
    while any(prefix + name in docs.columns for name in piece_lattice.RESULTS):
        prefix += "_"
    return piece_lattice.encode(docs, keep=keep, prefix=prefix)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: No SQL: the stages fit language models and round at random. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
