"""Small table helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumfit.session import drop_path, fresh_path

SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and reruns read files."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.scratch_path)


def salted(df: DataFrame, by: Column, salts: int = SALTS) -> DataFrame:
    """Rows of the large side of a join, spread over ``salts`` parts of each key."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def repeated(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows of the small side of a join, once for every part of each key."""
    parts = F.array(*[F.lit(k) for k in range(salts)])
    return df.withColumn("_salt", F.explode(parts))


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Left join of rows with one row per group; hot groups are split into salted parts.

    ``groups`` has at most one row for each key. Only groups that matter (of two rows or
    more) should be given, so that the repeated side stays small.
    """
    joined = salted(rows, spread).join(repeated(groups), [*keys, "_salt"], "left")
    return joined.drop("_salt")


def packed(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as one column ``row``, so that no name of theirs can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` back from ``row``, in their order and with their names."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by hash of doc_id; all of them when there are fewer."""
    count = docs.count()
    if count <= rows:
        return docs
    share = int(rows / count * 1_000_000)
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
