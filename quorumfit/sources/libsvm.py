"""LibSVM text readers.

Both readers return ``(id, y, size, idx, val)``: 0-based ascending unique indices
and one dimension ``size`` for the whole dataset. ``id`` is the number of the row in the
files, in the order of paths and lines, however the files are split; the tolerant reader
counts every line, the standard one those with an example.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumfit.functions import text
from quorumfit.functions.logistic import to_binary_label
from quorumfit.session import drop_path, fresh_path
from quorumfit.sources.places import PLACE, numbered, with_places

EXAMPLE_COLUMNS = ["id", "y", "size", "idx", "val"]
BLANK = "blank"


@dataclass
class ParsedLines:
    """Examples, the lines that were refused (with a reason), and what was detected."""

    examples: DataFrame
    rejected: DataFrame
    index_base: int
    num_features: int
    scan: Scan | None = None

    def release(self) -> None:
        """Delete the table of parsed lines, if there is one."""
        if self.scan is not None:
            self.scan.release()


@dataclass
class Scan:
    """Lines parsed once, as a table in the shared folder: the index base and the dimension
    follow from its columns, and are applied when it is read."""

    rows: DataFrame
    path: str

    def bounds(self) -> tuple[int | None, int | None]:
        """Lowest and highest index of the good lines; reads two columns."""
        return self.rows.filter(F.col("reason").isNull()).agg(F.min("low"), F.max("high")).first()

    def parsed(self, index_base: int | str = "auto", num_features: int | None = None) -> ParsedLines:
        base, size = layout([self], index_base, num_features)
        rows = self.rows if "id" in self.rows.columns else numbered(self.rows)
        return _shifted(rows, base, size, self)

    def release(self) -> None:
        drop_path(self.rows.sparkSession, self.path)


def layout(scans: list[Scan], index_base: int | str, num_features: int | None) -> tuple[int, int]:
    """Index base and dimension that hold for all scans together: base 0 when index 0 occurs
    anywhere, else 1."""
    if index_base != "auto" and num_features is not None:
        return int(index_base), num_features
    found = [scan.bounds() for scan in scans]
    low = min((b[0] for b in found if b[0] is not None), default=None)
    high = max((b[1] for b in found if b[1] is not None), default=0)
    base = (0 if low == 0 else 1) if index_base == "auto" else int(index_base)
    return base, num_features if num_features is not None else max(high + 1 - base, 1)


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Standard 1-based reader. Pass ``num_features`` so that training and test data
    agree on the dimension and Spark needs no extra pass to infer it."""
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", num_features)
    rows = numbered(with_places(reader.load(path)))
    return from_ml_vectors(rows, "label", "features")


def from_ml_vectors(df: DataFrame, label: str, features: str) -> DataFrame:
    """Open ML vectors, sparse or dense, without leaving the JVM. The vectors stay as
    ``features``, for Spark ML. Rows without an ``id`` are numbered as they lie."""
    raw = F.unwrap_udt(F.col(features))
    dense_idx = F.sequence(F.lit(0), F.size(raw["values"]) - 1)
    return df.select(
        "id" if "id" in df.columns else F.monotonically_increasing_id().alias("id"),
        F.col(label).cast("double").alias("y"),
        F.coalesce(raw["size"], F.size(raw["values"])).alias("size"),
        F.coalesce(raw["indices"], dense_idx).alias("idx"),
        raw["values"].alias("val"),
        F.col(features).alias("features"),
    )


def to_ml_vectors(df: DataFrame) -> DataFrame:
    """(label 0/1, features) for Spark ML; sparse rows stay sparse, and a ``features``
    column that is there already is kept."""
    labelled = df.withColumn("label", to_binary_label(F.col("y")))
    if "features" in df.columns:
        return labelled
    vector = array_to_vector("x") if "x" in df.columns else _sparse_vector()
    return labelled.withColumn("features", vector)


def _sparse_vector() -> Column:
    @F.pandas_udf(VectorUDT())
    def build(size: pd.Series, idx: pd.Series, val: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"type": 0, "size": size, "indices": idx, "values": val})

    return build("size", "idx", "val")


def read_libsvm_tolerant(
    spark: SparkSession,
    path: str,
    index_base: int | str = "auto",
    num_features: int | None = None,
) -> ParsedLines:
    """Tolerant reader; the text is read and parsed once, see :func:`scan_libsvm`."""
    return scan_libsvm(spark, path).parsed(index_base, num_features)


def scan_libsvm(spark: SparkSession, paths: str | list[str]) -> Scan:
    """Parse text into a table of the shared folder, one pass over the files."""
    lines = with_places(spark.read.text(paths)).withColumnRenamed("value", "line")
    return _scanned(lines, PLACE)


def parse_lines(
    lines: DataFrame, index_base: int | str = "auto", num_features: int | None = None
) -> ParsedLines:
    """Parse ``(id, line)``.

    The index base is one decision for the dataset: 0 when index 0 occurs anywhere,
    else 1. Lines with a bad number or an index outside the dimension are refused
    and returned with their reason instead of failing the job or being dropped
    silently. Blank lines are skipped. When base or dimension must be found, the lines are
    parsed once into a table that both the finding and the result read.
    """
    if index_base == "auto" or num_features is None:
        return _scanned(lines, ["id"]).parsed(index_base, num_features)
    return _shifted(_parsed(lines, ["id"]), int(index_base), num_features)


def _parsed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, y, reason, low, high, negative, idx, val) with the indices of the file.
    Blank lines stay, as they count in the numbers of the lines after them."""
    words = text.staged(lines, [*keys, "line"], words=text.tokens(F.col("line")))
    entries = text.staged(
        words,
        [*keys, "line"],
        blank=F.size("words") == 0,
        y=text.label_of(F.col("words")),
        entries=text.sort_entries(text.feature_entries(F.col("words"))),
    )
    bad_token = F.exists("entries", lambda e: e["i"].isNull() | e["v"].isNull())
    reason = (
        F.when(F.col("blank"), BLANK).when(F.col("y").isNull(), "bad label").when(bad_token, "bad feature")
    )
    indices = F.transform("entries", lambda e: e["i"])
    checked = text.staged(
        entries, [*keys, "line", "y"], reason=reason, kept=text.last_of_each_index(F.col("entries")),
        low=F.array_min(F.filter(indices, lambda i: i >= 0)), high=F.array_max(indices),
        negative=F.exists("entries", lambda e: e["i"] < 0),
    )
    return checked.select(
        *keys, "line", "y", "reason", "low", "high", "negative",
        F.transform("kept", lambda e: e["i"]).alias("idx"),
        F.transform("kept", lambda e: e["v"]).alias("val"),
    )


def _scanned(lines: DataFrame, keys: list[str]) -> Scan:
    spark, path = lines.sparkSession, fresh_path(lines.sparkSession, "lines")
    rows = _parsed(lines, keys)
    rows.write.parquet(path)
    return Scan(spark.read.schema(rows.schema).parquet(path), path)


def _shifted(rows: DataFrame, base: int, size: int, scan: Scan | None = None) -> ParsedLines:
    """Examples and refused lines once base and dimension are known."""
    outside = F.col("negative") | (F.col("low") < base) | (F.col("high") >= base + size)
    reason = F.coalesce("reason", F.when(outside, "index out of range"))
    examples = rows.filter(reason.isNull()).select(
        "id",
        "y",
        F.lit(size).alias("size"),
        F.transform("idx", lambda i: text.shift_index(i, base)).alias("idx"),
        "val",
    )
    rejected = rows.filter(reason != BLANK).select("id", "line", reason.alias("reason"))
    return ParsedLines(examples, rejected, base, size, scan)


def write_libsvm(df: DataFrame, path: str, base: int = 1) -> None:
    """Write ``(y, idx, val)`` rows as LibSVM text."""
    line = text.libsvm_line(F.col("y"), F.col("idx"), F.col("val"), base)
    df.select(line.alias("value")).write.mode("overwrite").text(path)
