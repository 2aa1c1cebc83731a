"""Named datasets and the loader that picks their reader."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quorumfit.sources.csv import read_dense_csv
from quorumfit.sources.libsvm import ParsedLines, read_libsvm, read_libsvm_tolerant


@dataclass(frozen=True)
class Dataset:
    train: str
    test: str
    reader: str  # "libsvm" | "tolerant" | "csv"
    num_features: int


# Default file names and dimensions of the two known datasets.
DATASETS = {
    "rcv1": Dataset("rcv1_train15k.binary", "rcv1_test10k.binary", "libsvm", 47236),
    "higgs": Dataset("higgs_train15k.binary", "higgs_test10k.binary", "tolerant", 28),
}


def resolve(
    dataset: str, base_dir: str, train_file: str = "", test_file: str = ""
) -> tuple[str, str]:
    """Paths of the training and test file. Absolute names and URIs are kept, others
    are looked up below ``base_dir``; an unknown dataset needs both names."""
    known = DATASETS.get(dataset.lower())
    if known is None and not (train_file and test_file):
        raise ValueError(f"unknown dataset {dataset!r}; known: {sorted(DATASETS)}")

    def full(name: str) -> str:
        if name.startswith("/") or "://" in name:
            return name
        return f"{base_dir.rstrip('/')}/{name}"

    return full(train_file or known.train), full(test_file or known.test)


def reader_of(dataset: str, reader: str | None = None) -> str:
    """The given reader, or that of a known dataset."""
    known = DATASETS.get(dataset.lower())
    if reader is None and known is None:
        raise ValueError(f"unknown dataset {dataset!r}; name a reader")
    return reader or known.reader


def accepted(parsed: ParsedLines, path: str, on_refused: str = "raise") -> DataFrame:
    """The examples, unless lines were refused and that is to raise."""
    if on_refused not in ("raise", "accept"):
        raise ValueError("on_refused is 'raise' or 'accept'")
    refused = parsed.rejected.count() if on_refused == "raise" else 0
    if refused:
        parsed.release()
        raise ValueError(f"{refused} lines of {path} were refused")
    return parsed.examples


def load_dataset(
    spark: SparkSession,
    path: str,
    dataset: str = "rcv1",
    reader: str | None = None,
    index_base: int | str = "auto",
    num_features: int | None = None,
    on_refused: str = "raise",
) -> DataFrame:
    """Load one file with the reader of its dataset, or with ``reader``. A dimension
    that is not given comes from the dataset, or from the data for other datasets.

    Lines that the tolerant reader refuses are an error that gives their number; with
    ``on_refused="accept"`` the other lines are loaded.
    """
    if on_refused not in ("raise", "accept"):
        raise ValueError("on_refused is 'raise' or 'accept'")
    known = DATASETS.get(dataset.lower())
    reader = reader_of(dataset, reader)
    if num_features is None and known is not None:
        num_features = known.num_features
    if reader == "csv":
        return read_dense_csv(spark, path, num_features or 28)
    if reader == "tolerant":
        parsed = read_libsvm_tolerant(spark, path, index_base, num_features)
        return accepted(parsed, path, on_refused)
    if reader == "libsvm":
        return read_libsvm(spark, path, num_features)
    raise ValueError(f"unknown reader {reader!r}")
