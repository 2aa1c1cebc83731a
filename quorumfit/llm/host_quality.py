"""Quality rules of documents, and verdicts on the hosts they come from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumfit.llm.tables import attach_groups, written
from quorumfit.llm.words import slices, words_of

SYMBOLS = r"[#*$%&|<>]"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules on a document's counts; each gives whether the document fails.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "word_length": "word_chars > 15 * n_words OR word_chars < 2 * n_words",
    "lines": "20 * n_dup_lines > n_words",
}


def repeated_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in it."""
    n = codes.size
    covered = np.zeros(n + 1, bool)
    if n >= 3:
        wide = int(codes.max()) + 1
        pairs = pd.factorize(codes[:-1].astype(np.int64) * wide + codes[1:])[0]
        triples = pd.factorize(pairs[:-1].astype(np.int64) * wide + codes[2:])[0]
        owner = np.repeat(np.arange(starts.size - 1), np.diff(starts))
        inside = owner[:-2] == owner[2:]
        keyed = owner[:-2].astype(np.int64) * (int(triples.max()) + 1) + triples
        which, distinct = pd.factorize(keyed[inside])
        often = np.flatnonzero(inside)[np.bincount(which, minlength=distinct.size)[which] > 1]
        for k in range(3):
            covered[often + k] = True
    before = np.concatenate([[0], np.cumsum(covered[:n])])
    return before[starts[1:]] - before[starts[:-1]]


def _duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    found = 0
    for line in text.split("\n") if "\n" in text else ():
        if line.strip(" \t\n\v\f\r"):
            found += line in seen
            seen.add(line)
    return found


def _measure(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = pc.fill_null(part.column("_text"), "")
                words = words_of(texts, lower=False)
                long = np.concatenate(
                    [[0], np.cumsum(pc.utf8_length(words.distinct).to_numpy()[words.codes])]
                )
                columns = [
                    np.diff(words.starts),
                    long[words.starts[1:]] - long[words.starts[:-1]],
                    pc.count_substring_regex(texts, SYMBOLS).to_numpy(),
                    [_duplicate_lines(t) for t in texts.to_pylist()],
                    repeated_words(words.codes, words.starts),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns)],
                    [*keep, *METRICS],
                )

    return run


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    r"""Columns ``keep`` of every row and its counts over the whole text (null: none).

    n_words and word_chars (code points) of words ``[^\x20\x09-\x0D]+``; n_symbols of
    ``SYMBOLS``; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words:
    words in three-word windows found twice or more. One pass, no shuffle.
    """
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    counts = ", ".join(f"{m} long" for m in METRICS)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(
        _measure(keep), f"{shape}, {counts}"
    )


def base_failed() -> Column:
    return F.expr(f"{RULES['short']} OR {RULES['repeated']}")


def host_rates(measured: DataFrame, host: str, rules: dict[str, str] | None = None,
               limit: float = 0.9) -> DataFrame:
    """One row a host: rows, shrunk failure rate of each rule, host_failed.

    The prior of a rule is the beta distribution that has the mean and variance of the
    failure rates over all hosts, each weighed by its rows. A rate is shrunk to
    (failures + a) / (rows + a + b). A host fails when a shrunk rate is above ``limit``.
    If all hosts have one rate, the prior is that rate with the weight of 1,000 rows. Rows
    without a host form a host of their own.
    """
    rules = RULES if rules is None else rules
    fails = [F.sum(F.expr(f"CAST({rule} AS INT)")).alias(name) for name, rule in rules.items()]
    hosts = written(measured.groupBy(host).agg(F.count("*").alias("rows"), *fails), "hosts")
    total = F.sum("rows")
    moments = hosts.agg(
        *[(F.sum(n) / total).alias(f"{n}_mean") for n in rules],
        *[(F.sum(F.col(n) * F.col(n) / F.col("rows")) / total).alias(f"{n}_square") for n in rules],
    ).first()
    shrunk = []
    for name in rules:
        mean, square = moments[f"{name}_mean"] or 0.0, moments[f"{name}_square"] or 0.0
        variance = square - mean * mean
        weight = mean * (1 - mean) / variance - 1 if variance > 1e-12 else 1000.0
        weight = min(max(weight, 1.0), 1000.0)
        shrunk.append(((F.col(name) + weight * mean) / (F.col("rows") + weight)).alias(f"{name}_rate"))
    rated = hosts.select(host, "rows", *shrunk)
    worst = F.greatest(*[F.col(f"{n}_rate") for n in rules], F.lit(0.0))
    return rated.withColumn("host_failed", worst > limit)


def judge(docs: DataFrame, host: str = "source", keep: list[str] | None = None,
          limit: float = 0.9) -> DataFrame:
    """Counts of every row, base_failed, host_failed and kept (neither failed).

    Counts are taken once, as a table without texts. Host verdicts are joined back with hot
    hosts split into salted parts. An empty table gives an empty table; repeated rows stay.
    """
    keep = ["doc_id"] if keep is None else keep
    plain = docs.select(*{*keep}, "text", F.col(host).alias("_host"))
    measured = written(measure(plain, [*keep, "_host"]), "counts")
    rates = host_rates(measured, "_host", limit=limit).select(
        F.col("_host").isNull().alias("_none"), F.coalesce("_host", F.lit("")).alias("_name"),
        "host_failed",
    )
    named = measured.withColumn("_none", F.col("_host").isNull()).withColumn(
        "_name", F.coalesce("_host", F.lit(""))
    )
    spread = F.hash(*keep, *METRICS)
    judged = attach_groups(named, rates, ["_none", "_name"], spread)
    return judged.select(
        *keep, *METRICS, base_failed().alias("base_failed"), "host_failed",
        (~base_failed() & ~F.col("host_failed")).alias("kept"),
    )
