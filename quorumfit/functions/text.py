"""Text expressions: LibSVM tokens, file-name tags, labels and number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` plus new columns that are computed once per row. The one-row generator
    keeps later filters and projections from repeating the expressions."""
    new = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(new)))


def tokens(line: Column) -> Column:
    """Words of a line; runs of blanks and tabs count as one separator."""
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def label_of(words: Column) -> Column:
    return F.get(words, F.lit(0)).try_cast("double")


def feature_entries(words: Column) -> Column:
    """array<struct<i:int, pos:int, v:double>> in text order from the words of a line; a
    word that is not ``int:number`` leaves nulls in its entry."""
    features = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))

    def entry(word: Column, pos: Column) -> Column:
        pair = F.split(word, ":")
        whole = F.size(pair) == 2
        return F.struct(
            F.when(whole, F.get(pair, F.lit(0)).try_cast("int")).alias("i"),
            pos.alias("pos"),
            F.when(whole, F.get(pair, F.lit(1)).try_cast("double")).alias("v"),
        )

    return F.transform(features, entry)


def sort_entries(entries: Column) -> Column:
    """Stable order by index: text position breaks ties."""
    return F.array_sort(entries)


def last_of_each_index(entries: Column) -> Column:
    """From sorted entries keep the last one written for every index: each entry is
    paired with its successor, one pass over the array."""
    successors = F.slice(entries, F.lit(2), F.greatest(F.size(entries) - 1, F.lit(0)))
    paired = F.zip_with(
        entries,
        successors,
        lambda e, after: F.struct(
            e.alias("e"), F.coalesce(after["i"] != e["i"], F.lit(True)).alias("last")
        ),
    )
    return F.transform(F.filter(paired, lambda p: p["last"]), lambda p: p["e"])


def shift_index(index: Column, base: Column | int) -> Column:
    """File index to 0-based column number."""
    return index - (base if isinstance(base, Column) else F.lit(int(base)))


def libsvm_line(y: Column, idx: Column, val: Column, base: int = 1) -> Column:
    """Format a sparse row as ``label idx:val idx:val ...``."""
    pairs = F.zip_with(
        idx, val, lambda i, v: F.concat((i + F.lit(base)).cast("string"), F.lit(":"), v.cast("string"))
    )
    return F.concat_ws(" ", y.cast("string"), F.array_join(pairs, " "))


def sample_size_tag(file_name: Column, kind: str) -> Column:
    """``.../rcv1_train15k.binary`` -> ``15k``; the bare file name when there is no tag."""
    base = F.element_at(F.split(file_name, "/"), -1)
    tag = F.regexp_extract(base, f".*{kind}([0-9]+k?).*", 1)
    return F.when(tag != "", tag).otherwise(base)


def series_label(algorithm: Column, version: Column) -> Column:
    return F.concat_ws(" v", algorithm, version)


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def nonzero_percent(nonzero: Column, width: Column) -> Column:
    return nonzero.cast("double") / width.cast("double") * 100.0


def convergence_status(converged: Column) -> Column:
    return F.when(converged, F.lit("converged")).otherwise(F.lit("max_iterations"))
