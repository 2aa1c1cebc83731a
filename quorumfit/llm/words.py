"""Words of a batch of texts as numbers, for operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

STRETCH = 4_000_000


@dataclass
class Words:
    """Words of texts in order: ``codes`` number the ``distinct`` words, text i owns
    ``codes[starts[i]:starts[i + 1]]``."""

    codes: np.ndarray
    starts: np.ndarray
    distinct: pa.Array


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    r"""Words ``[^\x20\x09-\x0D]+`` of each text (null: none), A-Z lower-cased if asked."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets, values = lists.offsets.to_numpy(), lists.values
    values = values.slice(offsets[0], offsets[-1] - offsets[0])
    encoded = values.dictionary_encode()
    codes = encoded.indices.to_numpy()
    full = (pc.binary_length(encoded.dictionary).to_numpy() > 0)[codes]
    before = np.concatenate([[0], np.cumsum(full)])
    return Words(codes[full], before[offsets - offsets[0]], encoded.dictionary)


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter(
        (xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct)
    )


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of text bytes (a longer text is alone)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > STRETCH:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)
