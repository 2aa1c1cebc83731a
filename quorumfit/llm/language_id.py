"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumfit.llm.tables import written
from quorumfit.llm.words import slices

ORDER = 4
STRETCH = 1_000_000
UNKNOWN = "und"
#: Bits of a letter in a packed gram: every code point has one of its own.
LETTER = 21
#: Bytes of sorted arrays that are sent to the tasks at once; more languages than fit take
#: further passes over the texts.
ARRAY_BYTES = 256 << 20
#: Bytes of one gram, and of one context, in the arrays.
GRAM_BYTES, CONTEXT_BYTES = 16, 24


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and its lower-case letter or a space."""
    kinds = np.array([unicodedata.category(chr(p))[0] for p in range(0x110000)])
    fold = np.full(0x110000, 32, np.uint32)
    for point in np.flatnonzero((kinds == "L") | (kinds == "M")):
        fold[point] = ord(chr(point).lower()[0])
    return kinds == "L", fold


_LETTERS, _FOLDED = _tables()
_SPACE = np.array([32], np.uint32)


def _folded(text: str) -> tuple[np.ndarray, bool, bool]:
    """Lower-case letters of a text, runs of anything else as one space, without spaces at the
    ends; whether there was one before, and one after."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = _FOLDED[points]
    space = codes == 32
    letters = np.flatnonzero(~space)
    if not letters.size or not _LETTERS[points].any():
        return codes[:0], True, True
    low, high = letters[0], letters[-1] + 1
    keep = ~space[low:high]
    keep[1:] |= ~space[low : high - 1]
    return codes[low:high][keep], low > 0, high < codes.size


def stretches(texts: list) -> Iterator[tuple[np.ndarray, list, list]]:
    """(document numbers, contexts, letter codes) for bounded stretches of the texts.

    A text is its letters with a space before and after. One above the bound goes in parts,
    so memory does not grow with the longest text; a part's context is the three letters
    before it, so the parts have the grams of the whole.
    """
    owners, contexts, parts, size = [], [], [], 0
    for number, text in enumerate(texts):
        text, context = text or "", np.repeat(_SPACE, ORDER - 1)
        began = gap = False
        for at in range(0, len(text), STRETCH):
            codes, before, after = _folded(text[at : at + STRETCH])
            part = [_SPACE] if began and codes.size and (gap or before) else []
            gap = after if codes.size else True
            began = began or codes.size > 0
            part = [*part, codes, *([_SPACE] if began and at + STRETCH >= len(text) else [])]
            part = np.concatenate(part)
            if not part.size:
                continue
            owners.append(number)
            contexts.append(context)
            parts.append(part)
            context = np.concatenate([context, part[-ORDER + 1 :]])[-ORDER + 1 :]
            size += part.size
            if size >= STRETCH:
                yield np.array(owners), contexts, parts
                owners, contexts, parts, size = [], [], [], 0
    if parts:
        yield np.array(owners), contexts, parts


def grams(contexts: list, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-gram that ends at every code of the parts, as its first letter and the packed
    other three, and where parts start."""
    lengths = np.array([p.size for p in parts])
    codes = np.concatenate([c for pair in zip(contexts, parts) for c in pair]).astype(np.int64)
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    last = (codes[at - 2] << 2 * LETTER) | (codes[at - 1] << LETTER) | codes[at]
    return codes[at - 3], last, np.cumsum(lengths) - lengths


def gram_key(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of a 4-gram; shorter grams and contexts are their own keys."""
    mixed = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= (mixed >> np.uint64(29)) + head.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _numbered(head: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct grams, told apart exactly, and where each comes first."""
    code, _ = pd.factorize((pd.factorize(last)[0].astype(np.int64) << LETTER) | head)
    first = np.empty(code.max(initial=-1) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, first


def _tally(head: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct grams with the sums of their counts."""
    code, first = _numbered(head, last)
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, code, n)
    return head[first], last[first], sums


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the 4-grams of each language in a task's rows."""
    held: dict[str, list] = {}

    def rows(lang: str) -> Iterator[pa.RecordBatch]:
        head, last, n = _tally(*(np.concatenate(c) for c in zip(*held.pop(lang))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n)), pa.array(head), pa.array(last), pa.array(n)],
            ["lang", "head", "gram", "n"],
        )

    for batch in (part for whole in batches for part in slices(whole, "text")):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = np.array(batch.column("text").to_pylist(), object)
        for lang in sorted(set(langs)):
            for _, contexts, parts in stretches(list(texts[langs == lang])):
                head, last, _ = grams(contexts, parts)
                held.setdefault(lang, []).append(_tally(head, last, np.ones(len(last), np.int64)))
            if sum(len(t[2]) for t in held.get(lang, ())) > STRETCH:
                yield from rows(lang)
    for lang in list(held):
        yield from rows(lang)


@dataclass
class Order:
    """Sorted hash arrays of one order: grams with counts, contexts with totals."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    types: np.ndarray
    discount: float


Arrays = dict[str, list[Order]]


@dataclass
class LanguageModels:
    """Models of all languages: tables of grams and contexts of every order, which grow with
    the corpus, and groups of languages whose arrays are sent to the tasks together."""

    tables: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    discounts: dict[str, list[float]] = field(default_factory=dict)
    alphabet: dict[str, int] = field(default_factory=dict)
    typical: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    held: dict[int, Arrays] = field(default_factory=dict)

    @property
    def languages(self) -> list[str]:
        return sorted(self.alphabet)

    def arrays(self, group: int) -> Arrays:
        """Sorted arrays of the languages of a group; of a single group they are kept."""
        if group in self.held:
            return self.held[group]
        names, out = self.groups[group], {lang: [] for lang in self.groups[group]}
        for k, (by_gram, by_context) in enumerate(self.tables):
            g, c = (t.where(F.col("lang").isin(names)).toPandas() for t in (by_gram, by_context))
            g["key"] = gram_key(g["head"].to_numpy(), g["gram"].to_numpy()) if k + 1 == ORDER else g["gram"]
            g, c = g.sort_values(["lang", "key"]), c.sort_values(["lang", "context"])
            for lang in names:
                own, ctx = g[g["lang"] == lang], c[c["lang"] == lang]
                out[lang].append(Order(
                    own["key"].to_numpy(np.int64), own["n"].to_numpy(np.float64),
                    ctx["context"].to_numpy(np.int64), ctx["n"].to_numpy(np.float64),
                    ctx["types"].to_numpy(np.float64), self.discounts[lang][k],
                ))
        if len(self.groups) == 1:
            self.held[group] = out
        return out

    def plain(self, group: int) -> tuple:
        """A group as arrays, dicts and numbers only, for a broadcast."""
        arrays = {lang: [tuple(vars(o).values()) for o in orders] for lang, orders in self.arrays(group).items()}
        return arrays, self.alphabet

    def log2(self, lang: str, head: np.ndarray, last: np.ndarray) -> np.ndarray:
        group = next(k for k, names in enumerate(self.groups) if lang in names)
        return log2(self.arrays(group)[lang], self.alphabet[lang], head, last)


def log2(orders: list[Order], alphabet: int, head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """log2 P(last letter | up to three before), interpolated over all orders."""
    p = np.full(last.size, 1.0 / (alphabet + 1))
    for k, order in enumerate(orders, start=1):
        total, types, count = np.zeros((3, last.size))
        if k == 1:
            total[:], types[:] = order.totals[0], order.types[0]
        else:
            at = _find(order.contexts, _context(head, last, k))
            total[at[0]], types[at[0]] = order.totals[at[1]], order.types[at[1]]
        key = gram_key(head, last) if k == ORDER else last & ((1 << LETTER * k) - 1)
        at = _find(order.grams, key)
        count[at[0]] = order.counts[at[1]]
        known = total > 0
        own = np.maximum(count - order.discount, 0.0)
        back = order.discount * types
        p[known] = np.minimum((own[known] + back[known] * p[known]) / total[known], 1.0)
    return np.log2(p)


def _context(head: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """What stands before the last letter of a gram of order k, as an exact key."""
    if k == ORDER:
        return (head << 2 * LETTER) | (last >> LETTER)
    return (last & ((1 << LETTER * k) - 1)) >> LETTER


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    return hit, at[hit]


def train(docs: DataFrame) -> LanguageModels:
    """Fit one model a language on all rows with text and lang, then its usual entropy.

    Counting 4-grams, continuation counts of the lower orders, and totals of contexts are
    Spark aggregations over every row, into tables that grow with the corpus; grams are told
    apart exactly. For use they become sorted arrays, whole languages at a time: as many
    languages as take ``ARRAY_BYTES`` form a group (a larger one is a group alone), and any
    number of languages takes as many passes as there are groups.
    """
    rows = docs.where(docs["text"].isNotNull() & docs["lang"].isNotNull()).select(
        docs["lang"].alias("lang"), docs["text"].alias("text")
    )
    quads = written(
        rows.mapInArrow(_count_grams, "lang string, head long, gram long, n long")
        .groupBy("lang", "head", "gram").agg(F.sum("n").alias("n")),
        "grams",
    )
    levels = {ORDER: quads}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << LETTER * k) - 1)).alias("gram")
        levels[k] = written(levels[k + 1].groupBy("lang", shorter).agg(F.count("*").alias("n")), "grams")
    model, sizes = LanguageModels(), {}
    for k in range(1, ORDER + 1):
        context = F.shiftright("gram", LETTER)
        if k == ORDER:
            context = F.shiftleft("head", 2 * LETTER).bitwiseOR(context)
        by_context = written(
            levels[k].groupBy("lang", context.alias("context")).agg(
                F.sum("n").alias("n"), F.count("*").alias("types")
            ),
            "contexts",
        )
        model.tables.append((levels[k], by_context))
        facts = levels[k].groupBy("lang").agg(
            F.count("*").alias("size"), F.count_if(F.col("n") == 1).alias("one"),
            F.count_if(F.col("n") == 2).alias("two"),
        )
        contexts = by_context.groupBy("lang").agg(F.count("*").alias("contexts"))
        for r in facts.join(contexts, "lang").collect():
            one, two = r["one"], r["two"]
            model.discounts.setdefault(r["lang"], []).append(
                min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5
            )
            if k == 1:
                model.alphabet[r["lang"]] = r["size"]
            size = GRAM_BYTES * r["size"] + CONTEXT_BYTES * r["contexts"]
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + size
    room = 0
    for lang in model.languages:
        if not model.groups or room + sizes[lang] > ARRAY_BYTES:
            model.groups.append([])
            room = 0
        model.groups[-1].append(lang)
        room += sizes[lang]
    for group in range(len(model.groups)):
        _calibrate(model, group, rows)
    return model


def entropies(model: LanguageModels, texts: list, langs: list[str]):
    """Bits a character (documents x languages), sums of squares, characters of each text."""
    arrays = {}
    for group, names in enumerate(model.groups):
        arrays |= model.arrays(group) if set(names) & set(langs) else {}
    return _entropies(arrays, model.alphabet, texts, langs)


def _entropies(arrays: Arrays, alphabet: dict, texts: list, langs: list[str]):
    size = len(texts)
    bits, squares, chars = np.zeros((size, len(langs))), np.zeros((size, len(langs))), np.zeros(size)
    for owners, contexts, parts in stretches(texts):
        head, last, starts = grams(contexts, parts)
        inverse, at = _numbered(head, last)
        np.add.at(chars, owners, np.diff(np.append(starts, last.size)))
        for j, lang in enumerate(langs):
            cost = -log2(arrays[lang], alphabet[lang], head[at], last[at])
            np.add.at(bits[:, j], owners, np.add.reduceat(cost[inverse], starts))
            np.add.at(squares[:, j], owners, np.add.reduceat((cost * cost)[inverse], starts))
    return bits / np.maximum(chars, 1)[:, None], squares, chars


def _opened(plain: tuple) -> tuple[Arrays, dict]:
    arrays, alphabet = plain
    return {k: [Order(*o) for o in v] for k, v in arrays.items()}, alphabet


def _calibrate(model: LanguageModels, group: int, rows: DataFrame) -> None:
    """Usual entropy of the languages of a group over their own training rows: mean, spread,
    spread a character."""
    shared = rows.sparkSession.sparkContext.broadcast(model.plain(group))

    def measure(batches):
        arrays, alphabet = _opened(shared.value)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            names = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array(batch.column("text").to_pylist(), object)
            for lang in sorted(set(names)):
                if lang not in arrays:
                    continue
                h, squares, n = _entropies(arrays, alphabet, list(texts[names == lang]), [lang])
                h, squares = h[n > 0, 0], squares[n > 0, 0]
                n = n[n > 0]
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang], "docs": [float(n.size)], "h": [h.sum()], "hh": [(h * h).sum()],
                    "chars": [n.sum()], "bits": [(h * n).sum()], "squares": [squares.sum()],
                })

    own = rows if len(model.groups) == 1 else rows.where(F.col("lang").isin(model.groups[group]))
    sums = own.mapInArrow(
        measure, "lang string, docs double, h double, hh double, chars double, bits double, squares double"
    ).groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("docs", "h", "hh", "chars", "bits", "squares")])
    for r in sums.collect():
        if not r["docs"]:
            continue
        mean = r["h"] / r["docs"]
        spread = math.sqrt(max(r["hh"] / r["docs"] - mean * mean, 0.0))
        each = r["bits"] / r["chars"]
        model.typical[r["lang"]] = (
            mean, spread, math.sqrt(max(r["squares"] / r["chars"] - each * each, 0.0))
        )
    shared.destroy()


#: What a pass over a group of languages hands on: the best language so far, its entropy, the
#: weight of all languages against it, and the letters of the text.
_SO_FAR = {"lang": "string", "low": "double", "odds": "double", "chars": "double"}


def identify(docs: DataFrame, model: LanguageModels, z: float = 6.0, keep: list[str] | None = None,
             slack: float = 0.25, prefix: str = "") -> DataFrame:
    """Columns ``keep`` of every row and lang_pred, score, entropy, rejected, after ``prefix``.

    lang_pred has the lowest cross-entropy a character, of equal ones the first by name;
    score (0 to 1) weighs it against the other languages over at most 40 characters. A text
    is rejected when its entropy lies above the usual one of that language by ``slack`` bits
    and ``z`` deviations, that of a text of its length being made up of the spread between
    documents and the spread a character. Text that is null or has no letter: ``und``, score
    0, rejected, no entropy. Without any learned language every text is ``und``. Very long
    texts are read whole, in parts. Only text is read for a prediction; other columns may
    have any names. An empty table gives an empty table.
    """
    keep = ["doc_id"] if keep is None else keep
    names = ["text" if c == "text" else f"keep_{k}" for k, c in enumerate(keep)]
    kinds = {n: docs.schema[c].dataType.simpleString() for n, c in zip(names, keep)}
    state = docs.select(*[
        docs[f"`{c}`"].alias(n) for n, c in ({n: c for n, c in zip(names, keep)} | {"text": "text"}).items()
    ])
    groups = range(len(model.groups))
    for group in groups:
        last = group == groups[-1]
        shape = kinds | ({} if last else {"text": "string"}) | _SO_FAR
        shared = docs.sparkSession.sparkContext.broadcast(model.plain(group))
        step = state.mapInArrow(
            _pass(shared, [c for c in shape if c not in _SO_FAR], group == 0),
            ", ".join(f"{c} {kind}" for c, kind in shape.items()),
        )
        state = step if last else written(step, "languages")
    if not groups:
        state = state.select(*names, *[F.lit(None).cast(kind).alias(c) for c, kind in _SO_FAR.items()])
    found = F.col("lang").isNotNull()
    limits = docs.sparkSession.createDataFrame(
        [(k, *v) for k, v in model.typical.items()], "lang string, mean double, spread double, each double"
    )
    wide = F.sqrt(F.col("spread") * F.col("spread") + F.col("each") * F.col("each") / F.col("chars"))
    above = F.col("low") > F.col("mean") + F.greatest(F.lit(slack), F.lit(z) * wide)
    joined = state.join(F.broadcast(limits), "lang", "left")
    results = [
        F.coalesce("lang", F.lit(UNKNOWN)), F.when(found, 1.0 / F.col("odds")).otherwise(0.0),
        F.when(found, F.col("low")), F.coalesce(above, F.lit(True)),
    ]
    return joined.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)],
        *[r.alias(prefix + c) for r, c in zip(results, ("lang_pred", "score", "entropy", "rejected"))],
    )


def _pass(shared, carried: list[str], first: bool):
    """Compare the texts with the languages of one group, going on from the groups before."""

    def run(batches):
        arrays, alphabet = _opened(shared.value)
        langs = sorted(arrays)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = batch.column("text").to_pylist()
            h, _, n = _entropies(arrays, alphabet, texts, langs)
            best = h.argmin(1)
            low = h[np.arange(len(texts)), best]
            weight = np.minimum(n, 40)
            odds = np.exp2(-(h - low[:, None]) * weight[:, None]).sum(1)
            lang = np.array(langs, object)[best]
            if not first:
                old, old_odds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "odds"))
                with np.errstate(over="ignore"):
                    together = np.where(
                        low < old, odds + old_odds * np.exp2(-np.maximum(old - low, 0) * weight),
                        old_odds + odds * np.exp2(-np.maximum(low - old, 0) * weight),
                    )
                lang = np.where(low < old, lang, np.array(batch.column("lang").to_pylist(), object))
                low, odds = np.minimum(low, old), together
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(lang, pa.string(), mask=none), pa.array(low, mask=none),
                 pa.array(odds, mask=none), pa.array(n.astype(float), mask=none)],
                [*carried, *_SO_FAR],
            )
    return run


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: crc32 of the id's digits leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
