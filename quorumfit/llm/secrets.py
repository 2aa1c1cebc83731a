"""Secrets in text: base patterns and a linear-chain conditional random field."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.llm import crf
from quorumfit.llm.tables import sampled
from quorumfit.llm.words import slices

#: Base patterns, in the order of their kinds.
ASSIGN = re.compile(
    "(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A
)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: A token is a run without blanks, quotes, brackets and signs that assign, or one such sign.
TOKEN = re.compile("[^\x20\x09-\x0D\"'`=:,;(){}\\[\\]<>|]+|[\"'`=:,;(){}\\[\\]<>|]")
NAMES = re.compile("pass|pwd|secret|token|key|auth|cred|bearer", re.I)
#: Words that stand between the name of a secret and its value.
LINKS = frozenset(["is", "was", "as", "to", "are", "be"])
ENDS = ".,;:!?"

#: Fixed values for the examples that the field is trained on besides the matches as they
#: are: names, ways to join name and value, and beginnings and alphabets of values.
OTHER_NAMES = ("password", "passphrase", "pwd", "secret", "client_secret", "credential", "token",
               "auth token", "access key", "api key", "private_key", "bearer")
JOINS = (" = ", "=", ": ", ":", " is ", " ", ' = "', ": '")
BEGINNINGS = ("", "", "", "", "sk-", "pk_", "key-", "x_", "v1.")
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
ALPHABETS = ("0123456789abcdef", LOWER + DIGITS, LOWER + LOWER.upper() + DIGITS,
             LOWER + LOWER.upper() + DIGITS + "-_", LOWER.upper() + DIGITS)

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Characters on either side of a training example, and examples made of a match.
AROUND, VARIANTS = 60, 8
#: One text in so many shows a stretch without secrets.
PLAIN = 8

_CHANGE = re.compile("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^a-zA-Z0-9])(?=[a-zA-Z0-9])")
_LENGTH_ENDS = (3, 5, 7, 9, 11, 15, 19, 23, 31, 39, 63)
#: Feature blocks: what a token looks like, its neighbours, and where it stands.
_SHAPES, _LENGTHS, _CHANGES, _LEVELS = 20, 12, 8, 5
_WIDTHS = (_SHAPES, _SHAPES, _SHAPES, _SHAPES, _SHAPES, _LENGTHS, _CHANGES, 6, 5, 8, 4,
           _LEVELS * 8 * 4, _LEVELS * _SHAPES, 2, 2)
_STARTS = np.cumsum([0, *_WIDTHS[:-1]])
_SIZE = int(sum(_WIDTHS))
_SLOTS = len(_WIDTHS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and apart for each kind."""
    found = []
    low = text.encode().lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found)


def values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the secrets themselves: of an assignment, its value."""
    out = []
    for start, end, kind in base:
        out.append((start + ASSIGN.fullmatch(text[start:end]).start(1) if kind == 0 else start, end))
    return sorted(set(out))


def _looks(token: str) -> tuple[int, ...]:
    """What a token looks like by itself: shape, length, changes of character class, share of
    digits, distinct characters, level of disorder, whether it names a secret, whether it
    links a name and a value. Plain words, which are most, take a short way."""
    core = token.rstrip(ENDS)
    if core.isalpha() and (core.islower() or core.istitle()):
        length = bisect.bisect_left(_LENGTH_ENDS, len(token))
        if not token.isascii():
            return 6, length, 0, 0, 0, 0, 0, 0
        low = core.lower()
        return (19 if core.islower() else 18, length, 0, 0, 0, 0, int(bool(NAMES.search(low))), 2 * (low in LINKS))
    n = len(token)
    digits = sum("0" <= c <= "9" for c in token)
    lower = sum("a" <= c <= "z" for c in token)
    upper = sum("A" <= c <= "Z" for c in token)
    other = n - digits - lower - upper
    changes = len(_CHANGE.findall(token)) if n < 400 else 99
    inner = token.strip(ENDS)
    joint = sum(c in "-_" for c in inner)
    if n == 1 and other and token.isascii():
        shape = {"=": 1, ":": 2, '"': 3, "'": 4}.get(token, 5)
    elif not token.isascii():
        shape = 6
    elif "@" in token:
        shape = 7
    elif "/" in token and not digits:
        shape = 8
    elif digits and not lower and not upper:
        shape = 9 if digits == len(inner) else 10
    elif digits and lower and upper:
        shape = 11
    elif digits and all(c in "0123456789abcdef" for c in inner):
        shape = 12
    elif digits and lower:
        shape = 13
    elif digits:
        shape = 14
    elif joint and lower:
        shape = 15
    elif upper > 1 and lower:
        shape = 16
    elif upper > 1:
        shape = 17
    elif upper:
        shape = 18
    else:
        shape = 19 if lower else 0
    level = 0
    mixed = bool(digits) + bool(lower) + bool(upper)
    if n >= 6 and token.isascii() and "@" not in token and not (digits and mixed == 1):
        if n >= 16 and changes >= 5 and digits:
            level = 4
        elif n >= 10 and changes >= 3 and digits or n >= 20 and mixed >= 2 and changes >= 4:
            level = 3
        elif n >= 8 and digits and changes >= 2 or joint >= 2 and n >= 14:
            level = 2
        elif digits or joint or (upper > 1 and lower and changes >= 3):
            level = 1
    distinct = 4 * len(set(token[:64])) // max(min(n, 64), 1)
    return (
        shape, bisect.bisect_left(_LENGTH_ENDS, n), bisect.bisect_left((0, 1, 2, 3, 5, 8, 12), changes),
        min(5 * digits // n + bool(digits), 5), min(distinct, 4), level,
        int(bool(NAMES.search(token)) and level < 3), int(token in "=:"),
    )


def file_features(text: str) -> tuple[int, int]:
    """Whether a text has many signs of code, and many lines."""
    marks = sum(text.count(c) for c in "{}=;")
    return int(marks * 200 >= len(text)), int(text.count("\n") * 400 >= len(text))


def features(texts: list[list[str]], files: list[tuple[int, int]]) -> list[np.ndarray]:
    """Feature numbers of the tokens of all texts, one after another: an array a slot.

    Distinct tokens are looked at once. A token's place is told by how many tokens ago a
    secret was named, and whether an assignment or a linking word came since.
    """
    flat = [t for tokens in texts for t in tokens]
    encoded = pa.array(flat, pa.string()).dictionary_encode()
    looks = np.array([_looks(t) for t in encoded.dictionary.to_pylist()], np.int32).reshape(-1, 8)
    own = looks[encoded.indices.to_numpy()]
    n = len(flat)
    lengths = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), lengths)
    first = firsts[text]
    at = np.arange(n)

    def last(where: np.ndarray) -> np.ndarray:
        """Place of the last such token at or before each token of its text, or -1."""
        seen = np.maximum.accumulate(np.where(where, at, -1)) if n else at
        return np.where(seen >= first, seen, -1)

    def beside(column: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        if by < 0:
            out[-by:] = column[:by]
            out[at + by < first] = 0
        else:
            out[:-by] = column[by:]
            out[at + by >= first + lengths[text]] = 0
        return out

    named = last(own[:, 6] > 0)
    away = np.where(named < 0, 7, np.minimum(at - named, 7))
    assigned, linked = last(own[:, 7] == 1), last(own[:, 7] == 2)
    link = np.where(named < 0, 0, (assigned > named) + 2 * (linked > named))
    shape, level = own[:, 0], own[:, 5]
    file = np.array(files, np.int32).reshape(-1, 2)[text]
    columns = (
        shape, beside(shape, -1), beside(shape, -2), beside(shape, 1), beside(shape, 2), own[:, 1], own[:, 2],
        own[:, 3], own[:, 4], away, link, (level * 8 + away) * 4 + link, level * _SHAPES + beside(shape, -1),
        file[:, 0], file[:, 1],
    )
    return [column + start for column, start in zip(columns, _STARTS)]


def scores_of(weights: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Scores (tokens x labels), slot by slot."""
    out = np.zeros((len(columns[0]), weights.shape[1]))
    for column in columns:
        out += weights[column]
    return out


def _labels(spans: list[tuple[int, int]], wanted: list[tuple[int, int]]) -> list[int]:
    """Begin and inside on the tokens of the wanted spans."""
    out = [OUTSIDE] * len(spans)
    for start, end in wanted:
        inside = [i for i, (a, b) in enumerate(spans) if a < end and b > start]
        for n, i in enumerate(inside):
            out[i] = BEGIN if n == 0 else INSIDE
    return out


def _made_value(rng: random.Random, words: list[str]) -> str:
    """A value of another shape: random characters, or words joined as in a passphrase."""
    if rng.random() < 0.25 and len(words) >= 4:
        return rng.choice("-_.").join(rng.sample(words, rng.randrange(3, 5))) + rng.choice(("", rng.choice(DIGITS)))
    alphabet = rng.choice(ALPHABETS)
    while True:
        value = "".join(rng.choice(alphabet) for _ in range(rng.choice((8, 10, 12, 16, 20, 24, 32, 40))))
        if len(value) > 12 or any(c in DIGITS for c in value):
            return rng.choice(BEGINNINGS) + value


def variants(text: str, start: int, end: int, seed: int) -> list[tuple[str, int, int]]:
    """A match in its surroundings as it is, and ``VARIANTS`` times with another name, another
    way to join or another value, or with a plain word for a value: (text, start, end), an
    empty span where nothing is secret.

    So the field cannot lean on the keywords and shapes of the base patterns alone.
    """
    rng = random.Random(seed)
    line = max(text.rfind("\n", 0, start), start - 40)
    before = text[max(0, line - AROUND) : line + 1]
    after, value = text[end : end + AROUND], text[start:end]
    low = max(0, start - AROUND)
    out = [(text[low : end + AROUND], start - low, end - low)]
    words = [w for w in re.findall("[A-Za-z]{3,12}", before + after)]
    for k in range(VARIANTS):
        name, join = rng.choice(OTHER_NAMES), rng.choice(JOINS)
        close = join[-1] if join[-1] in "\"'" else ""
        kind = k % 4
        if kind == 3 and words:
            shown, close = rng.choice(words), ""
            if rng.random() < 0.5:
                shown = rng.choice((rng.choice(words) + str(rng.randrange(100)), str(rng.randrange(10**6)),
                                    f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1990, 2030)}"))
                name, join = rng.choice(words), " "
        elif kind == 0:
            shown = value
        else:
            shown = _made_value(rng, words)
            if rng.random() < 0.25 and len(shown) >= 20:
                name, join, close = (rng.choice(words) if words else ""), " ", ""
        if rng.random() < 0.3:
            name = name.title()
        ahead = before + " " + name + join
        tail = after if after[:1] not in "\"'" else after[1:]
        whole = ahead + shown + close + (" " if tail[:1].strip() else "") + tail
        out.append((whole, len(ahead), len(ahead) + len(shown)) if kind != 3 or not words else (whole, 0, 0))
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature rows and labels of training chains: variants of matches, and of one text in
    ``PLAIN`` a stretch without a match, both chosen by its hash."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        chains = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            found = values(text, base_spans(text))
            digest = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest())
            for a, b in found[:3]:
                chains += [(t, [(x, y)] if y else []) for t, x, y in variants(text, a, b, digest + a)]
            place = (digest >> 8) % max(len(text), 1)
            part = text[place : place + 3 * AROUND]
            if digest % PLAIN == 0 and not any(a < place + 3 * AROUND and b > place for a, b in found):
                chains.append((part, []))
        tokens, labels = [], []
        for part, wanted in chains:
            spans = [m.span() for m in TOKEN.finditer(part)]
            words, marks = [part[a:b] for a, b in spans], _labels(spans, wanted)
            # What looks like a secret and is none for all we know has no label.
            unknown = any(m == OUTSIDE and _looks(w)[5] >= 3 for w, m in zip(words, marks))
            if words and not unknown:
                tokens.append(words)
                labels.append(marks)
        grid = np.stack(features(tokens, [(0, 0)] * len(tokens)), axis=1)
        cuts = np.cumsum([0, *map(len, tokens)])
        rows = [grid[a:b].ravel().tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32()))],
            ["features", "labels"],
        )


def train(docs: DataFrame, sample_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Fit the field on about ``sample_rows`` documents, chosen by hash of doc_id.

    Labels are the values of the base matches, as they are and with names, joining signs
    and values changed (see :func:`variants`), so the field learns how secrets look and
    stand rather than the patterns; stretches of all sampled documents show what is none.
    A token of secret shape that no pattern matches has no label, and its stretch is left
    out. Without matches all weights are zero and nothing is tagged.
    """
    rows = sampled(docs.select("doc_id", "text"), sample_rows).select("text").mapInArrow(
        _examples, "features array<int>, labels array<int>"
    ).toPandas()
    if rows.empty or not any(max(r, default=0) for r in rows["labels"]):
        return np.zeros((_SIZE, 3)), np.zeros((3, 3))
    rows = rows.assign(key=[tuple(r) for r in rows["features"]]).drop_duplicates("key").sort_values("key")
    labels = np.concatenate(rows["labels"].to_numpy())
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows["labels"]])])
    grid = np.concatenate(rows["features"].to_numpy()).reshape(-1, _SLOTS)
    return crf.fit_chain(grid, labels.astype(int), starts, _SIZE, 3, steps=40, decay=0.2)


def _uncertain(scores: np.ndarray, firsts: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of tokens that some path may label other than outside, with one token more
    on either side.

    A token's neighbours can change the worth of its label by the spread of the moves on
    either side; one whose outside score leads by more is outside on the best path, and the
    chain parts there without loss.
    """
    lead = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1)
    near = lead <= 2.0 * (moves.max() - moves.min()) + 1e-9
    wide = near.copy()
    wide[:-1] |= near[1:]
    wide[1:] |= near[:-1]
    # A stretch ends with its text.
    begin = np.zeros(len(near) + 1, bool)
    begin[firsts] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], wide, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cuts = [a, *(np.flatnonzero(begin[a + 1 : b]) + a + 1).tolist(), b]
        out += [(x, y) for x, y in zip(cuts[:-1], cuts[1:]) if near[x:y].any()]
    return out


def tagged(texts: list[str], bases: list, model) -> list[list[tuple[int, int]]]:
    """Spans of each text that the field tags and no base match touches.

    Every token of every text is scored; the best path is found by Viterbi.
    """
    weights, moves = model
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    tokens = [TOKEN.findall(t) for t in texts]
    if not weights.any() or not any(tokens):
        return out
    lengths = np.array([len(t) for t in tokens], np.int64)
    firsts = np.cumsum(lengths) - lengths
    scores = scores_of(weights, features(tokens, [file_features(t) for t in texts]))
    chains = _uncertain(scores, firsts, moves)
    some: list[tuple[int, int]] = []
    groups = [some]
    for a, b in sorted(chains, key=lambda c: c[1] - c[0]):
        if some and (len(some) + 1) * (b - a) > 200_000:
            some = []
            groups.append(some)
        some.append((a, b))
    hits: dict[int, list[tuple[int, int]]] = {}
    for some in groups:
        if not some:
            continue
        cuts = np.cumsum([0, *(b - a for a, b in some)])
        labels = crf.viterbi(np.concatenate([scores[a:b] for a, b in some]), cuts, moves)
        for n, (a, b) in enumerate(some):
            found = labels[cuts[n] : cuts[n + 1]]
            if found.any():
                owner = int(np.searchsorted(firsts, a, side="right")) - 1
                while not lengths[owner]:
                    owner -= 1
                hits.setdefault(owner, []).extend((a - int(firsts[owner]) + k, int(found[k])) for k in np.flatnonzero(found))
    for owner, marks in hits.items():
        text, spans = texts[owner], [m.span() for m in TOKEN.finditer(texts[owner])]
        found, last = [], None
        for place, label in sorted(marks):
            if label == INSIDE and last == place - 1:
                found[-1][1] = spans[place][1]
            else:
                found.append(list(spans[place]))
            last = place
        touched = _Touch(bases[owner])
        for a, b in found:
            b = a + len(text[a:b].rstrip(ENDS))
            if b - a >= 6 and not touched(a, b):
                out[owner].append((a, b))
    return out


class _Touch:
    """Whether a span overlaps one of many."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [a for a, *_ in spans]
        self.ends = list(np.maximum.accumulate([b for _, b, *_ in spans])) if spans else []

    def __call__(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def joined(spans: list[tuple[int, int, int]], kinds: tuple) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_secrets(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Secrets of every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``base_sha256`` is that of ``kind:start:end`` of the base matches by start, comma-joined
    (code points, end exclusive); ``spans`` has these and, as kind ``field``, what the
    field tags besides. All tokens are tagged begin, inside or outside by Viterbi from their
    shape, the words around and features of the file; of equal paths the one with smaller
    labels. Very long texts part, without loss, where outside is certain. Null text is
    empty; repeated rows and null doc_ids stay rows; other columns are ignored, whatever
    their names. An empty table gives an empty table.
    """
    weights, moves = (a.tolist() for a in model)
    kinds = (*KINDS, "field")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = np.array(weights), np.array(moves)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = tagged(texts, bases, fitted)
            counts = [[sum(k == n for *_, k in base) for base in bases] for n in range(3)]
            shas = [hashlib.sha256(joined(base, kinds).encode()).hexdigest() for base in bases]
            every = [joined(base + [(a, b, 3) for a, b in extra], kinds) for base, extra in zip(bases, more)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(shas), pa.array(every, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
