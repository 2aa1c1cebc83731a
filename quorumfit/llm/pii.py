"""Personal data in text: base patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.llm import crf
from quorumfit.llm.secrets import joined
from quorumfit.llm.tables import sampled
from quorumfit.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile("[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile("\\+[0-9][\x20().0-9-]+[0-9]")
#: A token that can be data by itself: it has a digit or an at sign. Other tokens can only be
#: data by what they are like, and are looked for by name.
TOKEN = re.compile(
    "(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*"
)
EDGE = "\"'()[]{}<>,;:!?*#$%&|"

OTHER = 4
_SLOTS = 9
_SIZE = 128
#: Ways to be like another token, by which sets are formed; 0 is none.
WAYS = {"same": 1, "digits": 2, "name": 3}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern: every at sign with the run before and a domain after."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + n % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and apart for each kind."""
    found = [(a, b, 0) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in re.split(r"\.0*", "." + m[0])[1:]):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), 3))
    return sorted(found)


def _features(token: str, before: str, after: str, like: int = 0) -> tuple:
    """Feature numbers of a token; ``like`` is the way in which it is like a base match."""
    digits = sum("0" <= c <= "9" for c in token)
    dots, dashes = min(token.count("."), 3), min(token.count("-"), 3)
    local = token.partition("@")
    return (
        min(digits, 19), 20 + min(len(token) // 4, 7),
        28 + 2 * ("@" in token) + (bool(local[1]) and "." in local[2]),
        32 + 4 * dots + dashes, 48 + ("+" in token) + 2 * ("(" in token or ")" in token),
        52 + min(max((len(p) for p in re.findall("[0-9]+", token)), default=0), 19),
        72 + (digits == len(token)) + 2 * any(c.isalpha() for c in token),
        76 + (before[-1:] == "+") + 2 * after[:1].isdigit(), 80 + like,
    )


#: Pairs of like tokens with one label that are assumed besides those seen.
AGREE = 50.0
#: Shortest name before an at sign that is looked for elsewhere.
NAME = 3


def _tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the tokens of the graph: those with a digit or an at sign, and those that
    repeat the name of an address of the text."""
    found, names = [], set()
    for m in TOKEN.finditer(text):
        token = m[0].strip(EDGE)
        if token:
            start = m.start() + m[0].index(token)
            found.append((start, start + len(token)))
    for a, b, k in base:
        if k == 0:
            names.add(text[a:b].partition("@")[0].lower())
    plain = sorted(n for n in names if len(n) >= NAME and not any("0" <= c <= "9" for c in n))
    if plain:
        # Letters fold one to one here, so places in the folded text are places in the text.
        low = text.translate(_FOLD)
        word = "|".join(map(re.escape, plain))
        for m in re.finditer(f"(?<![^\x20\x09-\x0D{re.escape(EDGE)}])(?:{word})(?![^\x20\x09-\x0D{re.escape(EDGE)}.])", low):
            found.append(m.span())
    return sorted(set(found))


_FOLD = {c: c + 32 for c in range(65, 91)}


def _keys(token: str) -> set[tuple]:
    """What a token is like: its letters and digits, six digits or more, a name."""
    letters = "".join(c for c in token.lower() if c.isalnum())
    keys = {("same", letters)} if letters else set()
    digits = _digits(token)
    if len(digits) >= 6:
        keys.add(("digits", digits))
    name = token.partition("@")[0].lower().rstrip(".")
    if len(name) >= NAME:
        keys.add(("name", name))
    return keys


@dataclass
class Graph:
    """Tokens of all texts and the edges between them and their hubs.

    Chain edges (kind 0) join tokens side by side. The tokens of a document that are alike
    in one way form a set, however far apart, and skip edges (kind 1) join each of them to
    the set's hub, a variable without a token: edges grow with the tokens, and every
    repeat is two edges from every other. Hubs are numbered after the tokens. ``unsure``
    marks unmatched tokens that share a set with a match.
    """

    spans: list
    owners: list
    rows: np.ndarray
    labels: np.ndarray
    edges: np.ndarray
    kinds: np.ndarray
    pairs: np.ndarray
    unsure: np.ndarray
    hubs: int


def _graph(texts: list[str], bases: list) -> Graph:
    spans, owners, around, labels, edges, kinds, pairs = [], [], [], [], [], [], []
    like: dict[int, int] = {}
    sets: list[tuple[int, ...]] = []
    for i, text in enumerate(texts):
        alike: dict[tuple, list[int]] = {}
        base, at, previous = bases[i], 0, None
        for start, end in _tokens(text, base):
            token, me = text[start:end], len(spans)
            while at < len(base) and base[at][1] <= start:
                at += 1
            label = next((k for a, b, k in base[at : at + 4] if a < end and b > start), OTHER)
            spans.append((start, end))
            owners.append(i)
            labels.append(label)
            around.append((token, text[max(0, start - 1) : start], text[end + 1 : end + 2]))
            if previous is not None and start - spans[previous][1] <= 3:
                edges.append((previous, me))
                kinds.append(0)
            previous = me
            for key in _keys(token):
                alike.setdefault(key, []).append(me)
        for (way, _), members in alike.items():
            if any(labels[m] != OTHER for m in members):
                like |= {m: max(WAYS[way], like.get(m, 0)) for m in members if labels[m] == OTHER}
        sets += sorted({tuple(members) for members in alike.values() if len(members) > 1})
    for hub, members in enumerate(sets):
        edges += [(m, len(spans) + hub) for m in members]
        kinds += [1] * len(members)
        pairs += zip(members, members[1:])
    unsure = np.zeros(len(spans), bool)
    unsure[list(like)] = True
    rows = [_features(*a, like.get(k, 0)) for k, a in enumerate(around)]
    return Graph(
        spans, owners, np.array(rows, np.int32).reshape(-1, _SLOTS), np.array(labels, np.int64),
        np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64),
        np.array(pairs, np.int64).reshape(-1, 2), unsure, len(sets),
    )


def _repeats(token: str, label: int) -> list[tuple]:
    """Made examples of what repeats a match without being one: the name of an address, the
    digits alone, the token without its signs."""
    digits = _digits(token)
    made = [("".join(c for c in token if c.isalnum()), "same")]
    if len(digits) >= 6:
        made += [(digits, "digits"), (digits[:3] + "-" + digits[3:], "digits")]
    name = token.partition("@")[0]
    if label == 0 and "@" in token and len(name) >= NAME:
        made += [(name, "name"), (name.title(), "name")]
    return [(*_features(t, " ", " ", WAYS[way]), label) for t, way in made if t]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature rows with their label, and label pairs along edges. Tokens that are like a match
    and match nothing have no label; made repeats of the matches stand for them."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        graph = _graph(texts, [base_spans(t) for t in texts])
        sure = ~graph.unsure
        data = [
            (*row, label) for row, label in zip(graph.rows[sure].tolist(), graph.labels[sure].tolist())
        ]
        for k in np.flatnonzero(graph.labels != OTHER):
            a, b = graph.spans[k]
            data += _repeats(texts[graph.owners[k]][a:b], int(graph.labels[k]))
        chain = graph.edges[graph.kinds == 0]
        for kind, found in enumerate((chain, graph.pairs)):
            kept = found[sure[found].all(axis=1)] if len(found) else found
            data += [(-1 - kind, *graph.labels[pair].tolist()) for pair in kept]
        yield pa.RecordBatch.from_arrays([pa.array(data, pa.list_(pa.int64()))], ["row"])


def train(docs: DataFrame, sample_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Token weights and the two edge potentials, from about ``sample_rows`` documents.

    Labels are the base matches, and repeats made of them (:func:`_repeats`), so that what a
    match's set says of a token is learnt beside what it looks like. Documents are
    chosen by hash of doc_id; equal examples are counted in Spark and come as one row, and
    weigh as often as they were counted. Like tokens are assumed to agree ``AGREE`` times
    for every label before any pair is seen.
    """
    counts = (
        sampled(docs.select("doc_id", "text"), sample_rows).select("text")
        .mapInArrow(_examples, "row array<long>").groupBy("row").count().toPandas()
    )
    weights, potentials = np.zeros((_SIZE, 5)), np.zeros((2, 5, 5))
    if counts.empty:
        return weights, potentials
    counts = counts.assign(row=[tuple(r) for r in counts["row"]]).sort_values("row")
    rows, many = counts["row"].tolist(), counts["count"].to_numpy(float)
    kind = np.array([r[0] for r in rows])
    tokens = np.array([r for r in rows if r[0] >= 0], np.int64).reshape(-1, _SLOTS + 1)
    weights = crf.fit_unary(tokens[:, :-1], tokens[:, -1], _SIZE, 5, counts=many[kind >= 0])
    for k in range(2):
        pairs = np.array([r[1:] for r in rows if r[0] == -1 - k], np.int64).reshape(-1, 2)
        potentials[k] = crf.pair_potential(
            pairs[:, 0], pairs[:, 1], 5, many[kind == -1 - k], agree=AGREE * k
        )
    potentials[1] = (potentials[1] + potentials[1].T) / 2
    return weights, potentials


def marginals(graph: Graph, model) -> np.ndarray:
    """Label marginals of the tokens; those of base matches keep their label."""
    weights, potentials = model
    scores = np.concatenate([crf.unary(weights, graph.rows), np.zeros((graph.hubs, OTHER + 1))])
    known = np.flatnonzero(graph.labels != OTHER)
    scores[known] -= 50.0
    scores[known, graph.labels[known]] += 100.0
    return crf.loopy_marginals(scores, graph.edges, potentials, graph.kinds)[: len(graph.spans)]


def labelled(texts: list[str], bases: list, model, sure: float = 0.9) -> list[list]:
    """(start, end, kind) of tokens that the field is sure of and no base match touches."""
    graph = _graph(texts, bases)
    out: list[list] = [[] for _ in texts]
    if not graph.spans or not model[0].any():
        return out
    found = marginals(graph, model)
    best = found[:, :OTHER].argmax(1)
    certain = found[np.arange(len(best)), best] >= sure
    for k in np.flatnonzero(certain & (graph.labels == OTHER)):
        out[graph.owners[k]].append((*graph.spans[k], int(best[k])))
    return out


def find_personal_data(docs: DataFrame, model) -> DataFrame:
    """Personal data of every row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and ``base_sha256`` are of the base matches (``kind:start:end`` by start, then
    kind, comma-joined; code points, end exclusive); ``spans`` has these and the tokens that
    the field labels besides, under the same kinds. The field's graph has all tokens with a
    digit or an at sign, and all that repeat the name of an address; neighbours and distant
    repeats share potentials, and loopy messages, sent until they settle, make their labels
    agree over the whole text, however long. Spans that start together go by kind. Null
    text is empty; repeated rows and null doc_ids stay rows; other columns are ignored,
    whatever their names. An empty table gives an empty table.
    """
    weights, potentials = (a.tolist() for a in model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = np.array(weights), np.array(potentials)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = labelled(texts, bases, fitted)
            counts = [[sum(k == n for *_, k in base) for base in bases] for n in range(4)]
            shas = [hashlib.sha256(joined(base, KINDS).encode()).hexdigest() for base in bases]
            every = [joined(base + extra, KINDS) for base, extra in zip(bases, more)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(shas), pa.array(every, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string"
    )
