"""SentencePiece encoding by a relational lattice, and decoding."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of text whose words form one pack.
PACK = 16_000_000
#: Groups by hash in which the distinct units of all packs meet.
BUCKETS = 4096
#: Longest unit with a lattice of its own; see :func:`encode`.
LONGEST = 256
MOST_PIECES = 1_000_000
#: Characters that tell which lengths of pieces can begin at a place.
HEAD = 3
RESULTS = ("n_tokens", "ids", "text_hash", "round_trip")
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    """A piece table: what a SentencePiece model file says, read on the driver."""

    names: list[str]
    scores: list[float]
    normal: list[int]
    bytes: dict[int, int]
    unknown: int

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if len(ids) > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        names = [model.id_to_piece(i) for i in ids]
        codes = {int(names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        normal = [
            i for i in ids
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        for i in normal:
            if SPACE in names[i].lstrip(SPACE) or "\n" in names[i]:
                raise ValueError(f"piece {i} reaches past a word")
        return cls(names, [model.get_score(i) for i in ids], normal, codes, model.unk_id())

    @property
    def longest(self) -> int:
        return max(len(self.names[i]) for i in self.normal)

    @property
    def unknown_score(self) -> float:
        return min(self.scores[i] for i in self.normal) - UNKNOWN_PENALTY

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            pd.DataFrame({
                "piece": [self.names[i] for i in self.normal],
                "id": np.array(self.normal, np.int32),
                "score": [self.scores[i] for i in self.normal],
            }),
            "piece string, id int, score double",
        )

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece has: its bytes, or the unknown piece."""
        data = char.encode()
        return [self.bytes[b] for b in data] if len(self.bytes) == 256 else [self.unknown]


class Cutter:
    """Cuts escaped text where no piece can reach across: between characters that no piece
    has side by side, so also before spaces and around characters such as line ends.

    What is still longer than ``LONGEST`` is cut where its best path has a piece's end, so the
    best paths of the parts make up that of the whole.
    """

    def __init__(self, pieces: Pieces):
        names = [pieces.names[i] for i in pieces.normal]
        alphabet = {c for n in names for c in n}
        #: Line ends and the like, when no piece has them, stand alone and need no lattice.
        self.alone = frozenset(c for c in "\n\t\r\x00\x0b\x0c" if c not in alphabet)
        pairs = {(ord(n[k]) << 21) | ord(n[k + 1]) for n in names for k in range(len(n) - 1)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.scores = {pieces.names[i]: pieces.scores[i] for i in pieces.normal}
        self.longest, self.unknown = pieces.longest, pieces.unknown_score

    def cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of all words, one after another, and the number of units of each word."""
        joined = "".join(words.to_pylist())
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = pc.utf8_length(words).to_numpy()
        starts = np.cumsum(lengths) - lengths
        begins = np.ones(len(chars), bool)
        if len(self.pairs):
            code = (chars[:-1] << 21) | chars[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            begins[1:] = self.pairs[at] != code
        begins[starts[lengths > 0]] = True
        firsts = np.flatnonzero(begins)
        sizes = np.diff(np.append(firsts, len(chars)))
        for k in np.flatnonzero(sizes > LONGEST):
            begins[firsts[k] + self._ends(joined[firsts[k] : firsts[k] + sizes[k]])] = True
        firsts = np.flatnonzero(begins)
        counts = np.add.reduceat(np.append(begins, False), starts) if len(starts) else np.zeros(0, int)
        counts = np.where(lengths > 0, counts, 0)
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        place = np.append(0, np.cumsum(width))
        offsets = np.append(place[firsts], place[-1]).astype(np.int32)
        data = pa.py_buffer(joined.encode())
        units = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(offsets), data)
        return units, counts.astype(np.int64)

    def _ends(self, unit: str) -> list[int]:
        """Where to cut a long unit: Viterbi with back pointers; the rule for ties is that of
        :func:`best_path`."""
        best, back = array("d", [0.0]), array("q", [0])
        scores, longest, unknown = self.scores, self.longest, self.unknown
        for end in range(1, len(unit) + 1):
            top, origin = float("-inf"), end - 1
            for start in range(max(0, end - longest), end):
                score = scores.get(unit[start:end], unknown if end - start == 1 else None)
                if score is not None and best[start] + score > top:
                    top, origin = best[start] + score, start
            best.append(top)
            back.append(origin)
        ends = [len(unit)]
        while ends[-1]:
            ends.append(back[ends[-1]])
        out, start, held = [], 0, 0
        for end in reversed(ends):
            if end - start > LONGEST and held > start:
                out.append(held)
                start = held
            held = end
        return out


def escaped(text: str) -> str:
    """Text as SentencePiece sees it: a space before, spaces as U+2581."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _planes(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers as one plane for each byte, which compresses better."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes, count: int, at: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, 4 * count, at).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _pack(pieces: Pieces, keep: int = 0):
    """Texts to packs of (pack, body).

    A body has twelve digits, the length of the next part; the distinct units of the pack in
    ``BUCKETS`` groups by hash (groups end with NUL, units in them with a line end, sorted);
    then, compressed, the texts as ranks of units by frequency and the place of each rank
    among the units, and the ``keep`` further columns of its rows as an Arrow stream.
    Negative ranks stand for single characters outside all pieces.
    """
    cutter = Cutter(pieces)

    def unit_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Units of all texts as numbers of distinct units (characters that stand alone as
        -1 - code point), the number of units of each text, and the distinct units."""
        # Words of plainly spaced texts are cut once each; any other text is one word.
        plain = (t[0] != " " and t[-1] != " " and "  " not in t if t else False for t in texts)
        column = [t if p else t.replace(" ", SPACE) or None for t, p in zip(texts, plain)]
        lists = pc.split_pattern(pa.array(column, pa.string()), " ")
        encoded = lists.values.dictionary_encode()
        words = encoded.indices.to_numpy()
        units, counts = cutter.cut(pc.binary_join_element_wise(SPACE, encoded.dictionary, ""))
        distinct = units.dictionary_encode()
        codes = distinct.indices.to_numpy().astype(np.int32)
        names = distinct.dictionary
        kept = np.ones(len(names), bool)
        alone = {at: c for c in cutter.alone if (at := pc.index(names, c).as_py()) >= 0}
        kept[list(alone)] = False
        number = np.cumsum(kept, dtype=np.int32) - 1
        for at, char in alone.items():
            number[at] = -1 - ord(char)
        codes = number[codes]
        ends = np.cumsum(counts)
        size = counts[words]
        to = np.cumsum(size)
        take = np.repeat((ends - counts)[words] - (to - size), size) + np.arange(to[-1] if to.size else 0)
        per_word = np.append(0, to)
        lengths = np.diff(per_word[lists.offsets.to_numpy()])
        return codes[take], lengths, names.filter(pa.array(kept))

    def flush(ids, texts, others) -> pa.RecordBatch:
        codes, lengths, units = unit_codes(texts)
        n_units = len(units)
        often = np.bincount(codes[codes >= 0], minlength=n_units)
        by_rank = np.argsort(-often, kind="stable")
        rank = np.empty(n_units, np.int32)
        rank[by_rank] = np.arange(n_units, dtype=np.int32)
        bucket = np.fromiter(
            (xxhash.xxh32_intdigest(u) % BUCKETS for u in units.to_pylist()), np.int32, n_units
        )
        order = pc.sort_indices(
            pa.table({"bucket": bucket, "unit": units}),
            sort_keys=[("bucket", "ascending"), ("unit", "ascending")],
        ).to_numpy()
        place = np.empty(n_units, np.int64)
        place[rank[order]] = np.arange(n_units)
        bounds = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).astype(np.int32)
        groups = pa.ListArray.from_arrays(pa.array(bounds), units.take(pa.array(order)))
        text = "\x00".join(pc.binary_join(groups, "\n").to_pylist()).encode()
        special = np.unique(codes[codes < 0])
        shown = codes.copy()
        for k, code in enumerate(special):
            shown[codes == code] = k
        shown[codes >= 0] = rank[codes[codes >= 0]] + len(special)
        head = np.array([len(ids), len(codes), n_units, len(special)], np.int64)
        hashes = [xxhash.xxh64_intdigest(t, seed=42) for t in texts]
        plain = b"".join([
            head.tobytes(), np.array([i is not None for i in ids], np.int64).tobytes(),
            np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array(hashes, np.uint64).tobytes(), lengths.astype(np.int64).tobytes(),
            special.astype(np.int64).tobytes(), _planes(place), _planes(shown), _stream(others),
        ])
        packed = zstandard.ZstdCompressor(level=4).compress(plain)
        key = xxhash.xxh64_intdigest(text + packed) - (1 << 63)
        body = b"%012d" % len(text) + text + packed
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array([body], pa.binary())], ["pack", "body"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, others, size = [], [], [], 0
        for batch in batches:
            rest, begin = batch.select(batch.schema.names[2:]) if keep else None, 0
            for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                text = text.as_py() or ""
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= PACK:
                    if keep:
                        others.append(rest.slice(begin, k + 1 - begin))
                    yield flush(ids, texts, others)
                    ids, texts, others, size, begin = [], [], [], 0, k + 1
            if keep and begin < batch.num_rows:
                others.append(rest.slice(begin))
        if ids:
            yield flush(ids, texts, others)

    return run


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    """Batches as one Arrow stream; nothing for none."""
    if not batches:
        return b""
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(batches).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _widths(pieces: Pieces, spark: SparkSession) -> DataFrame:
    """(head, widths): lengths of the pieces that begin with three characters."""
    lengths: dict[str, set[int]] = {}
    for i in pieces.normal:
        if len(pieces.names[i]) >= HEAD:
            lengths.setdefault(pieces.names[i][:HEAD], set()).add(len(pieces.names[i]))
    rows = [(head, sorted(found)) for head, found in lengths.items()]
    return spark.createDataFrame(rows, "head string, widths array<int>")


def edges(words: DataFrame, pieces: Pieces, key: str = "word") -> DataFrame:
    """Lattice of every word: the word's columns and end, start, id, score of each edge.

    Substrings up to the longest piece are joined to the piece table: those of one and two
    characters, and of the lengths that pieces with the same first three characters have, as
    no other substring can be a piece. A character that is no piece of its own has an edge
    with id -1 - code point and the unknown score.
    """
    spark = words.sparkSession
    table, left = pieces.frame(spark), F.length(key) - F.col("start")
    spans = words.withColumn("start", F.explode(F.sequence(F.lit(0), F.length(key) - 1)))
    spans = spans.withColumn("head", F.substring(F.col(key), F.col("start") + 1, F.lit(HEAD)))
    spans = spans.join(F.broadcast(_widths(pieces, spark)), "head", "left")
    short = F.slice(F.array(*[F.lit(k) for k in range(1, HEAD)]), F.lit(1), F.least(left, F.lit(HEAD - 1)))
    known = F.coalesce("widths", F.array().cast("array<int>"))
    spans = spans.withColumn("width", F.explode(F.concat(short, known))).where(F.col("width") <= left)
    spans = spans.withColumn("piece", F.substring(F.col(key), F.col("start") + 1, F.col("width")))
    joined = spans.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR width = 1")
    return joined.select(
        *words.columns, (F.col("start") + F.col("width")).alias("end"), "start",
        F.coalesce("id", -1 - F.ascii("piece")).alias("id"),
        F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
    )


def best_path(lattice: Column) -> Column:
    """Ids of the best-scoring path through an array of edges (end, start, id, score): Viterbi.

    The fold takes edges by end, then start. It holds the best score and ids of every place
    passed and of the place it is at; of equal scores the longer last piece stays. Every
    place must have an edge that ends there.
    """
    nothing = F.array().cast("array<int>")
    origin = F.struct(
        F.array().cast("array<struct<score:double,ids:array<int>>>").alias("passed"),
        F.lit(0).alias("at"), F.lit(0.0).alias("score"), nothing.alias("ids"),
    )

    def step(held: Column, e: Column) -> Column:
        here = F.struct(held["score"].alias("score"), held["ids"].alias("ids"))
        onward = e["end"] > held["at"]
        before = F.when(e["start"] == held["at"], here).otherwise(held["passed"][e["start"]])
        score = before["score"] + e["score"]
        better = onward | (score > held["score"])
        return F.struct(
            F.when(onward, F.concat(held["passed"], F.array(here))).otherwise(held["passed"]).alias("passed"),
            e["end"].alias("at"),
            F.when(better, score).otherwise(held["score"]).alias("score"),
            F.when(better, F.concat(before["ids"], F.array(e["id"]))).otherwise(held["ids"]).alias("ids"),
        )

    return F.aggregate(F.array_sort(lattice), origin, step, lambda held: held["ids"])


def encode_words(words: DataFrame, pieces: Pieces, by: list[str] | None = None) -> DataFrame:
    """Columns of ``words`` (one row for each ``word``) with the ids of its best path.

    ``by`` names further grouping columns that depend on the word, by which the rows lie.
    Other columns ride on one edge of each word only.
    """
    keys = [*(by or []), "word"]
    others = [c for c in words.columns if c not in keys]
    rest = F.struct(*others, F.lit(True).alias("_one"))
    rides = F.when((F.col("start") == 0) & (F.col("end") == 1), F.col("rest"))
    grouped = (
        edges(words.select(*keys, rest.alias("rest")), pieces)
        .withColumn("rest", rides).groupBy(*keys)
        .agg(
            F.first("rest", ignorenulls=True).alias("rest"),
            F.collect_list(F.struct("end", "start", "id", "score")).alias("lattice"),
        )
    )
    path = best_path(F.col("lattice")).alias("ids")
    return grouped.select(*keys, "rest.*", path).drop("_one")


def encode(
    docs: DataFrame, pieces: Pieces | None = None, keep: list[str] | None = None, prefix: str = ""
) -> DataFrame:
    """doc_id, n_tokens, ids, text_hash, round_trip of every row of ``docs`` (doc_id, text);
    with ``keep``, its columns of those names after doc_id, and ``prefix`` before the names
    of the four results.

    Text is escaped as SentencePiece does it (a space before, spaces as U+2581) and cut into
    units where no piece can reach across: before spaces, around characters such as line
    ends, and between characters that no piece has side by side. Tasks turn stretches of about ``PACK`` characters into packs of unit numbers. The
    distinct units of all packs meet by hash and become lattices (substrings joined to the
    piece table, edges grouped by unit, best path by a fold), once each, and return to their
    packs as dictionaries. So texts move once, as compressed numbers.

    The piece scores are the model's, summed along a path. A unit of more than ``LONGEST``
    characters with no such cut has its best path found first, by back pointers in the task that
    reads it, and is cut at ends of that path's pieces, so its parts lose nothing. Characters
    without a piece become byte pieces, or the unknown piece when the model has no bytes.

    Null text is empty text and has no ids; repeated rows and null doc_ids stay rows; columns
    that are not kept are ignored, whatever their names. text_hash is the 64-bit hash of the text; round_trip says whether
    the decoded ids have it.
    """
    pieces = pieces or Pieces.load()
    keep = keep or []
    others = [docs[f"`{c}`"].alias(f"other_{k}") for k, c in enumerate(keep)]
    packs = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *others)
        .mapInArrow(_pack(pieces, len(keep)), "pack long, body binary")
        .repartition("pack")
    )
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length = F.substring("body", 1, 12).cast("string").cast("int")
    groups = F.split(F.substring("body", F.lit(13), length).cast("string"), "\\x00", -1)
    placed = (
        packs.select("pack", F.posexplode(groups).alias("bucket", "units")).where("units <> ''")
        .repartition(tasks, "bucket")
        .select("bucket", "pack", F.posexplode(F.split("units", "\n", -1)).alias("number", "word"))
    )
    words = placed.groupBy("bucket", "word").agg(
        F.collect_list(F.struct("pack", "number")).alias("at")
    )
    found = (
        encode_words(words, pieces, ["bucket"])
        .select("bucket", F.explode("at").alias("at"), F.array_join("ids", " ").alias("ids"))
        .groupBy("bucket", "at.pack")
        .agg(F.array_sort(F.collect_list(F.struct("at.number", "ids"))).alias("found"))
        .select("bucket", "pack", F.array_join(F.transform("found", lambda e: e["ids"]), "\n").alias("found"))
    )
    named = found.groupBy("pack").agg(F.collect_list(F.struct("bucket", "found")).alias("found"))
    joined = packs.join(named, "pack", "left").select(
        "body", F.array_join(F.transform(F.array_sort("found"), lambda e: e["found"]), "\n").alias("entries")
    )
    shape = T.StructType([
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(f"other_{k}", docs.schema[c].dataType) for k, c in enumerate(keep)),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("text_hash", T.LongType()), T.StructField("round_trip", T.BooleanType()),
    ])
    return joined.mapInArrow(_unpack(pieces), shape).toDF("doc_id", *keep, *(prefix + name for name in RESULTS))


def _without_fallbacks(ids: np.ndarray, sizes: np.ndarray, pieces: Pieces):
    """Ids and sizes of rows with characters without a piece (-1 - code point) as bytes."""
    fallbacks = {i: pieces.fallback(chr(-1 - i)) for i in np.unique(ids[ids < 0]).tolist()}
    each = np.ones(len(ids), np.int64)
    for i, codes in fallbacks.items():
        each[ids == i] = len(codes)
    out = np.repeat(ids, each)
    starts = np.cumsum(each) - each
    for i, codes in fallbacks.items():
        for k, code in enumerate(codes):
            out[starts[ids == i] + k] = code
    row = np.repeat(np.arange(len(sizes)), sizes)
    return out, np.bincount(row, weights=each, minlength=len(sizes)).astype(np.int64)


def _unpack(pieces: Pieces):
    decoded = _decoder(pieces)

    def texts(body: bytes, entries: str | None) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress(body[12 + int(body[:12]) :])
        n, m, n_units, n_special = np.frombuffer(plain, np.int64, 4).tolist()
        at = 32 + 32 * n
        has, ids, hashes, lengths = np.frombuffer(plain, np.int64, 4 * n, 32).reshape(4, n)
        special = np.frombuffer(plain, np.int64, n_special, at)
        place = _from_planes(plain, n_units, at + 8 * n_special)
        codes = _from_planes(plain, m, at + 8 * n_special + 4 * n_units)
        rest = plain[at + 8 * n_special + 4 * (n_units + m) :]
        others = pa.ipc.open_stream(rest).read_all().combine_chunks() if rest else None
        data = np.frombuffer((entries or "").encode(), np.uint8)
        line_ends = np.flatnonzero(data == 10)
        if len(line_ends) + bool(len(data)) != n_units:
            raise ValueError("a pack met units of another pack; the input must not change between reads")
        found = np.array((entries or "").split(), np.int32)
        spaces = np.cumsum(data == 32)
        sizes = np.diff(np.concatenate([[0], spaces[line_ends], spaces[-1:]])) + 1
        if (found < 0).any():
            found, sizes = _without_fallbacks(found, sizes, pieces)
        alone = [np.array(pieces.fallback(chr(-1 - code)), np.int32) for code in special.tolist()]
        begins = np.cumsum(sizes) - sizes
        ahead = sum(map(len, alone))
        alone_sizes = np.array([len(a) for a in alone], np.int64)
        begins = np.concatenate([np.cumsum(alone_sizes) - alone_sizes, begins[place] + ahead])
        sizes = np.concatenate([alone_sizes, sizes[place]])
        flat_ids = np.concatenate([*alone, found])
        ends = np.cumsum(lengths)
        for low in range(0, n, 500):
            high = min(low + 500, n)
            part = codes[ends[low] - lengths[low] : ends[high - 1]]
            size = sizes[part]
            to = np.cumsum(size)
            take = np.repeat(begins[part] - (to - size), size) + np.arange(to[-1] if to.size else 0)
            per_unit = np.concatenate([[0], to])
            cuts = np.concatenate([[0], np.cumsum(lengths[low:high])])
            offsets = per_unit[cuts]
            lists = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(flat_ids[take])
            )
            back = np.array(
                [xxhash.xxh64_intdigest(t, seed=42) for t in decoded(lists)], np.uint64
            ).view(np.int64)
            kept = [] if others is None else [
                c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                for c in others.slice(low, high - low).columns
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[low:high], mask=has[low:high] == 0), *kept, pa.array(np.diff(offsets)),
                    lists, pa.array(hashes[low:high]), pa.array(back == hashes[low:high]),
                ],
                ["doc_id", *(others.schema.names if kept else []), *RESULTS],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, entries in zip(batch.column("body"), batch.column("entries")):
                yield from texts(body.as_py(), entries.as_py())

    return run


def _decoder(pieces: Pieces):
    """Function from an array of id lists to their texts, by the bytes of the pieces."""
    raw: list[bytes] = [n.encode() for n in pieces.names]
    for value, i in pieces.bytes.items():
        raw[i] = bytes([value])
    letters = np.frombuffer(b"".join(raw), np.uint8)
    widths = np.array([len(r) for r in raw], np.int64)
    begins, mark = np.cumsum(widths) - widths, SPACE.encode()

    def texts(column: pa.Array) -> Iterator[str | None]:
        for low in range(0, len(column), 500):
            part = column.slice(low, 500)
            flat = part.flatten().to_numpy(zero_copy_only=False)
            size = widths[flat]
            ends = np.cumsum(size)
            take = np.repeat(begins[flat] - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)
            data = letters[take].tobytes()
            bounds = np.concatenate([[0], ends])
            lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            cuts = bounds[np.concatenate([[0], np.cumsum(lengths)])]
            for k, known in enumerate(part.is_valid().to_pylist()):
                text = data[cuts[k] : cuts[k + 1]].replace(mark, b" ")[1:]
                yield text.decode("utf-8", "replace") if known else None

    return texts


def decode(encoded: DataFrame, pieces: Pieces | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids; a null array gives null text.

    The exact inverse of :func:`encode` for texts without U+2581, when the model has byte
    pieces. Ids outside the table raise an error; byte pieces that form no UTF-8 become
    replacement characters.
    """
    pieces = pieces or Pieces.load()
    decoded, fields = _decoder(pieces), encoded.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array(decoded(batch.column(ids)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return encoded.mapInArrow(run, f"{shape}, decoded string")
