"""Encoding: best paths by brute force, exact round trips, and the library's own lattice."""

import math
import random
from types import SimpleNamespace

import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from quorumfit.llm import piece_lattice as P


def _best(unit, pieces, by_name):
    """Best score of a unit over all segmentations."""
    best = [0.0] + [-math.inf] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(max(0, end - pieces.longest), end):
            name = unit[start:end]
            if name in by_name:
                score = pieces.scores[by_name[name]]
            elif end - start == 1:
                score = pieces.unknown_score
            else:
                continue
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_paths_are_the_best(spark, plain):
    pieces = P.Pieces.load()
    by_name = {pieces.names[i]: i for i in pieces.normal}
    words = sorted({P.SPACE + w for t in plain.text for w in t.split()})[:4000]
    got = P.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces)
    rows = got.collect()
    assert len(rows) == len(words)
    for r in rows:
        score = sum(pieces.scores[i] if i >= 0 else pieces.unknown_score for i in r.ids)
        assert score == _best(r.word, pieces, by_name), r


def test_same_as_the_library_in_unigram_mode(spark, plain):
    model = proto.ModelProto()
    model.ParseFromString(open(P.MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = sorted({w for t in plain.text for w in t.split()})[:3000]
    got = P.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"))
    same = sum(list(r.ids) == library.encode(words[r.doc_id]) for r in got.collect())
    assert same >= 0.999 * len(words)


def test_round_trip_of_the_table(docs):
    back = P.decode(P.encode(docs)).join(docs.select("doc_id", "text"), "doc_id")
    assert back.count() == docs.count() and back.where("decoded <> text").count() == 0


def test_round_trip_of_odd_rows(spark, odd, none):
    got = P.decode(P.encode(odd)).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted(
        (str(r.doc_id), r.text or "") for r in odd.collect()
    )
    assert all(len(r.ids) == r.n_tokens and r.round_trip for r in got)
    assert all(
        r.same for r in P.encode(odd).join(odd, "doc_id").select(
            (F.col("text_hash") == F.xxhash64(F.coalesce("text", F.lit("")))).alias("same")).collect()
    )
    assert P.encode(none).count() == 0
    texts = [" ", "  a", "a  b ", "\n", "a\n\nb\t c", "☃☃x", "日本語テキスト" * 200, "1234 5678", "x" * 1000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.decoded for r in P.decode(P.encode(rows)).collect()} == dict(enumerate(texts))


def test_many_small_packs_give_the_same(docs, monkeypatch):
    want = {r.doc_id: r.ids for r in P.encode(docs).collect()}
    monkeypatch.setattr(P, "PACK", 10_000)
    assert {r.doc_id: r.ids for r in P.encode(docs).collect()} == want


def test_cuts_are_where_no_piece_reaches():
    cutter = P.Cutter(P.Pieces.load())
    text = "ab" * 40 + "\n" + "☃é" * 50 + " tail, end."
    units, counts = cutter.cut(pa.array([P.escaped(text), "", "a"]))
    units, alone = units.to_pylist(), cutter.alone
    assert counts.tolist() == [len(units) - 1, 0, 1] and units.pop() == "a"
    assert "".join(units) == P.SPACE + text.replace(" ", P.SPACE)
    assert "\n" in alone and "\n" in units and "▁tail" in units and "," in units


def test_long_units_have_the_best_path_of_the_whole():
    """Parts of a unit above LONGEST add up to the score of the unit without cuts."""
    pieces = P.Pieces.load()
    by_name = {pieces.names[i]: i for i in pieces.normal}
    cutter = P.Cutter(pieces)
    fixed = SimpleNamespace(
        longest=pieces.longest, scores=pieces.scores, unknown_score=pieces.unknown_score
    )
    rng = random.Random(7)
    texts = ["the" * 400, "e" * 3001, "-" * 999] + ["".join(rng.choices("abcdeinorst", k=2000)) for _ in range(5)]
    for text in texts:
        parts = cutter.cut(pa.array([text]))[0].to_pylist()
        assert "".join(parts) == text and max(map(len, parts)) <= P.LONGEST
        assert math.isclose(sum(_best(u, fixed, by_name) for u in parts), _best(text, fixed, by_name))
