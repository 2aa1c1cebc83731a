"""Language models: brute force, held-out accuracy, probabilities, rejection, many languages."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumfit.llm import language_id


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    asked = docs.where(language_id.held_out(F.col("doc_id")))
    got = language_id.identify(asked, model, keep=["lang"]).toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.995
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.02


def _packed(grams):
    codes = np.array([[ord(c) for c in g] for g in grams], np.int64)
    return codes[:, 0], (codes[:, 1] << 42) | (codes[:, 2] << 21) | codes[:, 3]


def test_probabilities_of_a_context_add_up(model):
    """P(. | c1 c2 c3) over the alphabet is 1, less what unseen letters are left."""
    letters = sorted({c for c in "abcdefghijklmnopqrstuvwxyzäöüßéèêçàñóíúá "})
    for context in ("the", " th", "qqq"):
        total = np.exp2(model.log2("en", *_packed([context + c for c in letters]))).sum()
        assert 0.97 < total <= 1.001  # each unseen letter has what is left for one


def _clean(text):
    kept = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    return " " + " ".join(kept.split()) + " " if kept.strip() else ""


class _Plain:
    """Interpolated Kneser-Ney with dictionaries, as it is told."""

    def __init__(self, texts):
        self.counts = {4: Counter()}
        for t in map(_clean, texts):
            padded = "  " + t
            self.counts[4].update(padded[i - 3 : i + 1] for i in range(3, len(padded)))
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.totals, self.types, self.discount = {}, {}, {}
        for k, counts in self.counts.items():
            one, two = (sum(n == m for n in counts.values()) for m in (1, 2))
            self.discount[k] = min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5
            self.totals[k], self.types[k] = defaultdict(int), defaultdict(int)
            for g, n in counts.items():
                self.totals[k][g[:-1]] += n
                self.types[k][g[:-1]] += 1

    def p(self, gram):
        p = 1 / (len(self.counts[1]) + 1)
        for k in (1, 2, 3, 4):
            g, d = gram[4 - k :], self.discount[k]
            if total := self.totals[k].get(g[:-1], 0):
                p = min((max(self.counts[k].get(g, 0) - d, 0) + d * self.types[k][g[:-1]] * p) / total, 1.0)
        return p

    def entropy(self, text):
        padded = "  " + _clean(text)
        grams = [padded[i - 3 : i + 1] for i in range(3, len(padded))]
        return -sum(math.log2(self.p(g)) for g in grams) / len(grams)


SMALL = [
    ("en", "The one of that, and there is the other one!"), ("en", "of the the of 12 them"), ("en", ""), ("en", "  ?? "),
    ("xx", "𐐀𐐁𐐂 𐐨𐐀 𐐁𐐁"), ("xx", "𝒳𝒴 ab 𐐀b"), ("de", "Ärger über Öl und ßt"), (None, "nobody's"), ("de", None),
]


def test_models_equal_brute_force(spark, monkeypatch):
    """Also letters beyond 16 bits, each its own, and texts that go in parts."""
    docs = spark.createDataFrame(SMALL * 2, "lang string, text string").repartition(3)
    texts = ["the thing of them", "𐐀𐐁 𐐩 ab", "Über dem Öl", "zzz 9 zzz", "a", "one-of,them  "]
    want = {
        lang: [_Plain([t for k, t in SMALL * 2 if k == lang and t]).entropy(t) for t in texts]
        for lang in ("en", "xx", "de")
    }
    for stretch in (language_id.STRETCH, 3, 1):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        model = language_id.train(docs)
        assert model.languages == ["de", "en", "xx"]
        got = language_id.entropies(model, texts, ["en", "xx", "de"])[0]
        for j, lang in enumerate(("en", "xx", "de")):
            assert np.abs(got[:, j] - want[lang]).max() < 1e-9


def test_groups_of_languages_give_the_same(spark, model, monkeypatch):
    """More than 200 languages, in one pass and in many."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    many = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 60).cast("string")))
    asked = docs.where("doc_id < 60")
    keep = ["doc_id", "text"]
    one = language_id.train(many)
    want = language_id.identify(asked, one, keep=keep).toPandas().sort_values("doc_id", ignore_index=True)
    monkeypatch.setattr(language_id, "ARRAY_BYTES", max(1 << 20, 1))
    several = language_id.train(many)
    assert len(one.languages) > 100 and len(one.groups) == 1 and 3 < len(several.groups) < 100
    got = language_id.identify(asked, several, keep=keep).toPandas().sort_values("doc_id", ignore_index=True)
    assert list(got.columns) == ["doc_id", "text", "lang_pred", "score", "entropy", "rejected"]
    assert (got.lang_pred == want.lang_pred).all() and (got.rejected == want.rejected).all()
    assert np.allclose(got.score, want.score) and np.allclose(got.entropy.fillna(-1), want.entropy.fillna(-1))


def test_201_languages(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 30, f"l{k}") for k in range(201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.train(docs), keep=["lang"]).toPandas()
    assert (got.lang == got.lang_pred).all() and not got.rejected.any()


def test_noise_and_empty_text_are_rejected(spark, model, odd, none):
    rows = [(1, "qxj zvkq xxqz jjvq wqpx " * 20), (2, "12 !!"), (3, None), (4, "")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model)
    got = {r.doc_id: r for r in got.collect()}
    assert all(got[k].rejected for k in got)
    assert got[1].lang_pred != "und" and all(got[k].lang_pred == "und" for k in (2, 3, 4))
    assert all(got[k].score == 0 and got[k].entropy is None for k in (2, 3, 4))
    assert language_id.identify(odd, model).count() == odd.count()
    assert language_id.identify(none, model).count() == 0


def test_case_and_signs_do_not_matter(spark, model):
    rows = [(1, "The one of that and there"), (2, "THE!! ONE## OF %% THAT and there?")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert len({(r.lang_pred, round(r.entropy, 9)) for r in got.collect()}) == 1


def test_nothing_to_learn_from(none, odd):
    empty = language_id.train(none)
    got = language_id.identify(odd, empty).collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_long_texts_are_cut_into_stretches(monkeypatch, model):
    text = "the one of that and there " * 4000
    whole, _, n = language_id.entropies(model, [text], ["en"])
    monkeypatch.setattr(language_id, "STRETCH", 5000)
    parts, _, m = language_id.entropies(model, [text], ["en"])
    assert abs(whole - parts).max() < 1e-9 and n[0] == m[0]
