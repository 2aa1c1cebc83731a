"""The pipeline's stages against plain versions, and a whole run."""

import brute
import corpus_pipeline as P
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumfit.llm import language_id, mixing, piece_lattice


@pytest.fixture(scope="module")
def folder(spark, odd, docs, tmp_path_factory):
    """Documents with odd rows and further columns whose names clash."""
    path = str(tmp_path_factory.mktemp("tables"))
    strange = odd.where("doc_id IS NOT NULL").select(
        (F.col("doc_id") + 10_000_000).alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )
    more = docs.unionByName(strange).withColumns(
        {"score": F.lit(1.0), "kept": F.lit("x"), "rejected": F.lit(None).cast("int"), "size": F.lit(7)}
    )
    more.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def table(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _rows(df):
    return df.select("doc_id", "text").toPandas()


def test_stages_are_named():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "encoding"]


def test_language_stage_keeps_clean_documents(spark, table, folder):
    kept = P.known_language(spark, table, folder)
    assert kept.columns == table.columns
    before, after = _rows(table), _rows(kept)
    gone = before[~before.doc_id.isin(after.doc_id)]
    has_letter = before.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert not set(before[~has_letter].doc_id) & set(after.doc_id)
    assert len(gone[gone.doc_id < 10_000_000]) <= 0.01 * len(before)
    judged = language_id.identify(table, language_id.train(table)).where("NOT rejected")
    assert sorted(r.doc_id for r in judged.collect()) == sorted(after.doc_id)


def test_exact_stage(spark, table, folder):
    kept = P.without_copies(spark, table, folder)
    assert kept.columns == table.columns
    best = {}
    for doc_id, text in _rows(table).values:
        best[brute.lower(text)] = max(doc_id, best.get(brute.lower(text), -1))
    assert sorted(_rows(kept).doc_id) == sorted(best.values())


def test_near_stage(spark, table, folder):
    plain = P.without_copies(spark, table, folder)
    kept = P.without_near_copies(spark, plain, folder)
    assert kept.columns == table.columns
    classes = brute.near_classes([(i, t) for i, t in _rows(plain).values], 80)
    assert sorted(_rows(kept).doc_id) == sorted(i for i, (_, c) in classes.items() if i == c)


def test_mixing_stage(spark, docs, folder):
    taken = P.mixed(spark, docs, folder)
    assert taken.columns == docs.columns
    times = taken.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    want = mixing.mix(docs).where("copies > 0").toPandas().set_index("doc_id")["copies"]
    assert times.sort_index().to_dict() == want.sort_index().to_dict()


def test_whole_run(spark, folder, table):
    out = P.run(spark, folder)
    texts = piece_lattice.decode(out).select("doc_id", "decoded").toPandas()
    known = dict(_rows(table).drop_duplicates("doc_id").values)
    assert len(texts) and all(known[i] == t for i, t in texts.values)
    assert texts.groupby("doc_id").size().max() <= 2
    seen = {brute.lower(t) for t in texts.decoded}
    assert len(seen) == texts.doc_id.nunique()


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert isinstance(P.run(spark, str(tmp_path)).toPandas(), pd.DataFrame)


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
#: Rows that share a doc_id or have none, and columns with the names that stages use inside.
SHARED = [
    (1, "same text", "a"), (2, "same text", "a"), (1, "only here", "a"), (2, "Same Text", "b"),
    (3, LONG, "a"), (4, LONG + " eighteen", "a"), (4, "totally other words that nobody else has in a text", "b"),
    (None, LONG + " and more", "a"), (None, "no id and like no other text of all the texts that are here", None),
    (None, "no id and like no other text of all the texts that are here", None), (5, None, "a"), (6, "", "a"),
]
CLASH = ["_id", "_copies", "_turn", "row", "id", "sha", "copies", "own_doc_id", "text_hash", "again", "number", "kept", "ids"]


@pytest.fixture(scope="module")
def shared(spark):
    rows = [(*r, *[f"{k}{c}" for c in CLASH]) for k, r in enumerate(SHARED)]
    shape = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, shape).withColumn("lang", F.lit("en"))


def _texts(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())


def test_exact_stage_judges_rows_not_ids(spark, shared):
    kept = P.without_copies(spark, shared, "")
    assert kept.columns == shared.columns
    got = _texts(kept)
    assert len(got) == len({brute.lower(t) for _, t in got}) == len({brute.lower(t) for _, t, _ in SHARED})
    assert ("1", "only here") in got and ("1", "same text") not in got and ("6", "") in got


def test_near_stage_judges_rows_not_ids(spark, shared):
    plain = P.without_copies(spark, shared, "")
    kept = P.without_near_copies(spark, plain, "")
    got = _texts(kept)
    assert kept.columns == shared.columns
    assert ("4", "totally other words that nobody else has in a text") in got and ("3", LONG) in got
    assert ("4", LONG + " eighteen") not in got and ("None", LONG + " and more") not in got
    assert sum(t.startswith("no id") for _, t in got) == 1 and ("1", "only here") in got


def test_mixing_stage_takes_rows_not_ids(spark, shared):
    taken = P.mixed(spark, shared, "")
    assert taken.columns == shared.columns
    want = mixing.mix(shared).toPandas()
    assert len(want) == len(SHARED)
    words = taken.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words == want.taken.sum()
    # Every row as often as one of the rows like it is due.
    rows = taken.groupBy("_id").count().toPandas()["count"]
    assert rows.max() <= 2 and rows.sum() == want.copies[want["size"] > 0].sum()


def test_encoding_stage_carries_the_columns(spark, shared):
    out = P.encoded(spark, shared, "")
    assert set(shared.columns) - {"text"} <= set(out.columns) and "__ids" not in out.columns
    names = [c for c in out.columns if c not in shared.columns]
    assert names == ["_n_tokens", "_ids", "_text_hash", "_round_trip"]
    back = piece_lattice.decode(out, ids="_ids").collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == _texts(shared)
    assert {(r["_id"], r.decoded) for r in back} == {(f"{k}_id", t or "") for k, (_, t, _) in enumerate(SHARED)}


def test_all_stages_on_shared_ids(spark, shared, tmp_path):
    shared.write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    assert "source" in out.columns and out.where("NOT _round_trip").count() == 0
