"""Ids and other columns that pandas would change come back as they were."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapgauge.llm import fingerprints, language, line_dedup, pieces, quality, warc
from tests.conftest import SF_SMALL

BIG = (1 << 53) + 1
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, lang_pred string, score string, till timestamp, links long"
LATE = datetime(9999, 12, 31)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, documents):
    good = documents.filter("lang = 'en'").first()["text"]
    rows = [(doc, good if doc else text, "en", None, n, "own", "xx", "s", LATE, links) for doc, text, n, links in (
        (BIG, good, 7, None), (None, good, None, BIG), (-(1 << 63), "", 0, 1), (BIG, good, 7, None), (5, None, None, None))]
    return spark.createDataFrame(rows, COLUMNS)


def whole(df):
    return sorted(map(str, df.collect()))


def test_quality_keeps_what_it_does_not_score(spark, documents, odd):
    model = quality.learn(documents, spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", F.col("quality").alias("label")))
    scored = quality.quality_scores(odd, model)
    rest = [c for c in odd.columns if c != "quality_score"]
    assert whole(scored.select(rest)) == whole(odd.select(rest))
    by_text = {}
    for r in scored.collect():
        assert 0 <= r["quality_score"] <= 1 and by_text.setdefault(r["text"] or "", r["quality_score"]) == r["quality_score"]
    kept = odd.filter(quality.score_column(model, F.col("text")) >= 0)
    assert kept.columns == odd.columns and whole(kept) == whole(odd)


def test_quality_stage_returns_the_columns_of_its_input(spark, documents):
    wide = documents.withColumns({"quality_score": F.lit("own"), "till": F.lit(LATE), "links": F.when(F.col("doc_id") % 3 == 0, F.lit(BIG))})
    out = corpus_pipeline.classify_quality(spark, wide, SF_SMALL)
    assert out.columns == wide.columns and 0 < out.count() < wide.count()
    assert {(r[0], r[1]) for r in out.select("quality_score", "links").distinct().collect()} == {("own", None), ("own", BIG)}


def test_language_keeps_ids_and_asks_for_letters(spark, documents, odd):
    model = language.learn(documents)
    assert sorted(str(r["doc_id"]) for r in language.predict_languages(odd, model).collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    signs = spark.createDataFrame([(1, "²½ 12"), (2, "_ 7 ?"), (3, "ⅷ ①"), (4, "ª word")], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict_languages(signs, model).collect()}
    assert found[1] == found[2] == found[3] == "und" != found[4]


IDS = [None, BIG, BIG + 2, -(1 << 63), (1 << 63) - 1, 7]


def test_shared_lines_go_from_every_text_whatever_its_id(spark):
    words = [["amber", "birch", "cedar", "delta", "ember", "flint"][i:] + ["gravel", "harbor"][:i] for i in range(6)]
    rows = [(d, " ".join(w[::-1] * 6) + "\nthe very same footer under every single page\n" + " ".join(w * 7), "own", [1], "c", 3, LATE) for d, w in zip(IDS, words, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _cut array<int>, digest string, lines_dropped int, till timestamp").coalesce(1)
    out = line_dedup.drop_recurring_lines(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    found = {r["doc_id"]: r for r in out.collect()}
    assert set(found) == set(IDS)
    for doc, text, *rest in rows:
        r = found[doc]
        lines = text.split("\n")
        assert r["lines_dropped"] == 1 and r["text"] == "\n".join([lines[0], lines[2]])
        assert [r["_text"], r["_cut"], r["digest"], r["till"]] == [rest[0], rest[1], rest[2], LATE]


def test_pieces_keep_ids_and_columns(spark):
    rows = [(d, f"text {d}", 5, "mine", LATE, (1, "x") if d else None, BIG if d == 7 else None) for d in IDS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _block long, restored string, till timestamp, `odd.name` struct<a: int, b: string>, links long").coalesce(1)
    out = pieces.encode_documents(docs)
    assert whole(out.drop("ids")) == whole(docs) and out.columns == [*docs.columns, "ids"]
    back = pieces.decode_documents(out.drop("text"), column="text").select(*(f"`{c}`" for c in docs.columns))
    assert whole(back) == whole(docs)
    checked = pieces.encode_documents(docs, verify=True, keep=["doc_id"])
    assert checked.columns == ["doc_id", "ids", "restored"] and {r["restored"] for r in checked.collect()} == {True}


def test_long_units_equal_the_library(spark):
    model = pieces.processor(pieces.PieceParams().model)
    texts = ["x" * n for n in (61, 62, 63, 200, 5000)] + ["ab" * 31 + " " + "é" * 62, "://" * 40, "😀" * 62]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in pieces.encode_documents(docs).collect():
        assert list(r["ids"]) == model.encode(r["text"])


def test_fingerprints_keep_ids(spark):
    docs = spark.createDataFrame([(d, f"paragraph of {d}") for d in IDS], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in fingerprints.fingerprint_documents(docs).collect()} == set(IDS)


def test_archive_keeps_ids_and_a_second_run_takes_over(spark, tmp_path):
    rows = [(d, f"http://x/{d}", "p" * 2000 if d and d > BIG else f"own {d}") for d in IDS]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = f"{tmp_path}/archive"
    warc.write_archive(pages, folder)
    read = {r["page_id"]: r for r in warc.read_archive(warc.manifest_of(spark, folder), folder).collect()}
    assert set(read) == set(IDS) and read[BIG + 2]["refers_to"] == (1 << 63) - 1
    again = pages.filter("page_id = 7")
    warc.write_archive(again, folder)
    later = warc.read_archive(warc.manifest_of(spark, folder), folder).collect()
    assert [(r["page_id"], r["payload"]) for r in later] == [(7, "own 7")]
    warc.write_archive(pages.limit(0), folder)
    assert warc.manifest_of(spark, folder).count() == 0
    first = warc.write_archive(pages, folder)
    assert whole(first) == whole(warc.manifest_of(spark, folder)) and warc.read_archive(first, folder).count() == len(IDS)
