"""Operators on small tables, held against plain versions and libraries."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapgauge.llm import fingerprints, graph_search, language, line_dedup, mixing, near_dedup, pieces, quality, token_counts, warc
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars int, size string, target string"
BASE = " ".join(f"word{i} of the text" for i in range(60))
ODD = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "a", 0, None, None),
    (2, "", "en", "a", 0, None, None),
    (None, "no id here", "de", None, 10, "x", "y"),
    (3, BASE, "en", "a", len(BASE), "x", "y"),
    (4, BASE, "en", "b", len(BASE), "x", "y"),
    (5, BASE.replace("word7 ", "other "), "en", "b", len(BASE), "x", "y"),
    (6, "x" * 50_000, "fr", "b", 50_000, "x", "y"),
    (7, "Zeile eins\n\nZeile 2 " + "wort " * 3000, "de", "c", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_near_duplicates_of_odd_rows(odd, none):
    members, links = near_dedup.near_duplicates(odd)
    classes = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in members.collect())
    assert classes == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7)]
    assert links.count() == 1
    assert sorted(r["doc_id"] or 0 for r in near_dedup.keep_one(odd).collect()) == [0, 1, 3, 6, 7]
    assert near_dedup.near_duplicates(none)[0].count() == 0


def test_keep_one_goes_by_class(spark):
    own = [" ".join(f"text{k}word{i}" for i in range(60)) for k in range(5)]
    near = own[0].replace("text0word7 ", "other ")
    big = (1 << 53) + 1
    rows = [(7, own[0], 1), (7, own[1], 2), (7, own[1], 3), (3, near, 4), (big, own[2], 5), (None, own[2], 6), (None, own[3], 7), (None, own[3].upper(), 8), (None, own[4], 9), (None, own[4], 10)]
    results = []
    for turn in (rows, rows[::-1]):
        docs = spark.createDataFrame(turn, "doc_id long, text string, row int").coalesce(1)
        kept = near_dedup.keep_one(docs)
        found = {tuple(r) for r in kept.collect()}
        assert kept.columns == docs.columns and kept.count() == 5
        assert {r[:2] for r in found if r[1].lower() != own[3]} == {(3, near), (7, own[1]), (big, own[2]), (None, own[4])}
        results.append(found)
    assert results[0] == results[1]


def test_near_duplicates_equal_all_pairs(documents):
    rows = documents.collect()
    items = [i for _, i in near_dedup.items_of([r["text"] for r in rows], 5)]
    label = list(range(len(rows)))
    for i, a in enumerate(items):
        for j in range(i):
            if near_dedup.aligned_similarity(a, items[j], 0.8) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    ids = [r["doc_id"] for r in rows]
    lowest: dict[int, int] = {}
    for doc, at in zip(ids, label, strict=True):
        lowest[at] = min(doc, lowest.get(at, doc))
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(documents)[0].collect()}
    assert found == {doc: lowest[at] for doc, at in zip(ids, label, strict=True)}


def test_refined_buckets_give_the_same_classes(documents):
    plain = near_dedup.near_duplicates(documents)[0].select("doc_id", "class_id")
    fine = near_dedup.near_duplicates(documents, near_dedup.NearParams(hot=1))[0].select("doc_id", "class_id")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, fine.collect()))


def test_line_templates(spark, odd, none):
    rows = [(i, f"alpha beta gamma run {i} of day {i} ends\nown line number {'abcdefghij'[i]} with {'zyxwvutsrq'[i]} words") for i in range(6)]
    rows += [(20 + i, "copied line one stays here\ncopied line two stays here") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert all("alpha" not in out[i] for i in range(6))
    assert all(out[20 + i] == rows[6][1] for i in range(5))
    kept = line_dedup.drop_recurring_lines(odd)
    assert kept.count() == len(ODD) and kept.filter("lines_dropped > 0").isEmpty()
    assert kept.filter("doc_id = 1").first()["text"] is None
    assert line_dedup.drop_recurring_lines(none).count() == 0


def dropped_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["lines_dropped"] for r in line_dedup.drop_recurring_lines(docs).collect()}


def own_words(rng, n):
    return " ".join(f"w{''.join(rng.choice(list('abcdefghij'), 7))}" for _ in range(n))


def test_passages_of_unrelated_texts_are_dropped_and_copies_kept(spark):
    rng = np.random.default_rng(5)
    passage = [own_words(rng, 12) for _ in range(10)]
    texts = ["\n".join([own_words(rng, 40), *passage, own_words(rng, 40)]) for _ in range(120)]
    copied = [own_words(rng, 12) for _ in range(25)]
    for i in range(60):
        copy = list(copied)
        copy[i % 25] = own_words(rng, 12)
        texts.append("\n".join(copy))
    dropped = dropped_of(spark, texts)
    assert [dropped[i] for i in range(120)] == [10] * 120
    assert not any(dropped[i] for i in range(120, 180))


@pytest.mark.parametrize("texts", [60, 600, 6000])
def test_templates_do_not_depend_on_the_size_of_the_table(spark, texts):
    rng = np.random.default_rng(6)
    names, cities = ([own_words(rng, 1) for _ in range(40)] for _ in range(2))
    rows = [f"{own_words(rng, 20)}\nPosted in section by {rng.choice(names)} at {rng.choice(cities)} desk" for _ in range(texts)]
    assert set(dropped_of(spark, rows).values()) == {1}


def test_length_histogram(odd, none, documents):
    encode = token_counts.encoding(token_counts.tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary
    lengths = [len(encode(r["text"])) for r in documents.collect()]
    found = token_counts.length_histogram(token_counts.encoded_lengths(documents))
    for r in found.collect():
        n = r["length"]
        assert r["documents"] == lengths.count(n)
        assert r["documents_from"] == sum(x >= n for x in lengths)
        assert r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
    cut = token_counts.truncated_total(found, [100, 1000]).filter("limit = 100").first()
    assert (cut["tokens"], cut["tokens_left"], cut["documents_cut"]) == (sum(lengths), sum(min(x, 100) for x in lengths), sum(x > 100 for x in lengths))
    median = token_counts.length_quantiles(found, [0.5]).first()["length"]
    assert median == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.length_histogram(token_counts.encoded_lengths(odd)).filter("length = 0").first()["documents"] == 3
    assert token_counts.length_histogram(token_counts.encoded_lengths(none)).count() == 0


def test_graph_search_recall_and_odd_vectors(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    found = graph_search.nearest(table, table.filter("vec_id % 20 = 0")).collect()
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = 0
    for q in {r["query_id"] for r in found}:
        s = x @ x[ids == q][0]
        best = set(ids[np.lexsort((ids, -s))][:21].tolist()) - {q}
        hits += len(best & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits >= 0.9 * len(found)
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0])]
    small = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    near = graph_search.nearest(small, small.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in near] == [(1, 1.0), (6, 0.5)]
    assert graph_search.nearest(small.limit(0), small.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", ["one long", "spread", "extreme"])
def test_graph_search_recall_with_mixed_lengths(spark, lengths):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    scale = {"one long": np.where(np.arange(1200) == 7, 1e6, 1.0), "spread": 10.0 ** rng.uniform(-4, 4, 1200), "extreme": np.where(np.arange(1200) % 100 == 7, 1e150, 1.0)}[lengths]
    x *= scale[:, None]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = graph_search.nearest(table, table.filter("vec_id % 40 = 0")).collect()
    hits = 0
    for q in range(0, 1200, 40):
        best = [i for i in np.lexsort((np.arange(1200), -(x @ x[q]))).tolist() if i != q][:20]
        hits += len(set(best) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert len(found) == 600 and hits >= 0.95 * len(found)


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>é</p>" * 400, "<p>"
    rows = [(1, "http://a/\n", big), (2, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (3, "u", big), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifests = []
    for name in ("one", "two"):
        manifest = warc.write_archive(pages, f"{tmp_path}/{name}", warc.WarcParams(shard_bytes=4000, roll_bytes=400))
        manifests.append(sorted(map(tuple, manifest.collect())))
    assert manifests[0] == manifests[1] and len(manifests[0]) > 1
    read = warc.read_archive(warc.manifest_of(spark, f"{tmp_path}/two"), f"{tmp_path}/two").collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in read) == [
        (0, "response", None), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "response", None), (6, "response", None)
    ]
    for r in read:
        text = next((h or "") for p, _, h in rows if p == r["page_id"])
        assert r["payload_digest"] == hashlib.sha1(text.encode()).hexdigest() and r["payload_bytes"] == len(text.encode())
    assert warc.write_archive(pages.limit(0), f"{tmp_path}/empty").count() == 0


def test_quality_model_learns_and_scores_whole_texts(odd, none):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdef "), 3000)) + ("%%%" if i % 2 else "") for i in range(80)]
    labels = np.array([1 - i % 2 for i in range(80)], np.float32)
    p = quality.QualityParams(steps=150)
    model = quality.fitted([[t.encode()[-1000:]] for t in texts], labels, p)
    scores = np.array([quality.score(t.encode(), model) for t in texts])
    assert ((scores > 0.5) == (labels == 1)).mean() > 0.9
    data = texts[1].encode()
    whole = quality.responses(np.frombuffer(data, np.uint8), model.tables).max(axis=0)
    assert np.allclose(np.maximum(whole + model.bias, 0), quality.pooled(data, model).max(axis=0), atol=1e-4)
    scored = quality.quality_scores(odd, model)
    assert scored.count() == len(ODD) and scored.filter("quality_score between 0 and 1").count() == len(ODD)
    assert quality.learn(none, none.select("doc_id", F.lit(1).alias("label"))).offset == 0.0


def test_pieces_equal_the_library(spark, odd, none):
    texts = ["", " ", "a  b", "▁x", "naïve 中文 text 12.5%%% ...", "line\n\ttab", "ि क", "²½", "w" * 100, "://x", "😀😀 ok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = pieces.processor(pieces.PieceParams().model)
    encoded = pieces.encode_documents(docs, verify=True)
    for r in pieces.decode_documents(encoded).collect():
        assert list(r["ids"]) == model.encode(texts[r["doc_id"]])
        assert r["decoded"] == texts[r["doc_id"]].replace("▁", " ")
    out = pieces.encode_documents(odd).collect()
    assert len(out) == len(ODD) and next(r for r in out if r["doc_id"] == 1)["ids"] is None
    assert pieces.encode_documents(none).count() == 0


def test_a_pass_halts_at_pieces_that_make_a_better_one_possible(spark):
    p = pieces.PieceParams()
    wide = pieces.wide_pieces(p.model)
    place = dict(zip(wide["piece"], wide["place"], strict=True))
    halting = set(wide.loc[wide["halt"], "piece"])
    # " the" is better than "the", which it is also joined from
    assert place[" the"] < place["the"] and "the" in halting and 0 < len(halting) < len(wide)
    model, draw = pieces.processor(p.model), np.random.default_rng(5)
    parts = [x for x in [*sorted(halting), *wide["piece"]] if x.isalpha()]
    units = sorted({(" " * int(draw.integers(0, 2)) + "".join(draw.choice(parts, draw.integers(1, 5))))[:62] for _ in range(2000)})
    units = [u for u in units if pieces.UNIT.fullmatch(u)]
    rows = spark.createDataFrame([(u, [0]) for u in units], "unit string, blocks array<long>").repartition(4, "unit")
    found = {r.unit: r.ids for r in pieces.fold_units(pieces.lattice_edges(rows, p), p).collect()}
    assert len(units) > 1500 and found == {u: pieces.long_unit(model, u) for u in units}


def test_edges_are_joined_by_a_number_and_grouped_without_other_columns(spark):
    p = pieces.PieceParams()
    words = [" the", " another", "onion", "x", " " * 7, "w" * 70, "ab" * 31]
    units = spark.createDataFrame([(w, [i]) for i, w in enumerate(words)], "unit string, blocks array<long>").repartition(2, "unit")
    lattice = pieces.lattice_edges(units, p)
    known = set(pieces.wide_pieces(p.model)["piece"])
    for r in lattice.collect():
        spans = {(start, stop) for start in range(len(r.unit)) for stop in range(start + 2, len(r.unit) + 1) if r.unit[start:stop] in known} if len(r.unit) <= pieces.LONGEST else set()
        found = [(e >> 27 & 63, (e >> 27 & 63) + (e & 63)) for e in r.edges]
        assert set(found) == spans and len(found) == len(spans) and r.blocks == [words.index(r.unit)]
    plan = lattice._jdf.queryExecution()
    keys = re.search(r"BroadcastHashJoin \[(\w+)#", plan.executedPlan().toString())
    assert keys and keys[1] == "key" and "startswith" in plan.optimizedPlan().toString().lower()
    # what is sorted by unit: unit, blocks, edge
    grouped = plan.optimizedPlan()
    while grouped.nodeName() != "Aggregate":
        grouped = grouped.children().head()
    assert grouped.child().output().size() == 3


def test_units_dealt_to_more_tasks_give_the_same_ids(spark, odd):
    plain, dealt = (sorted((str(r.doc_id), str(r.ids)) for r in pieces.encode_documents(odd, keep=["doc_id"], spread=n).collect()) for n in (0, 3))
    assert plain == dealt and len(plain) == len(ODD)


def test_texts_of_lists_of_ids():
    octets = pa.array([b"", b"a", b" b", "ü".encode()[:1], "ü".encode()[1:]], pa.binary())
    packed = [np.array(x, np.int32).tobytes() if x is not None else None for x in ([2, 1], None, [], [0, 2, 3, 4], [2, 3])]
    assert pieces.texts_of(pieces.id_lists(packed), octets) == ["ba", "", "", "bü", "b\ufffd"]
    assert pieces.texts_of(pieces.id_lists([None, b""]), octets) == ["", ""] and pieces.texts_of(pieces.id_lists([]), octets) == []


def test_viterbi_finds_the_best_path(spark):
    p = pieces.PieceParams(fold="viterbi")
    known = pieces.pieces_of(p.model).set_index("piece")["score"].to_dict()
    words = ["thing", " another", "onion", "zzz"]
    units = spark.createDataFrame([(w, [1]) for w in words], "unit string, blocks array<long>")
    for r in pieces.fold_units(pieces.lattice_edges(units, p), p).collect():
        unit, best = r["unit"], [0.0]
        for stop in range(1, len(unit) + 1):
            best.append(max(best[start] + known.get(unit[start:stop], -1e18) for start in range(stop)))
        model = pieces.processor(p.model)
        assert sum(model.get_score(i) for i in r["ids"]) == pytest.approx(best[-1])


def test_languages(spark, odd, none, documents):
    held = documents.filter("doc_id % 4 = 0")
    p = language.LanguageParams()
    model = language.learn(documents.filter("doc_id % 4 != 0"), p)
    truth = {r["doc_id"]: r["lang"] for r in held.collect()}
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict_languages(held, model, p).collect()}
    assert np.mean([found[d] == truth[d] for d in truth]) > 0.9
    pred = language.predict_languages(odd, model, p).collect()
    assert all(r["lang_pred"] == "und" for r in pred if r["doc_id"] in (1, 2)) and len(pred) == len(ODD)
    assert {r["lang_pred"] for r in language.predict_languages(odd, language.learn(none)).collect()} == {"und"}


def targets_in_rounds(sizes: list[int]) -> list[float]:
    """Share, cap, share the excess again, until nothing is above."""
    weights, out, capped = [(5, 2, 1)[i % 3] for i in range(len(sizes))], [0.0] * len(sizes), set()
    left = 1.5 * sum(sizes)
    while True:
        total = sum(w for i, w in enumerate(weights) if i not in capped)
        for i, w in enumerate(weights):
            if i not in capped:
                out[i] = left * w / total
        over = [i for i in range(len(sizes)) if i not in capped and out[i] > 2 * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i] = 2.0 * sizes[i]
            capped.add(i)
            left -= out[i]


def test_mixing(odd, none, documents):
    rows = mixing.mixing_plan(documents).collect()
    sizes: dict[str, int] = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes)
    wanted = dict(zip(names, targets_in_rounds([sizes[n] for n in names]), strict=True))
    for name in names:
        own = [r for r in rows if r["source"] == name]
        assert own[0]["target"] == pytest.approx(wanted[name])
        assert abs(sum(r["taken"] for r in own) - wanted[name]) <= max(r["size"] for r in own)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mixing_plan(odd).count() == len(ODD) and mixing.mixing_plan(none).count() == 0


def test_mix_returns_all_columns_as_they_are(spark):
    names = ["size", "source_size", "target", "copies", "taken", "positions", "_u", "_source", "row", "position"]
    rows = [(i, f"some words of text {i}", "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    mixed = mixing.mixed_documents(docs)
    found = {tuple(r) for r in mixed.collect()}
    assert mixed.columns == docs.columns and found and found <= set(rows)


def test_fingerprints(odd, none, documents):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(documents, fingerprints.SketchParams(shard_chars=50_000)).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    order = sorted(texts, reverse=True)
    for i, doc in enumerate(order):
        text, following = texts[doc], texts[order[(i + 1) % len(order)]]
        changed = fingerprints.edited(text, following)
        assert rows[doc]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for other, column in ((changed, "near_edited"), (following, "near_next")):
            a, b = (set(fingerprints.digests([t], 16)[1].tolist()) for t in (text, other))
            assert rows[doc][column] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    found = fingerprints.fingerprint_documents(odd).collect()
    assert len(found) == len(ODD)
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (3, 4)}) == 1
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pieces"]
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "source", "n_pieces", "ids"] and out.count() > 0
