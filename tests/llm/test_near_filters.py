"""Filters before the alignment lose no similar pair, and copies of copies stay linear."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gapgauge.llm import near_dedup

BIG = (1 << 53) + 1


def edited(rng, words, share):
    out = list(words)
    for i in np.flatnonzero(rng.random(len(out)) < share):
        out[i] = f"e{rng.integers(1 << 40)}"
    return out


def classes_by_all_pairs(texts):
    items = [i for _, i in near_dedup.items_of(texts, 5)]
    label = list(range(len(texts)))
    for i, a in enumerate(items):
        for j in range(i):
            if label[i] != label[j] and near_dedup.aligned_similarity(a, items[j], 0.8) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def sketched(spark, texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, text string")
    return near_dedup.signatures(docs, near_dedup.NearParams(), ["name"]).drop("keys")


def test_no_similar_pair_is_filtered(spark):
    rng = np.random.default_rng(2)
    texts = []
    for length, times in ((8, 40), (40, 60), (300, 60), (3000, 30), (20_000, 6)):
        for _ in range(times):
            words = [f"w{x}" for x in rng.integers(1 << 40, size=length)]
            texts += [" ".join(words), " ".join(edited(rng, words, rng.choice([0.0, 0.01, 0.02, 0.03, 0.06])))]
    items = [i for _, i in near_dedup.items_of(texts, 5)]
    similar = {i for i in range(0, len(texts), 2) if near_dedup.aligned_similarity(items[i], items[i + 1], 0.8) >= 0.8}
    rows = sketched(spark, texts).withColumn("pair", F.col("name").cast("int").bitwiseAND(~1))
    l, r = rows.filter("cast(name as int) % 2 = 0").alias("l"), rows.filter("cast(name as int) % 2 = 1").alias("r")
    met = (F.col("l.pair") == F.col("r.pair")) & near_dedup.may_be_similar("l", "r", 0.8)
    passed = {x["pair"] for x in l.join(r, met).select("l.pair").collect()}
    assert len(similar) > 60 and similar <= passed
    unlike = set(range(0, len(texts), 2)) - similar
    assert len(unlike & passed) < len(unlike)


def test_copies_of_one_text_meet_in_few_pairs(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(1 << 40, size=200)]
    texts = [" ".join(edited(rng, base, 0.025)) for _ in range(150)]
    texts += [" ".join(base[20:]), " ".join(base[:-20]), " ".join(base)]
    label = classes_by_all_pairs(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, links = near_dedup.near_duplicates(docs)
    found = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert [found[i] for i in range(len(texts))] == label
    assert links.count() < 8 * len(texts)


def test_long_ids_beside_null_stay_as_they_are(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(BIG, text), (BIG + 2, text.replace("word7 ", "other ")), (None, "alone in the batch"), (-(1 << 63), "another one"), (BIG, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dedup.near_duplicates(docs)[0].collect())
    assert found == sorted([(str(BIG), str(BIG))] * 2 + [(str(BIG + 2), str(BIG)), ("None", "None"), (str(-(1 << 63)),) * 2])
