"""Prefix trie, exact duplicates and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapgauge.llm import conversation_trie, exact_dedup, hard_negatives, queries
from tests.conftest import SF_SMALL

TURNS = "conv_id long, turn long, role string, text string, c string, depth string, leaf string, k1 string, n string, member string"


def plain_trie(rows, borrow=False) -> set[tuple]:
    convs: dict[int, list] = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            key = (turn is not None, turn or 0, int(digest[:15], 16), int(digest[16:31], 16))
            convs.setdefault(conv, []).append((key, (role, text)))
    turns = {c: [t for _, t in sorted(own, key=lambda x: x[0])] for c, own in convs.items()}
    if borrow:
        of = lambda c: zlib.crc32(str(c).encode()) % 9
        turns = {c: turns.get(c - int(math.fmod(c, 5)), [])[: of(c)] + own[of(c) :] for c, own in turns.items()}
    nodes: dict[tuple, list[int]] = {}
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            nodes.setdefault(tuple(turns[c][:d]), []).append(c)
    children: dict[tuple, int] = {}
    for path in nodes:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1].encode()) if path else 0
    out = set()
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(turns[c]) == len(path))
        parent = nodes[path[:-1]][0] if path else None
        out.add((members[0], len(path), parent, len(members), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found_trie(spark, rows, **by) -> list[tuple]:
    full = [(*r, *("x",) * (10 - len(r))) for r in rows]
    out = conversation_trie.conversation_trie(spark.createDataFrame(full, TURNS), **by)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in out.collect()]


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, 2, None, "b"), (2, 0, "", ""), (2, 1, "user", "a"),
        (None, 0, "user", "lost"), (None, None, None, None), (-7, 5, "user", "é" * 40_000), ((1 << 53) + 1, 1, "ab", "c"), (-(1 << 63), 1, "a", "bc"),
        (3, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "user", "b"), (5, 0, "user", "a"),
    ]
    found = found_trie(spark, rows)
    assert len(found) == len(set(found)) and set(found) == plain_trie(rows)
    assert found_trie(spark, []) == []


def test_trie_of_chains_combs_and_borrowed_turns(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 7)
    monkeypatch.setattr(conversation_trie, "ID_TEXT", 20)
    draw = random.Random(3)
    rows = []
    chain = [("user", f"turn {i}") for i in range(45)]
    for c in range(60):
        if c < 30:  # leave the chain at some place: a comb
            at = draw.choice((3, 17, 44, 45))
            turns = chain[:at] + [("user", f"own {c % 7}")] * draw.choice((0, 1, 2))
        else:
            turns = [("ab"[draw.randrange(2)], "xyz"[draw.randrange(3)]) for _ in range(draw.randrange(1, 7))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    draw.shuffle(rows)
    borrowed = found_trie(
        spark, rows, borrowed=F.crc32(F.col("conv_id").cast("string")) % 9, lender=F.col("conv_id") - F.col("conv_id") % 5
    )
    assert len(borrowed) == len(set(borrowed)) and set(borrowed) == plain_trie(rows, borrow=True)


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_conversation_trie(spark, SF_SMALL)
    assert [t for _, t in out.drop("ends_sha256").dtypes] == ["bigint"] * 7
    assert {tuple(r) for r in out.collect()} == plain_trie(rows, borrow=True)


COPIES = "doc_id long, text string, keep_id string, kept string, prefix string, digest string, suspect boolean, m map<string,int>"
LONG = "Word of a Text " * 9000
TEXTS = [
    (1, None), (2, ""), (2, ""), (None, None), (None, "É No Id"), (None, "É no id"), (3, "Same Text"), (7, "sAME tEXT"), (7, "sAME tEXT"), (7, "SAME TEXT"),
    (4, "É"), (5, "é"), (6, LONG), ((1 << 53) + 1, LONG.upper()), (8, LONG[:-1] + "!"), (9, "x" * 300 + "a"), (10, "x" * 300 + "b"), (-(1 << 63), "alone"),
    (11, "İstanbul K"), (12, "İstanbul k"), (13, "İstanbul k"),
]


def lowered(text: str | None) -> str:
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")


def check_copies(rows, found, every: bool):
    groups: dict[str, list] = {}
    for doc, text in rows:
        groups.setdefault(lowered(text), []).append(doc)
    wanted = []
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        wanted += [(str(d), str(keep), len(ids), hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == sorted(w[:3] for w in wanted)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    assert sum(r["kept"] for r in found) == len(groups)
    digests = {(w[0], w[3]) for w in wanted}
    given = [r for r in found if r["text_sha256"] is not None]
    assert {(str(r["doc_id"]), r["text_sha256"]) for r in given} <= digests
    assert len({r["text_sha256"] for r in given if r["group_size"] > 1 and r["kept"]}) == sum(len(g) > 1 for g in groups.values())
    if every:
        assert len(given) == len(rows) and {(str(r["doc_id"]), r["text_sha256"]) for r in given} == digests


@pytest.mark.parametrize("bits", [1, 1 << 20])
def test_exact_duplicates(spark, bits):
    rows = [(d, t, f"k{i}", f"{i % 3}", "p", "d", True, {"a": i}) for i, (d, t) in enumerate(TEXTS)]
    docs, p = spark.createDataFrame(rows, COPIES), exact_dedup.DedupParams(prefix_chars=20, filter_bits=bits)
    check_copies(TEXTS, exact_dedup.exact_duplicates(docs, p, every_digest=True).collect(), True)
    found = exact_dedup.exact_duplicates(docs, p).collect()
    check_copies(TEXTS, found, False)
    if bits > 1:  # what nothing resembles is not read to its end
        assert next(r for r in found if r["doc_id"] == 9)["text_sha256"] is not None
        assert next(r for r in found if r["doc_id"] == -(1 << 63))["text_sha256"] is None
    kept = exact_dedup.deduplicated(docs, p)
    again = exact_dedup.deduplicated(docs.repartition(5), p)
    assert kept.columns == docs.columns
    whole = {(r["doc_id"], r["text"], r["keep_id"]) for r in kept.collect()}
    assert whole == {(r["doc_id"], r["text"], r["keep_id"]) for r in again.collect()}
    assert whole <= {(r[0], r[1], r[2]) for r in rows} and len(whole) == len({lowered(t) for _, t in TEXTS})
    nothing = spark.createDataFrame([], COPIES)
    assert exact_dedup.exact_duplicates(nothing, p).count() == 0 and exact_dedup.deduplicated(nothing, p).count() == 0


def test_exact_dedup_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check_copies(rows, queries.op12_exact_dedup(spark, SF_SMALL).collect(), True)


def plain_negatives(rows, is_anchor, p=hard_negatives.MiningParams()) -> set[tuple]:
    usable = {}
    for vec, label, v in rows:
        if vec is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[(vec, label, tuple(math.floor(p.scale * float(x)) for x in v))] = None
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  shorter ones end early
    out = set()
    for vec, label, v in usable:
        if not is_anchor(vec):
            continue
        scored = sorted({(-score(v, w), other, own == label) for other, own, w in usable if other != vec})
        positives = [(s, o) for s, o, same in scored if same][: p.n_positives]
        for s, positive in positives:
            fits = [(n, o) for n, o, same in scored if not same and p.least * -s <= 100 * -n <= p.most * -s][: p.n_negatives]
            out |= {(vec, positive, rank, o, -s, -n) for rank, (n, o) in enumerate(fits, 1)}
    return out


VECTORS = "vec_id long, label int, embedding array<float>, chunk string, block string, v string, at string"


@pytest.mark.parametrize(("size", "chunk", "block"), [(5, 7, 3), (16, 2048, 1024)])
def test_hard_negatives(spark, size, chunk, block):
    draw = np.random.default_rng(5)
    centre = draw.normal(0, 0.1, size)
    rows = [(i, int(draw.choice([0, 0, 1, 2])), [float(np.float32(x)) for x in centre + draw.normal(0, 0.05, size)]) for i in range(120)]
    rows += [rows[11]] * 9 + [(200 + i, 1, rows[5][2]) for i in range(8)]  # repeated rows, ties
    rows += [(None, 1, rows[0][2]), (300, None, rows[0][2]), (301, 1, None), (302, 0, [None] * size), (303, 0, [math.nan] * size), (304, 0, [math.inf] * size)]
    rows += [(305, 0, []), (306, 1, [1.5]), (310, 0, [-40.0] * size), (320, 2, [3.0] * (size + 9)), ((1 << 53) + 1, 2, rows[3][2]), (-(1 << 63), 1, rows[4][2])]
    table = spark.createDataFrame([(*r, "c", "b", "v", "a") for r in rows], VECTORS)
    p = hard_negatives.MiningParams(chunk_rows=chunk, block_anchors=block)
    out = [tuple(r) for r in hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, p).collect()]
    assert out and len(out) == len(set(out)) and set(out) == plain_negatives(rows, lambda i: math.fmod(i, 10) == 0)


def test_no_anchor_and_no_row(spark):
    table = spark.createDataFrame([(1, 0, [0.5], "", "", "", "")], VECTORS)
    assert hard_negatives.hard_negatives(table, F.lit(False)).count() == 0
    assert hard_negatives.hard_negatives(table.limit(0), F.lit(True)).count() == 0
    wide = spark.createDataFrame([(i, i % 2, [1e17], "", "", "", "") for i in range(4)], VECTORS)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        hard_negatives.hard_negatives(wide, F.lit(True)).count()


def test_scores_of_planes():
    draw = np.random.default_rng(1)
    v, a = draw.integers(-300, 300, (50, 24)), draw.integers(-300, 300, (7, 24))
    planes = hard_negatives.bit_planes(v, 10)
    assert planes.shape == (10, 3, 50)
    assert (hard_negatives.scores(hard_negatives.subset_sums(a), planes) == v @ a.T).all()


def test_hard_negatives_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    out = queries.op13_hard_negatives(spark, SF_SMALL)
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert {tuple(r) for r in out.collect()} == plain_negatives(moved, lambda i: i % 100 == 0)
