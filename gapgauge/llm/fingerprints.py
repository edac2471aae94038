"""Document fingerprints by invertible Bloom lookup sketches.

A text is its paragraphs: the lines that are not blank, lines of more than
``words`` words cut into runs of that many. A paragraph's digest is a 64-bit
hash of its text and of how often it came before. The sketch is a table of
``cells`` cells; each digest is added to one cell in each of three sub-tables:
the cell's counter, the exclusive or of the digests, and that of their checks.

Two sketches of a size are subtracted cell by cell. Cells that hold one digest
are peeled until nothing is left; what was peeled are the digests of only one
of the texts. If cells remain, both sketches are made again with twice the
cells. Likeness is shared digests / digests of either text, 1 for two texts
without paragraphs. The fingerprint is the table of the first size, in hex,
behind the number of digests, so equal texts have equal fingerprints.

NULL text is empty text: no paragraph, an empty table. Rows are one document
each; rows with the same id follow each other by text. NULL ids come last. Other columns are ignored. No document: no row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgauge.llm.common import hashed, mixed, ordered_shards, settled

HASHES = 3
SALTS = mixed(np.arange(1, HASHES + 2, dtype=np.uint64))


@dataclass(frozen=True)
class SketchParams:
    cells: int = 24
    words: int = 16
    shard_chars: int = 24 << 20
    batch_chars: int = 1 << 20


def paragraphs(text: str, words: int) -> list[str]:
    out = []
    for line in text.split("\n"):
        tokens = line.split()
        out += [" ".join(tokens[i : i + words]) for i in range(0, len(tokens), words)]
    return out


def digests(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of all texts and the place of the text of each."""
    split = [paragraphs(t, words) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    keys = hashed(x for s in split for x in s)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    first = np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])] if len(k) else np.empty(0, bool)
    place = np.arange(len(k))
    before = place - np.maximum.accumulate(np.where(first, place, 0)) if len(k) else place
    return o, mixed(k + before.astype(np.uint64) * SALTS[0])


def check_of(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ SALTS[HASHES]) >> np.uint64(32)


def cells_of(keys: np.ndarray, cells: int, owner: np.ndarray) -> np.ndarray:
    """Flat cell numbers, one row for each of the sub-tables."""
    part = cells // HASHES
    return np.stack([owner * cells + i * part + (mixed(keys + SALTS[i]) % np.uint64(part)).astype(np.int64) for i in range(HASHES)])


def add(table: tuple[np.ndarray, ...], keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int, cells: int) -> None:
    count, key, check = table
    for at in cells_of(keys, cells, owner):
        np.add.at(count, at, sign)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, check_of(keys))


def sketches(owner: np.ndarray, keys: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, ...]:
    table = (np.zeros(n * cells, np.int32), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64))
    add(table, keys, owner, 1, cells)
    return table


def peeled(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests only in one of each pair of sketches: owner, digest, sign; and which pairs are done."""
    table = (a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2])
    found = []
    while True:
        pure = np.flatnonzero((np.abs(table[0]) == 1) & (check_of(table[1]) == table[2]))
        if not len(pure):
            break
        owner, key, sign = pure // cells, table[1][pure], table[0][pure]
        _, once = np.unique(np.stack([owner.astype(np.uint64), key]), axis=1, return_index=True)
        owner, key, sign = owner[once], key[once], sign[once]
        add(table, key, owner, -sign, cells)
        found.append((owner, key, sign))
    left = (table[0] != 0) | (table[1] != 0)
    done = ~left.reshape(-1, cells).any(axis=1)
    empty = np.empty(0, np.int64)
    owner, key, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty.astype(np.uint64), empty)
    return owner, key, sign, done


def differences(owner_a: np.ndarray, a: np.ndarray, owner_b: np.ndarray, b: np.ndarray, n: int, cells: int) -> np.ndarray:
    """Number of digests by which each pair of texts differs."""
    out = np.zeros(n, np.int64)
    waiting = np.arange(n)
    while len(waiting):
        place = np.full(n, -1)
        place[waiting] = np.arange(len(waiting))
        in_a, in_b = place[owner_a] >= 0, place[owner_b] >= 0
        left = sketches(place[owner_a[in_a]], a[in_a], len(waiting), cells)
        right = sketches(place[owner_b[in_b]], b[in_b], len(waiting), cells)
        owner, _, _, done = peeled(left, right, cells)
        out[waiting[done]] = np.bincount(owner, minlength=len(waiting))[done]
        waiting, cells = waiting[~done], 2 * cells
    return out


def likeness(owner_a: np.ndarray, a: np.ndarray, owner_b: np.ndarray, b: np.ndarray, n: int, cells: int) -> np.ndarray:
    apart = differences(owner_a, a, owner_b, b, n, cells)
    total = np.bincount(owner_a, minlength=n) + np.bincount(owner_b, minlength=n)
    return np.where(total == 0, 1.0, (total - apart) / np.maximum(total + apart, 1))


def rendered(table: tuple[np.ndarray, ...], owner: np.ndarray, n: int, cells: int) -> list[str]:
    """Fingerprints in hex: number of digests, then counter, digest and check of each cell."""
    packed = np.empty((n * cells,), dtype=[("count", "<i2"), ("key", "<u8"), ("check", "<u4")])
    packed["count"], packed["key"], packed["check"] = table[0].astype(np.int16), table[1], table[2].astype(np.uint32)
    flat, size = packed.reshape(n, cells), np.bincount(owner, minlength=n)
    return [f"{size[i]:x}:{flat[i].tobytes().hex()}" for i in range(n)]


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(ids: list, texts: list[str], following: list[str], p: SketchParams) -> pd.DataFrame:
    n, changed = len(texts), [edited(t, f) for t, f in zip(texts, following, strict=True)]
    (o, k), (oe, ke), (on, kn) = digests(texts, p.words), digests(changed, p.words), digests(following, p.words)
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, "Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": rendered(sketches(o, k, n, p.cells), o, n, p.cells),
            "edited_fingerprint": rendered(sketches(oe, ke, n, p.cells), oe, n, p.cells),
            "near_edited": likeness(o, k, oe, ke, n, p.cells),
            "near_next": likeness(o, k, on, kn, n, p.cells),
        }
    )


def fingerprint_documents(docs: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """Fingerprints of all texts and of their edited versions.

    Documents are sorted by descending id in shards of bounded size. The first
    document of a shard also goes to the shard before it, as its last successor.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    down = rows.withColumn("down", F.bitwise_not("doc_id"))
    shard, shards = ordered_shards(down, "down", F.char_length("text").cast("long") + 64, p.shard_chars)
    last = F.lit(shards - 1)
    placed = down.withColumn("shard", F.when(F.col("down").isNull(), last).otherwise(shard))
    tie = F.xxhash64("text")
    order = F.struct(F.col("down").isNull().alias("none"), "down", tie.alias("tie"))
    heads = settled(placed.groupBy("shard").agg(F.min(order).alias("head")), "print-heads")
    first = [(r["shard"], r["head"]["down"], r["head"]["tie"]) for r in heads.collect()]
    first.sort()
    before = {s: first[i - 1][0] for i, (s, _, _) in enumerate(first)}
    spark = docs.sparkSession
    extra_of = spark.createDataFrame([(d, t, before[s]) for s, d, t in first], "down long, tie long, target int")

    keyed = placed.withColumn("tie", tie)
    extra = keyed.alias("k").join(F.broadcast(extra_of).alias("e"), F.col("k.down").eqNullSafe(F.col("e.down")) & (F.col("k.tie") == F.col("e.tie")))
    extra = extra.select("k.doc_id", "k.text", "k.down", F.col("k.tie").alias("tie"), F.col("e.target").alias("shard"), F.lit(1).alias("extra")).dropDuplicates(["down", "tie", "shard"])
    own = keyed.select("doc_id", "text", "down", "tie", "shard", F.lit(0).alias("extra"))
    dealt = own.unionByName(extra).repartitionById(shards, F.col("shard"))
    # the extra row closes its shard; the first document of all follows the last
    dealt = dealt.sortWithinPartitions("shard", "extra", F.col("down").asc_nulls_last(), "tie")
    # as text, since a NULL would turn the long ids of its batch into doubles
    dealt = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "extra", "shard")

    def compare(batches):
        held: list[tuple] = []  # rows whose successor has not come yet, at most one after each round
        ready: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text, extra, of in batch.itertuples(index=False):
                if held and held[0][2] == of:
                    ready.append((*held.pop()[:2], text))
                    size += len(ready[-1][1]) + 64
                if not extra:
                    held = [(None if pd.isna(doc) else int(doc), text, of)]
                if size > p.batch_chars:
                    yield compared(*map(list, zip(*ready, strict=True)), p)
                    ready, size = [], 0
        if ready:
            yield compared(*map(list, zip(*ready, strict=True)), p)

    return dealt.mapInPandas(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
