"""Near-duplicate documents by Order MinHash and banded alignment.

A text is the sequence of its lower-case words, and its items are the five-word
shingles, each labelled with its occurrence number. A sketch holds, for every
one of ``repeats`` hash orders, the ``picks`` smallest items in the order in
which they stand in the text. Two texts are candidates if one such ordered
pick agrees. A candidate is kept if an alignment within a band pairs enough
items in order: paired / (items of both - paired) >= ``similarity``. No pair of
that similarity lies outside the band. At similarity 0.8 a pair misses all 24
picks of three with probability 0.488 ** 24 = 3e-8.

No bucket is expanded into pairs. First every text is compared with the most
central text of each of its buckets; the linked texts become one group. Then,
within buckets that still hold several groups, texts outside the largest group
meet those of other groups if their lengths and two sketches allow the
similarity: the lowest bits of 128 minima, and the parity of the items in 1024
bins, whose difference counts the items that the two texts do not share (a miss
needs more than four standard deviations). Buckets above ``hot`` texts are cut
by a second agreeing pick, which every similar pair has, too.

Equal word sequences are one node of the graph whatever their number. NULL and
texts without a word are the same empty sequence and so copies of each other.
Rows that repeat a document, even its id, are kept as rows. No document: no row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgauge.llm.common import hashed, mixed, multipliers, settled, slices, words_of

BITS = 128
BINS = 1024
#: Size of the bitmap of nodes whose texts are wanted: 8 MB, whatever the table.
BITMAP_BITS = 1 << 26
DEVIATIONS = 4.3
PARITIES = [f"o{i}" for i in range(BINS // 64)]
SKETCH = ["n", "b0", "b1", *PARITIES]
CHUNK = 4096


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    similarity: float = 0.8
    repeats: int = 24
    picks: int = 3
    hot: int = 2000


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, one for a shorter text, none for an empty one."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : n - k + 1 + i]
    return mixed(out)


def labelled(items: np.ndarray) -> np.ndarray:
    """Mix the occurrence number into every repeated item."""
    order = np.argsort(items, kind="stable")
    ranked = items[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]] if len(items) else np.empty(0, bool)
    if first.all():
        return items
    place = np.arange(len(items))
    number = place - np.maximum.accumulate(np.where(first, place, 0))
    out = items.copy()
    again = number > 0
    out[order[again]] = mixed(ranked[again] + number[again].astype(np.uint64))
    return out


def sketch(items: np.ndarray, repeats: int, picks: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered picks, one hash for each repeat, and the lowest bits of BITS minima."""
    orders, minima = multipliers(repeats, 1), multipliers(BITS, 2)
    lowest = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    places = []
    with np.errstate(over="ignore"):
        for begin in range(0, len(items), CHUNK):
            part = items[begin : begin + CHUNK, None]
            lowest = np.minimum(lowest, (part * minima).min(axis=0))
            values = part * orders
            if len(part) > picks:
                places.append(np.argpartition(values, picks - 1, axis=0)[:picks] + begin)
            else:
                places.append(np.broadcast_to(np.arange(len(part))[:, None] + begin, (len(part), repeats)))
        found = np.concatenate(places)
        if len(found) > picks:
            best = np.argpartition(items[found] * orders, picks - 1, axis=0)[:picks]
            found = np.take_along_axis(found, best, axis=0)
        found = np.sort(found, axis=0)
        keys = np.arange(repeats, dtype=np.uint64)
        for row in items[found]:
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    bits = np.packbits((mixed(lowest) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return keys.view(np.int64), bits


def parities(items: np.ndarray) -> np.ndarray:
    """Parity of the number of items in every bin, packed into longs."""
    odd = np.bincount((mixed(items) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Share of items paired by the longest in-order chain within the band.

    Every item of a chain that reaches ``least`` is shifted by at most
    (1 - least) x the longer text, so the band loses nothing.
    """
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if longer == 0:
        return 1.0
    if shorter < least * longer:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= (1 - least) * longer + 1
    i, j = i[near], j[near]
    tails: list[int] = []
    for place in j[np.argsort(i)].tolist():
        at = bisect_left(tails, place)
        if at == len(tails):
            tails.append(place)
        else:
            tails[at] = place
    return len(tails) / (len(a) + len(b) - len(tails))


def items_of(texts: list[str | None], k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Digest of the word sequence and labelled shingles of every text."""
    split = [words_of(t) for t in texts]
    codes = hashed(w for words in split for w in words)
    at = 0
    for words in split:
        own = codes[at : at + len(words)]
        at += len(words)
        yield xxhash.xxh3_128_digest(" ".join(words).encode()), labelled(shingle_hashes(own, k))


def signatures(docs: DataFrame, p: NearParams, row_key: list[str]) -> DataFrame:
    """One row for each row of ``docs``: the row key, node and sketch of the text."""
    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for node, items in items_of(part["text"].tolist(), p.shingle):
                    keys, bits = sketch(items, p.repeats, p.picks) if len(items) else (np.empty(0, np.int64), np.zeros(2, np.int64))
                    rows.append((node, keys, len(items), *bits.tolist(), *parities(items).tolist()))
                yield pd.DataFrame(rows, columns=["node", "keys", *SKETCH], index=part.index).assign(**{c: part[c] for c in row_key})[[*row_key, "node", "keys", *SKETCH]]

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(row_key).schema]
    return docs.select(*row_key, "text").mapInPandas(sign, ", ".join([*fields, "node binary, keys array<long>", *(f"{c} long" for c in SKETCH)]))


def apart(a: str, b: str, columns: list[str]) -> Column:
    return reduce(add, (F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in columns))


def most_apart(similarity: float) -> int:
    """Bits in which minima of so similar texts can differ: mean + deviations."""
    p = (1 - similarity) / 2
    return int(np.ceil(BITS * p + DEVIATIONS * np.sqrt(BITS * p * (1 - p))))


def may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether lengths and sketches of ``a`` and ``b`` allow the similarity.

    So similar texts share all but (1 - s) / (1 + s) of their items. That many
    items at most make as many bins odd, fewer where items meet in a bin.
    """
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    single = total * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    rate = single / F.lit(float(BINS))
    mean = F.lit(BINS / 2) * (F.lit(1.0) - F.exp(rate * -2))
    spread = F.lit(BINS / 4) * (F.lit(1.0) - F.exp(rate * -4)) - single * F.exp(rate * -4)
    odd = F.least(single, mean + F.lit(DEVIATIONS) * F.sqrt(F.greatest(spread, F.lit(0.0))) + F.lit(1.0))
    lengths = F.least(f"{a}.n", f"{b}.n") >= F.greatest(f"{a}.n", f"{b}.n") * F.lit(similarity)
    return lengths & (apart(a, b, ["b0", "b1"]) <= most_apart(similarity)) & (apart(a, b, PARITIES) <= odd)


def buckets(nodes: DataFrame, p: NearParams) -> DataFrame:
    """(key, node, size) of all buckets with more than one node."""

    def shared(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        return rows.join(sizes, "key")

    single = settled(shared(nodes.select("node", F.explode("keys").alias("key"))), "near-buckets")
    hot = single.filter(F.col("size") > p.hot)
    if hot.isEmpty():
        return single
    both = hot.select("node", "key").join(nodes.select("node", "keys"), "node")
    finer = both.select("node", F.col("key").alias("first"), F.explode("keys").alias("second")).filter("first != second")
    fine = shared(finer.select("node", F.xxhash64("first", "second").alias("key")))
    return settled(single.filter(F.col("size") <= p.hot).unionByName(fine.select("key", "node", "size")), "near-finer")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()


def central_pairs(shared: DataFrame, sketches: DataFrame, p: NearParams) -> DataFrame:
    """Every node with the most central node of each of its buckets."""
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = settled(shared.join(weight, "node"), "near-weights")
    leaders = settled(weighted.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("leader")), "near-leaders")
    pairs = ordered_pairs(weighted.join(leaders, "key").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    pairs = settled(pairs, "near-central")
    left, right = sketches.alias("l"), sketches.alias("r")
    kept = pairs.join(left, F.col("a") == F.col("l.node")).join(right, F.col("b") == F.col("r.node"))
    return kept.filter(may_be_similar("l", "r", p.similarity)).select("a", "b")


def cross_pairs(shared: DataFrame, sketches: DataFrame, labels: DataFrame, p: NearParams) -> DataFrame:
    """Pairs of different groups that share a bucket and may be similar."""
    grouped = settled(shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "near-grouped")
    per_group = grouped.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_keys = per_group.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("groups"))
    open_keys = settled(open_keys.filter("groups > 1").drop("groups"), "near-open")
    mixed_rows = settled(grouped.join(open_keys, "key").join(sketches, "node"), "near-mixed")
    l, r = mixed_rows.filter("label != main").alias("l"), mixed_rows.alias("r")
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.label") != F.col("r.label"))
    met &= (F.col("r.label") == F.col("r.main")) | (F.col("l.node") < F.col("r.node"))
    met &= may_be_similar("l", "r", p.similarity)
    return ordered_pairs(l.join(r, met).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))


def verified(pairs: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """Pairs whose banded alignment reaches the similarity."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")

    def align(batches):
        for whole in batches:
            for batch in slices(whole, "text_a"):
                a = [i for _, i in items_of(batch["text_a"].tolist(), p.shingle)]
                b = [i for _, i in items_of(batch["text_b"].tolist(), p.shingle)]
                alike = [aligned_similarity(x, y, p.similarity) for x, y in zip(a, b, strict=True)]
                out = batch[["a", "b"]].assign(similarity=alike)
                yield out[out["similarity"] >= p.similarity]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(align, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the connected component.

    Rounds of smallest neighbouring label and one jump along the labels.
    """
    both = settled(edges.select("a", "b").union(edges.select("b", "a")), "near-edges")
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "near-labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = settled(labels.join(heard, "node", "left").select("node", "label", F.least("label", "heard").alias("next")), "near-heard")
        jump = near.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = near.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved"))
        moved = settled(moved, "near-labels")
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels


def near_classes(docs: DataFrame, p: NearParams, row_key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Row key, node and label (smallest node of the class) of every row, and the links."""
    signed = settled(signatures(docs, p, row_key), "near-signatures")
    nodes = signed.groupBy("node").agg(*(F.first(c).alias(c) for c in ["keys", *SKETCH]))
    nodes = settled(nodes, "near-nodes")
    sketches = nodes.select("node", *SKETCH)
    shared = buckets(nodes, p)
    central = settled(central_pairs(shared, sketches, p), "near-first")
    texts = bucket_texts(docs, shared)
    links = settled(verified(central, texts, p), "near-links")
    labels = components(links)
    more = cross_pairs(shared, sketches, labels, p).join(central, ["a", "b"], "left_anti")
    more = settled(verified(settled(more, "near-second"), texts, p), "near-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    labelled_rows = signed.select(*row_key, "node").join(labels, "node", "left").select(*row_key, "node", F.coalesce("label", "node").alias("label"))
    return settled(labelled_rows, "near-members"), links


def near_duplicates(docs: DataFrame, p: NearParams = NearParams()) -> tuple[DataFrame, DataFrame]:
    """Membership and links of near-duplicate documents.

    ``docs`` needs doc_id and text. The first frame has one row for each row of
    ``docs``: doc_id, node (digest of the word sequence), class_id (smallest
    doc_id of the class). The second has the verified links between different
    word sequences that were needed to form the classes: a, b, similarity.
    """
    # as text, since long ids beside NULL would pass through pandas as floats
    named = docs.select(F.col("doc_id").cast("string").alias("name"), "text")
    grouped, links = near_classes(named, p, ["name"])
    grouped = grouped.select("node", "label", F.col("name").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    lowest = settled(grouped.groupBy("label").agg(F.min("doc_id").alias("class_id")), "near-classes")
    return grouped.join(lowest, "label").select("doc_id", "node", "class_id"), links


def node_bitmap(nodes: DataFrame) -> np.ndarray:
    """Bitmap of fixed size that holds the leading bits of every node.

    It spares most texts without a bucket the way to the join, which decides;
    on a table that fills it, all texts go there.
    """
    places = nodes.select((F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long") % F.lit(BITMAP_BITS)).alias("place"))
    words = places.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).toLocalIterator():
        bitmap[word] = bits
    return bitmap.view(np.uint8)


def bucket_texts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, text) of the nodes that share a bucket, one text for each."""
    wanted = settled(shared.select("node").distinct(), "near-wanted")
    held = node_bitmap(wanted)

    def digests(batches):
        for batch in batches:
            nodes = [xxhash.xxh3_128_digest(" ".join(words_of(t)).encode()) for t in batch["text"]]
            at = np.array([int.from_bytes(n[:4], "big") % BITMAP_BITS for n in nodes], np.int64)
            known = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield pd.DataFrame({"node": nodes, "text": batch["text"]})[known]

    keyed = docs.select("text").mapInPandas(digests, "node binary, text string")
    return settled(keyed.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "near-texts")


def keep_one(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """One row of every class: smallest doc_id, then node, then digest of the text.

    NULL ids come last. A row is known by its id and text, so ids may repeat.
    Of rows equal in both, the first by all columns (as JSON) stays.
    """
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", "text", digest.alias("digest"))
    # as text, since long ids beside NULL would pass through pandas as floats
    named = keyed.select(F.col("doc_id").cast("string").alias("name"), "digest", "text")
    grouped, _ = near_classes(named, p, ["name", "digest"])
    grouped = grouped.withColumn("doc_id", F.col("name").cast(docs.schema["doc_id"].dataType))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "digest")
    counts = grouped.groupBy("label", "node", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = counts.groupBy("label").agg(F.min(F.struct(order.alias("key"), "n")).alias("first"))
    first = settled(first.select(F.col("first.key.doc_id").alias("first_id"), F.col("first.key.digest").alias("first_digest"), F.col("first.n").alias("n")), "near-kept")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    single, several = first.filter("n = 1"), first.filter("n > 1")
    kept = keyed.join(single, same, "left_semi").select("row.*")
    if several.isEmpty():
        return kept
    rows = keyed.join(several, same, "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(rows.select("row.*"))
