"""Line deduplication with a log-template tree.

A line is its whitespace-separated tokens. The tree has a fixed depth: the
token count, then the ``depth`` leading tokens, where a token with a digit
counts as variable. Within a leaf, a token stays constant if at least
``min_documents`` texts and half of the leaf's have it at that place; all others
become the wildcard. Lines with too few constant places (share ``constant``)
are judged again among those of the same pattern, by a quarter of the share
each time; what never gets enough is a template of its own (variable tokens
masked). Shares do not depend on the size of the table, and no order of arrival
is needed, so any number of tasks build the same tree.

A template recurs, and all its lines are dropped, if ``min_documents`` texts
that are no near copies of each other have it, whatever the number of all texts.
Texts are near copies if their sets of three-word runs overlap by ``alike``,
estimated from one-permutation sketches of BINS bins. So copies of a document
do not turn its own lines into boilerplate, while texts that share a passage
stay apart; near-duplicate removal is another operator's work.

NULL text stays NULL and empty text stays empty; blank lines are never
templates and stay. A document can lose all lines; it then has the text "".
Repeated rows are copies and treated alike. No document: no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgauge.llm.common import hashed, mixed, settled, slices

DIGIT = re.compile(r"\d")
VARIABLE = "<*>"
BITMAP_BITS = 1 << 22
BINS = 256
#: Parts into which the texts of a template are dealt before they are compared.
PARTS = 64
SALTS = 16
PRIME = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class LineParams:
    depth: int = 3
    min_documents: int = 3
    constant: float = 0.5
    alike: float = 0.65


def tokens_of(line: str) -> list[str]:
    """Tokens of a line, variable ones masked."""
    tokens = line.split()
    return [VARIABLE if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def chained(hashes: np.ndarray, taken: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Order-sensitive hash of each of the runs of ``taken`` hashes (none of them 0).

    ``sizes`` are the lengths that take part in the hash, where a run holds only
    the first hashes of something longer.
    """
    if not len(taken):
        return np.empty(0, np.uint64)
    starts = np.cumsum(taken) - taken
    place = np.arange(len(hashes)) - np.repeat(starts, taken)
    with np.errstate(over="ignore"):
        terms = mixed(hashes + place.astype(np.uint64) * np.uint64(PRIME))
        return mixed(np.add.reduceat(terms, starts) + (taken if sizes is None else sizes).astype(np.uint64))


def text_sketches(hashes: np.ndarray, sizes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """One row of BINS values for each of ``n`` texts: the smallest three-word run in each bin, 0 for an empty bin.

    Runs stay within a line; shorter lines give their single words.
    """
    starts = np.cumsum(sizes) - sizes
    padded = np.r_[hashes, np.zeros(2, np.uint64)]
    left = np.repeat(starts + sizes, sizes) - np.arange(len(hashes))
    with np.errstate(over="ignore"):
        grams = mixed(sum((padded[i : len(hashes) + i] * np.uint64(PRIME + 2 * i) for i in range(3)), np.uint64(0)))
    short = np.repeat(sizes < 3, sizes)
    grams[short] = mixed(hashes[short])
    taken = short | (left >= 3)
    grams, owner = grams[taken], np.repeat(doc, sizes)[taken]
    slot = owner * BINS + (grams >> np.uint64(56)).astype(np.int64)
    lowest = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(lowest, slot, grams)
    out = np.zeros(n * BINS, np.uint16)
    filled = np.unique(slot)
    # the bin is in the upper bits, so the lower ones tell the runs of a bin apart
    out[filled] = lowest[filled] % np.uint64(65521) + np.uint64(1)
    return out.reshape(n, BINS)


def overlap(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated share of common three-word runs of one text with each of ``others``."""
    used = ((others != 0) | (sketch != 0)).sum(axis=1)
    return ((others == sketch) & (sketch != 0)).sum(axis=1) / np.maximum(used, 1)


def apart(texts: DataFrame, by: list[str], p: LineParams) -> DataFrame:
    """Up to ``min_documents`` texts of each group, none of them near copies of each other.

    Texts come in the order of their hashes, so the choice repeats.
    """

    def pick(batches):
        at, held = None, np.zeros((0, BINS), np.uint16)
        for batch in batches:
            chosen = np.zeros(len(batch), bool)
            groups = batch[by].itertuples(index=False, name=None)
            for i, (group, sketch) in enumerate(zip(groups, batch["sketch"], strict=True)):
                if group != at:
                    at, held = group, held[:0]
                if len(held) < p.min_documents:
                    own = np.frombuffer(sketch, np.uint16)
                    if not (overlap(own, held) >= p.alike).any():
                        held, chosen[i] = np.r_[held, own[None]], True
            yield batch.loc[chosen, ["template", "text_hash", "sketch"]]

    sorted_texts = texts.repartition(*by).sortWithinPartitions(*by, "text_hash")
    return sorted_texts.mapInPandas(pick, "template long, text_hash long, sketch binary")


def leaf_bitmap(leaves: DataFrame) -> np.ndarray:
    """Bitmap of fixed size that holds the lowest bits of every leaf.

    It spares the second scan most lines of other leaves; a join decides.
    """
    low = F.col("leaf").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = leaves.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(leaf & 63 as int))").alias("bit"))
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).toLocalIterator():
        bitmap[word] = bits
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)


def scanned(docs: DataFrame, p: LineParams, keys: list[str]) -> DataFrame:
    """One row for each line that is not blank: the keys and hashes of the line.

    The first line of a text also has the text's sketch.
    """

    def parse(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                split = [[tokens_of(line) for line in (t or "").split("\n")] for t in batch["text"]]
                of_line = np.array([len(tokens) for lines in split for tokens in lines], np.int64)
                codes = hashed(chain.from_iterable(chain.from_iterable(split)))
                number = np.concatenate([np.arange(len(lines)) for lines in split])
                doc = np.repeat(np.arange(len(split)), [len(lines) for lines in split])
                full = of_line > 0
                of_line, number, doc = of_line[full], number[full], doc[full]
                leading = np.minimum(of_line, p.depth)
                place = np.arange(len(codes)) - np.repeat(np.cumsum(of_line) - of_line, of_line)
                leaf = chained(codes[place < p.depth], leading, of_line).view(np.int64)
                masked = chained(codes, of_line).view(np.int64)
                present, size = np.unique(doc), np.bincount(doc, weights=of_line, minlength=len(split)).astype(np.int64)
                text_hash = np.zeros(len(split), np.int64)
                text_hash[present] = chained(codes, size[present]).view(np.int64)
                sketch = np.empty(len(doc), object)
                first = np.unique(doc, return_index=True)[1]
                sketch[first] = [row.tobytes() for row in text_sketches(codes, of_line, doc, len(split))[present]]
                kept = {c: batch[c].to_numpy()[doc] if not batch[c].isna().any() else batch[c].iloc[doc].array for c in own}
                yield pd.DataFrame({**kept, "line_no": number, "leaf": leaf, "masked": masked, "text_hash": text_hash[doc], "sketch": sketch})

    # whole numbers go without NULL, which would turn those of its batch into doubles
    whole = [f.name for f in docs.select(keys).schema if isinstance(f.dataType, T.IntegralType)]
    sent = docs.select(*(F.coalesce(c, F.lit(0)).alias(c) if c in whole else c for c in keys), *(F.isnull(c).alias(f"{c}_null") for c in whole), "text")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in sent.drop("text").schema]
    own = sent.drop("text").columns
    found = sent.mapInPandas(parse, ", ".join([*fields, "line_no int", "leaf long", "masked long", "text_hash long", "sketch binary"]))
    back = [F.when(~F.col(f"{c}_null"), F.col(c)).alias(c) if c in whole else c for c in keys]
    return found.select(*back, "line_no", "leaf", "masked", "text_hash", "sketch")


def masked_tokens(docs: DataFrame, p: LineParams, wanted: np.ndarray) -> DataFrame:
    """leaf, masked, tokens: hashed tokens of the lines in a leaf of the bitmap.

    A line that comes again within a slice of a batch is given once. Only the
    leading tokens of other lines are hashed.
    """

    def parse(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                lines = [tokens for t in batch["text"] if t for line in t.split("\n") if (tokens := line.split())]
                sizes = np.array([len(tokens) for tokens in lines], np.int64)
                first = hashed(VARIABLE if DIGIT.search(w) else w for tokens in lines for w in tokens[: p.depth])
                leaf = chained(first, np.minimum(sizes, p.depth), sizes).view(np.int64)
                at = np.flatnonzero(wanted[leaf & (BITMAP_BITS - 1)])
                codes = hashed(VARIABLE if DIGIT.search(w) else w for i in at.tolist() for w in lines[i])
                masked = chained(codes, sizes[at]).view(np.int64)
                once = np.unique(masked, return_index=True)[1]
                ends = np.cumsum(sizes[at])
                tokens = [codes[ends[i] - sizes[at[i]] : ends[i]].view(np.int64) for i in once]
                yield pd.DataFrame({"leaf": leaf[at[once]], "masked": masked[once], "tokens": pd.Series(tokens, dtype=object)})

    return docs.select("text").mapInPandas(parse, "leaf long, masked long, tokens array<long>")


def line_templates(docs: DataFrame, candidates: DataFrame, p: LineParams) -> DataFrame:
    """(masked, template) of the different masked lines that share a leaf.

    Lines alone in their leaf, or only repeated unchanged, are their own template.
    """
    distinct = settled(candidates.groupBy("leaf", "masked").agg(F.count_distinct("text_hash").alias("texts")), "line-masked")
    leaves = settled(distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("leaf"), "line-leaves")
    found = masked_tokens(docs, p, leaf_bitmap(leaves)).groupBy("leaf", "masked").agg(F.first("tokens").alias("tokens"))
    several = found.join(distinct, ["leaf", "masked"]).join(leaves, "leaf", "left_semi")
    active = several.select("leaf", "masked", "texts", "tokens", F.expr("transform(tokens, x -> cast(null as long))").alias("pattern"), F.col("leaf").alias("cluster"))
    active = settled(active, "line-several")
    done, share, salt = [], 0.5, F.pmod("masked", F.lit(SALTS)).cast("int")
    while True:
        active = settled(refined(active, share, salt, p), "line-clusters")
        enough = F.expr("size(filter(pattern, x -> x is not null)) / size(pattern)") >= p.constant
        general = F.when(enough, F.xxhash64("leaf", F.transform("pattern", lambda x: F.coalesce(x, F.lit(0)))))
        # a share of less than min_documents texts is no bound any more
        ends = enough | (share * F.col("total") <= p.min_documents)
        done.append(active.filter(ends).select("masked", F.coalesce(general, F.col("masked")).alias("template")))
        active, share = active.filter(~ends).drop("total"), share / 4
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)


def refined(lines: DataFrame, share: float, salt: Column, p: LineParams) -> DataFrame:
    """``lines`` with the constants of their cluster in ``pattern``, the new cluster and the texts of the old one.

    Constants are few for each cluster; they are repeated for SALTS parts of
    its lines, so that a cluster with many lines is spread over tasks.
    """
    totals = settled(lines.groupBy("cluster").agg(F.sum("texts").alias("total")), "line-totals")
    placed = lines.select("cluster", "texts", F.posexplode("tokens").alias("place", "token"))
    known = placed.groupBy("cluster", "place", "token").agg(F.sum("texts").alias("n")).filter(F.col("n") >= p.min_documents)
    known = known.join(totals, "cluster").filter(F.col("n") >= share * F.col("total"))
    known = known.groupBy("cluster").agg(F.collect_set(F.struct("place", "token")).alias("known"))
    known = totals.join(known, "cluster", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = F.expr("transform(tokens, (x, i) -> if(array_contains(known, named_struct('place', i, 'token', x)), x, pattern[i]))")
    joined = lines.withColumn("salt", salt).join(known, ["cluster", "salt"])
    pattern = F.when(F.col("known").isNull(), F.col("pattern")).otherwise(held)
    out = joined.select("leaf", "masked", "texts", "tokens", pattern.alias("pattern"), "total")
    return out.withColumn("cluster", F.xxhash64("leaf", F.transform("pattern", lambda x: F.coalesce(x, F.lit(0)))))


def recurring_lines(docs: DataFrame, p: LineParams = LineParams(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines of recurring templates: the keys, line_no, template, texts, families.

    ``families`` counts up to ``min_documents``, which decides.
    """
    lines = settled(scanned(docs, p, list(keys)), "line-rows")
    shared = lines.groupBy("leaf").agg(F.count_distinct("text_hash").alias("n")).filter(F.col("n") >= p.min_documents).select("leaf")
    candidates = settled(lines.drop("sketch").join(shared, "leaf", "left_semi"), "line-candidates")
    templates = settled(line_templates(docs, candidates, p), "line-templates")
    named = candidates.join(templates, "masked", "left").withColumn("template", F.coalesce("template", "masked"))
    named = settled(named.select(*keys, "line_no", "template", "text_hash"), "line-named")
    having = named.select("template", "text_hash").distinct()
    counted = settled(having.groupBy("template").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= p.min_documents), "line-counts")
    # any text of a hash has the same words; the smallest sketch makes the choice repeatable
    sketches = settled(lines.filter("sketch is not null").groupBy("text_hash").agg(F.min("sketch").alias("sketch")), "line-sketches")
    sketched = having.join(counted, "template", "left_semi").join(sketches, "text_hash")
    some = settled(apart(sketched.withColumn("part", F.pmod("text_hash", F.lit(PARTS))), ["template", "part"], p), "line-apart")
    families = apart(some, ["template"], p).groupBy("template").agg(F.count(F.lit(1)).alias("families"))
    counted = settled(counted.join(families.filter(F.col("families") >= p.min_documents), "template"), "line-families")
    return named.join(counted, "template").select(*keys, "line_no", "template", "texts", "families")


def drop_recurring_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """``docs`` without the lines of recurring templates, all columns kept.

    Adds ``lines_dropped`` under that name; a column of that name is replaced.
    Rows are matched by doc_id and the text itself, so ids may repeat or be NULL.
    """
    names = [c for c in docs.columns if c != "lines_dropped"]
    # the columns ride in one struct, so their names meet none of those used here
    keyed = docs.select(F.struct(*(docs[f"`{c}`"] for c in names if c != "text")).alias("row"), "doc_id", "text", F.xxhash64("text").alias("digest"))
    found = recurring_lines(keyed.select("doc_id", "text", "digest"), p, ("doc_id", "digest"))
    cuts = settled(found.groupBy(F.col("doc_id").alias("cut_id"), F.col("digest").alias("cut_digest")).agg(F.collect_set("line_no").alias("cut")), "line-cuts")
    joined = keyed.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("digest") == F.col("cut_digest")), "left")

    # a one-element array binds a value that an expression uses several times
    kept = F.expr("transform(array(split(text, '\\n', -1)), lines -> concat_ws('\\n', transform(array_except(sequence(0, size(lines) - 1), cut), i -> lines[i])))[0]")
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept)
    own = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return joined.select(*own, F.coalesce(F.size("cut"), F.lit(0)).alias("lines_dropped"))
