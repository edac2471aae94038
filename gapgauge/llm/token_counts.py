"""Token counts from an exact length histogram.

Texts are encoded whole with a public byte-level BPE and only their lengths are
kept. Documents are aggregated by encoded length; suffix sums over the lengths
then answer, for every context limit, the number of documents and tokens, the
tokens left after cutting each document at the limit, and quantiles, all exact.

NULL text and empty text encode to 0 tokens and are counted with length 0.
Repeated rows count once each. Other columns are ignored. No document: no row.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgauge.llm.common import settled, slices, tokenizer_path

#: Fixed value: the published splitting pattern that belongs to the vocabulary file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``length`` of each row's text in tokens."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def lengths(batches):
        encode = encoding(path).encode_ordinary
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pd.DataFrame({"length": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return docs.select("text").mapInPandas(lengths, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length, with suffix sums.

    length, documents; documents_from, tokens_from: of documents at least this
    long; truncated_tokens: of all documents if each is cut at this length. The
    sums run over blocks of lengths, then within a block, so no task sees all.
    """
    counts = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("documents"))
    counts = settled(counts.withColumn("block", F.expr(f"length div {BLOCK}")), "lengths")
    docs, tokens = F.sum("documents"), F.sum(F.col("length") * F.col("documents"))
    blocks = counts.groupBy("block").agg(docs.alias("d"), tokens.alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.select("block", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("d", later, "d_later"), ("t", later, "t_later"), ("t", earlier, "t_earlier"))))
    own = Window.partitionBy("block").orderBy(F.col("length").desc())
    below = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.join(after, "block").select(
        "length",
        "documents",
        (F.sum("documents").over(own) + F.col("d_later")).alias("documents_from"),
        (F.sum(F.col("length") * F.col("documents")).over(own) + F.col("t_later")).alias("tokens_from"),
        (F.coalesce(F.sum(F.col("length") * F.col("documents")).over(below), F.lit(0)) + F.col("t_earlier")).alias("tokens_below"),
    )
    return sums.withColumn("truncated_tokens", F.col("tokens_below") + F.col("length") * F.col("documents_from")).drop("tokens_below")


def truncated_total(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: documents and tokens in all, documents cut, tokens left."""

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    each = histogram.withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    length, n = F.col("length"), F.col("documents")
    return each.groupBy("limit").agg(total(n).alias("documents"), total(length * n).alias("tokens"), total(F.when(length > F.col("limit"), n)).alias("documents_cut"), total(F.least(length, "limit") * n).alias("tokens_left"))


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Smallest length that at least the share of documents does not exceed."""
    whole = histogram.agg(F.max("documents_from").alias("total"))
    each = histogram.crossJoin(F.broadcast(whole)).withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    reached = F.col("total") - F.col("documents_from") + F.col("documents") >= F.ceil(F.col("share") * F.col("total"))
    return each.filter(reached).groupBy("share").agg(F.min("length").alias("length"))
