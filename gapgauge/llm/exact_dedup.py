"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Texts count as equal when they are identical after lower-casing A-Z only, which
changes no length, so the length in bytes separates texts before anything is
hashed. Three groupings follow each other, each over what the one before left:

1. lengths that at least two rows have,
2. among their rows, pairs (length, hash of the first characters) that at least
   two rows have; the rest of a text is not hashed so far,
3. the SHA-256 of the whole normalised text, for rows of such a pair only.

No text is ever shuffled to decide. The pairs that are left reach the second
scan as a bitmap of a checked size; a row whose bit is not set has no equal. A
row whose bit is set by chance is hashed for nothing, and the last grouping goes
by length, prefix and digest, so results do not depend on the bitmap's size.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgauge.llm.common import settled

#: Bits of one row of the bitmap, as Spark's bitmap functions have it.
ROW_BITS = 32_768
GROUP = ["length", "prefix", "digest"]


@dataclass(frozen=True)
class DedupParams:
    prefix_chars: int = 256
    # The bitmap has 16 bits for each pair that is left, up to this: 16 MB for
    # every task. Beyond that more rows are hashed for nothing, none is missed.
    filter_bits: int = 1 << 27


def normalised(text: Column) -> Column:
    """Lower case of A-Z only. Pure ASCII takes the short way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _keys(text: Column, p: DedupParams) -> list[Column]:
    prefix = F.xxhash64(normalised(F.substring(text, 1, p.prefix_chars)))
    return [F.octet_length(text).alias("length"), prefix.alias("prefix")]


def shared_prefixes(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """Pairs (length, prefix) of at least two rows: what the first two groupings leave."""
    keys = settled(docs.select(*_keys(F.coalesce("text", F.lit("")), p)), "dedup-keys")
    # Written, so that a length that very many rows have is an ordinary skewed join.
    lengths = settled(keys.groupBy("length").count().filter("count > 1").select("length"), "dedup-lengths")
    return keys.join(lengths, "length", "left_semi").groupBy("length", "prefix").count().filter("count > 1").drop("count")


def _with_bit(rows: DataFrame, shared: DataFrame, p: DedupParams) -> DataFrame:
    """Column ``suspect``: whether the bit of the row's (length, prefix) is set."""
    wanted = max(ROW_BITS, 16 * shared.count())
    bits = min(p.filter_bits, 1 << (wanted - 1).bit_length())
    place = F.pmod(F.xxhash64("length", "prefix"), F.lit(bits))
    bitmap = (
        shared.select(place.alias("place"))
        .groupBy(F.floor(F.col("place") / ROW_BITS).alias("_at"))
        .agg(F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("_bits"))
    )
    placed = rows.withColumn("_place", place).withColumn("_at", F.floor(F.col("_place") / ROW_BITS))
    inside = (F.col("_place") % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    set_bit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), inside % 8)), F.lit(2)) == 1
    # At most filter_bits / ROW_BITS rows of 4 KB.
    joined = placed.join(F.broadcast(bitmap), "_at", "left")
    return joined.withColumn("suspect", F.coalesce(set_bit, F.lit(False))).drop("_at", "_bits", "_place")


def exact_duplicates(docs: DataFrame, p: DedupParams = DedupParams(), every_digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Exactly one row of a group of equal texts is kept, that with the largest id;
    NULL ids come last, and of equal rows with that id any one. A NULL text is
    an empty one. ``text_sha256`` is the digest of the normalised text; it is
    NULL where no other row has the same length and prefix, unless
    ``every_digest`` asks for it. An empty table gives an empty result; other
    columns of ``docs`` play no part, whatever their names.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = _with_bit(rows.select("doc_id", "text", *_keys(F.col("text"), p)), shared_prefixes(docs, p), p)
    digest = F.sha2(normalised(F.col("text")), 256)
    hashed = found.select(
        "doc_id",
        "length",
        "prefix",
        "suspect",
        (digest if every_digest else F.when(F.col("suspect"), digest)).alias("digest"),
        # Tells equal rows apart; only the written value is used.
        F.monotonically_increasing_id().alias("row"),
    )
    hashed = settled(hashed, "dedup-digests")
    suspects = hashed.filter("suspect")
    groups = (
        suspects.groupBy(*GROUP)
        .agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    # Written, so that Spark can split the rows of a large group when it joins.
    groups = settled(groups.select(*GROUP, "last", "group_size"), "dedup-groups")
    joined = suspects.join(groups, GROUP, "left").select(
        "doc_id",
        F.when(F.col("last").isNotNull(), F.col("last.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    alone = hashed.filter("not suspect").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return joined.unionByName(alone)


def deduplicated(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, as they are.

    Rows that share an id and a text but differ elsewhere are told apart by the
    digest of the whole row, so a repeated run keeps the same one. Only rows that
    may have an equal are grouped; a task sends one row of a group at most.
    """
    packed = docs.select(F.struct("*").alias("doc"))
    text = F.coalesce("doc.text", F.lit(""))
    found = _with_bit(packed.select("doc", *_keys(text, p)), shared_prefixes(docs, p), p)
    alone = found.filter("not suspect").select("doc.*")
    order = F.struct(F.col("doc.doc_id"), F.sha2(F.to_json("doc"), 256))
    grouped = found.filter("suspect").groupBy("length", "prefix", F.sha2(normalised(text), 256).alias("digest"))
    return grouped.agg(F.max_by("doc", order).alias("doc")).select("doc.*").unionByName(alone)
