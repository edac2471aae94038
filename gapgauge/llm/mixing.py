"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a ramp: its share of the mix moves linearly over
training time t from weight x (1 - ramp) at t = 0 to weight x (1 + ramp) at
t = 1. The integral of the ramp is the source's cumulative token demand, and
its inverse turns a place in the source's token stream into a time. A source is
streamed in a random but repeatable order, whole epochs first and then the part
of an epoch that is left; a document's position is the time at which the middle
of its tokens is asked for, and the mix is the documents range-sorted by it.

Targets: all sources share ``volume`` x all sizes by weight. A source stops at
``repeats`` x its own size, and what it can't take goes to the others by weight
until none is above. A document enters the last part of an epoch if its middle
lies before the end, so a source misses its target by half a document at most.

Size: runs of characters other than the six ASCII white-space ones. NULL or
empty text has size 0 and is never taken. The NULL source is a source of its
own, the last one; sources are ordered by code point. Repeated rows are documents of their own. No document: no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgauge.llm.common import hash_unit, settled

#: Fixed value: what counts as one word of a document's size.
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: Sequence[float] = (5.0, 2.0, 1.0)
    ramps: Sequence[float] = (-0.4, 0.0, 0.4)
    volume: float = 1.5
    repeats: float = 2.0
    bucket_rows: int = 20_000
    seed: int = 7


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def cycled(values: Sequence[float], place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(place - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """_source, weight, ramp, source_size, target from (_source, source_size).

    A source is capped if its cap is below the weight's share of what the
    sources with lower cap per weight leave; that settles all rounds of sharing
    the excess at once. One row for each source is all that is sorted.
    """
    order = F.row_number().over(Window.orderBy("_source"))
    ranked = sizes.withColumn("_place", order).withColumns({"weight": cycled(p.weights, F.col("_place")), "ramp": cycled(p.ramps, F.col("_place"))})
    capped = ranked.withColumn("_cap", F.col("source_size") * F.lit(p.repeats)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    everyone = Window.partitionBy()
    before = Window.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(p.volume) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = capped.withColumn("_level", left / weights)
    free = level.withColumn("_free", F.when(F.col("_ratio") > F.col("_level"), F.col("_level")))
    settled_level = F.max("_free").over(everyone)
    target = F.when(F.col("_free").isNull(), F.col("_cap")).otherwise(settled_level * F.col("weight"))
    return free.select("_source", "weight", "ramp", "source_size", target.alias("target"))


def demand_time(share: Column, ramp: Column) -> Column:
    """Time by which ``share`` of a source's tokens is asked for.

    The demand up to t is t + ramp (t^2 - t); this is its inverse on [0, 1].
    """
    slope = 1 - ramp
    return 2 * share / (slope + F.sqrt(slope * slope + 4 * ramp * share))


def mixing_plan(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken and positions.

    ``positions`` has the time of every copy. Columns of these names are replaced.
    Cumulative sizes come from sums per range of the random order, so a source
    with a third of all rows is spread over many tasks.
    """
    sized = docs.drop("size", "source_size", "target", "copies", "taken", "positions")
    key = [F.col("doc_id").cast("string"), F.xxhash64("text"), F.lit(p.seed)]
    sized = sized.withColumns({"_source": F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("z")), "size": text_size(F.col("text")), "_u": hash_unit(*key)})
    per_source = settled(sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "mix-sources")
    most = per_source.agg(F.max("_rows")).first()[0] or 0
    buckets = max(64, -(-most // p.bucket_rows))
    sized = sized.withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    sums = sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("_begun", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    targets = source_targets(per_source.drop("_rows"), p)
    ranges = settled(begun.join(targets.select("_source", F.col("ramp").alias("_ramp"), "source_size", "target"), "_source"), "mix-ranges")

    joined = sized.join(ranges, ["_source", "_bucket"])
    within = Window.partitionBy("_source", "_bucket").orderBy("_u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_begun") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = joined.withColumn("_middle", start + F.col("size") / 2)
    epochs = F.floor(F.col("target") / F.col("source_size")).cast("int")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = F.when(F.col("size") == 0, 0).otherwise(epochs + (F.col("_middle") < rest).cast("int"))
    placed = placed.withColumn("copies", copies)
    share = lambda epoch: F.least(F.lit(1.0), (epoch * F.col("source_size") + F.col("_middle")) / F.col("target"))
    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: demand_time(share(e), F.col("_ramp")))).otherwise(F.array().cast("array<double>"))
    placed = placed.withColumns({"taken": (F.col("copies") * F.col("size")).cast("long"), "positions": times})
    return placed.select(*(c for c in sized.columns if not c.startswith("_")), "source_size", "target", "copies", "taken", "positions")


def mixed_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mix: every copy a row, range-sorted by position, columns of ``docs``."""
    packed = docs.select("doc_id", "text", "source", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    each = mixing_plan(packed, p).select("doc_id", "row", F.explode("positions").alias("position"))
    return each.orderBy("position", "doc_id").select("row.*")
