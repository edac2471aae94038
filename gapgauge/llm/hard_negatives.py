"""Hard negatives by Four-Russians scoring of integer vectors.

Components are scaled to integers and written in two's complement, one bit
plane after the other, eight components to a byte. For every anchor the sums of
all subsets of eight neighbouring components are tabulated (256 entries for each
group of eight). A candidate's score is then a walk over its planes from the
sign down: double what there is, add the entry that the plane's byte selects in
every group. All scores are exact integers.

Anchors are a stated set, scored against all rows in blocks: rows are dealt into
chunks and anchors into blocks of bounded size, and a task scores one chunk
against one block. It returns the best few of every anchor, never its scores, so
what leaves it is bounded by the block. The positives come first, since a
negative is judged by the score of its positive; a second run over the same
chunks then finds the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgauge.llm.common import settled

#: Scores held at a time, in one array that stays in the cache of a core.
CELLS = 1 << 18
MOST_TASKS = 20_000


@dataclass(frozen=True)
class MiningParams:
    scale: int = 256
    n_positives: int = 5
    n_negatives: int = 5
    # Percent of the positive's score: a negative lies between the two.
    least: int = 80
    most: int = 100
    chunk_rows: int = 2048
    block_anchors: int = 1024


def scaled_vectors(vectors: DataFrame, p: MiningParams) -> DataFrame:
    """vec_id, label and the components as whole numbers; each (id, label, vector) once.

    Rows with a NULL label, id, vector or component, or with one that is not
    finite, are left out.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * p.scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.select("vec_id", "label", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    )
    return usable.select("vec_id", "label", whole.alias("v")).distinct()


def bit_planes(v: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the planes, highest first: (bits, groups of eight, rows)."""
    planes = [np.packbits((v >> k) & 1, axis=1, bitorder="little") for k in range(bits - 1, -1, -1)]
    return np.stack([p.T for p in planes]).astype(np.intp) if len(v) else np.empty((bits, v.shape[1] // 8, 0), np.intp)


def subset_sums(a: np.ndarray) -> np.ndarray:
    """For every group of eight components the sums of all its subsets: (groups, 256, anchors)."""
    groups = a.T.reshape(-1, 8, len(a))
    table = np.zeros((len(groups), 256, len(a)), a.dtype)
    for i in range(8):  # the upper half of the first 2^(i+1) entries has component i
        table[:, 1 << i : 2 << i] = table[:, : 1 << i] + groups[:, i : i + 1]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products of rows (last axis of ``planes``) and anchors."""
    n = planes.shape[2]
    out = np.zeros((n, table.shape[2]), table.dtype)
    found = np.empty_like(out)
    for k, plane in enumerate(planes):
        out += out
        for sums, byte in zip(table, plane, strict=True):
            np.take(sums, byte, axis=0, out=found, mode="clip")
            # The highest plane of two's complement counts negative.
            np.subtract(out, found, out=out) if k == 0 else np.add(out, found, out=out)
    return out


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter vectors filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _blocks(rows: pd.DataFrame, anchors: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of runs of rows against all anchors of a block."""
    longest = max(1, max((len(v) for side in (rows, anchors) for v in side["v"]), default=1))
    width = -(-longest // 8) * 8
    v, a = _matrix(rows["v"], width), _matrix(anchors["v"], width)
    top = [max(int(x.max(initial=0)), -int(x.min(initial=0)), 1) for x in (v, a)]
    if top[0] * top[1] * width >= 1 << 62:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    bits = top[0].bit_length() + 1
    narrow = (1 << bits) * top[1] * width < 1 << 31
    table = subset_sums(a.astype(np.int32 if narrow else np.int64))
    step = max(1, CELLS // len(anchors))
    for begin in range(0, len(v), step):
        yield slice(begin, begin + step), scores(table, bit_planes(v[begin : begin + step], bits))


def _best(ids: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` highest different (value, id), ties by smaller id."""
    order = np.lexsort((ids, -values))
    ids, values = ids[order], values[order]
    fresh = np.r_[True, (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])][: len(ids)]
    return ids[fresh][:n], values[fresh][:n]


def _merged(parts: dict, key, ids: np.ndarray, values: np.ndarray, n: int) -> None:
    if len(ids):
        old = parts.get(key)
        if old is not None:
            ids, values = np.r_[old[0], ids], np.r_[old[1], values]
        parts[key] = _best(ids, values, n)


def _positives_of(rows: pd.DataFrame, anchors: pd.DataFrame, n: int) -> dict:
    """Best rows of the anchor's own label; only those are scored."""
    best: dict = {}
    for label, same in anchors.groupby("label"):
        own = rows[rows["label"] == label].sort_values("vec_id")
        ids, names = own["vec_id"].to_numpy(), same["vec_id"].to_numpy()
        for part, s in _blocks(own, same) if len(own) else ():
            for j, (at, name) in enumerate(zip(same["at"], names, strict=True)):
                other = ids[part] != name
                _merged(best, at, ids[part][other], s[other, j].astype(np.int64), n)
    return best


def _negatives_of(rows: pd.DataFrame, anchors: pd.DataFrame, p: MiningParams) -> dict:
    """Best rows of other labels below each positive of each anchor."""
    best: dict = {}
    rows = rows.sort_values("vec_id")
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    places, names, own = (anchors[c].to_numpy() for c in ("at", "vec_id", "label"))
    bounds = [sorted({int(x) for x in found}, reverse=True) for found in anchors["found"]]
    for part, s in _blocks(rows, anchors):
        for j, positives in enumerate(bounds):
            column = s[:, j]
            # What lies between the lowest lower and the highest upper bound of all positives.
            low = min(-(-p.least * x // 100) for x in positives) if positives else 0
            high = max(p.most * x // 100 for x in positives) if positives else -1
            inside = np.flatnonzero((column >= low) & (column <= high) & (labels[part] != own[j]) & (ids[part] != names[j]))
            if not len(inside):
                continue
            values, candidates = column[inside].astype(np.int64), ids[part][inside]
            for x in positives:
                fits = (100 * values <= p.most * x) & (100 * values >= p.least * x)
                if fits.any():
                    _merged(best, (places[j], x), candidates[fits], values[fits], p.n_negatives)
    return best


FOUND = "at long, bound long, vec_id long, score long"


def _frame(best: dict) -> pd.DataFrame:
    parts = []
    for key, (ids, values) in best.items():
        at, bound = key if isinstance(key, tuple) else (key, 0)
        parts.append(pd.DataFrame({"at": at, "bound": bound, "vec_id": ids, "score": values}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("at", "bound", "vec_id", "score")})


def _scored(rows: DataFrame, anchors: DataFrame, chunks: int, blocks: int, work) -> DataFrame:
    """``work`` on every chunk of rows with every block of anchors."""
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # A number of tasks that Spark does not lower: the bytes are few, the work is not.
    tasks = min(2 * chunks * blocks, MOST_TASKS)
    # Of one type on both sides, or equal numbers would hash to different places.
    keys = {c: F.col(c).cast("int") for c in ("chunk", "block")}
    left, right = (side.withColumns(keys).repartition(tasks, "chunk", "block") for side in (left, right))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _frame(work(a, b) if len(a) and len(b) else {})

    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(score, FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` best of every anchor and bound; a chunk sends at most ``n`` of them."""
    order = Window.partitionBy("at", "bound").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, is_anchor: Column, p: MiningParams = MiningParams()) -> DataFrame:
    """Negatives just below the positives of every anchor.

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` is a condition on
    vec_id and label. A row's score is its integer inner product with the
    anchor; shorter vectors count as filled with zeros. An anchor's positives
    are the rows of its label with the highest scores, its negatives, for each
    positive, the rows of other labels with the highest scores between
    ``least`` and ``most`` percent of the positive's. Ties go to the smaller id.
    Returns anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score; a positive without such a negative has no row.

    Rows with a NULL id, label, vector or component or with one that is not
    finite take no part. Rows equal in id, label and vector count once, rows
    with the anchor's id are never its positives or negatives, and rows of one
    id and score are one candidate. An empty table, or one without an anchor,
    gives an empty result; other columns play no part. Scores must fit 64 bits.
    """
    rows = settled(scaled_vectors(vectors, p), "mining-rows")
    # Equal rows are gone, so hashes deal evenly.
    where = F.xxhash64("vec_id", "label", "v")
    chosen = rows.filter(is_anchor)
    n_rows, n_anchors = rows.count(), chosen.count()
    chunks, blocks = max(1, -(-n_rows // p.chunk_rows)), max(1, -(-n_anchors // p.block_anchors))
    dealt = rows.withColumn("chunk", F.pmod(where, F.lit(chunks)))
    # An anchor goes by its hash, since rows of one id may differ.
    anchors = chosen.withColumns({"block": F.pmod(where, F.lit(blocks)), "at": where})

    found = _scored(dealt, anchors, chunks, blocks, lambda a, b: _positives_of(a, b, p.n_positives))
    positives = settled(_first(found, p.n_positives).select("at", "vec_id", "score"), "mining-positives")
    bounds = positives.groupBy("at").agg(F.collect_set("score").alias("found"))
    judged = settled(anchors.join(bounds, "at"), "mining-anchors")
    found = _scored(dealt, judged, chunks, blocks, lambda a, b: _negatives_of(a, b, p))
    negatives = _first(found, p.n_negatives)
    names = judged.select("at", F.col("vec_id").alias("anchor_id"))
    return (
        positives.select("at", F.col("vec_id").alias("positive_id"), F.col("score").alias("bound"))
        .join(names, "at")
        .join(negatives.withColumnRenamed("vec_id", "negative_id"), ["at", "bound"])
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            "negative_id",
            F.col("bound").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
