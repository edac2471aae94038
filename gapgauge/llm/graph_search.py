"""Approximate nearest neighbours by a robust-pruned directed graph.

Vectors are dealt into shards of at most ``shard`` different vectors. Each
shard builds one graph: points enter in rounds of doubling size, a greedy
search over the graph so far proposes neighbours, and relaxed distance pruning
keeps an edge only if no kept neighbour is closer to the target by the factor
``alpha``. A query walks every shard's graph with a beam of ``beam`` and the
shards' nearest are merged. The measure is the inner product, by which queries
walk in double precision. Graphs are built by distances: one extra coordinate
gives all vectors the length of the longest. A shard holds vectors whose lengths
differ by a factor of two at most and is scaled to length 1, so no vector hides
the distances of others. Reported scores are double-precision products of the
original vectors.

Equal vectors are one point with its ``k`` + 1 smallest ids, so a vector that
fills a third of the table is one point. Rows with a NULL id, a NULL, empty or
zero vector, or NULL or non-finite components take no part, neither as queries
nor as candidates; vectors of another length are searched among themselves.
Repeated ids are separate rows, and a query excludes rows of its own id. Ties
go to the smaller id. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgauge.llm.common import settled

QUERY_BLOCK = 8192


@dataclass(frozen=True)
class GraphParams:
    k: int = 20
    shard: int = 4096
    degree: int = 32
    beam: int = 96
    alpha: float = 1.2


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def octave(vector: Column) -> Column:
    """Whole binary logarithm of the length, with lengths around 1 in one class."""
    most = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / most) * (x / most))
    return F.floor(F.log2(most) + F.log2(squares) / 2 + 0.5).cast("int")


def scaled(vectors: np.ndarray, axis: int | None = None) -> np.ndarray:
    """``vectors`` over their largest component (of each along ``axis``)."""
    return vectors / np.abs(vectors).max(axis=axis, keepdims=axis is not None)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def opposed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Negative inner product: the larger the product, the nearer."""
    return -(a * b).sum(axis=1)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all have the length of the longest."""
    squares = (vectors**2).sum(axis=1)
    return np.c_[vectors, np.sqrt(np.maximum(squares.max() - squares, 0))].astype(np.float32)


def walk(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, apart: Callable = squared) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step. Ids and distances of the beams, nearest first.

    ``graph`` has one row of neighbours for each point, -1 where there is none.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf, points.dtype)
    ids[:, 0], dist[:, 0] = start, apart(queries, points[start])
    seen = np.zeros((n, len(points)), bool)
    seen[:, start] = True
    opened = np.zeros((n, beam), bool)
    while True:
        waiting = np.where(opened | (ids < 0), np.inf, dist)
        at = waiting.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(waiting[np.arange(n), at]))
        if not len(live):
            return ids, dist
        opened[live, at[live]] = True
        around = graph[ids[live, at[live]]]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        r, c = np.nonzero(fresh)
        seen[live[r], around[r, c]] = True
        new = np.full(around.shape, np.inf, points.dtype)
        new[r, c] = apart(queries[live[r]], points[around[r, c]])
        all_ids, all_dist = np.c_[ids[live], np.where(fresh, around, -1)], np.c_[dist[live], new]
        all_open = np.c_[opened[live], np.zeros(around.shape, bool)]
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        pick = rows[: len(live)]
        ids[live], dist[live], opened[live] = all_ids[pick, best], all_dist[pick, best], all_open[pick, best]


def pruned(points: np.ndarray, owners: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of proposed neighbours (-1: none), for many points in step."""
    own = points[owners]
    bad = (proposed < 0) | (proposed == owners[:, None])
    dist = np.where(bad, np.inf, ((points[proposed] - own[:, None]) ** 2).sum(axis=2))
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(proposed, order, 1), np.take_along_axis(dist, order, 1)
    dist[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf
    out = np.full((len(owners), degree), -1)
    each = np.arange(len(owners))
    for place in range(degree):
        at = dist.argmin(axis=1)
        live = np.isfinite(dist[each, at])
        if not live.any():
            break
        chosen = cand[each, at]
        out[live, place] = chosen[live]
        between = ((points[cand] - points[chosen][:, None]) ** 2).sum(axis=2)
        dist[alpha**2 * between <= dist] = np.inf
        dist[each, at] = np.inf
    return out


def built(points: np.ndarray, p: GraphParams) -> tuple[np.ndarray, int]:
    """Neighbours of every point and the point where searches start."""
    n = len(points)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, p.degree), -1)
    order = np.random.default_rng(n).permutation(n)
    order = np.r_[start, order[order != start]]
    done, width = 1, 1
    while done < n:
        batch = order[done : done + width]
        ids, _ = walk(points, graph, start, points[batch], p.beam)
        graph[batch] = pruned(points, batch, ids, p.degree, p.alpha)
        source, place = np.nonzero(graph[batch] >= 0)
        target, source = graph[batch][source, place], batch[source]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        owners, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(owners), count.max(initial=0)), -1)
        back[np.repeat(np.arange(len(owners)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for begin in range(0, len(owners), 256):
            part = slice(begin, begin + 256)
            graph[owners[part]] = pruned(points, owners[part], np.c_[graph[owners[part]], back[part]], p.degree, p.alpha)
        done, width = done + len(batch), min(2 * width, 256, max(1, done))
    return graph, start


def shard_classes(distinct: DataFrame, p: GraphParams) -> tuple[DataFrame, int]:
    """(dim, octave, first, shards): numbers of the shards of each class; and their count."""
    rows, first = [], 0
    for r in distinct.groupBy("dim", "octave").count().orderBy("dim", "octave").collect():
        shards = -(-r["count"] // p.shard)
        rows.append((r["dim"], r["octave"], first, shards))
        first += shards
    return distinct.sparkSession.createDataFrame(rows, "dim int, octave int, first int, shards int"), max(1, first)


def shard_graphs(distinct: DataFrame, classes: DataFrame, p: GraphParams) -> DataFrame:
    """One row for each shard: vectors, ids and neighbours as packed arrays."""

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(batch["vector"].to_numpy()).astype(np.float64)
        graph, start = built(lifted(scaled(vectors)), p)
        return pd.DataFrame([(*batch[["dim", "shard"]].iloc[0], start, vectors.tobytes(), graph.astype(np.int32).tobytes(), batch["ids"].tolist())], columns=["dim", "shard", "start", "vectors", "graph", "ids"])

    # a range of the hash fills the shards evenly; the bound on their size holds on average
    dealt = distinct.join(F.broadcast(classes), ["dim", "octave"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, start int, vectors binary, graph binary, ids array<array<long>>")


def nearest(vectors: DataFrame, queries: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query.

    Both frames have vec_id and embedding. Each block of queries visits each
    shard: work is (queries x shards), pairs are never formed.
    """
    named = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    same = Window.partitionBy("vector").orderBy("vec_id")
    lowest = named.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= p.k + 1)
    distinct = lowest.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumns({"dim": F.size("vector"), "octave": octave(F.col("vector"))})
    distinct = settled(distinct, "graph-points")
    classes, shards = shard_classes(distinct, p)
    graphs = settled(shard_graphs(distinct, classes, p), "graph-shards")

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).filter(usable(F.col("vector")) & F.col("query_id").isNotNull())
    asked = settled(asked.withColumn("dim", F.size("vector")), "graph-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    every = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    placed = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(graph: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(graph) and len(asking):
            g = graph.iloc[0]
            points = np.frombuffer(g["vectors"]).reshape(-1, g["dim"])
            neighbours = np.frombuffer(g["graph"], np.int32).reshape(len(points), -1).astype(np.int64)
            level, wanted = scaled(points), np.stack(asking["vector"].to_numpy())
            for begin in range(0, len(asking), 512):
                part = wanted[begin : begin + 512]
                ids, _ = walk(level, neighbours, g["start"], scaled(part, 1), max(p.beam, p.k), opposed)
                for q, vector, found in zip(asking["query_id"].iloc[begin : begin + 512], part, ids, strict=True):
                    found = found[found >= 0]
                    rows += sorted(((q, float(np.dot(points[i], vector)), v) for i in found for v in g["ids"][i] if v != q), key=lambda x: (-x[1], x[2]))[: p.k]
        return pd.DataFrame(rows, columns=["query_id", "score", "vec_id"])

    keys = ["dim", "shard", "block"]
    found = placed.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(search, "query_id long, score double, vec_id long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
