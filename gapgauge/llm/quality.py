"""Quality score of whole texts by a byte-level convolutional network.

A text is cut into chunks of ``chunk`` bytes that overlap by ``overlap``; the
chunks cover it from the first to the last byte. Each filter is a table of
weights for the byte at each of ``width`` neighbouring places. Its largest
response within a chunk is kept (max pooling). A text's features are the mean
and the maximum of each filter over its chunks, and a logistic unit combines
them into the probability that the label is 1. Filters and unit are learned
together by gradient descent in numpy, on a sample of labelled rows.

The sample is drawn by a hash of the id: about ``sample`` texts, or all if there
are fewer. Each gives the network ``chunks`` of its chunks, spread evenly over
the whole text, so what is collected is bounded. Scoring reads every byte.

Only texts go to the Python workers, so ids and other columns, whatever their
types and names, come back as they were. NULL text is scored as empty text, which is one empty chunk. Rows are scored
alone, so repeated rows get equal scores. Labels other than 0 and 1 or NULL are
not learned from. If there is nothing to learn from, or only one label, the
score is the share of label 1 with one pseudo-count each. No document: no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgauge.llm.common import hash_unit, settled


@dataclass(frozen=True)
class QualityParams:
    filters: int = 16
    width: int = 4
    chunk: int = 1024
    overlap: int = 128
    sample: int = 4000
    chunks: int = 4
    steps: int = 500
    batch: int = 64
    rate: float = 0.01
    seed: int = 3


@dataclass(frozen=True)
class QualityModel:
    """Filter weights (width x 256 x filters), biases, and the combining unit."""

    tables: np.ndarray
    bias: np.ndarray
    combine: np.ndarray
    offset: float
    params: QualityParams


def bounds(size: int, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the chunks that cover ``size`` bytes."""
    step = p.chunk - p.overlap
    begin = np.arange(0, max(size - p.overlap, 1), step)
    return begin, np.minimum(begin + p.chunk, max(size, p.width))


def responses(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Response of every filter at every place, without bias."""
    places = len(data) - len(tables) + 1
    out = tables[0][data[:places]]
    for k in range(1, len(tables)):
        out += tables[k][data[k : places + k]]
    return out


def pooled(text: bytes, model: QualityModel) -> np.ndarray:
    """Pooled responses of every chunk, computed in slabs of whole chunks."""
    p = model.params
    data = np.frombuffer(text.ljust(p.width, b"\0"), np.uint8)
    begin, end = bounds(len(text), p)
    out = np.empty((len(begin), p.filters), np.float32)
    for at in range(0, len(begin), 64):
        first, last = begin[at : at + 64], end[at : at + 64] - p.width + 1
        low = first[0]
        found = responses(data[low : end[min(at + 63, len(end) - 1)]], model.tables)
        edges = np.c_[first - low, np.minimum(last - low, len(found) - 1)].ravel()
        edges[1::2] = np.maximum(edges[1::2], edges[::2])
        top = np.maximum.reduceat(found, edges, axis=0)[::2]
        out[at : at + 64] = np.maximum(top, found[np.minimum(last - low, len(found)) - 1])
    return np.maximum(out + model.bias, 0)


def score(text: bytes, model: QualityModel) -> float:
    top = pooled(text, model)
    logit = np.r_[top.mean(axis=0), top.max(axis=0)] @ model.combine + model.offset
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def constant_model(labels: np.ndarray, p: QualityParams) -> QualityModel:
    share = (labels.sum() + 1) / (len(labels) + 2)
    return QualityModel(np.zeros((p.width, 256, p.filters), np.float32), np.zeros(p.filters, np.float32), np.zeros(2 * p.filters, np.float32), float(np.log(share / (1 - share))), p)


def fitted(texts: list[list[bytes]], labels: np.ndarray, p: QualityParams) -> QualityModel:
    """Learn from the chunks of each text. Adam; gradients follow the pooled places."""
    if len(labels) == 0 or labels.min() == labels.max():
        return constant_model(labels, p)
    rng = np.random.default_rng(p.seed)
    tables = rng.normal(0, 0.15, (p.width, 256, p.filters)).astype(np.float32)
    state = [tables, np.zeros(p.filters, np.float32), rng.normal(0, 0.1, 2 * p.filters).astype(np.float32), np.full(1, np.log(labels.mean() / (1 - labels.mean())), np.float32)]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    chunks = [[np.frombuffer(c.ljust(p.width, b"\0"), np.uint8) for c in text] for text in texts]
    order = np.concatenate([rng.permutation(len(labels)) for _ in range(-(-p.steps * p.batch // len(labels)))])
    for step in range(1, p.steps + 1):
        rows = order[(step - 1) * p.batch : step * p.batch]
        own = [chunks[i] for i in rows]
        counts = np.array([len(c) for c in own])
        flat = [c for text in own for c in text]
        at = np.empty((len(flat), p.filters), np.int64)
        top = np.empty((len(flat), p.filters), np.float32)
        for n, data in enumerate(flat):
            found = responses(data, state[0])
            at[n] = found.argmax(axis=0)
            top[n] = found[at[n], np.arange(p.filters)]
        text_of = np.repeat(np.arange(len(rows)), counts)
        active = np.maximum(top + state[1], 0)
        start = np.r_[0, np.cumsum(counts)[:-1]]
        mean = np.add.reduceat(active, start, axis=0) / counts[:, None]
        highest = np.maximum.reduceat(active, start, axis=0)
        features = np.c_[mean, highest]
        error = (1 / (1 + np.exp(-np.clip(features @ state[2] + state[3], -30, 30))) - labels[rows]) / len(rows)
        back = error[:, None] * state[2]
        is_highest = active == highest[text_of]
        flow = (back[text_of, : p.filters] / counts[text_of, None] + np.where(is_highest, back[text_of, p.filters :], 0)) * (active > 0)
        grad = np.zeros_like(state[0])
        for k in range(p.width):
            seen = np.stack([data[a + k] for data, a in zip(flat, at, strict=True)])
            np.add.at(grad[k], (seen, np.arange(p.filters)), flow)
        grads = [grad, flow.sum(axis=0), features.T @ error, error.sum(keepdims=True)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            fixed = p.rate * (1 - step / (p.steps + 1))
            state[i] = (state[i] - fixed * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return QualityModel(state[0], state[1], state[2], float(state[3][0]), p)


def learn(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> QualityModel:
    """Fit on a sample of the labels (doc_id, label) and the texts of their documents.

    About ``sample`` labels are drawn, so the drawn side of the join is bounded.
    """
    rows = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    count = rows.count()
    drawn = settled(rows.filter(hash_unit(F.col("doc_id"), F.lit(p.seed)) < min(1.0, p.sample / max(1, count))), "quality-sample")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(drawn, "doc_id").select("doc_id", "text", "label")

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, label in batch.itertuples(index=False):
                data = text.encode()
                begin, end = bounds(len(data), p)
                chosen = np.unique(np.linspace(0, len(begin) - 1, min(p.chunks, len(begin))).round().astype(int))
                out.append((doc, label, [data[begin[i] : end[i]] for i in chosen]))
            yield pd.DataFrame(out, columns=["doc_id", "label", "chunks"])

    sample = texts.mapInPandas(cut, "doc_id long, label int, chunks array<binary>").toPandas()
    sample = sample.sort_values(["doc_id", "label"], kind="stable")
    return fitted([[bytes(c) for c in text] for text in sample["chunks"]], sample["label"].to_numpy(np.float32), p)


def score_column(model: QualityModel, text: Column) -> Column:
    """Score of a text, NULL as an empty one; the other columns stay in the JVM."""

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score((t or "").encode(), model) for t in texts], dtype="float64")

    return rate(text)


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``quality_score``; a column of that name is replaced, all others stay as they are."""
    return docs.withColumn("quality_score", score_column(model, F.col("text")))
