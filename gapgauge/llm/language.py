"""Language of whole texts by hierarchical discrimination.

Features are hashed counts of byte trigrams of the lower-cased letters, square
roots scaled to length one. A one-versus-rest linear support vector machine per
family picks the language family first; within it a machine for each pair of
languages votes, and the larger summed margin breaks ties. Languages without an
entry in the family table are families of their own.

The machines are fitted in numpy on a sample of about ``sample`` rows for each
language (all, if there are fewer), drawn by a hash of the id.

``und`` with score 0 if the text is NULL or has no letter, or nothing was
learned. The score is the weaker of the two decisions' logistic margins, 0 to 1.
Rows are judged alone, so repeated rows agree. Texts with a NULL language are
not learned from. No document: no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgauge.llm.common import hash_unit, settled

#: Families of widely used languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    features: int = 4096
    sample: int = 500
    epochs: int = 12
    penalty: float = 1e-4
    sharpness: float = 3.0
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)


def has_letter(text: str) -> bool:
    """Whether a character is a letter; signs like a raised two are none."""
    return any(map(str.isalpha, text))


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower() in members), lang)


def features(text: str, size: int) -> np.ndarray:
    data = np.frombuffer(b" " + b" ".join(text.encode().translate(BYTES).split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(size, np.float32)
    grams = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - size.bit_length() + 1)
    counts = np.sqrt(np.bincount(grams, minlength=size)).astype(np.float32)
    return counts / max(1e-9, float(np.linalg.norm(counts)))


def machine(x: np.ndarray, y: np.ndarray, p: LanguageParams) -> np.ndarray:
    """Linear support vector machine: averaged subgradient steps on the hinge loss.

    Both sides weigh the same whatever their numbers. The last weight is the bias.
    """
    x = np.c_[x, np.ones(len(x), np.float32)]
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for begin in range(0, len(order), 32):
            rows = order[begin : begin + 32]
            step += 1
            short = (y[rows] * (x[rows] @ w) < 1) * weight[rows] * y[rows]
            w = w * (1 - 1 / (step + 20)) + (short @ x[rows]) / len(rows) / (p.penalty * 20 * (step + 20)) * 0.02
            mean += (w - mean) / step
    return mean


def fitted(langs: list[str], x: np.ndarray, p: LanguageParams) -> LanguageModel:
    names = np.array(langs, dtype=object)
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    group = np.array([family_of(n) for n in names], dtype=object)
    weights = np.stack([machine(x, np.where(group == f, 1, -1), p) for f in families]) if len(families) > 1 else np.zeros((len(families), x.shape[1] + 1))
    pairs = {}
    for inside in members.values():
        for a, b in combinations(inside, 2):
            rows = (names == a) | (names == b)
            pairs[a, b] = machine(x[rows], np.where(names[rows] == a, 1, -1), p)
    return LanguageModel(families, members, weights, pairs)


def learn(docs: DataFrame, p: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on a sample of rows with text and non-NULL lang that have a letter."""
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = settled(rows.groupBy("lang").count(), "language-counts")
    share = F.lit(float(p.sample)) / F.col("count")
    drawn = rows.join(counts, "lang").filter(hash_unit(F.col("doc_id"), F.lit(p.seed)) < share)

    def describe(batches):
        for batch in batches:
            batch = batch[[bool(has_letter(t)) for t in batch["text"]]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "x": [features(t, p.features).tobytes() for t in batch["text"]]})

    sample = drawn.select("doc_id", "text", "lang").mapInPandas(describe, "doc_id long, lang string, x binary").toPandas()
    sample = sample.sort_values(["doc_id", "lang"], kind="stable")
    x = np.stack([np.frombuffer(v, np.float32) for v in sample["x"]]) if len(sample) else np.empty((0, p.features), np.float32)
    return fitted(sample["lang"].tolist(), x, p)


def predicted(text: str | None, model: LanguageModel, p: LanguageParams) -> tuple[str, float]:
    if not text or not model.families or not has_letter(text):
        return UNKNOWN, 0.0
    x = np.r_[features(text, p.features), np.float32(1)]
    margins = model.family_weights @ x
    best = int(margins.argmax())
    certain = [float(margins[best])] if len(margins) > 1 else []
    inside = model.members[model.families[best]]
    votes = dict.fromkeys(inside, 0.0)
    total = dict.fromkeys(inside, 0.0)
    for (a, b), w in model.pair_weights.items():
        if a in votes and b in votes:
            margin = float(w @ x)
            votes[a if margin > 0 else b] += 1
            total[a] += margin
            total[b] -= margin
    lang = max(inside, key=lambda c: (votes[c], total[c]))
    if len(inside) > 1:
        certain.append(total[lang] / (len(inside) - 1))
    margin = min(certain, default=30.0)
    return lang, float(1 / (1 + np.exp(-np.clip(p.sharpness * margin, -30, 30))))


def predict_languages(docs: DataFrame, model: LanguageModel, p: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, lang_pred, score for every row; only texts leave the JVM."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predicted(t, model, p) for t in texts], columns=["lang_pred", "score"])

    return docs.select("doc_id", predict("text").alias("found")).select("doc_id", "found.lang_pred", "found.score")
