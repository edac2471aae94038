"""Corpus preparation in five stages, from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result and reads it back for the next one. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgauge.llm import line_dedup, mixing, near_dedup, pieces, quality
from gapgauge.llm.common import settled, table
from gapgauge.llm.queries import GOOD, quality_labels


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, as they are."""
    model = quality.learn(docs, quality_labels(spark, sf_dir))
    return docs.filter(quality.score_column(model, F.col("text")) >= GOOD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates."""
    out = line_dedup.drop_recurring_lines(docs)
    changed = F.when(F.col("lines_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near duplicates."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for every time it is taken; its order is not kept by the next stage."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and their number, one row for every row of the mix."""
    encoded = pieces.encode_documents(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"], spread=4)
    return encoded.select("doc_id", "source", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("quality", classify_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: No stage can be expressed in SQL; tests hold near duplicates, mix and pieces against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
