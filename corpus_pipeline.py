"""The corpus pipeline: five stages over documents, each of which works on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, mixing, neardup, pii, quality
from quillgraph.llm.common import cut, read

#: Documents whose probability of being good lies below go.
QUALITY = 0.3


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the compression classifier, learnt from all labelled documents."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, model).where(F.col("score") >= QUALITY).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.dedup(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes benchmark passages out of the texts; documents that are benchmark text for the most part go."""
    out = decontam.remove(decontam.annotate(docs, read(spark, sf_dir, "benchmark")))
    return _measured(out).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts kinds in place of personal data."""
    return _measured(pii.redact(pii.find(docs))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its place in a mixture of the sources."""
    return mixing.mix(docs)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: SQL has no zstandard, boosted trees or schedules: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
