"""The corpus pipeline: documents through quality, near-duplicate, contamination, privacy and packing stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that run() writes to the shared folder and reads again.
All stages but the last return the columns of documents; rows with a null or empty text pass through every stage
by the rules its operator states, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, jaccard_join, packing, pii, pu_quality
from shelfmark.llm.common import cut, table

KEEP_FROM = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under KEEP_FROM go. It learns from all labelled documents."""
    model = pu_quality.learn(docs, table(spark, sf_dir, "labels"), trusted=F.lit(True))
    scored = pu_quality.score(docs, model, name="_quality_score")
    return scored.where(F.col("_quality_score") >= KEEP_FROM).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the one with the smallest id. Rows of
    one id are one document and go or stay together; texts without words link with nothing and stay."""
    gone = jaccard_join.join(docs, width=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    gone = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; n_chars follows the text."""
    masked = pii.mask(docs, pii.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", private),
    ("packing", packed),
]
# No stage but the joins is an expression that SQL has; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
