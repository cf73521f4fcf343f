"""The corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the shared scratch folder and hands it to the next. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlytics.llm.bpe import vocabulary_path
from revlytics.llm.common import free_name, passing, stage, table
from revlytics.llm.jaccard import one_of_each
from revlytics.llm.packing import pack_documents
from revlytics.llm.quality_classifier import fit_quality, score_quality
from revlytics.llm.secrets import redact_secrets
from revlytics.llm.substrings import remove_repeats

#: Score below which a document is rejected.
LEAST_QUALITY = 0.3
#: Near-duplicates share 4/5 of their distinct five-word shingles (jaccard.py).
SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least LEAST_QUALITY; it is trained on the labelled ones."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: SimHash links and an exact check of their similarity (jaccard.py)."""
    return one_of_each(docs, SHINGLE_WORDS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that a document of smaller id has."""
    return remove_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each piece of each document lies."""
    return pack_documents(docs, vocabulary_path())


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

#: Training, suffix sorting and tokenizing have no SQL. tests/llm compares near_duplicate, and the operators of repeats, secrets and
#: packing, with brute force, and the classifier with held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with passing(spark) as kept:
            docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
    return docs
