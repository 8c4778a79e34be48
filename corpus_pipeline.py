"""The corpus pipeline: quality, line dedup, near-duplicates, benchmark decontamination, segmentation.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
All but the last return the columns of documents; the last returns the sampled piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrules.llm.common import documents
from segrules.llm.decontam import drop_contaminated
from segrules.llm.line_dedup import dedup_lines
from segrules.llm.near_dup import keep_one_each
from segrules.llm.quality_gbt import reject_low_quality
from segrules.llm.spm_sample import sample_segmentations
from segrules.session import shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return reject_low_quality(docs, documents(spark, sf_dir, "labels"), COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, except in one; n_chars is counted anew."""
    lined = dedup_lines(docs, keep=("lang", "source"))
    return lined.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_each(docs, COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark items go."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark"), COLUMNS)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each document that is left, four of each where there are so many.

    A null or empty text has one without pieces; an empty table gives an empty result."""
    return sample_segmentations(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("segmentation", segmentation),
]

#: Fitted trees and sampled segmentations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
