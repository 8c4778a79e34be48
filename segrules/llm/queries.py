"""Registered queries of the subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segrules.llm.brown_lm import score_texts
from segrules.llm.common import documents
from segrules.llm.decontam import contamination
from segrules.llm.html_extract import extract_main_text
from segrules.llm.line_dedup import dedup_lines
from segrules.llm.near_dup import near_duplicates
from segrules.llm.pii import KINDS, find_personal_data, span_text
from segrules.llm.quality_gbt import THRESHOLD, fit_quality, is_held_out, score_quality
from segrules.llm.sharding import assign_shards
from segrules.llm.spm_sample import sample_segmentations
from segrules.llm.token_links import align_tokenizers
from segrules.llm.topk_search import exact_top_k
from segrules.llm.url_rules import judge_urls
from segrules.llm.vector_codes import compress_vectors

# The rules (action, host, path) of the url query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return find_personal_data(documents(spark, sf_dir)).select(
        "doc_id",
        *counts,
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(documents(spark, sf_dir), digest=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), SHARDS)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_quality(docs, fit_quality(docs, documents(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(documents(spark, sf_dir, "pages"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir), digest=True)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return judge_urls(documents(spark, sf_dir, "pages"), rules)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(documents(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_class_lm": op2_class_lm,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece_sampling": op4_sentencepiece_sampling,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_html_extraction": op9_html_extraction,
    "op10_topk_search": op10_topk_search,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_url_filter": op12_url_filter,
    "op13_vector_codes": op13_vector_codes,
}
