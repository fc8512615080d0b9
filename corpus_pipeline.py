"""From documents to token ids: good ones, one of each group of near copies, without personal data, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last keep the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingotide.llm import bpe, mixing, overlap, personal_data, quality
from lingotide.llm.queries import vocabulary
from lingotide.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def texts_of(docs: DataFrame) -> DataFrame:
    """Documents as sentence texts."""
    return docs.select(F.col("doc_id").alias("id"), "text", "source")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of the labelled ones, scores at least 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    return quality.keep_good(docs, quality.fit_quality(texts_of(docs), labels))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest id.

    Documents without words or id are all kept; rows that repeat id and text count once.
    """
    groups = overlap.overlap_groups(texts_of(docs), overlap.Rule(words=5, num=80, den=100))
    known = staged(groups.filter("id IS NOT NULL").select("id", "component_id"), "groups")
    others = staged(known.filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "other-copies")
    repeated = staged(known.groupBy(F.col("id").alias("doc_id")).count().filter("count > 1").select("doc_id"), "repeated-ids")
    kept = docs.join(others, "doc_id", "left_anti")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kinds; ``n_chars`` follows the text."""
    masked = personal_data.mask_personal_data(docs)
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs, mixing.mix_sources(texts_of(docs)), "doc_id")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: doc_id, n_tokens, token_ids."""
    encoded = bpe.encode_texts(texts_of(docs), bpe.load_rules(vocabulary()))
    return encoded.select(F.col("id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

# a fitted classifier, hashes and merges by rank have no SQL form; tests check each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
