"""Transcript files: interleaved character/pinyin lines and two-column lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingotide.functions.text import WHITESPACE, strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an ``ord`` that grows along each file."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.text(path).select("value", place.alias("ord"))


def parse_interleaved(lines: DataFrame) -> DataFrame:
    """(utt_id, hanzi, pinyin) of lines ``utt.wav<TAB>char pinyin char pinyin ...``.

    Blank lines and lines without a tab are skipped; of several lines for an utterance the last one wins.
    """
    rows = lines.withColumn("_line", strip(F.col("value"))).filter(F.contains("_line", F.lit("\t")))
    parts = F.split("_line", "\t", 2)
    rows = rows.select(F.replace(parts[0], F.lit(".wav"), F.lit("")).alias("utt_id"), parts[1].alias("_rest"), "ord")
    # lines move as text and are cut once they are known to be the last ones
    last = rows.groupBy("utt_id").agg(F.max_by("_rest", "ord").alias("_rest"))
    other = f"[{WHITESPACE.replace(' ', '')}]"
    cut = F.when(F.col("_rest").rlike(other), F.split("_rest", f"[{WHITESPACE}]+")).otherwise(F.split("_rest", " "))
    return last.withColumn("_tokens", F.array_remove(cut, "")).select(
        "utt_id",
        F.array_join(F.filter("_tokens", lambda t, i: i % 2 == 0), "").alias("hanzi"),
        F.array_join(F.filter("_tokens", lambda t, i: i % 2 == 1), " ").alias("pinyin"),
    )


def read_interleaved(spark: SparkSession, path: str) -> DataFrame:
    return parse_interleaved(read_lines(spark, path))


def parse_transcript(lines: DataFrame) -> DataFrame:
    """(utt_id, text) of lines ``utt text ...``; lines with fewer than two parts are skipped, the last one wins."""
    pattern = f"^([^{WHITESPACE}]+)[{WHITESPACE}]+(.+)$"
    rows = lines.withColumn("_line", strip(F.col("value"))).filter(F.col("_line").rlike(pattern))
    return (
        rows.select(F.regexp_extract("_line", pattern, 1).alias("utt_id"), F.regexp_extract("_line", pattern, 2).alias("text"), "ord")
        .groupBy("utt_id")
        .agg(F.max_by("text", "ord").alias("text"))
    )


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcript(read_lines(spark, path))
