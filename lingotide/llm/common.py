"""Expressions that several operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed by the contracts: words are what white space of ASCII leaves
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text itself, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def uniform(*parts: str | Column | int) -> Column:
    """A number strictly between 0 and 1 that depends on ``parts`` alone: 48 bits of an md5 digest.

    Null parts count as an empty string. Plain SQL can state the same number.
    """
    texts = [F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def packed(df: DataFrame, *needed: Column) -> DataFrame:
    """``needed`` columns beside the whole row as one struct ``_row``, so that no helper meets a column's name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *needed)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def free_finished(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so once the driver's memory manager has collected what referred to them, which a driver with little to do
    may put off for half an hour. Called between the steps of a long operator whose results are written.
    """
    gc.collect()
    spark._jvm.System.gc()
