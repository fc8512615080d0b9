"""Seeded draws that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *parts: str | Column) -> Column:
    """A number from 0 to 2^60 - 1 that depends on the seed and the parts alone: 15 digits of an md5 digest."""
    texts = [F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 15), 16, 10).cast("long")


def draw_sql(seed: int, *parts: str) -> str:
    """The same in SQL, for the counterparts of queries."""
    joined = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"
