"""Rendezvous hashing of sentence texts over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.llm.common import whole
from lingotide.operators.blocks import number_rows

# rows of one shard are numbered within stretches of so many ids
SLOT_IDS = 1 << 12


def rendezvous(key: str | Column, weights: Sequence[float]) -> Column:
    """The shard that wins ``key``: each shard waits ``-ln(u) / weight`` for a hash ``u`` of key and shard, the first wins.

    A shard's chance is its share of the weights. Adding a shard takes keys only into the new one and removing the
    last moves only its own keys, since the other waits stay. Shards of weight 0 or less never win; equal waits go
    to the smaller number; a null key is a key of its own.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    key = F.col(key) if isinstance(key, str) else key
    waits = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
            waits.append(F.struct((-F.log((bits + 0.5) / float(1 << 53)) / float(weight)).alias("w"), F.lit(shard).alias("s")))
    return F.array_min(F.array(*waits))["s"]


def assign_shards(texts: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0) -> DataFrame:
    """Deal sentence texts (id, text) into shards by their stable id.

    Returns per row: id, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``shard``, ``slot`` (0, 1, 2, ...
    within the shard along id) and ``grown_shard``, the shard once one more of ``grown_weight`` exists.

    The id alone decides, so equal texts under different ids may part and repeated ids meet in one shard. A null
    text counts as empty. Rows without id share a shard and are numbered before all others. Rows that are equal in
    all columns take neighbouring slots. An empty table gives an empty result; other columns are left out.
    """
    sized = texts.select(
        "id",
        (F.octet_length(whole("text")) + 1).cast("long").alias("size"),
        F.crc32(whole("text").cast("binary")).alias("text_crc32"),
        rendezvous("id", weights).alias("shard"),
        rendezvous("id", [*weights, grown_weight]).alias("grown_shard"),
    )
    # rows without id come first, in stretches of their checksums; the others in stretches of their ids
    stretch = F.when(F.col("id").isNull(), F.shiftright("text_crc32", 12) - (1 << 60)).otherwise(
        F.floor(F.col("id") / F.lit(SLOT_IDS))
    )
    return number_rows(sized, ["shard"], ["id", "text_crc32", "size"], stretch.cast("long"), "slot")
