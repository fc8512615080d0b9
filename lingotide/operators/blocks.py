"""Ordered per-key work that never needs a whole key in one task.

A learner, sentence or recording may hold a large share of all rows, so a plain
``partitionBy(key)`` window can put most of a table into one task. The helpers here cut each key into
blocks of its order column: neighbouring rows are copied across block edges, and running numbers
are block-local values plus the totals of the earlier blocks. Block totals are summed in two levels, so the last
step gathers one row per 4,096 blocks of a key: of a million million rows under one key, about 3,700.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingotide.session import staged

BLOCK_ROWS = 1 << 16
# intervals meet frames on far smaller blocks, since all of a block's pairs are compared
BAND_ROWS = 1 << 10
# so many neighbouring blocks are summed up before their totals meet
SPAN_BLOCKS = 1 << 12


def block_of(idx: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of an integer position."""
    return F.floor(F.col(idx) / F.lit(rows)) if isinstance(idx, str) else F.floor(idx / F.lit(rows))


def halo(df: DataFrame, idx: str, before: int = 0, after: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Assign ``_block`` and copy edge rows so each block sees its neighbours.

    ``idx`` must be dense within a key. ``before``/``after`` say how many preceding/following rows
    a row looks at. Copies carry ``_own = false`` and are removed by :func:`own_rows`.
    """
    place = F.col(idx) % F.lit(rows)
    home = block_of(idx, rows)
    first, last = (place < after) & (home > 0), place >= rows - before
    # a choice of fixed lists stays in generated code; almost every row takes the last one
    copies = F.when(first & last, F.array(home, home - 1, home + 1)) if before and after else F
    copies = copies.when(first, F.array(home, home - 1)) if after else copies
    copies = copies.when(last, F.array(home, home + 1)) if before else copies
    copies = F.array(home) if copies is F else copies.otherwise(F.array(home))
    return df.filter(F.col(idx).isNotNull()).withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_block") == home)


def halo_window(keys: Sequence[str], idx: str) -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy(idx)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_block", "_own")


def _before(totals: DataFrame, keys: Sequence[str], value: str, span: int = SPAN_BLOCKS) -> DataFrame:
    """Sum of ``value`` over the earlier blocks of each key.

    Blocks that are integers are summed within spans of neighbours, then the spans' totals among themselves.
    """
    earlier = (Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    if not isinstance(totals.schema["_block"].dataType, T.IntegralType):
        summed = F.sum(value).over(every.orderBy("_block").rowsBetween(*earlier))
        return totals.select(*keys, "_block", F.coalesce(summed, F.lit(0)).alias("_before"))
    spans = totals.withColumn("_span", F.floor(F.col("_block") / F.lit(span)))
    upper = (
        spans.groupBy(*keys, "_span")
        .agg(F.sum(value).alias("_t"))
        .select(*keys, "_span", F.coalesce(F.sum("_t").over(every.orderBy("_span").rowsBetween(*earlier)), F.lit(0)).alias("_u"))
    )
    inside = Window.partitionBy(*keys, "_span").orderBy("_block").rowsBetween(*earlier)
    return (
        spans.withColumn("_l", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(upper, [*keys, "_span"])
        .select(*keys, "_block", (F.col("_l") + F.col("_u")).alias("_before"))
    )


def number_sorted(df: DataFrame, order: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """0-based row number of the whole table in ``order``, whatever the values and their distribution.

    Rows are dealt out by sampled bounds of ``order`` and written once, so each task sorts its own share and
    only one row count per share is summed up. Rows that tie are numbered in any order; nulls may occur.
    """
    count = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = staged(
        df.repartitionByRange(int(count), *order).withColumn("_block", F.spark_partition_id()), "numbered"
    )
    counts = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    local = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(counts.select("_block", F.coalesce(before, F.lit(0)).alias("_before")), "_block")
        .withColumn(name, F.col("_before") + F.col("_local") - 1)
        .drop("_block", "_local", "_before")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: Column, name: str = "row_no"
) -> DataFrame:
    """0-based row number per key in ``order``; ``block`` must not decrease along that order.

    Keys and block must not be null.
    """
    placed = df.withColumn("_block", block)
    counts = placed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    local = placed.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    )
    return (
        local.join(_before(counts, keys, "_n"), [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_local") - 1)
        .drop("_block", "_local", "_before")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, block: Column | None = None
) -> DataFrame:
    """Inclusive running sum of ``value`` per key along ``order``."""
    placed = df.withColumn("_block", block if block is not None else block_of(order)).withColumn("_v", value)
    totals = placed.groupBy(*keys, "_block").agg(F.sum("_v").alias("_t"))
    w = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_s", F.sum("_v").over(w))
        .join(_before(totals, keys, "_t"), [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_s"))
        .drop("_block", "_v", "_s", "_before")
    )


def runs(df: DataFrame, keys: Sequence[str], idx: str, flag: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """Maximal runs of consecutive rows where ``flag`` holds: (keys, run_no, run_start, run_end)."""
    w = halo_window(keys, idx)
    marked = halo(df.select(*keys, idx, flag.alias("_f")), idx, 1, 1, rows)
    marked = marked.withColumn("_prev", F.lag("_f", 1, False).over(w)).withColumn(
        "_next", F.lead("_f", 1, False).over(w)
    )
    edges = own_rows(marked).filter("_f AND NOT (_prev AND _next)")
    edges = running_sum(
        edges, keys, idx, F.when(F.col("_prev"), 0).otherwise(1), "run_no", block_of(idx, rows)
    )
    return edges.groupBy(*keys, "run_no").agg(
        F.min(idx).alias("run_start"), F.max(idx).alias("run_end")
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, width: float, name: str) -> DataFrame:
    """Exact median per key: (keys, name).

    Equal values are counted before the shuffle, values are cut into buckets of ``width``, and only the buckets that
    contain the middle ranks are sorted, so no buffer holds a key's values.
    """
    values = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_block", F.floor(F.col("_x") / F.lit(float(width))))
    )
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    buckets = values.groupBy(*keys, "_block").agg(F.sum("_c").alias("_n"))
    w = every.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        buckets.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(every))
        .withColumn("_lo", F.expr("(_total + 1) div 2"))
        .withColumn("_hi", F.expr("_total div 2 + 1"))
        .filter("_before < _hi AND _before + _n >= _lo")
        .drop("_total", "_n")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.join(hit, [*keys, "_block"]).withColumn("_to", F.col("_before") + F.sum("_c").over(inside))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_to") >= F.col(rank)) & (F.col("_to") - F.col("_c") < F.col(rank)), F.col("_x")))

    return ranked.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(name))


def merge_rows(*parts: DataFrame) -> DataFrame:
    """Put the columns of several one-row frames side by side, without joining."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
