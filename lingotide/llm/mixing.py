"""Mixing sources of sentence texts to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingotide.llm.common import packed, uniform, word_count
from lingotide.operators.blocks import number_sorted
from lingotide.session import staged

# a source's ranks are cut into so many stretches; only one of them is sorted
STRETCHES = 1 << 16


def source_targets(sizes: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """Targets per source from (source, source_size, texts): adds ``target`` in words.

    Weights repeat along the sources in code point order, null last. A target stops at ``most`` times its source's
    size and what is over goes to the others by weight, until none is above: one level per unit of weight is
    raised until it is stable. Each round sends one row of sums to the driver.
    """
    numbered = number_sorted(sizes, [F.asc_nulls_last("source")], "_no")
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int"))
    ranked = staged(numbered.withColumn("_w", pick).drop("_no"), "source-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * float(most)
    while True:
        full = cap <= F.lit(level) * F.col("_w")
        row = ranked.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("capped"), F.sum(F.when(~full, F.col("_w"))).alias("open")
        ).first()
        raised = (total - (row["capped"] or 0) * float(most)) / row["open"] if row["open"] else level
        if raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least(cap, F.lit(level) * F.col("_w"))).drop("_w")


def mix_sources(
    texts: DataFrame, weights: Sequence[int] = (5, 2, 1), most: float = 3.0, seed: int = 17, unit: Column | None = None
) -> DataFrame:
    """How often the mix takes each sentence text (id, text, source) so that sources meet their target sizes.

    Size is the number of words (or ``unit``, a long). A source that must give ``c`` times its size gives every text
    ``floor(c)`` times for certain; the rest is an unequal-probability sample with inclusion probability
    ``p = c - floor(c)``: texts are ranked by the odds of a hash of the id over the odds of ``p``, and taken in that
    order while they bring the sum of words nearer to the remainder. One more text, the one whose size is nearest to
    what is still lacking, closes the gap. So a source ends within a text of its target, and reruns agree.

    Returns per row: id, size, source, source_size, target (both of its source), copies (long), taken (copies x size).

    Ranks are cut into stretches whose sums are added up per source, and only the stretch with the cut is sorted, so
    no source is ever gathered. Null texts and texts without words have size 0 and are taken as often as certain.
    Null sources are one source, ranked last. Rows without id, and repeated ids, share a rank and are ordered by size; rows equal
    in id and size are interchangeable. An empty table gives an empty result; other columns are left out.
    """
    size = word_count("text") if unit is None else unit.cast("long")
    sized = staged(texts.select("id", "source", size.alias("size"), uniform("id", seed).alias("u")), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = staged(
        source_targets(by_source, weights, most)
        .withColumn("sure", F.floor(share + 1e-12))
        .withColumn("rest", F.greatest(F.col("target") - F.col("sure") * F.col("source_size"), F.lit(0.0)))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
        .withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
        .drop("source"),
        "mix-plan",
    )
    keyed = sized.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    # the odds of the hash over the odds of p, mapped from (0, inf) to (0, 1)
    against = F.col("u") * (1 - F.col("p"))
    rank = against / (against + F.col("p") * (1 - F.col("u")))
    ranked = (
        keyed.join(plan, "_key")
        .withColumn("rank", F.when(F.col("p") > 0, rank).otherwise(1.0))
        .withColumn("stretch", F.least(F.floor(F.col("rank") * STRETCHES), F.lit(STRETCHES - 1)))
    )
    order = ["rank", "id", "size"]
    earlier = Window.partitionBy("_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.filter("p > 0").groupBy("_key", "rest", "stretch").agg(F.sum("size").alias("n"))
    cut = staged(
        sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .filter("before <= rest AND before + n > rest")
        .groupBy("_key")
        .agg(F.min("stretch").alias("cut"), F.min("before").alias("before")),
        "mix-cut",
    )
    # in the stretch of the cut: texts are taken while the sum stays nearer to the remainder with them than without
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        ranked.join(cut, "_key")
        .filter("stretch = cut")
        .withColumn("upto", F.col("before") + F.sum("size").over(inside))
        .filter("upto <= rest")
        .groupBy("_key")
        .agg(F.max(F.struct(*order)).alias("last"), F.max("upto").alias("upto"))
    )
    cuts = staged(
        cut.join(edge, "_key", "left").select("_key", "cut", "last", F.coalesce("upto", "before").alias("upto")), "mix-cuts"
    )
    chosen = ranked.join(cuts, "_key", "left").withColumn(
        "_in",
        (F.col("p") > 0) & F.coalesce((F.col("stretch") < F.col("cut")) | ((F.col("stretch") == F.col("cut")) & F.coalesce(F.struct(*order) <= F.col("last"), F.lit(False))), F.lit(True)),
    )
    lacking = F.col("rest") - F.col("upto")
    spare = (
        chosen.filter("NOT _in AND size > 0 AND cut IS NOT NULL")
        .groupBy("_key", "id", "size", "rank", "rest", "upto")
        .agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
        .withColumn("off", F.abs(F.col("words") - lacking))
        .filter(F.col("off") < lacking)
        .groupBy("_key")
        .agg(F.min(F.struct("off", "rank", "id", "size")).alias("fill"))
    )
    fills = staged(spare.select("_key", F.col("fill.id").alias("fill_id"), F.col("fill.size").alias("fill_size")), "mix-fills")
    filled = chosen.join(fills, "_key", "left")
    extra = F.col("_in") | F.coalesce(F.col("id").eqNullSafe(F.col("fill_id")) & (F.col("size") == F.col("fill_size")) & (F.col("p") > 0), F.lit(False))
    copies = F.col("sure") + extra.cast("long")
    return filled.select(
        "id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def take_mix(documents: DataFrame, mixed: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``documents``, each as often as ``mixed`` (id, copies) takes it; their columns are unchanged.

    Rows whose key is null take the copies of the null id. ``mixed`` may hold a key several times; its rows for one
    key must agree, as those of equal texts do, else the largest number counts.
    """
    copies = mixed.groupBy("id").agg(F.max("copies").alias("copies")).filter("copies > 0")
    rows = packed(documents, F.col(key).alias("_key"))
    taken = rows.join(copies, F.col("_key").eqNullSafe(F.col("id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
