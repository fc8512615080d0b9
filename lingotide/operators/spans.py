"""Span and chunk planning over whole recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.functions.units import SAMPLE_RATE, frames_for_samples, samples_to_frame
from lingotide.operators.blocks import running_sum

CHUNK, MARGIN = 16000, 1600


def _positions(n: str) -> Column:
    """0..n-1, and nothing for n = 0."""
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def uniform_boundaries(utts: DataFrame, key: str) -> DataFrame:
    """Even sample ranges: (key, idx, start_sample, end_sample); the last one runs to the end."""
    step = F.expr("n_samples div n_syllables")
    rows = utts.filter("n_syllables > 0").withColumn("idx", _positions("n_syllables"))
    end = F.when(F.col("idx") == F.col("n_syllables") - 1, F.col("n_samples")).otherwise((F.col("idx") + 1) * step)
    return rows.select(key, "idx", (F.col("idx") * step).alias("start_sample"), end.alias("end_sample"))


def uniform_spans(utts: DataFrame, key: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """Even ms spans with confidence 0.5; an utterance without targets gives one row with only a warning."""
    total = F.expr(f"CAST(n_samples / {rate} * 1000 AS INT)")
    rows = utts.withColumn("_total", total).withColumn(
        "idx", F.explode_outer(F.when(F.col("n_syllables") > 0, F.sequence(F.lit(0), F.col("n_syllables") - 1)))
    )
    width = F.col("_total") / F.col("n_syllables")
    end = F.when(F.col("idx") == F.col("n_syllables") - 1, F.col("_total")).otherwise(((F.col("idx") + 1) * width).cast("int"))
    return rows.select(
        key,
        "idx",
        (F.col("idx") * width).cast("int").alias("start_ms"),
        end.alias("end_ms"),
        F.when(F.col("idx").isNull(), 1.0).otherwise(0.5).alias("confidence"),
        F.when(F.col("idx").isNull(), "no_targets").alias("warning"),
    )


def proportional_positions(utts: DataFrame, key: str, regions: DataFrame | None = None) -> DataFrame:
    """Syllable positions of equal length inside the active regions: (key, idx, start_sample, end_sample).

    Each region is cut into pieces of the common step (the last piece of a region may be shorter), and the
    first n pieces are used. A short list repeats its last piece; with more syllables than active
    samples every position is the empty start of the first region. Without regions the whole
    recording is divided, the remainder staying unused. ``regions`` has key, region_no, start and end.
    """
    wanted = utts.filter("n_syllables > 0")
    even = wanted.withColumn("_step", F.expr("n_samples div n_syllables")).withColumn("idx", _positions("n_syllables"))
    even = even.select(key, "idx", (F.col("idx") * F.col("_step")).alias("start_sample"), ((F.col("idx") + 1) * F.col("_step")).alias("end_sample"))
    if regions is None:
        return even
    totals = regions.groupBy(key).agg(
        F.sum(F.col("end") - F.col("start")).alias("_active"),
        F.min_by(F.struct("start", "end"), F.when(F.col("end") > F.col("start"), F.col("region_no"))).alias("_first"),
    )
    planned = wanted.join(totals, key).withColumn("_step", F.expr("_active div n_syllables"))
    pieces = regions.join(planned.filter("_step > 0").select(key, "n_syllables", "_step"), key).withColumn(
        "_count", F.expr("(end - start + _step - 1) div _step")
    )
    pieces = running_sum(pieces, [key], "region_no", F.col("_count"), "_upto")
    offset = F.col("_upto") - F.col("_count")
    room = F.least(F.col("_count"), F.col("n_syllables") - offset)
    cut = pieces.withColumn("_offset", offset).withColumn("_room", room).filter("_room > 0")
    cut = cut.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_room") - 1)))
    start = F.col("start") + F.col("_j") * F.col("_step")
    placed = cut.select(
        key, "n_syllables", (F.col("_offset") + F.col("_j")).alias("idx"), start.alias("start_sample"),
        F.least(start + F.col("_step"), F.col("end")).alias("end_sample"),
    )
    tail = (
        placed.groupBy(key, "n_syllables")
        .agg(F.max(F.struct("idx", "start_sample", "end_sample")).alias("t"))
        .filter(F.col("t.idx") < F.col("n_syllables") - 1)
        .select(key, F.explode(F.sequence(F.col("t.idx") + 1, F.col("n_syllables").cast("long") - 1)).alias("idx"), "t.start_sample", "t.end_sample")
    )
    # step 0: empty positions at the first region that has samples; without any active sample the whole recording
    stuck = planned.filter("_step = 0").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_syllables").cast("long") - 1)))
    stuck = stuck.select(
        key,
        "idx",
        F.coalesce("_first.start", F.lit(0)).alias("start_sample"),
        F.coalesce("_first.start", F.col("n_samples")).alias("end_sample"),
    )
    bare = even.join(totals, key, "left_anti").select(key, F.col("idx").cast("long"), "start_sample", "end_sample")
    used = placed.select(key, "idx", "start_sample", "end_sample")
    return used.unionByName(tail).unionByName(stuck).unionByName(bare)


def chunk_window(spans: DataFrame, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """Fixed-size chunk that holds a span with margins: adds chunk_start, chunk_end, first_frame, n_frames and pad.

    Spans need start_sample, end_sample and n_samples. Where the margins do not fit the chunk is
    centred on the span; otherwise it takes the middle of the allowed range.
    """
    total = F.col("n_samples")
    low = F.greatest(F.lit(0), F.col("end_sample") + margin - chunk)
    high = F.greatest(F.lit(0), F.least(F.col("start_sample") - margin, total - chunk))
    centre = F.floor((F.col("start_sample") + F.col("end_sample")) / 2)
    centred = F.greatest(F.lit(0), F.least(centre - chunk // 2, total - chunk))
    start = F.when(low > high, centred).otherwise(F.floor((low + high) / 2))
    out = spans.withColumn("chunk_start", start.cast("long"))
    return out.withColumns(
        {
            "chunk_end": F.least(F.col("chunk_start") + chunk, total),
            "first_frame": samples_to_frame(F.col("chunk_start")),
            "n_frames": frames_for_samples(F.lit(chunk)),
            "pad": F.greatest(F.lit(0), F.col("chunk_start") + chunk - total),
        }
    )
