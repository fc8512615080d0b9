"""Pitch contours per syllable span and their shape features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.functions.units import FRAME_HZ, ms_to_frame, semitones
from lingotide.operators.blocks import BAND_ROWS, block_of, number_rows
from lingotide.operators.frames import VOICED, robust_normalize
from lingotide.session import staged

POINTS = 20
MIN_VOICED = 3


def frames_in_spans(frames: DataFrame, spans: DataFrame, key: str, frame_hz: float = FRAME_HZ, block: int = BAND_ROWS) -> DataFrame:
    """Frames with the span (key, idx) they fall into. Both sides meet on (key, block of frames)."""
    cut = spans.withColumn("_from", F.greatest(F.lit(0), ms_to_frame(F.col("start_ms"), frame_hz))).withColumn(
        "_to", ms_to_frame(F.col("end_ms"), frame_hz)
    )
    cut = cut.filter("_to > _from").select(
        key, "idx", "_from", "_to", F.explode(F.sequence(block_of("_from", block), block_of(F.col("_to") - 1, block))).alias("_block")
    )
    placed = frames.withColumn("_block", block_of("frame_idx", block))
    return placed.join(cut, [key, "_block"]).filter("frame_idx >= _from AND frame_idx < _to").drop("_block", "_from", "_to")


def resample(frames: DataFrame, keys: list[str], value: str, k: int = POINTS, threshold: float = VOICED, strict: bool = False) -> DataFrame:
    """Voiced values stretched to k points by linear interpolation: (keys, pos, value) in long form.

    Target point j sits at p = j (m - 1) / (k - 1) of the m voiced values. Each value adds its share
    to the few points less than one step away, so no row meets another. Groups with fewer than
    three voiced values are left out. ``strict`` counts voicing above, not at, the threshold.
    """
    loud = F.col("voicing") > threshold if strict else F.col("voicing") >= threshold
    voiced = frames.filter(loud).select(*keys, "frame_idx", F.col(value).alias("_v"))
    sizes = voiced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= MIN_VOICED)
    numbered = number_rows(voiced, keys, ["frame_idx"], block_of("frame_idx"), "_i").join(sizes, keys)
    scale = F.lit(float(k - 1)) / (F.col("_m") - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - 1) * scale)).cast("int")
    last = F.least(F.lit(k - 1), F.floor((F.col("_i") + 1) * scale)).cast("int")
    near = numbered.filter(first <= last).withColumn("pos", F.explode(F.sequence(first, last)))
    weight = F.lit(1.0) - F.abs(F.col("pos") * (F.col("_m") - 1) / F.lit(float(k - 1)) - F.col("_i"))
    return (
        near.withColumn("_w", weight)
        .filter("_w > 0")
        .groupBy(*keys, "pos")
        .agg(F.sum(F.col("_w") * F.col("_v")).alias("value"))
    )


def _points(long: DataFrame, keys: list[str]) -> DataFrame:
    """k points per group as one array; k is a small constant."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return long.groupBy(*keys).agg(F.transform(ordered, lambda s: s["value"]).alias("f0_norm"))


def array_gradient(values: Column, k: int) -> Column:
    """Central differences of an array of k elements, one-sided at the ends."""
    at = lambda i: F.element_at(values, i + 1)
    inner = [(at(i + 1) - at(i - 1)) / 2 for i in range(1, k - 1)]
    return F.array(at(1) - at(0), *inner, at(k - 1) - at(k - 2))


def contours(frames: DataFrame, spans: DataFrame, key: str, k: int = POINTS, frame_hz: float = FRAME_HZ) -> DataFrame:
    """Normalized k-point contour, its derivatives, duration and voicing ratio of each span.

    Frames are normalized within the span; spans without frames get zeros and ratio 0. The frames of
    the spans are staged once, since the ratio, the median, the deviation and the points all read them.
    """
    keys = [key, "idx"]
    needed = frames.select(key, "frame_idx", "f0_hz", "voicing")
    inside = staged(frames_in_spans(needed, spans, key, frame_hz), "frames-in-spans")
    ratio = inside.groupBy(*keys).agg(F.avg((F.col("voicing") >= VOICED).cast("double")).alias("voicing_ratio"))
    pitched = inside.select(*keys, "frame_idx", "voicing", semitones(F.col("f0_hz")).alias("_st"))
    normal = staged(robust_normalize(pitched, keys, "_st"), "normalized-frames")
    shapes = _points(resample(normal, keys, "f0_norm", k), keys)
    zeros = F.array_repeat(F.lit(0.0), k)
    built = (
        spans.select(*keys, (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
        .join(ratio, keys, "left")
        .join(shapes, keys, "left")
        .withColumn("voicing_ratio", F.coalesce("voicing_ratio", F.lit(0.0)))
        .withColumn("f0_norm", F.coalesce("f0_norm", zeros))
    )
    first = built.withColumn("df0", array_gradient(F.col("f0_norm"), k))
    return first.withColumn("ddf0", array_gradient(F.col("df0"), k))


def tone_features(rows: DataFrame, contour: str = "f0_norm") -> DataFrame:
    """Shape features of each contour array: slope, range, start/end level, extremes and their positions."""
    y = F.col(contour)
    k = F.size(y)
    middle = (k - 1) / 2
    products = F.zip_with(y, F.sequence(F.lit(0), k - 1), lambda v, i: v * i)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    spread = k * (k * k - 1) / 12
    slope = F.when(k > 1, (total(products) - middle * total(y)) / spread).otherwise(0.0)
    part = F.greatest(F.lit(1), F.floor(k / 5)).cast("int")
    flat = (k <= 0) | F.forall(y, lambda v: v == 0)
    last = F.greatest(F.lit(1), k - 1)
    values = {
        "slope": slope,
        "range_st": F.array_max(y) - F.array_min(y),
        "start_level": total(F.slice(y, F.lit(1), part)) / part,
        "end_level": total(F.slice(y, k - part + 1, part)) / part,
        "min_level": F.array_min(y),
        "max_level": F.array_max(y),
    }
    places = {
        "min_position": (F.array_position(y, F.array_min(y)) - 1) / last,
        "max_position": (F.array_position(y, F.array_max(y)) - 1) / last,
    }
    out = {name: F.when(flat, 0.0).otherwise(c) for name, c in values.items()}
    out |= {name: F.when(flat, 0.5).otherwise(c) for name, c in places.items()}
    return rows.withColumns(out)


def tone_templates(rows: DataFrame, tone: str = "tone", contour: str = "f0_norm", min_n: int = 5) -> DataFrame:
    """Element-wise mean and population deviation of the contours per tone: (tone, pos, mean, std, n)."""
    points = rows.select(F.col(tone).alias("tone"), F.posexplode(contour).alias("pos", "v"))
    return (
        points.groupBy("tone", "pos")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_n)
    )
