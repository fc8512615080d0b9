"""Frame-series operators: normalization, deltas, framing and recording profiles.

``frames`` is the long form (key, frame_idx, ...) with a dense frame_idx per key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.functions.units import HOP, SAMPLE_RATE, WINDOW
from lingotide.operators.blocks import BLOCK_ROWS, exact_median, halo, halo_window, own_rows

VOICED = 0.5
MAD_SCALE = 1.4826
BUCKET = 1 / 64


def robust_stats(frames: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation of the voiced frames per key; a zero deviation counts as 1."""
    voiced = frames.filter(F.col("voicing") >= VOICED).select(*keys, F.col(value).alias("_x"))
    middle = exact_median(voiced, keys, "_x", BUCKET, "median")
    off = voiced.join(middle, list(keys)).select(*keys, F.abs(F.col("_x") - F.col("median")).alias("_off"))
    mad = exact_median(off, keys, "_off", BUCKET, "mad")
    return middle.join(mad, list(keys)).withColumn("mad", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad")))


def robust_normalize(frames: DataFrame, keys: Sequence[str], value: str, name: str = "f0_norm") -> DataFrame:
    """Robust z-score of the voiced frames within each key; unvoiced frames become 0."""
    stats = robust_stats(frames, keys, value)
    scaled = (F.col(value) - F.col("median")) / (F.col("mad") * MAD_SCALE)
    return (
        frames.join(stats, list(keys), "left")
        .withColumn(name, F.when(F.col("voicing") >= VOICED, scaled).otherwise(0.0))
        .drop("median", "mad")
    )


def normalize_f0(frames: DataFrame, keys: Sequence[str], method: str, f0: str = "f0_hz", name: str = "f0_norm") -> DataFrame:
    """Alternative scaling of frames with f0 > 0: 'log_zscore', 'semitone' or 'minmax'; other frames are 0."""
    voiced = frames.filter(F.col(f0) > 0)
    x = F.col(f0)
    if method == "log_zscore":
        logs = F.log(x + 1e-8)
        stats = voiced.groupBy(*keys).agg(F.avg(logs).alias("_a"), (F.stddev_pop(logs) + 1e-8).alias("_b"))
        scaled = (logs - F.col("_a")) / F.col("_b")
    elif method == "semitone":
        stats = exact_median(voiced, keys, f0, 1.0, "_a").withColumn("_b", F.lit(None))
        scaled = F.log2(x / F.col("_a") + 1e-8) * 12
    elif method == "minmax":
        stats = voiced.groupBy(*keys).agg(F.min(f0).alias("_a"), F.max(f0).alias("_b"))
        scaled = F.when(F.col("_b") > F.col("_a"), (x - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.5)
    else:
        raise ValueError(f"unknown method {method!r}")
    return (
        frames.join(stats, list(keys), "left")
        .withColumn(name, F.when(x > 0, scaled).otherwise(0.0))
        .drop("_a", "_b")
    )


def delta(frames: DataFrame, key: str, value: str, name: str = "delta", block: int = BLOCK_ROWS) -> DataFrame:
    """First difference along the frames; the first one is 0."""
    w = halo_window([key], "frame_idx")
    step = F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))
    return own_rows(halo(frames, "frame_idx", before=1, rows=block).withColumn(name, step))


def _slope(value: str, w) -> Column:
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    here = F.col(value)
    return (
        F.when(before.isNull() & after.isNull(), 0.0)
        .when(before.isNull(), after - here)
        .when(after.isNull(), here - before)
        .otherwise((after - before) / 2)
    )


def gradient(frames: DataFrame, key: str, value: str, block: int = BLOCK_ROWS) -> DataFrame:
    """First and second gradient: central inside, one-sided at the ends."""
    w = halo_window([key], "frame_idx")
    out = halo(frames, "frame_idx", before=2, after=2, rows=block)
    return own_rows(out.withColumn("gradient", _slope(value, w)).withColumn("gradient2", _slope("gradient", w)))


def frame_energy(
    samples: DataFrame, key: str, window: int = WINDOW, hop: int = HOP, short: str = "zero"
) -> DataFrame:
    """RMS per complete frame: (key, frame_idx, energy).

    Samples are first summed over steps shorter than a hop, so only those sums are copied to the
    overlapping frames. A signal shorter than one window gives a single frame: 0, or with
    ``short='rms'`` the RMS of what there is.
    """
    step = math.gcd(window, hop)
    per_frame, per_hop = window // step, hop // step
    steps = samples.groupBy(key, F.floor(F.col("sample_idx") / step).alias("_step")).agg(
        F.sum(F.col("x") * F.col("x")).alias("_sq"), F.count(F.lit(1)).alias("_n")
    )
    first = F.greatest(F.lit(0), F.floor((F.col("_step") - per_frame) / per_hop) + 1)
    last = F.floor(F.col("_step") / per_hop)
    parts = steps.withColumn("frame_idx", F.explode(F.sequence(first, last)))
    framed = parts.groupBy(key, "frame_idx").agg(F.sum("_sq").alias("_sq"), F.sum("_n").alias("_n"))
    whole = F.col("_n") == window
    partial = F.sqrt(F.col("_sq") / F.col("_n")) if short == "rms" else F.lit(0.0)
    return framed.filter(whole | (F.col("frame_idx") == 0)).select(
        key,
        F.col("frame_idx").cast("int").alias("frame_idx"),
        F.when(whole, F.sqrt(F.col("_sq") / window)).otherwise(partial).alias("energy"),
    )


def profile(samples: DataFrame, key: str, threshold: float = 0.01, rate: int = SAMPLE_RATE) -> DataFrame:
    """Duration, level, peak and leading/trailing silence of each recording."""
    level = samples.groupBy(key).agg(
        (F.count(F.lit(1)) / rate).alias("duration"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
        F.max(F.abs("x")).alias("peak"),
    )
    energy = frame_energy(samples, key, short="rms")
    loud = F.when(F.col("energy") > threshold, F.col("frame_idx"))
    voice = energy.groupBy(key).agg(
        (F.min(loud) * HOP / rate).alias("_first"), (F.max(loud) * HOP / rate).alias("_last")
    )
    both = level.join(voice, key, "left")
    return both.select(
        key,
        "duration",
        "rms",
        (F.log10(F.col("rms") + 1e-10) * 20).alias("rms_db"),
        "peak",
        (F.log10(F.col("peak") + 1e-10) * 20).alias("peak_db"),
        F.coalesce("_first", F.lit(0.0)).alias("silence_before"),
        F.coalesce(F.col("duration") - F.col("_last"), F.lit(0.0)).alias("silence_after"),
    )


def profile_summary(profiles: DataFrame, group: str) -> DataFrame:
    """Count and spread of the profiles per group."""
    return profiles.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("rms").alias("rms_mean"),
        F.stddev_pop("rms").alias("rms_std"),
        F.min("rms").alias("rms_min"),
        F.max("rms").alias("rms_max"),
        F.avg("peak").alias("peak_mean"),
        F.stddev_pop("peak").alias("peak_std"),
        F.avg("silence_before").alias("silence_before_mean"),
        F.avg("silence_after").alias("silence_after_mean"),
    )


def range_cover(summary: DataFrame, group: str, inner: str, outer: str) -> DataFrame:
    """Whether the level range of ``outer`` covers that of ``inner``."""
    def edge(which: str, name: str) -> Column:
        return F.max(F.when(F.col(group) == which, F.col(name)))

    covered = (edge(inner, "rms_min") >= edge(outer, "rms_min")) & (edge(inner, "rms_max") <= edge(outer, "rms_max"))
    return summary.agg(covered.alias("covered")).select(F.lit(inner).alias("inner_group"), F.lit(outer).alias("outer_group"), "covered")
