"""Segmentation of frame series: voicing gaps, energy valleys, speech regions and silences.

``targets`` has key, n_syllables and n_frames.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingotide.functions.units import HOP, HOP_MS, SAMPLE_RATE, WINDOW
from lingotide.operators.blocks import BAND_ROWS, BLOCK_ROWS, block_of, halo, halo_window, number_rows, own_rows, running_sum, runs
from lingotide.operators.frames import VOICED

MIN_GAP = 2
EDGE = 5
SPEECH_DB = -40.0
SILENCE_SHARE = 0.02
SILENT_FRAMES = 10


def voicing_boundaries(frames: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Syllable boundaries at the middles of the longest unvoiced runs: (key, boundary).

    The n - 1 longest runs of at least two frames are used (earlier ones on ties), possibly fewer;
    without any run the boundaries are uniform.
    """
    gaps = runs(frames, [key], "frame_idx", F.col("voicing") < VOICED).withColumn(
        "_len", F.col("run_end") - F.col("run_start") + 1
    )
    gaps = gaps.filter(F.col("_len") >= MIN_GAP)
    longest_first = F.struct((-F.col("_len")).alias("l"), block_of("run_start").alias("b"))
    ranked = number_rows(gaps, [key], [F.col("_len").desc(), "run_start"], longest_first, "_rank")
    wanted = targets.filter("n_syllables > 1")
    found = (
        ranked.join(wanted, key)
        .filter(F.col("_rank") < F.col("n_syllables") - 1)
        .select(key, (F.col("run_start") + F.expr("_len div 2")).cast("int").alias("boundary"))
    )
    even = wanted.join(gaps.select(key).distinct(), key, "left_anti").select(
        key, F.explode(F.expr("transform(sequence(1, n_syllables - 1), i -> CAST(n_frames * i div n_syllables AS INT))")).alias("boundary")
    )
    return found.union(even)


def boundary_spans(boundaries: DataFrame, targets: DataFrame, key: str, confidence: float) -> DataFrame:
    """Spans in ms between consecutive boundaries; the last one ends with the recording."""
    ends = boundaries.select(key, "boundary").union(targets.select(key, F.col("n_frames").alias("boundary")))
    numbered = number_rows(ends, [key], ["boundary"], block_of("boundary"), "idx")
    previous = F.coalesce(F.lag("boundary").over(halo_window([key], "idx")), F.lit(0))
    spans = own_rows(halo(numbered, "idx", before=1).withColumn("_start", previous))
    return spans.select(
        key,
        "idx",
        (F.col("_start") * HOP_MS).alias("start_ms"),
        (F.col("boundary") * HOP_MS).alias("end_ms"),
        F.lit(confidence).alias("confidence"),
    )


def energy_boundaries(
    frames: DataFrame, targets: DataFrame, key: str, block: int = BLOCK_ROWS, band: int = BAND_ROWS
) -> DataFrame:
    """Boundary i at the lowest smoothed energy near its even position: (key, boundary_no, boundary).

    Energy is median-smoothed over three frames with repeated edges. The search windows meet the frames
    on (key, block), never on the key alone.
    """
    w = halo_window([key], "frame_idx")
    around = F.array_sort(
        F.array(
            F.coalesce(F.lag("energy").over(w), F.col("energy")),
            F.col("energy"),
            F.coalesce(F.lead("energy").over(w), F.col("energy")),
        )
    )
    smooth = own_rows(
        halo(frames.select(key, "frame_idx", "energy"), "frame_idx", 1, 1, block).withColumn("_e", around)
    ).select(key, "frame_idx", F.element_at("_e", 2).alias("_e"), block_of("frame_idx", band).alias("_block"))
    windows = (
        targets.filter("n_syllables > 1")
        .withColumn("boundary_no", F.explode(F.sequence(F.lit(0), F.col("n_syllables") - 2)))
        .withColumn("_expected", F.expr("CAST(n_frames * (boundary_no + 1) div n_syllables AS INT)"))
        .withColumn("_r", F.expr("greatest(3, n_frames div n_syllables div 3)"))
        .withColumn("_from", F.greatest(F.lit(EDGE), F.col("_expected") - F.col("_r")))
        .withColumn("_to", F.least(F.col("n_frames") - EDGE, F.col("_expected") + F.col("_r")))
    )
    searched = (
        windows.filter("_from < _to")
        .withColumn("_block", F.explode(F.sequence(block_of("_from", band), block_of(F.col("_to") - 1, band))))
        .select(key, "boundary_no", "_from", "_to", "_block")
        .join(smooth, [key, "_block"])
        .filter("frame_idx >= _from AND frame_idx < _to")
        .groupBy(key, "boundary_no")
        .agg(F.min_by("frame_idx", F.struct("_e", "frame_idx")).alias("_at"))
    )
    return windows.join(searched, [key, "boundary_no"], "left").select(
        key, "boundary_no", F.coalesce("_at", "_expected").cast("int").alias("boundary")
    )


def speech_region(frames: DataFrame, key: str) -> DataFrame:
    """First and last loud frame of each recording in ms; a silent recording is kept whole."""
    tops = frames.groupBy(key).agg(F.max("energy").alias("_top"), (F.max("frame_idx") + 1).alias("_n"))
    level = F.log10(F.col("energy") / F.col("_top") + 1e-10) * 20
    loud = (
        frames.select(key, "frame_idx", "energy")
        .join(tops.filter("_top > 0").select(key, "_top"), key)
        .filter(level > SPEECH_DB)
        .groupBy(key)
        .agg(F.min("frame_idx").alias("_a"), F.max("frame_idx").alias("_b"))
    )
    return tops.join(loud, key, "left").select(
        key,
        F.coalesce(F.col("_a") * HOP_MS, F.lit(0)).alias("start_ms"),
        F.coalesce((F.col("_b") + 1) * HOP_MS, F.col("_n") * HOP_MS).alias("end_ms"),
    )


def sample_region(samples: DataFrame, key: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """Speech region in samples: complete 10 ms windows above 2 % of the peak, one window margin on both sides."""
    size = rate // 100
    windows = samples.groupBy(key, F.floor(F.col("sample_idx") / size).alias("_w")).agg(
        F.sum(F.col("x") * F.col("x")).alias("_sq"), F.count(F.lit(1)).alias("_n"), F.max(F.abs("x")).alias("_peak")
    )
    totals = windows.groupBy(key).agg(F.max("_peak").alias("_top"), F.sum("_n").alias("_total"))
    limit = F.when(F.col("_top") > 0, F.col("_top") * SILENCE_SHARE).otherwise(SILENCE_SHARE)
    loud = (
        windows.filter(F.col("_n") == size)
        .join(totals.select(key, "_top"), key)
        .filter(F.sqrt(F.col("_sq") / size) > limit)
        .groupBy(key)
        .agg(F.min("_w").alias("_a"), F.max("_w").alias("_b"))
    )
    return totals.join(loud, key, "left").select(
        key,
        F.coalesce(F.greatest(F.lit(0), (F.col("_a") - 1) * size), F.lit(0)).alias("start_sample"),
        F.coalesce(F.least("_total", (F.col("_b") + 2) * size), "_total").alias("end_sample"),
    )


def detect_segments(frames: DataFrame, key: str, n_samples: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Loud segments between silences of at least 100 ms: (key, seg_no, start_sample, end_sample).

    Energy is averaged over five frames with zeros beyond the ends; loud is above 2 % of the largest
    value. Closed one-frame segments are dropped; a segment still open at the end takes all
    remaining samples. ``n_samples`` has key and n_samples.
    """
    w = halo_window([key], "frame_idx").rowsBetween(-2, 2)
    smooth = own_rows(
        halo(frames.select(key, "frame_idx", "energy"), "frame_idx", 2, 2, block).withColumn("_e", F.sum("energy").over(w) / 5)
    )
    tops = smooth.groupBy(key).agg(F.max("_e").alias("_top"), (F.max("frame_idx") + 1).alias("_frames"))
    active = smooth.join(tops.select(key, "_top"), key).withColumn("_on", F.col("_e") > F.col("_top") * SILENCE_SHARE)
    loud = runs(active, [key], "frame_idx", F.col("_on"), block)
    prior = F.lag("run_end").over(halo_window([key], "_no"))
    opened = own_rows(
        halo(loud.withColumn("_no", F.col("run_no") - 1), "_no", before=1).withColumn("_prior", prior)
    )
    starts = F.when(F.col("run_start") - F.col("_prior") - 1 < SILENT_FRAMES, 0).otherwise(1)
    numbered = running_sum(opened, [key], "_no", starts, "seg_no")
    merged = numbered.groupBy(key, "seg_no").agg(F.min("run_start").alias("_a"), F.max("run_end").alias("_b"))
    still_open = F.col("_frames") - 1 - F.col("_b") < SILENT_FRAMES
    return (
        merged.join(tops.select(key, "_frames"), key)
        .join(n_samples.select(key, "n_samples"), key)
        .filter(still_open | (F.col("_b") > F.col("_a")))
        .select(
            key,
            "seg_no",
            (F.col("_a") * HOP).cast("long").alias("start_sample"),
            F.when(still_open, F.col("n_samples")).otherwise(F.col("_b") * HOP + WINDOW).cast("long").alias("end_sample"),
        )
    )


def _merge_shortest(key: str):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_sample")
        start, end = pdf["start_sample"].tolist(), pdf["end_sample"].tolist()
        left, wanted = len(start), max(int(pdf["_wanted"].iloc[0]), 1)
        before, after = list(range(-1, left - 1)), [*range(1, left), -1]
        # the shortest of all, the earliest among equals; entries of spans that have changed since are skipped
        heap = [(b - a, a, i) for i, (a, b) in enumerate(zip(start, end))]
        heapq.heapify(heap)
        alive = [True] * left
        while left > wanted:
            length, _, at = heapq.heappop(heap)
            if not alive[at] or length != end[at] - start[at]:
                continue
            first = at if after[at] >= 0 else before[at]
            gone = after[first]
            end[first], after[first] = end[gone], after[gone]
            if after[gone] >= 0:
                before[after[gone]] = first
            alive[gone] = False
            left -= 1
            heapq.heappush(heap, (end[first] - start[first], start[first], first))
        kept = [i for i, there in enumerate(alive) if there]
        return pd.DataFrame({
            key: pdf[key].iloc[0], "seg_no": range(len(kept)), "start_sample": [start[i] for i in kept], "end_sample": [end[i] for i in kept],
        })

    return merge


def silence_segments(
    frames: DataFrame, key: str, n_samples: DataFrame, n_expected: int | str, block: int = BLOCK_ROWS
) -> DataFrame:
    """Detected segments, the shortest merged with the next (or, when last, the previous) until n are left.

    ``n_expected`` is a number, or a column of ``n_samples`` with each recording's own number. Detection runs in Spark;
    only the segment list of a recording reaches the sequential merge, which takes time in its length times a logarithm.
    """
    found = detect_segments(frames, key, n_samples, block)
    if isinstance(n_expected, str):
        found = found.join(n_samples.select(key, F.col(n_expected).alias("_wanted")), key)
    else:
        found = found.withColumn("_wanted", F.lit(n_expected))
    kind = found.schema[key].dataType.simpleString()
    return found.groupBy(key).applyInPandas(_merge_shortest(key), f"{key} {kind}, seg_no int, start_sample long, end_sample long")
