"""Tone classification of contours: shape rules, or distance to templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lingotide.operators.contours import tone_features
from lingotide.operators.scoring import argmax

# Thresholds of the shape rules.
SHORT_MS, LOW_VOICING = 100, 0.4
FLAT_SLOPE, FLAT_RANGE = 0.02, 0.5
TILT_SLOPE, TILT_CHANGE = 0.03, 0.5
DIP_FROM, DIP_TO, DIP_RANGE = 0.25, 0.75, 0.5
STEEP, FULL_CHANGE = 0.1, 2.0
# Probabilities of the early neutral exits, tones 0..4.
SHORT_PROBS_RULES = [0.7, 0.1, 0.1, 0.05, 0.05]
SHORT_PROBS_TEMPLATES = [0.7, 0.075, 0.075, 0.075, 0.075]
UNVOICED_PROBS = [0.6, 0.1, 0.1, 0.1, 0.1]
# Idealized contours by tone, in tie-break order.
TEMPLATES = {
    1: [0.8] * 20,
    2: [-0.6, -0.5, -0.4, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9],
    3: [0.2, 0.1, 0.0, -0.1, -0.3, -0.5, -0.7, -0.8, -0.8, -0.7, -0.6, -0.4, -0.2, 0.0, 0.1, 0.2, 0.3, 0.4, 0.45, 0.5],
    4: [0.9, 0.85, 0.75, 0.6, 0.45, 0.3, 0.15, 0.0, -0.15, -0.3, -0.45, -0.55, -0.65, -0.7, -0.75, -0.8, -0.82, -0.85, -0.87, -0.9],
    0: [0.0] * 20,
}
TEMPERATURE = 2.0


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _strength(slope: Column, change: Column) -> Column:
    return F.least(F.lit(1.0), slope / STEEP) * F.least(F.lit(1.0), change / FULL_CHANGE)


def _early_exit(rows: DataFrame, short_probs: list[float]) -> DataFrame:
    short, unvoiced = F.col("duration_ms") < SHORT_MS, F.col("voicing_ratio") < LOW_VOICING
    tag = F.when(short, "short_duration").when(unvoiced, "low_voicing")
    probs = F.when(short, _doubles(short_probs)).when(unvoiced, _doubles(UNVOICED_PROBS))
    return rows.withColumn("_exit_tag", tag).withColumn("_exit_probs", probs)


def classify_rules(rows: DataFrame, contour: str = "f0_norm") -> DataFrame:
    """Add predicted tone, confidence, probabilities (tones 0..4) and tags from the contour shape."""
    f = _early_exit(tone_features(rows, contour), SHORT_PROBS_RULES)
    slope, span = F.col("slope"), F.col("range_st")
    rise = F.col("end_level") - F.col("start_level")
    dip = F.least(F.col("start_level"), F.col("end_level")) - F.col("min_level")
    place = F.col("min_position")
    flat_score = (1 - F.abs(slope) / FLAT_SLOPE) * (1 - span / FLAT_RANGE)
    scores = {
        "_s1": F.when((F.abs(slope) < FLAT_SLOPE) & (span < FLAT_RANGE), flat_score),
        "_s2": F.when((slope > TILT_SLOPE) & (rise > TILT_CHANGE), _strength(slope, rise)),
        "_s3": F.when(
            (place > DIP_FROM) & (place < DIP_TO) & (dip > 0) & (span > DIP_RANGE),
            F.least(F.lit(1.0), dip) * (1 - F.abs(place - 0.5)),
        ),
        "_s4": F.when((slope < -TILT_SLOPE) & (-rise > TILT_CHANGE), _strength(-slope, -rise)),
    }
    f = f.withColumns({name: F.coalesce(c, F.lit(0.0)) for name, c in scores.items()})
    f = f.withColumns({"_p1": F.col("_s1") * 0.8} | {f"_p{t}": F.col(f"_s{t}") * 0.85 for t in (2, 3, 4)})
    total = F.col("_p1") + F.col("_p2") + F.col("_p3") + F.col("_p4")
    f = f.withColumn("_total", total)
    ruled = F.array(F.lit(0.0), *[F.col(f"_p{t}") / F.col("_total") for t in (1, 2, 3, 4)])
    f = f.withColumn(
        "probs", F.coalesce("_exit_probs", F.when(F.col("_total") > 0, ruled).otherwise(_doubles([0.2] * 5)))
    )
    tags = F.array_compact(
        F.array(
            F.when(F.col("_s1") > 0.5, "flat_contour"),
            F.when(F.col("_s2") > 0.3, "rising_contour"),
            F.when(F.col("_s3") > 0.3, "dipping_contour"),
            F.when(F.col("_s4") > 0.3, "falling_contour"),
            F.when(F.col("_total") <= 0, "no_rule_matched"),
        )
    )
    f = f.withColumn("tags", F.when(F.col("_exit_tag").isNotNull(), F.array("_exit_tag")).otherwise(tags))
    out = f.withColumn("predicted", argmax(F.col("probs"))).withColumn("confidence", F.array_max("probs"))
    return out.select(*rows.columns, "predicted", "confidence", "probs", "tags")


def resample_array(values: Column, n: Column) -> Column:
    """Linear interpolation of an array to n evenly spaced points."""
    m = F.size(values)

    def at(i: Column) -> Column:
        p = i * (m - 1) / (n - 1)
        low = F.floor(p).cast("int")
        a = F.element_at(values, low + 1)
        return a + (F.element_at(values, F.least(low + 2, m)) - a) * (p - low)

    return F.when(m == n, values).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def _rms_distance(a: Column, b: Column, n: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / n)


def dtw_distances(contours: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Warping distance (absolute cost) of every contour to every template, all pairs advancing together."""
    rows, n = contours.shape
    kinds, m = templates.shape
    previous = np.full((rows, kinds, m + 1), np.inf)
    previous[:, :, 0] = 0.0
    for i in range(n):
        cost = np.abs(contours[:, i, None, None] - templates[None])
        current = np.full_like(previous, np.inf)
        for j in range(m):
            best = np.minimum(np.minimum(previous[:, :, j + 1], current[:, :, j]), previous[:, :, j])
            current[:, :, j + 1] = cost[:, :, j] + best
        previous = current
    return previous[:, :, m]


def _dtw_udf(templates: dict[int, list[float]]):
    table = np.array(list(templates.values()), dtype=float)

    @F.pandas_udf(ArrayType(DoubleType()))
    def distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for _, same in batch.groupby(batch.map(len)):
                block = dtw_distances(np.stack(same.to_list()).astype(float), table)
                for at, row in zip(same.index, block):
                    out[at] = row.tolist()
            yield out

    return distances


def template_distances(
    rows: DataFrame, contour: str = "f0_norm", templates: dict[int, list[float]] | None = None, use_dtw: bool = False
) -> DataFrame:
    """Add ``distances`` to the templates, in template order; the shorter side is stretched unless warping."""
    shapes = templates or TEMPLATES
    if use_dtw:
        return rows.withColumn("distances", _dtw_udf(shapes)(F.col(contour)))
    longest = max(len(t) for t in shapes.values())
    sized = rows.withColumn("_n", F.greatest(F.size(contour), F.lit(longest)))
    sized = sized.withColumn("_c", F.when(F.size(contour) == F.col("_n"), F.col(contour)).otherwise(resample_array(F.col(contour), F.col("_n"))))
    each = [_rms_distance(F.col("_c"), resample_array(_doubles(t), F.col("_n")), F.col("_n")) for t in shapes.values()]
    return sized.withColumn("distances", F.array(*each)).drop("_n", "_c")


def classify_templates(
    rows: DataFrame, contour: str = "f0_norm", templates: dict[int, list[float]] | None = None, use_dtw: bool = False
) -> DataFrame:
    """Add predicted tone, confidence, probabilities (tones 0..4) and the match tag of the nearest template."""
    shapes = templates or TEMPLATES
    order = list(shapes)
    f = _early_exit(template_distances(rows, contour, shapes, use_dtw), SHORT_PROBS_TEMPLATES)
    f = f.withColumn("_low", F.array_min("distances"))
    weights = F.transform("distances", lambda d: F.exp(-d / TEMPERATURE))
    f = f.withColumn("_w", weights)
    total = F.aggregate("_w", F.lit(0.0), lambda acc, v: acc + v)
    f = f.withColumn("_sum", total)
    by_tone = F.array(*[F.element_at("_w", order.index(t) + 1) / F.col("_sum") for t in range(5)])
    nearest = F.element_at(F.array(*[F.lit(t) for t in order]), argmax(F.transform("distances", lambda d: -d)) + 1)
    match = F.when(F.col("_low") < 0.5, "strong_match").when(F.col("_low") < 1.0, "moderate_match").otherwise("weak_match")
    out = f.withColumn("probs", F.coalesce("_exit_probs", by_tone)).withColumn(
        "predicted", F.when(F.col("_exit_tag").isNotNull(), 0).otherwise(nearest)
    )
    out = out.withColumn("confidence", F.element_at("probs", F.col("predicted") + 1))
    out = out.withColumn("tags", F.array(F.coalesce("_exit_tag", match)))
    return out.select(*rows.columns, "predicted", "confidence", "probs", "tags")
