"""Score bands, heat levels and the combined syllable score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grade_band(prob: Column) -> Column:
    """Band of a probability of the right answer."""
    return F.when(prob >= 0.6, "easy").when(prob >= 0.4, "good").when(prob >= 0.2, "almost").otherwise("bad")


def score_band(score: Column) -> Column:
    """Band of a 0..100 score."""
    return F.when(score >= 80, "good").when(score >= 50, "almost").otherwise("bad")


def heat_level(ratio: Column) -> Column:
    """Activity intensity 0..4 from the share of the busiest day."""
    return F.when(ratio > 0.75, 4).when(ratio > 0.5, 3).when(ratio > 0.25, 2).when(ratio > 0, 1).otherwise(0)


def combined_score(syllable: Column, tone: Column) -> Column:
    """0.7 syllable + 0.3 tone; a missing syllable score is 0, a missing tone score is 1."""
    return F.coalesce(syllable, F.lit(0.0)) * 0.7 + F.coalesce(tone, F.lit(1.0)) * 0.3
