"""End-to-end grading of recordings against their target syllables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingotide.functions.units import HOP
from lingotide.operators.classify import classify_rules, classify_templates
from lingotide.operators.contours import POINTS, contours
from lingotide.operators.scoring import sentence_score, syllable_scores, with_empty_sentences
from lingotide.operators.spans import uniform_spans
from lingotide.operators.syllables import apply_sandhi
from lingotide.session import staged


def grade_syllables(
    frames: DataFrame,
    targets: DataFrame,
    key: str,
    spans: DataFrame | None = None,
    classifier: str = "rules",
    k: int = POINTS,
    use_dtw: bool = False,
) -> DataFrame:
    """Each target with its predicted tone and scores: sandhi, spans, contours, classification, fusion.

    ``targets`` has key, idx, base and tone. Spans are even unless given (for instance by the
    reference alignment); targets beyond the last span are dropped.
    """
    expected = apply_sandhi(targets, key).select(key, "idx", F.col("surface").alias("expected"))
    if spans is None:
        lengths = frames.groupBy(key).agg((F.count(F.lit(1)) * HOP).alias("n_samples"))
        counts = targets.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_syllables"))
        spans = uniform_spans(lengths.join(counts, key), key)
    spans = staged(spans.select(key, "idx", "start_ms", "end_ms"), "spans")
    shapes = contours(frames, spans, key, k)
    if classifier == "rules":
        told = classify_rules(shapes)
    else:
        told = classify_templates(shapes, use_dtw=use_dtw)
    both = expected.join(told.select(key, "idx", "predicted", "confidence", "tags"), [key, "idx"])
    return staged(syllable_scores(both), "syllable-scores")


def grade(
    frames: DataFrame,
    targets: DataFrame,
    recordings: DataFrame,
    key: str,
    spans: DataFrame | None = None,
    classifier: str = "rules",
    k: int = POINTS,
    use_dtw: bool = False,
) -> DataFrame:
    """Sentence score of every recording; recordings without targets score 0 with a warning."""
    scored = grade_syllables(frames, targets, key, spans, classifier, k, use_dtw)
    return with_empty_sentences(recordings, sentence_score(scored, [key]), [key])
