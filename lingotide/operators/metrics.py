"""Evaluation metrics over predictions, ranks and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingotide.operators.blocks import exact_median, merge_rows

TONES = range(5)


def _counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("scorer", "expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """All (scorer, expected, predicted) cells for tones 0..4, zero-filled."""
    counts = _counts(pred)
    cells = (
        counts.select("scorer")
        .distinct()
        .withColumn("expected", F.explode(_ints(TONES)))
        .withColumn("predicted", F.explode(_ints(TONES)))
    )
    return cells.join(counts, ["scorer", "expected", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_report(pred: DataFrame) -> DataFrame:
    """The matrix as one row per scorer and expected tone."""
    wide = confusion_matrix(pred).groupBy("scorer", "expected").pivot("predicted", list(TONES)).agg(F.sum("n"))
    return wide.select("scorer", "expected", *[F.col(str(t)).alias(f"predicted_{t}") for t in TONES])


def accuracy(pred: DataFrame) -> DataFrame:
    """(scorer, tone, n, correct, accuracy) per expected tone and, with a null tone, overall; 0.0 for an empty class."""
    counts = _counts(pred)
    right = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)
    per_class = counts.groupBy("scorer", F.col("expected").alias("tone")).agg(
        F.sum("n").alias("n"), F.sum(right).alias("correct")
    )
    overall = counts.groupBy("scorer").agg(F.sum("n").alias("n"), F.sum(right).alias("correct"))
    filled = (
        counts.select("scorer")
        .distinct()
        .withColumn("tone", F.explode(_ints(TONES)))
        .join(per_class, ["scorer", "tone"], "left")
        .select("scorer", "tone", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("correct", F.lit(0)).alias("correct"))
    )
    both = filled.union(overall.select("scorer", F.lit(None).cast("int"), "n", "correct"))
    return both.withColumn("accuracy", F.col("correct") / F.greatest(F.col("n"), F.lit(1)))


def top_confusions(pred: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent (expected, predicted) mistakes over all scorers; ties by tone."""
    return (
        _counts(pred)
        .filter("expected <> predicted")
        .groupBy("expected", "predicted")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "expected", "predicted")
        .limit(n)
    )


def scorer_summary(pred: DataFrame, sentence_scores: DataFrame) -> DataFrame:
    """Accuracy, mean and population deviation of the sentence scores, failed sentences, and the best scorer.

    ``sentence_scores`` has scorer and score, null for a failed sentence. Equal accuracies go to
    the scorer that sorts first.
    """
    rates = accuracy(pred).filter("tone IS NULL").select("scorer", "accuracy")
    scores = sentence_scores.groupBy("scorer").agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("std_score"),
        F.count_if(F.col("score").isNull()).alias("n_errors"),
    )
    # one row per scorer is left here
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("accuracy").desc(), "scorer"))
    return rates.join(scores, "scorer", "left").withColumn("is_best", first == 1)


def topk_accuracy(ranks: DataFrame, rank: str = "target_rank", ks: Sequence[int] = (1, 2, 5, 10)) -> DataFrame:
    """Share of rows whose rank is within k, one row per k."""
    shares = ranks.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col(rank) <= k).cast("double")).alias(f"k{k}") for k in ks]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"k{k}", F.lit(0.0)).alias("accuracy")) for k in ks])
    return shares.select("n", F.inline(rows))


THRESHOLDS = (0.1, 0.2, 0.3, 0.5)


def prob_metrics(probs: DataFrame, prob: str = "target_prob") -> DataFrame:
    """One row: count, mean and median probability of the right answer, shares at or above the thresholds."""
    shares = [
        F.coalesce(F.avg((F.col(prob) >= t).cast("double")), F.lit(0.0)).alias(f"above_{int(t * 100)}") for t in THRESHOLDS
    ]
    means = probs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(prob), F.lit(0.0)).alias("mean_prob"), *shares)
    middle = exact_median(probs, [], prob, 1 / 1024, "median_prob")
    return merge_rows(means, middle).withColumn("median_prob", F.coalesce("median_prob", F.lit(0.0)))


def class_mean_prob(probs: DataFrame, cls: str, classes: Sequence[int], prob: str = "target_prob") -> DataFrame:
    """Mean probability of the right answer per class, 0 for an empty class: (class, n, mean_prob)."""
    found = probs.groupBy(F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"))
    every = probs.sparkSession.range(1).select(F.explode(_ints(classes)).alias("class"))
    return every.join(found, "class", "left").select(
        "class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_prob", F.lit(0.0)).alias("mean_prob")
    )


def position_accuracy(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of scores above the threshold per test set and position, with the set's variance over positions."""
    per_position = scores.groupBy("test_set", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("score") > threshold).cast("double")).alias("accuracy")
    )
    spread = per_position.groupBy("test_set").agg(F.var_pop("accuracy").alias("spread"))
    return per_position.join(spread, "test_set")


def worst_predictions(probs: DataFrame, keys: Sequence[str], prob: str = "target_prob", n: int = 10) -> DataFrame:
    """The n least probable right answers; ties by key."""
    return probs.orderBy(prob, *keys).limit(n)
