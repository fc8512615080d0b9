"""Daily attempt counts kept up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_attempts(attempts: DataFrame, delay: str | None = None) -> DataFrame:
    """Counts per learner and day of ``graded_at`` (a timestamp), however late an attempt arrives.

    The state is one row per learner and day. A ``delay`` such as "30 days" bounds it: rows later than that watermark
    are dropped.

    Run in update mode: a day is emitted again when late attempts change it.
    """
    return (
        (attempts if delay is None else attempts.withWatermark("graded_at", delay))
        .groupBy(F.window("graded_at", "1 day"), "learner_id")
        .agg(F.count(F.lit(1)).alias("n_attempts"))
        .select("learner_id", F.to_date("window.start").alias("day"), "n_attempts")
    )


def latest_counts(updates: DataFrame) -> DataFrame:
    """Current count per learner and day from the emitted updates (with their ``batch_id``)."""
    return updates.groupBy("learner_id", "day").agg(F.max_by("n_attempts", "batch_id").alias("n_attempts"))
