"""Streaming queries, run to the end of the given table and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotide.plans.registry import query
from lingotide.plans.views import ATTEMPTS, TOGGLES, Views
from lingotide.streaming import daily as D
from lingotide.streaming import events as EV
from lingotide.streaming import progress as PR
from lingotide.streaming.run import run_updates


def event_stream(v: Views):
    """The event table as a stream of files."""
    schema = v.table("events").schema
    return v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)


def attempt_stream(v: Views):
    """The attempt log read as a stream of files, with UTC timestamps."""
    rows = v.spark.sql(ATTEMPTS.replace("FROM events", "FROM {events}"), events=event_stream(v))
    return rows.withColumn("graded_at", F.col("graded_at").cast("timestamp"))


@query(
    "stm1_progress_upkeep",
    """
SELECT learner_id, sequence_id, true AS tracked, arg_max(graded_at, arrival_seq) AS last_attempt_at, count(*) AS attempt_count,
  arg_max(rating, arrival_seq) AS last_rating FROM attempts GROUP BY 1, 2""",
)
def stm1(v: Views):
    state = run_updates(PR.progress_updates(attempt_stream(v)), "progress", keys=PR.PAIR).drop("batch_id")
    return state.withColumn("last_attempt_at", F.col("last_attempt_at").cast("timestamp_ntz"))


@query(
    "stm1_history_upkeep",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY learner_id, sequence_id ORDER BY arrival_seq DESC) AS k FROM attempts)
SELECT learner_id, sequence_id, string_agg(CAST(arrival_seq AS VARCHAR), ',' ORDER BY k) AS arrivals, string_agg(rating, ',' ORDER BY k) AS ratings
FROM r WHERE k <= 50 GROUP BY 1, 2""",
)
def stm1_history(v: Views):
    kept = run_updates(PR.history_updates(attempt_stream(v)), "history", keys=PR.PAIR)
    return kept.select(
        "learner_id", "sequence_id", F.array_join(F.col("arrivals").cast("array<string>"), ",").alias("arrivals"),
        F.array_join("ratings", ",").alias("ratings"),
    )


@query(
    "stm2_daily_counts",
    "SELECT learner_id, CAST(graded_at AS DATE) AS day, count(*) AS n_attempts FROM attempts GROUP BY 1, 2",
)
def stm2(v: Views):
    return run_updates(D.daily_attempts(attempt_stream(v)), "daily", keys=["learner_id", "day"]).drop("batch_id")


@query(
    "stm1_progress_with_toggles",
    """
WITH a AS (SELECT learner_id, sequence_id, arg_max(graded_at, arrival_seq) AS last_attempt_at, count(*) AS attempt_count,
    arg_max(rating, arrival_seq) AS last_rating, max(arrival_seq) AS settled FROM attempts GROUP BY 1, 2),
f AS (SELECT t.learner_id, t.sequence_id, count(*) FILTER (settled IS NULL OR arrival_seq > settled) AS flips
    FROM toggles t LEFT JOIN a USING (learner_id, sequence_id) GROUP BY 1, 2),
k AS (SELECT learner_id, sequence_id, string_agg(CAST(arrival_seq AS VARCHAR), ',' ORDER BY arrival_seq DESC) AS arrivals
    FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, sequence_id ORDER BY arrival_seq DESC) AS r FROM attempts) WHERE r <= 50 GROUP BY 1, 2)
SELECT learner_id, sequence_id, (settled IS NOT NULL) <> (coalesce(flips, 0) % 2 = 1) AS tracked, last_attempt_at, coalesce(attempt_count, 0) AS attempt_count,
  last_rating, coalesce(arrivals, '') AS arrivals FROM a FULL JOIN f USING (learner_id, sequence_id) LEFT JOIN k USING (learner_id, sequence_id)""",
)
def stm1_toggles(v: Views):
    """Attempts and toggles of one stream of files, replayed by arrival."""
    toggles = v.spark.sql(TOGGLES.replace("FROM events", "FROM {events}"), events=event_stream(v))
    kept = run_updates(EV.keep_progress(EV.practice_events(attempt_stream(v), toggles)), "progress-events", keys=PR.PAIR)
    return kept.select(
        *PR.PAIR, "tracked", F.col("last_attempt_at").cast("timestamp_ntz").alias("last_attempt_at"), "attempt_count", "last_rating",
        F.array_join(F.col("arrivals").cast("array<string>"), ",").alias("arrivals"),
    )
