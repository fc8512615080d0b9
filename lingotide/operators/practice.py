"""Practice statistics over an attempt log.

``attempts`` has learner_id, sequence_id, arrival_seq, graded_at and rating; ``toggles`` has learner_id,
sequence_id and arrival_seq. Windows run only over data already reduced to learner-days, except the
top-n windows, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingotide.functions.bands import heat_level

RATINGS = ["hard", "almost", "good", "easy"]
PAIR = ["learner_id", "sequence_id"]


def _date(day: str | Column) -> Column:
    return F.to_date(F.lit(day)) if isinstance(day, str) else day


def practice_totals(attempts: DataFrame) -> DataFrame:
    """Attempts, rating counts and last practice day per learner."""
    counts = [F.count_if(F.col("rating") == r).alias(f"n_{r}") for r in RATINGS]
    return attempts.groupBy("learner_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), *counts, F.max(F.to_date("graded_at")).alias("last_practice")
    )


def daily_attempts(attempts: DataFrame) -> DataFrame:
    """Attempt count per learner and calendar day."""
    return attempts.groupBy("learner_id", F.to_date("graded_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n_attempts")
    )


def sequences_practised(progress: DataFrame) -> DataFrame:
    """Tracked sequences with at least one attempt, per learner."""
    return (
        progress.filter("tracked AND attempt_count > 0")
        .groupBy("learner_id")
        .agg(F.count(F.lit(1)).alias("n_sequences"))
    )


def weekly_attempts(attempts: DataFrame, today: str) -> DataFrame:
    """Attempts since the Monday of the week of ``today``, per learner."""
    monday = F.to_date(F.date_trunc("week", _date(today)))
    return (
        attempts.filter(F.to_date("graded_at") >= monday)
        .groupBy("learner_id")
        .agg(F.count(F.lit(1)).alias("n_attempts"))
    )


def activity_grid(attempts: DataFrame, today: str) -> DataFrame:
    """52 x 7 days per learner from the Monday on or before today - 364, with intensity levels.

    The grid ends before the week of ``today``; the intensity scale is the learner's busiest day overall.
    A learner's counts within the grid, at most 364, are one map, so the days are filled in without another join.
    """
    start = F.to_date(F.date_trunc("week", F.date_sub(_date(today), 364)))
    shown = F.when(F.col("day").between(start, F.date_add(start, 363)), F.struct("day", "n_attempts"))
    learners = daily_attempts(attempts).groupBy("learner_id").agg(
        F.max("n_attempts").alias("busiest"), F.map_from_entries(F.collect_list(shown)).alias("counts")
    )
    filled = learners.select("learner_id", "busiest", "counts", F.explode(F.sequence(start, F.date_add(start, 363))).alias("day"))
    count = F.coalesce(F.try_element_at("counts", F.col("day")), F.lit(0))
    return filled.select(
        "learner_id",
        "day",
        F.expr("CAST(datediff(day, date_trunc('week', day)) AS INT)").alias("weekday"),
        count.alias("n_attempts"),
        heat_level(count / F.col("busiest")).alias("heat"),
        (F.col("day") > _date(today)).alias("is_future"),
    )


def streaks(attempts: DataFrame, today: str) -> DataFrame:
    """Longest run of practice days, and the run that reaches today or yesterday, per learner."""
    days = attempts.select("learner_id", F.to_date("graded_at").alias("day")).distinct()
    w = Window.partitionBy("learner_id").orderBy("day")
    islands = (
        days.withColumn("island", F.date_sub("day", F.row_number().over(w)))
        .groupBy("learner_id", "island")
        .agg(F.count(F.lit(1)).alias("length"), F.max("day").alias("last_day"))
    )
    latest = F.max(F.struct("last_day", "length"))
    return (
        islands.groupBy("learner_id")
        .agg(F.max("length").alias("longest_streak"), latest.alias("latest"))
        .select(
            "learner_id",
            "longest_streak",
            F.when(F.datediff(_date(today), "latest.last_day") <= 1, F.col("latest.length"))
            .otherwise(0)
            .alias("current_streak"),
        )
    )


def cumulative_mastery(attempts: DataFrame, sequences: DataFrame, today: str) -> DataFrame:
    """Sequences ever rated good or easy, per level 1..6, for each day up to ``today``.

    Each (learner, sequence) is reduced to its first mastery day before the level join, so the
    running sums only see learner-days.
    """
    day = F.to_date("graded_at")
    today_ = _date(today)
    first = (
        attempts.filter(F.col("rating").isin("good", "easy"))
        .groupBy(*PAIR)
        .agg(F.min(day).alias("day"))
        .join(sequences.filter("level BETWEEN 1 AND 6").select("sequence_id", "level"), "sequence_id")
    )
    gained = first.groupBy("learner_id", "day").agg(
        *[F.count_if(F.col("level") == k).alias(f"g{k}") for k in range(1, 7)]
    )
    calendar = (
        attempts.groupBy("learner_id")
        .agg(F.min(day).alias("first_day"))
        .filter(F.col("first_day") <= today_)
        .select("learner_id", F.explode(F.sequence("first_day", today_)).alias("day"))
    )
    w = Window.partitionBy("learner_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    levels = [F.sum(F.coalesce(F.col(f"g{k}"), F.lit(0))).over(w).alias(f"level_{k}") for k in range(1, 7)]
    filled = calendar.join(gained, ["learner_id", "day"], "left").select("learner_id", "day", *levels)
    return filled.withColumn("total", sum((F.col(f"level_{k}") for k in range(2, 7)), F.col("level_1")))


def recent_attempts(attempts: DataFrame, n: int) -> DataFrame:
    """The n most recently arrived attempts of each learner and sequence, numbered newest first."""
    w = Window.partitionBy(*PAIR).orderBy(F.col("arrival_seq").desc())
    return attempts.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def retain_latest(attempts: DataFrame, n: int = 50) -> DataFrame:
    """Retention: drop everything but the n most recently arrived attempts per learner and sequence."""
    return recent_attempts(attempts, n).drop("recency")


def progress_state(attempts: DataFrame, toggles: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """Progress per learner and sequence after replaying attempts, track toggles and set events in arrival order.

    An attempt always tracks, a set event (``sets`` with a boolean ``tracked``) tracks or not, a toggle flips. So only
    the last attempt or set event and the parity of the toggles after it matter. The state fields follow arrival, not
    the graded time.
    """
    state = attempts.groupBy(*PAIR).agg(
        F.max_by(F.struct("graded_at", "rating", "arrival_seq"), "arrival_seq").alias("last"),
        F.count(F.lit(1)).alias("attempt_count"),
    )
    if sets is not None:
        given = sets.groupBy(*PAIR).agg(F.max(F.struct("arrival_seq", "tracked")).alias("given"))
        state = state.join(given, PAIR, "full")
    else:
        state = state.withColumn("given", F.lit(None).cast("struct<arrival_seq:bigint,tracked:boolean>"))
    later = F.col("last").isNull() | (F.col("given.arrival_seq") > F.col("last.arrival_seq"))
    state = state.withColumn("base", F.when(F.col("given").isNotNull() & later, F.col("given.tracked")).otherwise(F.col("last").isNotNull()))
    if toggles is None:
        joined = state.withColumn("flips", F.lit(0))
    else:
        settled = F.greatest(F.col("last.arrival_seq"), F.col("given.arrival_seq"))
        flips = (
            toggles.select(*PAIR, "arrival_seq")
            .join(state.select(*PAIR, settled.alias("settled")), PAIR, "left")
            .groupBy(*PAIR)
            .agg(F.count_if(F.col("settled").isNull() | (F.col("arrival_seq") > F.col("settled"))).alias("flips"))
        )
        joined = state.join(flips, PAIR, "full")
    odd = F.coalesce(F.col("flips"), F.lit(0)) % 2 == 1
    return joined.select(
        *PAIR,
        (F.coalesce("base", F.lit(False)) != odd).alias("tracked"),
        F.col("last.graded_at").alias("last_attempt_at"),
        F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"),
        F.col("last.rating").alias("last_rating"),
    )


def with_progress(pairs: DataFrame, sequences: DataFrame, progress: DataFrame) -> DataFrame:
    """Requested (learner, sequence) pairs with their sequence and progress; unseen pairs get the default state."""
    return (
        pairs.join(sequences, "sequence_id")
        .join(progress, PAIR, "left")
        .withColumn("tracked", F.coalesce("tracked", F.lit(False)))
        .withColumn("attempt_count", F.coalesce("attempt_count", F.lit(0)))
    )


def progress_map(pairs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Progress of the requested pairs straight from the log, with the default state for unseen ones."""
    return (
        pairs.join(progress_state(attempts), PAIR, "left")
        .withColumn("tracked", F.coalesce("tracked", F.lit(False)))
        .withColumn("attempt_count", F.coalesce("attempt_count", F.lit(0)))
    )


def latest_recording(recordings: DataFrame, keys: list[str], created: str, unique: str) -> DataFrame:
    """The newest recording per key; a later save replaces an earlier one."""
    rest = [c for c in recordings.columns if c not in keys]
    newest = recordings.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(created, unique)).alias("r")
    )
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
