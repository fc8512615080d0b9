"""What to practise next: priorities, queues and picks per learner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingotide.functions.draws import draw
from lingotide.operators.blocks import block_of, number_rows
from lingotide.operators.practice import PAIR
from lingotide.session import staged

# Practice need by last rating; never rated counts as 100.
NEED = {"hard": 100.0, "almost": 75.0, "good": 50.0, "easy": 25.0}
QUEUE_CLASS = {"hard": 1, "almost": 2, "good": 3, "easy": 4}
RECENCY_WEIGHT = 50.0


def _mapped(column: str, values: dict, default) -> Column:
    out = None
    for key, value in values.items():
        hit = F.col(column) == key
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def tracked_sequences(progress: DataFrame, sequences: DataFrame) -> DataFrame:
    """Tracked pairs with their sequence; pairs whose sequence no longer exists are dropped."""
    return progress.filter("tracked").join(sequences, "sequence_id")


def rank_sequences(candidates: DataFrame, now: str) -> DataFrame:
    """Priority of each candidate pair: need by last rating minus a penalty for recent practice."""
    days = F.expr(f"timestampdiff(DAY, last_attempt_at, TIMESTAMP_NTZ'{now}')")
    penalty = F.when(days < 1, F.lit(RECENCY_WEIGHT)).otherwise(F.lit(RECENCY_WEIGHT) / days)
    return candidates.withColumn(
        "priority", _mapped("last_rating", NEED, 100.0) - F.when(F.col("last_attempt_at").isNull(), 0.0).otherwise(penalty)
    )


def top_candidates(
    candidates: DataFrame, now: str, n: int = 5, exclude: DataFrame | None = None
) -> DataFrame:
    """The n highest priorities per learner after dropping excluded pairs; ties by sequence id."""
    ranked = rank_sequences(candidates, now)
    if exclude is not None:
        ranked = ranked.join(exclude.select(*PAIR), PAIR, "left_anti")
    w = Window.partitionBy("learner_id").orderBy(F.col("priority").desc(), "sequence_id")
    return ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def select_next(
    candidates: DataFrame, now: str, seed: int, n: int = 5, exclude: DataFrame | None = None
) -> DataFrame:
    """One pick per learner, pseudo-random among the n best; the same seed gives the same pick."""
    top = top_candidates(candidates, now, n, exclude)
    pick = draw(seed, "learner_id", "sequence_id")
    best = top.groupBy("learner_id").agg(
        F.min_by(F.struct("sequence_id", "priority"), F.struct(pick.alias("h"), F.col("sequence_id"))).alias("p")
    )
    return best.select("learner_id", "p.sequence_id", "p.priority")


def practice_queue(
    learners: DataFrame, sequences: DataFrame, progress: DataFrame, level: int, n: int = 10
) -> DataFrame:
    """First n sequences of a level per learner: never rated first, then hard, almost, good, easy; ties by id.

    Learners are not multiplied with sequences. With the level's sequences ranked by id and a
    learner's rated ones numbered along those ranks, the k-th unrated sequence sits at rank
    ``k + #{i : rank_i - i <= k}``, so n counters per learner find all unrated picks.
    """
    ranked = number_rows(
        sequences.filter(F.col("level") == level).select("sequence_id"), [], ["sequence_id"], block_of("sequence_id"), "rank"
    )
    rated = progress.filter("last_rating IS NOT NULL").select(*PAIR, "last_rating").join(ranked, "sequence_id")
    rated = staged(rated, "rated-sequences")
    numbered = number_rows(rated, ["learner_id"], ["rank"], block_of("rank"), "nth")
    shift = numbered.groupBy("learner_id").agg(
        *[F.count_if(F.col("rank") - F.col("nth") <= k).alias(f"s{k}") for k in range(n)]
    )
    places = F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0)) + k for k in range(n)])
    unrated = (
        learners.select("learner_id")
        .join(shift, "learner_id", "left")
        .select("learner_id", F.explode(places).alias("rank"))
        .join(ranked, "rank")
        .select("learner_id", "sequence_id", F.lit(0).alias("class"))
    )
    w = Window.partitionBy("learner_id").orderBy("class", "sequence_id")
    seen = (
        rated.withColumn("class", _mapped("last_rating", QUEUE_CLASS, 0))
        .select("learner_id", "sequence_id", "class")
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= n)
        .drop("place")
    )
    return unrated.union(seen).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def next_from_queue(queue: DataFrame, current: DataFrame) -> DataFrame:
    """First queued sequence that is not the learner's current one; the first one if there is no other."""
    marked = queue.join(current.select("learner_id", F.col("sequence_id").alias("current_id")), "learner_id", "left")
    other = F.coalesce(F.col("sequence_id") != F.col("current_id"), F.lit(True))
    return marked.groupBy("learner_id").agg(
        F.min_by("sequence_id", F.struct((~other).alias("same"), F.col("place"))).alias("sequence_id")
    )


def pick_by_level(requests: DataFrame, sequences: DataFrame, seed: int) -> DataFrame:
    """Pseudo-random sequence of the requested level, not the current one unless it is the only one.

    ``requests`` has learner_id, level and current_id. Sequences are ranked within their level once,
    and each request computes the rank it wants, so no request meets more than one sequence.
    Levels without sequences give null.
    """
    ranked = number_rows(
        sequences.filter("level IS NOT NULL").select("level", "sequence_id"),
        ["level"],
        ["sequence_id"],
        block_of("sequence_id"),
        "rank",
    )
    sizes = ranked.groupBy("level").agg(F.count(F.lit(1)).alias("size"))
    here = ranked.select("level", F.col("sequence_id").alias("current_id"), F.col("rank").alias("current_rank"))
    asked = requests.join(sizes, "level", "left").join(here, ["level", "current_id"], "left")
    skip = F.col("current_rank").isNotNull() & (F.col("size") > 1)
    span = F.when(skip, F.col("size") - 1).otherwise(F.col("size"))
    nth = F.pmod(draw(seed, "learner_id"), span)
    rank = F.when(skip & (nth >= F.col("current_rank")), nth + 1).otherwise(nth)
    return (
        asked.withColumn("rank", rank)
        .join(ranked, ["level", "rank"], "left")
        .select("learner_id", "level", "current_id", "sequence_id")
    )


def browse(sequences: DataFrame, levels: Sequence[int] | None = None) -> DataFrame:
    """Sequences by level (none last), text and id; a level filter leaves out sequences without level."""
    chosen = sequences.filter(F.col("level").isin(list(levels))) if levels else sequences
    return chosen.orderBy(F.col("level").asc_nulls_last(), "text", "sequence_id")
