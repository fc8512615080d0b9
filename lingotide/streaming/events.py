"""Progress with track toggles and retained history in one keyed state, kept up to date from a stream of events."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lingotide.streaming.progress import HISTORY, PAIR, by_block, sequences_of

# what an event does: an attempt tracks, a set event tracks or not, a toggle flips
ATTEMPT, SET, TOGGLE = "attempt", "set", "toggle"
STATE = (
    "sequences array<int>, tracked array<boolean>, last_us array<long>, counts array<long>, last_ratings array<string>, "
    "arrivals array<array<long>>, ratings array<array<string>>, touched_ms array<long>"
)
OUTPUT = "learner_id long, sequence_id int, tracked boolean, last_us long, attempt_count long, last_rating string, arrivals array<long>, ratings array<string>"


def practice_events(attempts: DataFrame, toggles: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """Attempts, toggles and set events as one stream or table of events in arrival order."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = attempts.select(*PAIR, "arrival_seq", F.lit(ATTEMPT).alias("kind"), F.col("graded_at").cast("timestamp").alias("graded_at"), "rating", none("boolean").alias("tracked"))
    for other, kind in ((toggles, TOGGLE), (sets, SET)):
        if other is not None:
            value = F.col("tracked") if kind == SET else none("boolean")
            rows = rows.unionByName(
                other.select(*PAIR, "arrival_seq", F.lit(kind).alias("kind"), none("timestamp").alias("graded_at"), none("string").alias("rating"), value.alias("tracked"))
            )
    return rows


def _progress_keeper(ttl_ms: int | None) -> Callable[[tuple[Any, ...], Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Replays the events of a batch by arrival; batches follow each other in arrival order."""

    def keep(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # no pair of the block had an event for that long
            state.remove()
            return
        now = 0 if ttl_ms is None else state.getCurrentProcessingTimeMs()
        pairs = {row[0]: row[1:] for row in zip(*state.get) if ttl_ms is None or row[-1] + ttl_ms > now} if state.exists else {}
        told: dict[int | None, tuple[int, bool]] = {}
        last: dict[int | None, tuple[int, Any, str]] = {}
        toggles: dict[int | None, list[int]] = {}
        counts: dict[int | None, int] = {}
        newest = {q: list(zip(row[4], row[5])) for q, row in pairs.items()}
        for batch in batches:
            arrived: dict[int | None, list[tuple[int, str]]] = {}
            fields = (batch[c].tolist() for c in ("arrival_seq", "kind", "graded_us", "rating", "tracked"))
            for sequence, arrival, kind, graded, rating, tracked in zip(sequences_of(key, batch), *fields):
                if kind == TOGGLE:
                    toggles.setdefault(sequence, []).append(arrival)
                    continue
                if sequence not in told or arrival >= told[sequence][0]:
                    told[sequence] = (arrival, kind == ATTEMPT or bool(tracked))
                if kind == ATTEMPT:
                    arrived.setdefault(sequence, []).append((arrival, rating))
                    if sequence not in last or arrival >= last[sequence][0]:
                        last[sequence] = (arrival, graded, rating)
            # only the newest attempts and the arrivals of toggles are kept between batches
            for sequence, rows in arrived.items():
                counts[sequence] = counts.get(sequence, 0) + len(rows)
                newest[sequence] = heapq.nlargest(HISTORY, newest.get(sequence, []) + rows)
        touched = told.keys() | toggles.keys()
        for sequence in touched:
            tracked, last_us, count, last_rating, *_ = pairs.get(sequence, (False, None, 0, None))
            settled, tracked = told.get(sequence, (None, tracked))
            flips = sum(settled is None or arrival > settled for arrival in toggles.get(sequence, []))
            if sequence in last:
                _, graded, last_rating = last[sequence]
                last_us = None if pd.isna(graded) else int(graded)
            rows = newest.get(sequence, [])
            pairs[sequence] = (
                bool(tracked) != (flips % 2 == 1), last_us, count + counts.get(sequence, 0), last_rating, [a for a, _ in rows], [r for _, r in rows], now,
            )
        state.update(tuple(map(list, zip(*((q, *row) for q, row in pairs.items())))))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        out = [(key[0], q, *row[:-1]) for q, row in pairs.items() if q in touched]
        columns = pd.DataFrame(out, columns=[*PAIR, "tracked", "last_us", "attempt_count", "last_rating", "arrivals", "ratings"], dtype=object)
        yield columns.astype({"last_us": "Int64"})

    return keep


def keep_progress(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Emit progress and retained history of every pair that a micro-batch touches (update mode).

    The state is one row per learner and block of sequences and works with any state store. With a time to live, pairs without an
    event for that long start afresh. It is for queries that are triggered by an interval: Spark keeps starting batches to drop old
    state, so a run to the end of the available input would never end.
    """
    rows = events.select(*PAIR, "arrival_seq", "kind", F.unix_micros("graded_at").alias("graded_us"), "rating", "tracked")
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    kept = by_block(rows).applyInPandasWithState(_progress_keeper(ttl_ms), OUTPUT, STATE, "update", timeout)
    return kept.select(*PAIR, "tracked", F.timestamp_micros("last_us").alias("last_attempt_at"), "attempt_count", "last_rating", "arrivals", "ratings")
