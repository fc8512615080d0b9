import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lingotide.operators import practice as P
from lingotide.operators import selection as S

ATTEMPT = "learner_id long, sequence_id int, arrival_seq long, graded_at timestamp_ntz, rating string"


def at(day, hour=10):
    return dt.datetime(2024, 1, day, hour)


def attempts(spark, days, rating="good"):
    return spark.createDataFrame([(1, 5, i, at(d), rating) for i, d in enumerate(days)], ATTEMPT)


@pytest.mark.parametrize(
    "days, longest, current",
    [
        ([29, 30, 31], 3, 3),
        ([28, 29, 30], 3, 3),  # yesterday still counts
        ([27, 28, 29], 3, 0),
        ([1, 2, 3, 4, 10, 31], 4, 1),
        ([31, 31, 30], 2, 2),
        ([5], 1, 0),
    ],
)
def test_streaks(spark, days, longest, current):
    row = P.streaks(attempts(spark, days), "2024-01-31").first()
    assert (row.longest_streak, row.current_streak) == (longest, current)


def test_grid_ends_before_the_current_week(spark):
    grid = P.activity_grid(attempts(spark, [31]), "2024-01-31")
    row = grid.agg(F.min("day"), F.max("day"), F.count("*"), F.max("n_attempts")).first()
    assert tuple(row) == (dt.date(2023, 1, 30), dt.date(2024, 1, 28), 364, 0)
    assert grid.filter("weekday = 0").count() == 52


def test_mastery_counts_each_sequence_once(spark):
    rows = [(1, 1, 0, at(1), "hard"), (1, 1, 1, at(2), "good"), (1, 1, 2, at(3), "easy"), (1, 2, 3, at(3), "easy"), (1, 3, 4, at(3), "good"), (1, 4, 5, at(3), "good")]
    seqs = spark.createDataFrame([(1, 1), (2, 6), (3, None), (4, 9)], "sequence_id int, level int")
    got = P.cumulative_mastery(spark.createDataFrame(rows, ATTEMPT), seqs, "2024-01-05").orderBy("day").collect()
    assert [(r.level_1, r.level_6, r.total) for r in got] == [(0, 0, 0), (1, 0, 1), (1, 1, 2), (1, 1, 2), (1, 1, 2)]


def replay(events):
    tracked, count, last = {}, {}, {}
    for pair, seq, kind, when, rating in events:
        if kind == "toggle":
            tracked[pair] = not tracked.get(pair, False)
        else:
            tracked[pair], last[pair] = True, (when, rating)
            count[pair] = count.get(pair, 0) + 1
    return {p: (tracked[p], count.get(p, 0), *last.get(p, (None, None))) for p in tracked}


def test_progress_replays_toggles_in_arrival_order(spark):
    rng = random.Random(8)
    events = []
    for seq in range(400):
        kind = rng.choice(["toggle", "attempt", "toggle"])
        events.append(((rng.randint(1, 3), rng.randint(1, 9)), seq, kind, at(rng.randint(1, 30)), rng.choice(P.RATINGS)))
    log = spark.createDataFrame([(*p, s, w, r) for p, s, k, w, r in events if k == "attempt"], ATTEMPT)
    toggles = spark.createDataFrame([(*p, s) for p, s, k, _, _ in events if k == "toggle"], "learner_id long, sequence_id int, arrival_seq long")
    got = {(r.learner_id, r.sequence_id): (r.tracked, r.attempt_count, r.last_attempt_at, r.last_rating) for r in P.progress_state(log, toggles).collect()}
    assert got == replay(events)


def test_retention_follows_arrival(spark):
    log = attempts(spark, [30 - i % 20 for i in range(60)])
    kept = P.retain_latest(log, 50)
    assert sorted(r.arrival_seq for r in kept.collect()) == list(range(10, 60))


def candidates(spark):
    rows = [(1, 1, None, None), (1, 2, "hard", at(31)), (1, 3, "easy", at(21)), (1, 4, "almost", at(30, 9)), (1, 5, "good", at(29)), (1, 6, "hard", at(11))]
    return spark.createDataFrame(rows, "learner_id long, sequence_id int, last_rating string, last_attempt_at timestamp_ntz")


def test_priorities(spark):
    got = {r.sequence_id: round(r.priority, 6) for r in S.rank_sequences(candidates(spark), "2024-01-31 10:00:00").collect()}
    assert got == {1: 100.0, 2: 50.0, 3: 20.0, 4: 25.0, 5: 25.0, 6: 97.5}


def test_next_pick_is_among_the_best(spark):
    exclude = spark.createDataFrame([(1, 1)], "learner_id long, sequence_id int")
    picks = {S.select_next(candidates(spark), "2024-01-31 10:00:00", seed, 2, exclude).first().sequence_id for seed in range(8)}
    assert picks == {6, 2}


def test_queue_against_brute_force(spark):
    rng = random.Random(4)
    seqs = [(i, 1 + i % 2) for i in range(60)]
    progress = [(learner, i, rng.choice([*P.RATINGS, None])) for learner in (1, 2, 3) for i in range(60) if rng.random() < (0.2, 0.9, 1.0)[learner - 1]]
    learners = spark.createDataFrame([(1,), (2,), (3,), (4,)], "learner_id long")
    got = S.practice_queue(
        learners,
        spark.createDataFrame(seqs, "sequence_id int, level int"),
        spark.createDataFrame(progress, "learner_id long, sequence_id int, last_rating string"),
        2,
    ).collect()
    order = {None: 0, "hard": 1, "almost": 2, "good": 3, "easy": 4}
    for learner in (1, 2, 3, 4):
        rated = {s: r for k, s, r in progress if k == learner}
        want = sorted((order[rated.get(i)], i) for i, level in seqs if level == 2)[:10]
        mine = sorted((r.place, getattr(r, "class"), r.sequence_id) for r in got if r.learner_id == learner)
        assert [(c, s) for _, c, s in mine] == want


def test_level_pick(spark):
    seqs = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 2)], "sequence_id int, level int")
    rows = [(k, 1, 2) for k in range(30)] + [(100, 2, 9), (101, 5, 1), (102, 1, 9)]
    got = {r.learner_id: r.sequence_id for r in S.pick_by_level(spark.createDataFrame(rows, "learner_id long, level int, current_id int"), seqs, 1).collect()}
    assert {got[k] for k in range(30)} == {1, 3}
    assert (got[100], got[101]) == (9, None) and got[102] in {1, 2, 3}


def test_browse_puts_missing_levels_last(spark):
    seqs = spark.createDataFrame([(1, None, "a"), (2, 3, "b"), (3, 1, "z"), (4, 1, "c")], "sequence_id int, level int, text string")
    assert [r.sequence_id for r in S.browse(seqs).collect()] == [4, 3, 2, 1]
    assert [r.sequence_id for r in S.browse(seqs, [1]).collect()] == [4, 3]
