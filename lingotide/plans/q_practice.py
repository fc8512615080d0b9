"""Practice statistics and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotide.functions.draws import draw_sql
from lingotide.operators import practice as P
from lingotide.operators import selection as S
from lingotide.plans.registry import query
from lingotide.plans.views import TODAY, Views

NOW = f"{TODAY} 12:00:00"

PROGRESS_SQL = """
last_attempt AS (
  SELECT learner_id, sequence_id, max(arrival_seq) AS settled, arg_max(graded_at, arrival_seq) AS last_attempt_at,
    arg_max(rating, arrival_seq) AS last_rating, count(*) AS attempt_count
  FROM attempts GROUP BY 1, 2),
flips AS (
  SELECT t.learner_id, t.sequence_id, count(*) FILTER (a.settled IS NULL OR t.arrival_seq > a.settled) AS flips
  FROM toggles t LEFT JOIN last_attempt a USING (learner_id, sequence_id) GROUP BY 1, 2),
progress AS (
  SELECT learner_id, sequence_id,
    CASE WHEN settled IS NULL THEN coalesce(flips, 0) % 2 = 1 ELSE coalesce(flips, 0) % 2 = 0 END AS tracked,
    last_attempt_at, coalesce(attempt_count, 0) AS attempt_count, last_rating
  FROM last_attempt FULL JOIN flips USING (learner_id, sequence_id))"""


def _progress(v: Views):
    return P.progress_state(v.attempts, v.toggles)


@query(
    "agg1_practice_totals",
    """
SELECT learner_id, count(*) AS n_attempts, count(*) FILTER (rating = 'hard') AS n_hard, count(*) FILTER (rating = 'almost') AS n_almost,
  count(*) FILTER (rating = 'good') AS n_good, count(*) FILTER (rating = 'easy') AS n_easy, max(CAST(graded_at AS DATE)) AS last_practice
FROM attempts GROUP BY 1""",
)
def agg1(v: Views):
    return P.practice_totals(v.attempts)


@query(
    "agg2_daily_attempts",
    "SELECT learner_id, CAST(graded_at AS DATE) AS day, count(*) AS n_attempts FROM attempts GROUP BY 1, 2",
)
def agg2(v: Views):
    return P.daily_attempts(v.attempts)


@query(
    "agg3_sequences_practised",
    f"WITH {PROGRESS_SQL} SELECT learner_id, count(*) AS n_sequences FROM progress WHERE tracked AND attempt_count > 0 GROUP BY 1",
)
def agg3(v: Views):
    return P.sequences_practised(_progress(v))


@query(
    "agg4_weekly_attempts",
    f"""SELECT learner_id, count(*) AS n_attempts FROM attempts
WHERE CAST(graded_at AS DATE) >= date_trunc('week', DATE '{TODAY}') GROUP BY 1""",
)
def agg4(v: Views):
    return P.weekly_attempts(v.attempts, TODAY)


@query(
    "agg5_activity_grid",
    f"""
WITH daily AS (SELECT learner_id, CAST(graded_at AS DATE) AS day, count(*) AS n FROM attempts GROUP BY 1, 2),
busiest AS (SELECT learner_id, max(n) AS busiest FROM daily GROUP BY 1),
grid AS (SELECT learner_id, busiest, CAST(date_trunc('week', DATE '{TODAY}' - 364) AS DATE) + CAST(i AS INT) AS day
         FROM busiest, range(364) r(i))
SELECT learner_id, day, CAST(isodow(day) - 1 AS INT) AS weekday, coalesce(n, 0) AS n_attempts,
  CASE WHEN coalesce(n, 0) / busiest > 0.75 THEN 4 WHEN coalesce(n, 0) / busiest > 0.5 THEN 3
       WHEN coalesce(n, 0) / busiest > 0.25 THEN 2 WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS heat,
  day > DATE '{TODAY}' AS is_future
FROM grid LEFT JOIN daily USING (learner_id, day)""",
)
def agg5(v: Views):
    return P.activity_grid(v.attempts, TODAY)


@query(
    "win4_streaks",
    f"""
WITH days AS (SELECT DISTINCT learner_id, CAST(graded_at AS DATE) AS day FROM attempts),
islands AS (SELECT learner_id, count(*) AS length, max(day) AS last_day FROM (
  SELECT *, day - CAST(row_number() OVER (PARTITION BY learner_id ORDER BY day) AS INT) AS island FROM days) GROUP BY learner_id, island)
SELECT learner_id, max(length) AS longest_streak,
  CASE WHEN DATE '{TODAY}' - max(last_day) <= 1 THEN arg_max(length, last_day) ELSE 0 END AS current_streak
FROM islands GROUP BY 1""",
)
def win4(v: Views):
    return P.streaks(v.attempts, TODAY)


@query(
    "win5_cumulative_mastery",
    f"""
WITH firsts AS (
  SELECT learner_id, sequence_id, level, min(CAST(graded_at AS DATE)) AS day FROM attempts JOIN sequences USING (sequence_id)
  WHERE rating IN ('good', 'easy') AND level BETWEEN 1 AND 6 GROUP BY 1, 2, 3),
calendar AS (
  SELECT learner_id, CAST(unnest(generate_series(min(CAST(graded_at AS DATE)), DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day
  FROM attempts GROUP BY 1)
SELECT c.learner_id, c.day, {', '.join(f'count(f.day) FILTER (level = {k}) AS level_{k}' for k in range(1, 7))}, count(f.day) AS total
FROM calendar c LEFT JOIN firsts f ON f.learner_id = c.learner_id AND f.day <= c.day GROUP BY 1, 2""",
)
def win5(v: Views):
    return P.cumulative_mastery(v.attempts, v.sequences, TODAY)


@query(
    "win1_retain_latest",
    """
SELECT attempt_id, arrival_seq, learner_id, sequence_id, graded_at, rating FROM attempts
QUALIFY row_number() OVER (PARTITION BY learner_id, sequence_id ORDER BY arrival_seq DESC) <= 50""",
)
def win1(v: Views):
    return P.retain_latest(v.attempts)


@query("win2_progress_state", f"WITH {PROGRESS_SQL} SELECT * FROM progress")
def win2(v: Views):
    return _progress(v)


@query(
    "win2_progress_with_sets",
    """
WITH ev AS (
  SELECT learner_id, sequence_id, arrival_seq, true AS sets, NULL::BOOLEAN AS flips FROM attempts WHERE rating <> 'easy'
  UNION ALL SELECT learner_id, sequence_id, arrival_seq, arrival_seq % 3 > 0, NULL FROM attempts WHERE rating = 'easy'
  UNION ALL SELECT learner_id, sequence_id, arrival_seq, NULL, true FROM toggles),
s AS (SELECT learner_id, sequence_id, max(arrival_seq) FILTER (sets IS NOT NULL) AS settled, arg_max(sets, arrival_seq) FILTER (sets IS NOT NULL) AS base FROM ev GROUP BY 1, 2),
f AS (SELECT ev.learner_id, ev.sequence_id, count(*) FILTER (flips AND (settled IS NULL OR arrival_seq > settled)) AS n FROM ev JOIN s USING (learner_id, sequence_id) GROUP BY 1, 2)
SELECT s.learner_id, s.sequence_id, coalesce(base, false) <> (n % 2 = 1) AS tracked FROM s JOIN f USING (learner_id, sequence_id)""",
)
def win2_sets(v: Views):
    """Attempts rated easy are read as set events, the others as attempts."""
    sets = v.attempts.filter("rating = 'easy'").select(*P.PAIR, "arrival_seq", (F.col("arrival_seq") % 3 > 0).alias("tracked"))
    return P.progress_state(v.attempts.filter("rating <> 'easy'"), v.toggles, sets).select(*P.PAIR, "tracked")


@query(
    "win3_recent_attempts",
    """
SELECT learner_id, sequence_id, attempt_id, rating, recency FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY learner_id, sequence_id ORDER BY arrival_seq DESC) AS INT) AS recency FROM attempts)
WHERE recency <= 3""",
)
def win3(v: Views):
    return P.recent_attempts(v.attempts, 3).select("learner_id", "sequence_id", "attempt_id", "rating", "recency")


@query(
    "win20_latest_recording",
    """
SELECT learner_id, sequence_id, attempt_id, graded_at FROM attempts
QUALIFY row_number() OVER (PARTITION BY learner_id, sequence_id ORDER BY graded_at DESC, attempt_id DESC) = 1""",
)
def win20(v: Views):
    recordings = v.attempts.select("learner_id", "sequence_id", "attempt_id", "graded_at")
    return P.latest_recording(recordings, P.PAIR, "graded_at", "attempt_id")


@query(
    "jn1_with_progress",
    f"""
WITH {PROGRESS_SQL}
SELECT p.learner_id, p.sequence_id, s.text, s.level, coalesce(g.tracked, false) AS tracked, coalesce(g.attempt_count, 0) AS attempt_count,
  g.last_attempt_at, g.last_rating
FROM pairs p JOIN sequences s USING (sequence_id) LEFT JOIN progress g ON g.learner_id = p.learner_id AND g.sequence_id = p.sequence_id""",
)
def jn1(v: Views):
    return P.with_progress(v.pairs, v.sequences, _progress(v)).select(
        "learner_id", "sequence_id", "text", "level", "tracked", "attempt_count", "last_attempt_at", "last_rating"
    )


@query(
    "src13_progress_map",
    """
SELECT p.learner_id, p.sequence_id, count(a.attempt_id) > 0 AS tracked, arg_max(a.graded_at, a.arrival_seq) AS last_attempt_at,
  count(a.attempt_id) AS attempt_count, arg_max(a.rating, a.arrival_seq) AS last_rating
FROM pairs p LEFT JOIN attempts a USING (learner_id, sequence_id) GROUP BY 1, 2""",
)
def src13(v: Views):
    return P.progress_map(v.pairs, v.attempts)


@query(
    "jn11_tracked_sequences",
    f"WITH {PROGRESS_SQL} SELECT learner_id, sequence_id, text, level, last_rating FROM progress JOIN sequences USING (sequence_id) WHERE tracked",
)
def jn11(v: Views):
    return S.tracked_sequences(_progress(v), v.sequences).select("learner_id", "sequence_id", "text", "level", "last_rating")


PRIORITY_SQL = f"""
CASE last_rating WHEN 'hard' THEN 100.0E0 WHEN 'almost' THEN 75.0E0 WHEN 'good' THEN 50.0E0 WHEN 'easy' THEN 25.0E0 ELSE 100.0E0 END
 - CASE WHEN last_attempt_at IS NULL THEN 0.0E0
        WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_attempt_at)) // 86400000000 < 1 THEN 50.0E0
        ELSE 50.0E0 / ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_attempt_at)) // 86400000000) END"""


def _candidates(v: Views):
    return v.pairs.join(_progress(v), P.PAIR, "left")


@query(
    "srt1_rank_sequences",
    f"""
WITH {PROGRESS_SQL}
SELECT p.learner_id, p.sequence_id, last_rating, round({PRIORITY_SQL}, 6) AS priority
FROM pairs p LEFT JOIN progress g ON g.learner_id = p.learner_id AND g.sequence_id = p.sequence_id""",
)
def srt1(v: Views):
    ranked = S.rank_sequences(_candidates(v), NOW)
    return ranked.select("learner_id", "sequence_id", "last_rating", F.round("priority", 6).alias("priority"))


def _current(v: Views):
    """The sequence each learner practised last."""
    return v.attempts.groupBy("learner_id").agg(F.max_by("sequence_id", "arrival_seq").alias("sequence_id"))


@query(
    "srt2_top_candidates",
    f"""
WITH {PROGRESS_SQL},
cur AS (SELECT learner_id, arg_max(sequence_id, arrival_seq) AS sequence_id FROM attempts GROUP BY 1),
ranked AS (SELECT learner_id, sequence_id, {PRIORITY_SQL} AS priority FROM progress WHERE tracked)
SELECT learner_id, sequence_id, round(priority, 6) AS priority,
  CAST(row_number() OVER (PARTITION BY learner_id ORDER BY priority DESC, sequence_id) AS INT) AS place
FROM ranked ANTI JOIN cur USING (learner_id, sequence_id)
QUALIFY place <= 5""",
)
def srt2_top(v: Views):
    tracked = _progress(v).filter("tracked")
    top = S.top_candidates(tracked, NOW, 5, _current(v))
    return top.select("learner_id", "sequence_id", F.round("priority", 6).alias("priority"), "place")


@query(
    "srt2_select_next",
    f"""
WITH {PROGRESS_SQL},
cur AS (SELECT learner_id, arg_max(sequence_id, arrival_seq) AS sequence_id FROM attempts GROUP BY 1),
ranked AS (SELECT learner_id, sequence_id, {PRIORITY_SQL} AS priority FROM progress WHERE tracked),
top AS (SELECT * FROM ranked ANTI JOIN cur USING (learner_id, sequence_id)
  QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY priority DESC, sequence_id) <= 5)
SELECT learner_id, sequence_id, round(priority, 6) AS priority FROM top
QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY {draw_sql(42, "learner_id", "sequence_id")}, sequence_id) = 1""",
)
def srt2(v: Views):
    picked = S.select_next(_progress(v).filter("tracked"), NOW, 42, 5, _current(v))
    return picked.select("learner_id", "sequence_id", F.round("priority", 6).alias("priority"))


QUEUE_SQL = f"""
WITH {PROGRESS_SQL},
queue AS (
  SELECT l.learner_id, s.sequence_id,
    CASE g.last_rating WHEN 'hard' THEN 1 WHEN 'almost' THEN 2 WHEN 'good' THEN 3 WHEN 'easy' THEN 4 ELSE 0 END AS class
  FROM (SELECT DISTINCT learner_id FROM pairs) l CROSS JOIN (SELECT sequence_id FROM sequences WHERE level = 3) s
  LEFT JOIN progress g ON g.learner_id = l.learner_id AND g.sequence_id = s.sequence_id
  QUALIFY row_number() OVER (PARTITION BY l.learner_id ORDER BY class, s.sequence_id) <= 10)"""


def _queue(v: Views):
    learners = v.table("events").select(F.col("user_id").alias("learner_id")).distinct()
    return S.practice_queue(learners, v.sequences, _progress(v), 3, 10)


@query(
    "srt3_practice_queue",
    f"""{QUEUE_SQL}
SELECT learner_id, sequence_id, class, CAST(row_number() OVER (PARTITION BY learner_id ORDER BY class, sequence_id) AS INT) AS place FROM queue""",
)
def srt3(v: Views):
    return _queue(v)


@query(
    "srt3_next_from_queue",
    f"""{QUEUE_SQL},
cur AS (SELECT learner_id, arg_max(sequence_id, arrival_seq) AS current_id FROM attempts GROUP BY 1)
SELECT learner_id, sequence_id FROM queue LEFT JOIN cur USING (learner_id)
QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY coalesce(sequence_id = current_id, false), class, sequence_id) = 1""",
)
def srt3_next(v: Views):
    return S.next_from_queue(_queue(v), _current(v))


@query(
    "srt4_pick_by_level",
    f"""
WITH cur AS (SELECT learner_id, arg_max(sequence_id, arrival_seq) AS current_id FROM attempts GROUP BY 1),
req AS (SELECT learner_id, coalesce(level, 1) AS level, current_id FROM cur JOIN sequences ON sequence_id = current_id),
r AS (SELECT level, sequence_id, row_number() OVER (PARTITION BY level ORDER BY sequence_id) - 1 AS rank, count(*) OVER (PARTITION BY level) AS size
  FROM sequences WHERE level IS NOT NULL),
a AS (SELECT q.*, s.size, h.rank AS here, h.rank IS NOT NULL AND s.size > 1 AS skip FROM req q
  LEFT JOIN (SELECT DISTINCT level, size FROM r) s USING (level) LEFT JOIN r h ON h.level = q.level AND h.sequence_id = q.current_id),
d AS (SELECT *, {draw_sql(42, "learner_id")} % (size - CASE WHEN skip THEN 1 ELSE 0 END) AS n FROM a)
SELECT d.learner_id, d.level, d.current_id, r.sequence_id FROM d
LEFT JOIN r ON r.level = d.level AND r.rank = n + CASE WHEN skip AND n >= here THEN 1 ELSE 0 END""",
)
def srt4(v: Views):
    requests = _current(v).join(v.sequences, "sequence_id").select(
        "learner_id", F.coalesce("level", F.lit(1)).alias("level"), F.col("sequence_id").alias("current_id")
    )
    return S.pick_by_level(requests, v.sequences, 42)


@query(
    "srt5_browse",
    "SELECT sequence_id, level, text FROM sequences WHERE level IN (1, 3, 5) ORDER BY level NULLS LAST, text, sequence_id",
)
def srt5(v: Views):
    return S.browse(v.sequences, [1, 3, 5]).select("sequence_id", "level", "text")
