"""Grading and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotide.functions import bands as B
from lingotide.operators import metrics as M
from lingotide.operators import scoring as SC
from lingotide.plans.registry import query
from lingotide.plans.views import Views


@query(
    "prj11_bands",
    """
SELECT scorer, utt_id, idx, CASE WHEN confidence >= 0.6E0 THEN 'easy' WHEN confidence >= 0.4E0 THEN 'good' WHEN confidence >= 0.2E0 THEN 'almost' ELSE 'bad' END AS grade_band,
  CASE WHEN confidence * 100 >= 80 THEN 'good' WHEN confidence * 100 >= 50 THEN 'almost' ELSE 'bad' END AS score_band,
  CASE WHEN confidence > 0.75E0 THEN 4 WHEN confidence > 0.5E0 THEN 3 WHEN confidence > 0.25E0 THEN 2 WHEN confidence > 0 THEN 1 ELSE 0 END AS heat FROM predictions""",
)
def prj11(v: Views):
    c = F.col("confidence")
    return v.predictions.select(
        "scorer", "utt_id", "idx", B.grade_band(c).alias("grade_band"), B.score_band(c * 100).alias("score_band"), B.heat_level(c).alias("heat")
    )


@query(
    "prj12_combined_score",
    """
SELECT scorer, utt_id, idx, round(coalesce(CASE WHEN predicted <> 3 THEN confidence END, 0.0E0) * 0.7E0
  + coalesce(CASE WHEN expected <> 2 THEN 1 - confidence END, 1.0E0) * 0.3E0, 6) AS score FROM predictions""",
)
def prj12(v: Views):
    syllable = F.when(F.col("predicted") != 3, F.col("confidence"))
    tone = F.when(F.col("expected") != 2, 1 - F.col("confidence"))
    return v.predictions.select("scorer", "utt_id", "idx", F.round(B.combined_score(syllable, tone), 6).alias("score"))


MATRIX_SQL = """
counts AS (SELECT scorer, expected, predicted, count(*) AS n FROM predictions GROUP BY 1, 2, 3),
matrix AS (SELECT s.scorer, CAST(e AS INT) AS expected, CAST(p AS INT) AS predicted, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT scorer FROM counts) s CROSS JOIN range(5) a(e) CROSS JOIN range(5) b(p)
  LEFT JOIN counts c ON c.scorer = s.scorer AND c.expected = e AND c.predicted = p)"""


@query("agg11_confusion_matrix", f"WITH {MATRIX_SQL} SELECT * FROM matrix")
def agg11(v: Views):
    return M.confusion_matrix(v.predictions)


@query(
    "snk6_benchmark_report",
    f"WITH {MATRIX_SQL} SELECT scorer, expected, {', '.join(f'CAST(sum(n) FILTER (predicted = {t}) AS BIGINT) AS predicted_{t}' for t in range(5))} FROM matrix GROUP BY 1, 2",
)
def snk6_benchmark(v: Views):
    return M.confusion_report(v.predictions)


ACCURACY_SQL = f"""{MATRIX_SQL},
acc AS (
  SELECT scorer, expected AS tone, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (expected = predicted) AS BIGINT) AS correct FROM matrix GROUP BY 1, 2
  UNION ALL SELECT scorer, NULL, CAST(sum(n) AS BIGINT), CAST(sum(n) FILTER (expected = predicted) AS BIGINT) FROM matrix GROUP BY 1)"""


@query("agg12_accuracy", f"WITH {ACCURACY_SQL} SELECT *, round(correct / greatest(n, 1), 6) AS accuracy FROM acc")
def agg12(v: Views):
    return M.accuracy(v.predictions).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "agg13_top_confusions",
    """SELECT expected, predicted, count(*) AS n FROM predictions WHERE expected <> predicted GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5""",
)
def agg13(v: Views):
    return M.top_confusions(v.predictions)


SCORES_SQL = f"""
scored AS (SELECT *, CASE WHEN expected = predicted THEN 0.7E0 + 0.3E0 * confidence ELSE greatest(0, 0.4E0 * (1 -
  CASE expected * 10 + predicted {' '.join(f'WHEN {e * 10 + p} THEN {x}E0' for (e, p), x in SC.CONFUSION_PENALTIES.items())} ELSE 0.5E0 END) * confidence) END AS tone_score FROM predictions),
syl AS (SELECT *, 0.7E0 * tone_score + 0.3E0 * 0.7E0 AS overall FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scorer, utt_id ORDER BY overall) AS rk, count(*) OVER (PARTITION BY scorer, utt_id) AS n FROM syl),
weighted AS (SELECT *, CASE WHEN rk <= greatest(1, floor(n * 0.3E0)) THEN 1.5E0 ELSE 1.0E0 END AS w FROM ranked),
sentence AS (SELECT scorer, utt_id, count(*) AS n_syllables, sum(overall * w) / sum(w) * 100 AS score FROM weighted GROUP BY 1, 2)"""


@query("scr1_tone_score", f"WITH {SCORES_SQL} SELECT scorer, utt_id, idx, round(tone_score, 6) AS tone_score FROM syl")
def scr1(v: Views):
    score = SC.tone_score(F.col("expected"), F.col("predicted"), F.col("confidence"))
    return v.predictions.select("scorer", "utt_id", "idx", F.round(score, 6).alias("tone_score"))


@query(
    "scr2_syllable_scores",
    f"""WITH {SCORES_SQL} SELECT scorer, utt_id, idx, round(overall, 6) AS overall,
  CASE WHEN expected <> predicted THEN concat('tone_', predicted, '_vs_', expected) END AS tag FROM syl""",
)
def scr2(v: Views):
    return SC.syllable_scores(v.predictions).select("scorer", "utt_id", "idx", F.round("overall", 6).alias("overall"), "tag")


@query(
    "scr2_placeholder_scores",
    "SELECT scorer, utt_id, count(*) AS n, 50.0E0 AS overall FROM predictions GROUP BY 1, 2",
)
def scr2_placeholder(v: Views):
    return SC.placeholder_scores(v.predictions, ["scorer", "utt_id"]).withColumn("overall", F.round("overall", 6))


@query("agg21_sentence_score", f"WITH {SCORES_SQL} SELECT scorer, utt_id, n_syllables, round(score, 6) AS score FROM sentence")
def agg21(v: Views):
    scored = SC.syllable_scores(v.predictions)
    return SC.sentence_score(scored, ["scorer", "utt_id"]).withColumn("score", F.round("score", 6))


@query(
    "agg14_scorer_summary",
    f"""WITH {ACCURACY_SQL}, {SCORES_SQL.strip()},
a AS (SELECT scorer, correct / greatest(n, 1) AS accuracy FROM acc WHERE tone IS NULL),
f AS (SELECT scorer, CASE WHEN score >= 40 THEN score END AS score FROM sentence),
s AS (SELECT scorer, avg(score) AS mean_score, stddev_pop(score) AS std_score, count(*) - count(score) AS n_errors FROM f GROUP BY 1)
SELECT scorer, round(accuracy, 6) AS accuracy, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, n_errors,
  row_number() OVER (ORDER BY accuracy DESC, scorer) = 1 AS is_best FROM a JOIN s USING (scorer)""",
)
def agg14(v: Views):
    scores = SC.sentence_score(SC.syllable_scores(v.predictions), ["scorer", "utt_id"])
    # sentences below 40 stand for failed ones
    scores = scores.select("scorer", F.when(F.col("score") >= 40, F.col("score")).alias("score"))
    out = M.scorer_summary(v.predictions, scores)
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "mean_score", "std_score")})


@query(
    "agg22_sentence_grade",
    "SELECT scorer, utt_id, CAST(round(avg(confidence) * 100) AS INT) AS grade FROM predictions GROUP BY 1, 2",
)
def agg22(v: Views):
    return SC.sentence_grade(v.predictions, ["scorer", "utt_id"], "confidence")


@query(
    "agg17_position_accuracy",
    """
WITH p AS (SELECT scorer AS test_set, idx, count(*) AS n, avg(CASE WHEN confidence > 0.5E0 THEN 1.0E0 ELSE 0.0E0 END) AS accuracy FROM predictions GROUP BY 1, 2)
SELECT test_set, idx, n, round(accuracy, 6) AS accuracy, round(var_pop(accuracy) OVER (PARTITION BY test_set), 6) AS spread FROM p""",
)
def agg17(v: Views):
    scores = v.predictions.select(F.col("scorer").alias("test_set"), "idx", F.col("confidence").alias("score"))
    return M.position_accuracy(scores).withColumns({c: F.round(c, 6) for c in ("accuracy", "spread")})


def _ranked(v: Views):
    return SC.target_ranks(SC.with_probs(v.logits))


RANK_SQL = """
ranked AS (SELECT p.utt_id, p.frame, p.target, p.prob AS target_prob,
  1 + (SELECT count(*) FROM probs q WHERE q.utt_id = p.utt_id AND q.frame = p.frame AND q.prob > p.prob) AS target_rank FROM probs p WHERE p.token = p.target)"""


@query("agg24_softmax", "SELECT utt_id, frame, token, round(prob, 6) AS prob FROM probs")
def agg24(v: Views):
    probs = SC.with_probs(v.logits).select("utt_id", "frame", F.posexplode("probs").alias("token", "prob"))
    return probs.withColumn("prob", F.round("prob", 6))


@query("agg24_argmax", "SELECT utt_id, frame, token AS best FROM probs QUALIFY row_number() OVER (PARTITION BY utt_id, frame ORDER BY prob DESC, token) = 1")
def agg24_argmax(v: Views):
    return SC.with_probs(v.logits).select("utt_id", "frame", SC.argmax(F.col("probs")).alias("best"))


@query("win11_target_rank", f"WITH {RANK_SQL} SELECT utt_id, frame, target, round(target_prob, 6) AS target_prob, CAST(target_rank AS INT) AS target_rank FROM ranked")
def win11(v: Views):
    return _ranked(v).select("utt_id", "frame", "target", F.round("target_prob", 6).alias("target_prob"), "target_rank")


@query(
    "agg15_topk_accuracy",
    f"WITH {RANK_SQL} SELECT CAST(k AS INT) AS k, count(*) AS n, round(avg(CASE WHEN target_rank <= k THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy FROM ranked, (VALUES (1), (2), (5), (10)) t(k) GROUP BY 1",
)
def agg15(v: Views):
    return M.topk_accuracy(_ranked(v)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "agg16_prob_metrics",
    f"""WITH {RANK_SQL} SELECT count(*) AS n, round(avg(target_prob), 6) AS mean_prob, round(median(target_prob), 6) AS median_prob,
  {', '.join(f'round(avg(CASE WHEN target_prob >= {t}E0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS above_{int(t * 100)}' for t in M.THRESHOLDS)} FROM ranked""",
)
def agg16(v: Views):
    out = M.prob_metrics(_ranked(v))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "n"})


@query(
    "agg16_class_mean_prob",
    f"WITH {RANK_SQL} SELECT CAST(c AS INT) AS class, count(target_prob) AS n, round(coalesce(avg(target_prob), 0), 6) AS mean_prob FROM range(12) r(c) LEFT JOIN ranked ON target = c GROUP BY 1",
)
def agg16_class(v: Views):
    return M.class_mean_prob(_ranked(v), "target", range(12)).withColumn("mean_prob", F.round("mean_prob", 6))


@query(
    "srt6_worst_predictions",
    f"WITH {RANK_SQL} SELECT utt_id, frame, target, round(target_prob, 6) AS target_prob FROM ranked ORDER BY ranked.target_prob, utt_id, frame LIMIT 10",
)
def srt6(v: Views):
    worst = M.worst_predictions(_ranked(v), ["utt_id", "frame"])
    return worst.select("utt_id", "frame", "target", F.round("target_prob", 6).alias("target_prob"))


DECODE_SQL = """
starts AS (SELECT utt_id, frame_idx, token, prob FROM (SELECT *, lag(token) OVER (PARTITION BY utt_id ORDER BY frame_idx) AS previous FROM frames)
  WHERE (previous IS NULL OR previous <> token) AND token <> 0)"""


@query(
    "win9_ctc_decode",
    f"WITH {DECODE_SQL} SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY frame_idx) - 1 AS pos, token FROM starts",
)
def win9(v: Views):
    return SC.ctc_decode(v.frame_table, "utt_id").select("utt_id", "pos", "token")


@query(
    "win10_ctc_decode_probs",
    f"WITH {DECODE_SQL} SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY frame_idx) - 1 AS pos, frame_idx, token, prob FROM starts",
)
def win10(v: Views):
    return SC.ctc_decode(v.frame_table, "utt_id").select("utt_id", "pos", "frame_idx", "token", "prob")


def _targets(v: Views):
    return v.logits.select("utt_id", F.col("frame").alias("pos"), F.col("target").alias("token"))


@query(
    "arr6_score_targets",
    """
WITH best AS (SELECT utt_id, token, max(prob) AS score FROM probs GROUP BY 1, 2)
SELECT t.utt_id, t.frame AS pos, t.target AS token, round(score, 6) AS score FROM (SELECT DISTINCT utt_id, frame, target FROM logits) t
JOIN best b ON b.utt_id = t.utt_id AND b.token = t.target""",
)
def arr6(v: Views):
    scored = SC.score_targets(_targets(v), SC.with_probs(v.logits), "utt_id")
    return scored.select("utt_id", "pos", "token", F.round("score", 6).alias("score"))


# monotone search over tp(utt_id, pos, ps): per target the probabilities of its token, frame by frame
ALIGNED_SQL = """
ask AS (SELECT utt_id, list(ps ORDER BY pos) AS ps, count(*) AS n, any_value(len(ps)) AS t FROM tp GROUP BY 1),
walk(utt_id, i, m, score) AS (
  SELECT utt_id, 0::BIGINT, 0::BIGINT, NULL::DOUBLE FROM ask
  UNION ALL
  SELECT utt_id, i + 1, m + greatest(1, coalesce(list_position(w, best), 1)), best FROM (
    SELECT utt_id, i, m, w, greatest(0, coalesce(list_max(w), 0)) AS best FROM (
      SELECT walk.utt_id, i, m, ps[i + 1][m + 1:greatest(m + 1, least(t, m + (t - m) // greatest(1, n - i)))] AS w
      FROM walk JOIN ask ON ask.utt_id = walk.utt_id WHERE i < n)))"""


@query(
    "arr7_score_aligned",
    f"""WITH RECURSIVE tp AS (SELECT t.utt_id, t.pos, list(p.prob ORDER BY p.frame) AS ps FROM (SELECT DISTINCT utt_id, frame AS pos, target FROM logits) t
  JOIN probs p ON p.utt_id = t.utt_id AND p.token = t.target GROUP BY 1, 2),
{ALIGNED_SQL.strip()}
SELECT utt_id, CAST(i - 1 AS INT) AS pos, round(score, 6) AS score FROM walk WHERE i > 0""",
)
def arr7(v: Views):
    scored = SC.score_aligned(_targets(v), SC.with_probs(v.logits), "utt_id")
    return scored.select("utt_id", "pos", F.round("score", 6).alias("score"))


@query(
    "arr5_map_to_characters",
    """
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS s, CAST(1 + vec_id % 100 AS INT) AS n_chars FROM embeddings),
c AS (SELECT id, s, n_chars, len(s) AS n, unnest(range(n_chars)) AS i FROM e)
SELECT id, CAST(i AS INT) AS char_idx, round(CASE WHEN n_chars > n THEN s[i * n // n_chars + 1] ELSE s[i + 1] END, 6) AS score FROM c""",
)
def arr5(v: Views):
    rows = v.contours.withColumn("scores", F.transform("f0_norm", lambda x: F.abs(x)))
    n_chars = F.col("id").cast("int") % 100 + 1
    spread = rows.select("id", F.posexplode(SC.map_to_characters(F.col("scores"), n_chars)).alias("char_idx", "score"))
    return spread.withColumn("score", F.round("score", 6))
