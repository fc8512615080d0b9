import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lingotide.functions.bands import combined_score
from lingotide.operators import metrics as M
from lingotide.operators import scoring as SC
from lingotide.plans.q_metrics import ALIGNED_SQL


@pytest.mark.parametrize(
    "logits, want",
    [
        ([1.0, 2.0, 3.0], [0.09003057, 0.24472848, 0.66524094]),
        ([1.0, 1.0, 1.0], [1 / 3] * 3),
        ([100.0, 200.0, 300.0], [0.0, 0.0, 1.0]),
        ([-1.0, 0.0, 1.0], [0.09003057, 0.24472848, 0.66524094]),
    ],
)
def test_softmax(spark, logits, want):
    row = spark.createDataFrame([(logits,)], "l array<double>").select(SC.softmax(F.col("l")).alias("p")).first()
    assert np.allclose(row.p, want, atol=1e-7)


@pytest.mark.parametrize(
    "scores, n, want",
    [
        ([0.9, 0.8, 0.7], 3, [0.9, 0.8, 0.7]),
        ([0.9, 0.7], 4, [0.9, 0.9, 0.7, 0.7]),
        ([0.9, 0.8, 0.7, 0.6], 2, [0.9, 0.8]),
        ([], 3, [0.0, 0.0, 0.0]),
        ([0.9, 0.8, 0.7], 5, [0.9, 0.9, 0.8, 0.8, 0.7]),
        ([0.9], 0, []),
    ],
)
def test_map_to_characters(spark, scores, n, want):
    df = spark.createDataFrame([(scores, n)], "s array<double>, n int")
    assert df.select(SC.map_to_characters(F.col("s"), F.col("n"))).first()[0] == want


@pytest.mark.parametrize("syl, tone, want", [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.7), (0.0, 1.0, 0.3), (0.8, 0.6, 0.74), (None, None, 0.3)])
def test_combined_score(spark, syl, tone, want):
    df = spark.createDataFrame([(syl, tone)], "s double, t double")
    assert abs(df.select(combined_score(F.col("s"), F.col("t"))).first()[0] - want) < 1e-9


def aligned_by_sql(probs, targets):
    """The recursive SQL of the query, over one utterance."""
    con = duckdb.connect()
    tp = pd.DataFrame({"utt_id": 7, "pos": range(len(targets)), "ps": [[float(p[t]) for p in probs] for t in targets]})
    con.register("tp", tp)
    return [r[0] for r in con.execute(f"WITH RECURSIVE {ALIGNED_SQL.strip()} SELECT score FROM walk WHERE i > 0 ORDER BY i").fetchall()]


@pytest.mark.parametrize("n_frames, n_vocab, targets", [(20, 10, [1, 3, 5, 7]), (10, 20, [1, 2, 3, 4, 5, 6, 7, 8]), (3, 5, [1, 2, 1, 2, 1]), (1, 4, [2]), (50, 6, [5, 5, 5])])
def test_aligned_scores(spark, n_frames, n_vocab, targets):
    probs = np.random.default_rng(n_frames).dirichlet(np.ones(n_vocab), n_frames)
    frames = spark.createDataFrame([(7, i, p.tolist()) for i, p in enumerate(probs)], "utt_id long, frame int, probs array<double>")
    wanted = spark.createDataFrame([(7, i, t) for i, t in enumerate(targets)], "utt_id long, pos int, token int")
    got = [r.score for r in SC.score_aligned(wanted, frames, "utt_id").orderBy("pos").collect()]
    assert np.allclose(got, aligned_by_sql(probs, targets))


def test_aligned_scores_of_many_utterances_and_a_long_one(spark):
    rng = np.random.default_rng(31)
    sizes = {f"u{k}": (int(rng.integers(1, 40)), int(rng.integers(1, 12))) for k in range(60)} | {"half an hour": (45_000, 900)}
    probs = {u: rng.integers(0, 50, (t, 4)) / 50 for u, (t, _) in sizes.items()}
    tokens = {u: rng.integers(0, 4, n).tolist() for u, (_, n) in sizes.items()}
    frames = pd.DataFrame([(u, f, row.tolist()) for u, ps in probs.items() for f, row in enumerate(ps)], columns=["utt_id", "frame", "probs"])
    wanted = pd.DataFrame([(u, p, t) for u, ts in tokens.items() for p, t in enumerate(ts)], columns=["utt_id", "pos", "token"])
    got = SC.score_aligned(
        spark.createDataFrame(wanted, "utt_id string, pos int, token int"),
        # in many batches, so that windows lie across them
        spark.createDataFrame(frames.sample(frac=1, random_state=1), "utt_id string, frame int, probs array<double>"),
        "utt_id",
    ).toPandas()
    for u in sizes:
        assert np.allclose(got[got["utt_id"] == u].sort_values("pos")["score"], aligned_by_sql(probs[u], tokens[u]))
    no_frames = spark.createDataFrame([("x", 0, 1)], "utt_id string, pos int, token int")
    assert SC.score_aligned(no_frames, spark.createDataFrame(frames[:5], "utt_id string, frame int, probs array<double>"), "utt_id").count() == 0


def test_decoding_across_blocks(spark):
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 3, 200)
    probs = rng.random(200).round(3)
    df = spark.createDataFrame([(1, i, int(t), float(p)) for i, (t, p) in enumerate(zip(tokens, probs))], "utt_id long, frame_idx int, token int, prob double")
    starts = [i for i in range(200) if (i == 0 or tokens[i] != tokens[i - 1]) and tokens[i] != 0]
    got = SC.ctc_decode(df, "utt_id", block=8).orderBy("pos").collect()
    assert [(r.pos, r.frame_idx, r.token, r.prob) for r in got] == [(k, i, tokens[i], probs[i]) for k, i in enumerate(starts)]


def test_sentence_score_weights(spark):
    scores = [0.5, 0.9, 0.1, 0.7, 0.6, 0.3, 0.8]
    df = spark.createDataFrame([(1, s) for s in scores] + [(2, 0.4)], "utt_id long, overall double")
    got = {r.utt_id: r.score for r in SC.sentence_score(df, ["utt_id"]).collect()}
    low = sorted(scores)
    want = (1.5 * sum(low[:2]) + sum(low[2:])) / (3 + 5) * 100
    assert abs(got[1] - want) < 1e-9 and abs(got[2] - 40) < 1e-9


def test_no_targets(spark):
    utts = spark.createDataFrame([(1,), (2,)], "utt_id long")
    scores = spark.createDataFrame([(1, 3, 55.0)], "utt_id long, n_syllables long, score double")
    got = {r.utt_id: (r.score, r.warning) for r in SC.with_empty_sentences(utts, scores, ["utt_id"]).collect()}
    assert got == {1: (55.0, None), 2: (0.0, "no_targets")}


def test_tone_score(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 3, 0.5), (1, 2, 0.5), (3, 4, 0.0)], "e int, p int, c double")
    got = [r[0] for r in df.select(SC.tone_score(F.col("e"), F.col("p"), F.col("c"))).collect()]
    assert np.allclose(got, [0.85, 0.14, 0.1, 0.0])


def test_best_scorer_is_the_first_of_equals(spark):
    pred = spark.createDataFrame([("b", 1, 1), ("a", 1, 1), ("c", 1, 2)], "scorer string, expected int, predicted int")
    scores = spark.createDataFrame([("a", 50.0), ("a", None), ("b", 60.0), ("c", 10.0)], "scorer string, score double")
    got = {r.scorer: (r.is_best, r.n_errors) for r in M.scorer_summary(pred, scores).collect()}
    assert got == {"a": (True, 1), "b": (False, 0), "c": (False, 0)}
