"""Streams fed file by file end in the state of the batch operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lingotide.operators import practice as P
from lingotide.streaming import daily as D
from lingotide.streaming import events as EV
from lingotide.streaming import progress as PR
from lingotide.streaming.run import run_updates

SCHEMA = "learner_id long, sequence_id int, arrival_seq long, graded_at timestamp, rating string"


def feed(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for seq in range(600):
        hot = rng.random() < 0.4
        when = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 5))
        rows.append((1 if hot else rng.randint(2, 6), 1 if hot else rng.randint(1, 4), seq, when, rng.choice(P.RATINGS)))
    for k in range(4):
        # a batch arrives in any order
        part = rows[k * 150:(k + 1) * 150]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    return stream, spark.createDataFrame(rows, SCHEMA)


def test_progress(spark, tmp_path):
    stream, log = feed(spark, tmp_path)
    updates = run_updates(PR.progress_updates(stream), "progress")
    assert updates.select("batch_id").distinct().count() == 4
    want = P.progress_state(log).select("learner_id", "sequence_id", "tracked", "last_attempt_at", "attempt_count", "last_rating")
    assert sorted(PR.latest(updates).collect()) == sorted(want.collect())


def test_history(spark, tmp_path):
    stream, log = feed(spark, tmp_path)
    got = PR.latest(run_updates(PR.history_updates(stream), "history")).select("learner_id", "sequence_id", F.explode("arrivals").alias("arrival_seq"))
    want = P.retain_latest(log, 50).select("learner_id", "sequence_id", "arrival_seq")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.filter("learner_id = 1 AND sequence_id = 1").count() == 50


def test_daily(spark, tmp_path):
    stream, log = feed(spark, tmp_path)
    got = D.latest_counts(run_updates(D.daily_attempts(stream, "30 days"), "daily"))
    assert sorted(got.collect()) == sorted(P.daily_attempts(log).collect())


EVENTS = "learner_id long, sequence_id int, arrival_seq long, kind string, graded_at timestamp, rating string, tracked boolean"


def event_rows(n=600):
    rng = random.Random(4)
    rows = []
    for seq in range(n):
        kind = rng.choices([EV.ATTEMPT, EV.SET, EV.TOGGLE], [5, 1, 3])[0]
        pair = (1, 1) if rng.random() < 0.4 else (rng.randint(2, 6), rng.randint(1, 4))
        when = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 5))
        rows.append((*pair, seq, kind, when if kind == EV.ATTEMPT else None, rng.choice(P.RATINGS) if kind == EV.ATTEMPT else None, rng.random() < 0.5 if kind == EV.SET else None))
    return rows


def put(spark, folder, rows):
    rows = list(rows)
    random.Random(len(rows)).shuffle(rows)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_events_with_toggles_over_several_runs(spark, tmp_path):
    rows, folder, path, checkpoint = event_rows(), str(tmp_path / "log"), str(tmp_path / "table"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        return run_updates(EV.keep_progress(stream), "progress", path, checkpoint, PR.PAIR, compact_every=2)

    for k in range(3):
        put(spark, folder, rows[k * 100:(k + 1) * 100])
    run()
    # the state carries over to a later run, which compacts again
    for k in range(3, 6):
        put(spark, folder, rows[k * 100:(k + 1) * 100])
    got = run()
    log = spark.createDataFrame(rows, EVENTS)
    part = lambda kind: log.filter(F.col("kind") == kind)
    want = P.progress_state(part(EV.ATTEMPT), part(EV.TOGGLE), part(EV.SET))
    fields = [*PR.PAIR, "tracked", "last_attempt_at", "attempt_count", "last_rating"]
    assert sorted(got.select(*fields).collect(), key=str) == sorted(want.select(*fields).collect(), key=str)
    kept = got.select(*PR.PAIR, F.explode("arrivals").alias("arrival_seq"))
    retained = P.retain_latest(part(EV.ATTEMPT), 50).select(*PR.PAIR, "arrival_seq")
    assert sorted(kept.collect()) == sorted(retained.collect())
    # only batches after the last compaction are read besides it
    assert (tmp_path / "table/compacted/upto=5").exists() and got.filter("batch_id > 5").isEmpty()


def test_a_cut_compaction_is_ignored(spark, tmp_path):
    folder, path, checkpoint = str(tmp_path / "log"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    put(spark, folder, event_rows(50))
    stream = spark.readStream.schema(EVENTS).parquet(folder)
    before = run_updates(EV.keep_progress(stream), "progress", path, checkpoint, PR.PAIR)
    # written, but not in the log
    before.limit(0).drop("batch_id").write.parquet(f"{path}/compacted/upto=9")
    again = run_updates(EV.keep_progress(spark.readStream.schema(EVENTS).parquet(folder)), "progress", path, checkpoint, PR.PAIR)
    assert sorted(map(str, before.collect())) == sorted(map(str, again.collect())) and before.count() > 0


def test_neighbouring_sequences_share_a_state(spark, tmp_path):
    rows = [(learner, sequence, 100 * learner + sequence, dt.datetime(2024, 1, 1), "good") for learner in (1, 2, None) for sequence in range(40) if learner]
    rows += [(None, 3, 900, dt.datetime(2024, 1, 1), "easy"), (2, None, 901, dt.datetime(2024, 1, 1), "hard"), (2, None, 902, dt.datetime(2024, 1, 1), "good")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    checkpoint = str(tmp_path / "checkpoint")
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log"))
    got = PR.latest(run_updates(PR.history_updates(stream), "history", checkpoint=checkpoint))
    assert sorted((r[0], r[1], *r[2], *r[3]) for r in got.filter("learner_id < 3 AND sequence_id < 99").collect()) == [(*r[:3], r[4]) for r in rows[:80]]
    assert [tuple(map(str, r)) for r in got.filter("learner_id IS NULL OR sequence_id IS NULL").orderBy("learner_id").collect()] == [
        ("None", "3", "[900]", "['easy']"), ("2", "None", "[902, 901]", "['good', 'hard']"),
    ]
    # one state for each learner's 40 pairs, one for the pair without a learner and one for that without a sequence
    assert spark.read.format("statestore").load(checkpoint).count() == 4


def test_events_need_no_special_state_store(spark, tmp_path):
    put(spark, str(tmp_path / "log"), event_rows(200))
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        got = run_updates(EV.keep_progress(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "log"))), "progress", keys=PR.PAIR).collect()
    finally:
        spark.conf.set(name, before)
    assert len(got) == len({r[:2] for r in event_rows(200)})
