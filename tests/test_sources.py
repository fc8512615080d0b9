import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from lingotide.operators import quality as Q
from lingotide.operators import sequences as S
from lingotide.sources import audio as A
from lingotide.sources import corpora as CO
from lingotide.sources import lexicon as L
from lingotide.sources import sentences as SE
from lingotide.sources import synth as SY
from lingotide.sources import transcripts as TR


def write_wave(path, n, rate=16000, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\x01\x02" * n * channels)


def dataset(**changes):
    doc = {
        "schema_version": "1.0.0",
        "dataset_id": "core_v1",
        "language": "zh-CN",
        "generated_at": "2025-05-04T03:02:01Z",
        "items": [
            {
                "id": "ts_000001",
                "text": "你好！",
                "gloss": {"en": "Hello"},
                "tokens": ["你", "好"],
                "tags": ["greeting", "HSK1"],
                "difficulty": 2,
                "example_audio": {"voices": [{"id": "f1", "label": {"en": "Female"}, "uri": "assets://f/1.opus", "duration_ms": 850}]},
            },
            {"id": "ts_000002", "text": "再见"},
        ],
    }
    return doc | changes


def test_sentences(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(dataset(), ensure_ascii=False, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(dataset(dataset_id="empty", items=[])))
    rows = SE.read_sentences(spark, str(tmp_path))
    got = S.to_domain(rows).orderBy("id").collect()
    assert [(r.id, r.level, r.difficulty, len(r.voices)) for r in got] == [("ts_000001", 1, 2, 1), ("ts_000002", None, 1, 0)]
    assert got[1].gloss == {} and got[1].tokens == [] and got[1].tags == []
    rules = Q.validate_sentences(SE.read_sentences(spark, str(tmp_path), keep_empty=True)).collect()
    assert [(r.dataset_id, r.rule) for r in rules] == [("empty", "items_empty")]


@pytest.mark.parametrize(
    "doc, rule",
    [
        (dataset(items=[{"id": "invalid_id", "text": "x"}]), "id_pattern"),
        (dataset(language="invalid-language-code"), "language_pattern"),
        (dataset(items=[{"id": "ts_000001", "text": "x", "difficulty": 10}]), "difficulty_range"),
        (dataset(items=[{"id": "ts_000001"}]), "text_required"),
        (dataset(items=[{"id": "ts_000001", "text": "x"}] * 2), "id_duplicate"),
        (dataset(schema_version=None), "schema_version_required"),
    ],
)
def test_invalid_datasets(spark, tmp_path, doc, rule):
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rules = {r.rule for r in Q.validate_sentences(SE.read_sentences(spark, str(tmp_path), keep_empty=True)).collect()}
    assert rules == {rule}


def test_sentence_round_trip(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    items = [dataset()["items"][0] | {"id": f"ts_{k:06d}", "text": f"句{k}"} for k in range(25)]
    (source / "a.json").write_text(json.dumps(dataset(items=items), ensure_ascii=False))
    rows = SE.read_sentences(spark, str(source))
    SE.write_sentences(rows, str(target), max_items=10)
    files = sorted(target.glob("part-*.json"))
    assert [len(json.loads(f.read_text())["items"]) for f in sorted(files, key=lambda f: json.loads(f.read_text())["items"][0]["id"])] == [10, 10, 5]
    assert "句7" in "".join(f.read_text() for f in files)  # not escaped
    again = SE.read_sentences(spark, str(target))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    SE.write_sentences(rows, str(tmp_path / "lang"), by_language=True)
    assert [p.name for p in (tmp_path / "lang").glob("lang=*")] == ["lang=zh"]


def test_transcripts(spark, tmp_path):
    (tmp_path / "content.txt").write_text("u1.wav\t广 guang3 州 zhou1\n\nno tab here\nu2.wav\t好 hao3\tx\nu1.wav\t女 nv3\n  u3.wav\t大 da4 人  \n")
    got = {r.utt_id: (r.hanzi, r.pinyin) for r in TR.read_interleaved(spark, str(tmp_path / "content.txt")).collect()}
    assert got == {"u1": ("女", "nv3"), "u2": ("好x", "hao3"), "u3": ("大人", "da4")}
    (tmp_path / "two.txt").write_text("a  hello there \nb\n\n c\tx\na again\n")
    got = {r.utt_id: r.text for r in TR.read_transcript(spark, str(tmp_path / "two.txt")).collect()}
    assert got == {"a": "again", "c": "x"}


def test_audio_catalog(spark, tmp_path):
    write_wave(tmp_path / "wav/S1/u1.wav", 1600)
    write_wave(tmp_path / "wav/S2/u2.wav", 441, 44100, 2)
    write_wave(tmp_path / "wav/S2/empty.wav", 0)
    (tmp_path / "wav/S2/bad.wav").write_bytes(b"not a wave file")
    got = A.read_audio_catalog(spark, str(tmp_path / "wav")).orderBy("utt_id").collect()
    assert [(r.speaker, r.utt_id, r.n_frames, r.sample_rate, r.channels, r.sample_width, r.duration) for r in got] == [
        ("S1", "u1", 1600, 16000, 1, 2, 0.1), ("S2", "u2", 441, 44100, 2, 2, 0.01),
    ]


def test_lexicon_forms(spark, tmp_path):
    v1 = tmp_path / "v1"
    v1.mkdir()
    entry = {"pinyin": "ni", "tone": 3, "voice_id": "female", "audio_path": "a.wav", "duration_ms": 100}
    entries = [entry, entry | {"pinyin": "hao", "duration_ms": None}, entry | {"audio_path": "b.wav", "duration_ms": 300}]
    (v1 / "lexicon.json").write_text(json.dumps({"version": "1.0", "entries": entries}))
    lexicon = L.read_lexicon(spark, str(v1))
    assert {(r.base, r.audio_path, r.duration_ms) for r in lexicon.collect()} == {("ni", "b.wav", 300), ("hao", "a.wav", 0)}
    L.write_lexicon(lexicon, str(tmp_path / "again"), max_entries=1)
    assert sorted(L.read_lexicon_v1(spark, str(tmp_path / "again")).collect()) == sorted(lexicon.collect())
    v2 = tmp_path / "v2"
    write_wave(v2 / "female/tone3/ni.wav", 1601)
    write_wave(v2 / "female/tone5/ni.wav", 1600)
    write_wave(v2 / "other/tone3/ni.wav", 1600)
    (v2 / "female/tone1").mkdir()
    (v2 / "female/tone1/ma.wav").write_bytes(b"bad")
    (v2 / "metadata.json").write_text(json.dumps({"voices": {"female": "X"}}))
    got = {(r.voice_id, r.base, r.tone, r.audio_path, r.duration_ms) for r in L.read_lexicon(spark, str(v2)).collect()}
    assert got == {("female", "ni", 3, "female/tone3/ni.wav", 100), ("female", "ma", 1, "female/tone1/ma.wav", 0)}


def test_synthetic_layouts(spark, tmp_path):
    for name in ("s1", "s2", "s3", "sub/s4"):
        write_wave(tmp_path / f"audio/{name}.wav", 10)
    items = [
        {"id": "s1", "text": "你好", "romanization": "nǐhǎo", "boundaries": [{"start_ms": 0, "end_ms": 100}, [1600, 3200], [5]]},
        {"id": "s2", "syllables": [{"hanzi": "好", "pinyin": "hao", "tone": 3}], "ground_truth_spans": [{"start_ms": 10.5, "end_ms": 20}]},
        {"id": "s3", "text": "abc"},
        {"id": "s4", "audio_path": "audio\\sub\\s4.wav", "syllables": []},
        {"id": "gone", "syllables": []},
    ]
    (tmp_path / "metadata.json").write_text(json.dumps({"samples": items}))
    got = {r.id: r for r in SY.read_synth(spark, str(tmp_path)).collect()}
    assert set(got) == {"s1", "s2", "s3", "s4"}
    assert [tuple(b) for b in got["s1"].boundaries] == [(0, 1600), (1600, 3200)]
    assert [tuple(s) for s in got["s1"].syllables] == [("你", "nǐ", 3), ("好", "hǎo", 3)]
    assert [tuple(b) for b in got["s2"].boundaries] == [(168, 320)] and [tuple(s) for s in got["s2"].syllables] == [("好", "hao", 3)]
    assert got["s3"].syllables == [] and got["s3"].boundaries == [] and got["s4"].audio_path == "audio/sub/s4.wav"


def test_tts(spark, tmp_path):
    write_wave(tmp_path / "audio/a.wav", 100)
    write_wave(tmp_path / "x/b.wav", 7)
    syllables = [{"pinyin": "ni3"}, {"pinyin": "ma9", "tone": 0}, {"pinyin": "hao3", "tone": 2}]
    items = [
        {"id": "a", "syllables": syllables}, {"id": "b", "audio_file": "x/b.wav", "syllables": syllables[:1]},
        {"id": "c", "syllables": syllables}, {"id": "a2", "audio_file": "audio/a.wav", "syllables": []},
    ]
    (tmp_path / "sentences.json").write_text(json.dumps({"sentences": items}))
    got = {r.id: r for r in SY.read_tts(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"}
    assert [tuple(b) for b in got["a"].boundaries] == [(0, 33), (33, 66), (66, 100)]
    assert [(s.pinyin, s.tone) for s in got["a"].syllables] == [("ni", 3), ("ma", 9), ("hao3", 2)]
    assert got["b"].total_samples == 7


def test_split_is_exact_and_order_free(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    a = CO.train_split(df, "k", 0.8, 1)
    b = CO.train_split(df.orderBy(F.desc("k")).repartition(7), "k", 0.8, 1)
    assert a.filter("split = 'train'").count() == 802 and a.count() == 1003
    assert sorted(a.collect()) == sorted(b.collect())
    assert sorted(a.collect()) != sorted(CO.train_split(df, "k", 0.8, 2).collect())


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, 2 if i < 3 else 5 if i < 50 else 20) for i in range(200)], "id int, n int")
    got = CO.stratified_sample(df, "id", F.col("n"), 30)
    sizes = {r.stratum: r["count"] for r in got.groupBy("stratum").count().collect()}
    assert sum(sizes.values()) == 30 and sizes[0] == 3 and sizes[1] >= 10 and sizes[2] >= 10
    assert got.select("id").distinct().count() == 30
    assert CO.stratified_sample(df.limit(2), "id", F.col("n"), 30).count() == 2


def test_sources_and_caps(spark):
    parts = [("a", spark.range(5).toDF("id")), ("zz", spark.range(9).toDF("id")), ("b", spark.range(3).toDF("id").withColumn("x", F.lit(1)))]
    known = {"a": CO.NATIVE, "b": CO.TTS}
    count = lambda cap: {(r.source, r.domain): r["count"] for r in CO.load_sources(parts, known, cap=cap).groupBy("source", "domain").count().collect()}
    assert count(None) == {("a", 0): 5, ("b", 1): 3}
    assert count(4) == {("a", 0): 4, ("b", 1): 3}
    assert count(0) == {}


def test_waves_with_other_chunks(spark, tmp_path):
    import struct

    from lingotide.sources import audio as A

    def wave(before=b"", between=b""):
        form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16)
        return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + before + form + between + b"data" + struct.pack("<I", 400) + b"\0" * 400

    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    files = {
        "plain.wav": wave(), "junk.wav": wave(between=chunk(b"JUNK", b"x" * 9001)), "list.wav": wave(chunk(b"LIST", b"INFOdata fmt ")),
        "many.wav": wave(chunk(b"note", b"data") * 100), "cut.wav": wave()[:30], "other.wav": b"RIFF\0\0\0\0AVI data",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = {r.path.rsplit("/", 1)[1]: (r.n_frames, r.sample_rate, r.channels) for r in A.parse_audio(
        spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")).collect()}
    good = (100, 8000, 2)
    ranged = {r.relative: (r.n_frames, r.sample_rate, r.channels) for r in A.read_headers(spark, str(tmp_path)).collect()}
    assert ranged == found
    assert found == {n: good if n in ("plain.wav", "junk.wav", "list.wav", "many.wav") else (0, None, None) for n in files}


def test_shards_are_exact(spark, tmp_path):
    from lingotide.sources import corpora as CO

    utts = spark.range(103).selectExpr("CAST(id % 7 AS INT) AS speaker", "id AS utt_id")
    CO.write_shards(utts, str(tmp_path / "s"), size=10)
    back = spark.read.parquet(str(tmp_path / "s")).toPandas().sort_values(["speaker", "utt_id"])
    assert back["shard_id"].tolist() == [i // 10 for i in range(103)]
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "s").glob("shard_id=*"))


def test_released_folders_are_gone(spark):
    from pathlib import Path

    from lingotide import session

    df = session.staged(spark.range(3), "released")
    path = session._given[-1]
    assert df.count() == 3 and Path(path).exists()
    kept, session._given[:] = session._given[:-1], [path]
    assert session.release_staged(spark) == 1 and not Path(path).exists()
    session._given[:] = kept


def test_token_distance_takes_any_id(spark):
    from pyspark.sql import functions as F

    from lingotide.functions import text as T

    rows = spark.createDataFrame([([36000, 60000, 5], [36000, 5]), ([70000] * 3, [70000, 1, 70000]), ([], [9])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(T.token_distance(F.col("a"), F.col("b"))).collect()] == [1, 1, 1]


def test_headers_of_huge_files_are_read_alone(spark, tmp_path):
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16)
    data = 3 << 30
    for name, before in (("S1/long.wav", 0), ("S1/late ü.wav", 1 << 30)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        with path.open("wb") as file:
            file.write(b"RIFF" + struct.pack("<I", 0) + b"WAVE")
            if before:
                file.write(b"JUNK" + struct.pack("<I", before))
                file.seek(before, 1)
            file.write(form + b"data" + struct.pack("<I", data))
            # a hole: the file takes no room
            file.truncate(file.tell() + data)
        with A.open_range(f"file:{path}") as file:
            assert A.wave_header(file)[4] < 1 << 16
    got = A.read_audio_catalog(spark, str(tmp_path)).orderBy("utt_id").collect()
    assert [(r.utt_id, r.n_frames, r.sample_rate) for r in got] == [("late ü", data // 2, 16000), ("long", data // 2, 16000)]
    (tmp_path / "none").mkdir()
    assert A.read_audio_catalog(spark, str(tmp_path / "none")).count() == 0


def test_native_corpus(spark, tmp_path):
    (tmp_path / "content.txt").write_text("u1.wav\t广 guang3 州 Zhou1 x\nu2.wav\t好 hao5\nu3.wav\t女 nv3\nu5.wav\t你\nu6.wav\tabc\n")
    for name, n in (("S1/u1", 100), ("S2/u2", 7), ("S2/u3", 0), ("S2/u4", 50), ("S1/u5", 9), ("S1/u6", 9)):
        write_wave(tmp_path / f"wav/{name}.wav", n)
    got = {r.id: r for r in CO.read_native(spark, str(tmp_path)).collect()}
    assert set(got) == {"u1", "u2", "u5"}
    assert [tuple(s) for s in got["u1"].syllables] == [("广", "guang", 3), ("州", "zhou", 1)] and got["u1"].text == "广州x"
    assert [tuple(b) for b in got["u1"].boundaries] == [(0, 50), (50, 100)] and got["u1"].sample_rate == 16000
    assert [tuple(s) for s in got["u2"].syllables] == [("好", "hao", 0)] and [tuple(b) for b in got["u2"].boundaries] == [(0, 7)]
    assert [tuple(s) for s in got["u5"].syllables] == [("你", "", 0)] and got["u5"].speaker == "S1"
    assert [r.id for r in CO.read_native(spark, str(tmp_path), ["S2"]).collect()] == ["u2"]


@pytest.mark.parametrize("rows", [1 << 20, 50, 1])
def test_split_sizes_whatever_the_bucket(spark, monkeypatch, rows):
    monkeypatch.setattr(CO, "CUT_ROWS", rows)
    # a draw of few values, so that many keys share the hash at the cut
    monkeypatch.setattr(CO, "draw", lambda seed, key: F.col(key) % 7 * F.lit(1 << 45))
    df = spark.range(1000).withColumnRenamed("id", "k")
    order = sorted(range(1000), key=lambda k: (k % 7, k))
    for fraction in (0.0, 0.333, 0.8, 1.0):
        got = {r.k for r in CO.train_split(df, "k", fraction).filter("split = 'train'").collect()}
        assert got == set(order[: int(1000 * fraction)])


def test_synthetic_samples_are_written_compressed(spark, tmp_path):
    samples = spark.range(500).selectExpr("id AS sentence_id", "'economy' AS voice_id", "true AS augmented")
    SY.write_synth(samples, spark.range(1).selectExpr("id AS tone"), str(tmp_path / "synth"))
    assert list((tmp_path / "synth/samples").glob("*.json.gz")) and not list((tmp_path / "synth/samples").glob("*.json"))
    assert spark.read.schema(samples.schema).json(str(tmp_path / "synth/samples")).count() == 500
