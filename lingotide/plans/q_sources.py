"""Source, sink and corpus-assembly queries.

Where a reader needs files, Spark first writes them from the given tables below the shared folder.
"""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from lingotide.functions.draws import draw_sql
from lingotide.operators.blocks import block_of
from lingotide.operators.corpus import expand_samples, latest_entries, synth_stats
from lingotide.operators.syllables import apply_sandhi
from lingotide.plans.registry import query
from lingotide.plans.views import Views, word_case
from lingotide.session import scratch_path
from lingotide.sources import audio as A
from lingotide.sources import corpora as CO
from lingotide.sources import lexicon as L
from lingotide.sources import sentences as SE
from lingotide.sources import synth as SY
from lingotide.sources import transcripts as TR


def _items(v: Views):
    """Documents as dataset items, one dataset per source and language."""
    return v.table("documents").select(
        F.lit("1.0.0").alias("schema_version"),
        F.col("source").alias("dataset_id"),
        F.concat("lang", F.lit("-XX")).alias("language"),
        F.lit("2026-01-01T00:00:00Z").alias("generated_at"),
        F.format_string("ts_%06d", "doc_id").alias("id"),
        "text",
        F.create_map(F.lit("en"), F.col("source")).alias("gloss"),
        F.split("lang", "").alias("tags"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("difficulty"),
    )


ITEM_SQL = """
SELECT '1.0.0' AS schema_version, source AS dataset_id, concat(lang, '-XX') AS language, '2026-01-01T00:00:00Z' AS generated_at,
  concat('ts_', CASE WHEN doc_id < 1000000 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0') ELSE CAST(doc_id AS VARCHAR) END) AS id, text, source AS gloss_en,
  CAST(doc_id % 5 + 1 AS INT) AS difficulty FROM documents"""


@query("src1_read_sentences", ITEM_SQL)
def src1(v: Views):
    path = scratch_path(v.spark, "sentences")
    SE.write_sentences(_items(v), path, max_items=50)
    rows = SE.read_sentences(v.spark, path)
    return rows.select(*SE.HEADER, "id", "text", F.col("gloss")["en"].alias("gloss_en"), "difficulty")


@query(
    "snk1_write_sentences",
    """
WITH d AS (SELECT source, lang, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) // 20 AS doc FROM documents)
SELECT source AS dataset_id, concat(lang, '-XX') AS language, count(*) AS n_items FROM d GROUP BY source, lang, doc""",
)
def snk1(v: Views):
    path = scratch_path(v.spark, "sentences")
    SE.write_sentences(_items(v), path, max_items=20)
    docs = v.spark.read.schema(SE.DATASET).option("multiLine", True).json(path)
    return docs.select("dataset_id", "language", F.size("items").cast("long").alias("n_items"))


@query("snk2_export_by_language", "SELECT lang, source AS dataset_id, count(*) AS n FROM documents GROUP BY 1, 2")
def snk2(v: Views):
    path = scratch_path(v.spark, "by-language")
    SE.write_sentences(_items(v), path, by_language=True)
    docs = v.spark.read.schema(SE.DATASET.add("lang", "string")).option("multiLine", True).json(path)
    return docs.select("lang", "dataset_id", F.explode("items")).groupBy("lang", "dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src3_read_interleaved",
    f"""
SELECT CAST(sentence_id AS VARCHAR) AS utt_id, repeat('x', CAST(len(words) AS INT)) AS hanzi,
  array_to_string(list_transform(words, lambda w: concat({word_case(0, 'length(w) % 8')}, CAST({word_case(1, 'length(w) % 8')} AS VARCHAR))), ' ') AS pinyin FROM sentences""",
)
def src3(v: Views):
    path = scratch_path(v.spark, "interleaved")
    v.interleaved.select("value").write.text(path)
    return TR.read_interleaved(v.spark, path)


NATIVE_FRAMES = "3200 * CAST({n} AS BIGINT) + doc_id % 97"


@query(
    "src11_native_corpus",
    f"""
SELECT CAST(sentence_id AS VARCHAR) AS id, concat('S', doc_id % 7) AS speaker, repeat('x', CAST(len(words) AS INT)) AS text, len(words) AS n_syllables,
  array_to_string(list_transform(words, lambda w: {word_case(0, 'length(w) % 8')}), ' ') AS pinyin,
  array_to_string(list_transform(words, lambda w: {word_case(1, 'length(w) % 8')}), '') AS tones,
  (len(words) - 1) * (({NATIVE_FRAMES.format(n='len(words)')}) // len(words)) AS last_start, {NATIVE_FRAMES.format(n='len(words)')} AS last_end, 16000 AS sample_rate
FROM sentences WHERE sentence_id % 11 > 0""",
)
def src11_native(v: Views):
    """Every sentence as a recording with its transcript; one of eleven waves is broken."""
    path = scratch_path(v.spark, "native")
    v.interleaved.select("value").write.text(path)
    files = v.sentences.selectExpr(
        "concat('/data/wav/S', doc_id % 7, '/', sentence_id, '.wav') AS path",
        f"CASE WHEN sentence_id % 11 = 0 THEN CAST('broken' AS BINARY) ELSE {_wave(NATIVE_FRAMES.format(n='size(words)'))} END AS content",
    )
    rows = CO.native_sentences(TR.read_interleaved(v.spark, path), A.parse_audio(files))
    last = F.element_at("boundaries", -1)
    return rows.select(
        "id", "speaker", "text", F.size("syllables").alias("n_syllables"), F.array_join("syllables.pinyin", " ").alias("pinyin"),
        F.array_join(F.col("syllables.tone").cast("array<string>"), "").alias("tones"), last["start"].alias("last_start"), last["end"].alias("last_end"), "sample_rate",
    )


@query(
    "src4_read_transcript",
    r"""
WITH l AS (SELECT concat('utt', doc_id) AS utt_id, trim(regexp_replace(text, '[ \n\t]+', ' ', 'g')) AS text FROM documents)
SELECT utt_id, text FROM l WHERE text <> ''""",
)
def src4(v: Views):
    path = scratch_path(v.spark, "transcript")
    text = F.trim(F.regexp_replace("text", "[ \\n\\t]+", " "))
    v.table("documents").select(F.concat(F.lit("utt"), "doc_id", F.lit("  "), text).alias("value")).write.text(path)
    return TR.read_transcript(v.spark, path)


def _le(number: str) -> str:
    """SQL for the little-endian hex text of a 4-byte number."""
    digits = f"lpad(hex(CAST({number} AS BIGINT)), 8, '0')"
    return "concat(" + ", ".join(f"substring({digits}, {2 * k + 1}, 2)" for k in reversed(range(4))) + ")"


def _wave(samples: str, rate: int = 16000) -> str:
    """SQL for the header bytes of a mono 16-bit wave file, with a note before the samples that names their chunk."""
    note = b"LIST" + struct.pack("<I", 12) + b"INFOfmt data"
    form = b"WAVE" + note + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + note + b"data"
    riff, form = b"RIFF".hex(), form.hex()
    return f"unhex(concat('{riff}', {_le(f'76 + 2 * ({samples})')}, '{form}', {_le(f'2 * ({samples})')}))"


@query(
    "src5_audio_catalog",
    """
SELECT concat('S', c_nationkey) AS speaker, concat('utt', c_custkey) AS utt_id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS n_frames, 16000 AS sample_rate,
  round(floor(abs(c_acctbal)) / 16000.0E0, 8) AS duration FROM customer WHERE floor(abs(c_acctbal)) > 0 AND c_mktsegment <> 'MACHINERY'""",
)
def src5(v: Views):
    # one broken file per machinery customer
    samples = "CAST(floor(abs(c_acctbal)) AS BIGINT)"
    files = v.table("customer").selectExpr(
        "concat('/data/wav/S', c_nationkey, '/utt', c_custkey, '.wav') AS path",
        f"CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST('broken' AS BINARY) ELSE {_wave(samples)} END AS content",
    )
    rows = A.audio_catalog(A.parse_audio(files))
    return rows.select("speaker", "utt_id", "n_frames", "sample_rate", F.round("duration", 8).alias("duration"))


LATEST_SQL = "SELECT voice_id, base, tone, arg_max(duration_ms, pos) AS duration_ms FROM lexicon_entries GROUP BY 1, 2, 3"


def _entries(v: Views):
    return v.lexicon_entries.withColumn("audio_path", F.concat_ws("/", "voice_id", F.concat("base", "tone")))


@query("src6_read_lexicon_v1", LATEST_SQL)
def src6(v: Views):
    """All entries, repeats included, in their order: the reader keeps the last one of each key."""
    path = scratch_path(v.spark, "lexicon")
    L.write_lexicon(_entries(v), path, order=["pos"])
    return L.read_lexicon_v1(v.spark, path).select("voice_id", "base", "tone", "duration_ms")


@query("snk5_write_lexicon", LATEST_SQL)
def snk5(v: Views):
    path = scratch_path(v.spark, "lexicon")
    L.write_lexicon(latest_entries(_entries(v)), path)
    return L.read_lexicon_v1(v.spark, path).select("voice_id", "base", "tone", "duration_ms")


@query(
    "src7_lexicon_from_files",
    """
SELECT voice_id, base, tone, CAST(floor(160.0E0 * duration_ms / 16000 * 1000) AS INT) AS duration_ms, concat(voice_id, '/tone', tone, '/', base, '.wav') AS audio_path
FROM lexicon""",
)
def src7(v: Views):
    files = v.lexicon.select(
        F.concat(F.lit("lexicon/"), "voice_id", F.lit("/tone"), "tone", F.lit("/"), "base", F.lit(".wav")).alias("relative"),
        F.expr(_wave("160 * duration_ms")).alias("content"),
    )
    return L.lexicon_from_files(A.parse_audio(files), v.lexicon.select("voice_id").distinct())


def _synth_items(v: Views):
    """Utterances as metadata items in three layouts, by speaker."""
    ms, rate = "floor(n_samples / 16)", 16000
    docs = v.utterances.selectExpr(
        f"{rate} AS sample_rate",
        "speaker",
        f"""CASE WHEN speaker % 3 = 0 THEN to_json(named_struct('id', concat('u', utt_id), 'text', '你好', 'romanization', 'nǐhǎo',
      'audio_path', concat('audio\\\\', 'u', utt_id, '.wav'), 'boundaries', array(named_struct('start_ms', 0, 'end_ms', {ms} div 2), named_struct('start_ms', {ms} div 2, 'end_ms', {ms}))))
    WHEN speaker % 3 = 1 THEN to_json(named_struct('id', concat('u', utt_id), 'syllables', array(named_struct('hanzi', '你', 'pinyin', 'ni', 'tone', 3)), 'boundaries', array(array(0, n_samples))))
    ELSE to_json(named_struct('id', concat('u', utt_id), 'text', '你好', 'romanization', 'nǐ hǎo', 'ground_truth_spans', array(named_struct('start_ms', 0, 'end_ms', {ms})))) END AS item""",
    )
    return docs.select("sample_rate", F.from_json("item", SY.SYNTH_ITEM).alias("item"))


@query(
    "src8_parse_synth",
    """
WITH f AS (SELECT *, floor(n_samples / 16) AS ms FROM utterances WHERE speaker <> 4)
SELECT concat('u', utt_id) AS id, concat('audio/u', utt_id, '.wav') AS audio_path, CASE WHEN speaker % 3 = 1 THEN '' ELSE '你好' END AS text,
  CASE WHEN speaker % 3 = 1 THEN '你:ni:3' ELSE '你:nǐ:3,好:hǎo:3' END AS syllables,
  CASE speaker % 3 WHEN 0 THEN concat('0-', CAST(floor(ms / 2) * 16 AS BIGINT), ',', CAST(floor(ms / 2) * 16 AS BIGINT), '-', CAST(ms * 16 AS BIGINT))
    WHEN 1 THEN concat('0-', n_samples) ELSE concat('0-', CAST(ms * 16 AS BIGINT)) END AS boundaries FROM f""",
)
def src8(v: Views):
    files = v.utterances.filter("speaker <> 4").select(F.concat(F.lit("audio/u"), "utt_id", F.lit(".wav")).alias("relative"))
    rows = SY.parse_synth(_synth_items(v), files)
    return rows.selectExpr(
        "id", "audio_path", "text",
        "array_join(transform(syllables, s -> concat_ws(':', s.hanzi, s.pinyin, CAST(s.tone AS STRING))), ',') AS syllables",
        "array_join(transform(boundaries, b -> concat(b.start, '-', b.end)), ',') AS boundaries",
    )


@query(
    "src9_parse_tts",
    """
WITH u AS (SELECT *, CASE WHEN speaker % 2 = 0 THEN n_syllables - 1 ELSE n_syllables END AS n FROM utterances WHERE speaker <> 4)
SELECT concat('u', utt_id) AS id, CASE WHEN speaker = 5 THEN 'other/x.wav' ELSE concat('audio/u', utt_id, '.wav') END AS audio_path,
  CAST(n AS INT) AS n, CASE WHEN speaker % 2 = 0 THEN 'ma:7' ELSE 'ma2:3' END AS first_syllable,
  (n - 1) * (n_samples // n) AS last_start, n_samples AS last_end FROM u WHERE n > 0 AND speaker <> 5""",
)
def src9(v: Views):
    items = v.utterances.selectExpr(
        "16000 AS sample_rate",
        """from_json(to_json(named_struct('id', concat('u', utt_id), 'audio_file', CASE WHEN speaker = 5 THEN 'other/x.wav' ELSE '' END,
  'syllables', transform(sequence(1, 12), i -> named_struct('pinyin', CASE WHEN speaker % 2 = 0 THEN 'ma7' ELSE 'ma2' END, 'tone', CASE WHEN speaker % 2 = 0 THEN 0 ELSE 3 END)))),
  'struct<id:string,text:string,audio_file:string,syllables:array<struct<hanzi:string,pinyin:string,tone:int>>>') AS item""",
        "CASE WHEN speaker % 2 = 0 THEN n_syllables - 1 ELSE n_syllables END AS n",
    )
    items = items.withColumn("item", F.col("item").withField("syllables", F.slice("item.syllables", F.lit(1), F.col("n")))).drop("n")
    files = v.utterances.filter("speaker <> 4").select(
        F.concat(F.lit("audio/u"), "utt_id", F.lit(".wav")).alias("relative"), F.col("n_samples").alias("n_frames")
    )
    rows = SY.parse_tts(items, files)
    return rows.selectExpr(
        "id", "audio_path", "size(syllables) AS n", "concat(syllables[0].pinyin, ':', syllables[0].tone) AS first_syllable",
        "boundaries[size(boundaries) - 1].start AS last_start", "boundaries[size(boundaries) - 1].end AS last_end",
    )


@query(
    "src10_pair_features",
    """
SELECT utt_id, n_syllables, CAST(CASE WHEN speaker > 10 THEN n_samples ELSE greatest(0, (o.n - 1) * 160 + 400) END AS BIGINT) AS total_samples
FROM utterances JOIN (SELECT o_custkey AS utt_id, count(*) AS n FROM orders GROUP BY 1) o USING (utt_id)""",
)
def src10(v: Views):
    meta = v.utterances.select("utt_id", "n_syllables", F.when(F.col("speaker") > 10, F.col("n_samples")).otherwise(0).alias("audio_num_samples"))
    feats = v.table("orders").groupBy(F.col("o_custkey").alias("utt_id")).agg(F.count(F.lit(1)).alias("n_frames"))
    return CO.pair_features(meta, feats).select("utt_id", "n_syllables", "total_samples")


# all sources of the documents; every third counts as synthetic speech
KNOWN = {f"src{k}": CO.TTS if k % 3 == 0 else CO.NATIVE for k in range(20)}
DOMAIN_SQL = "CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 1 ELSE 0 END AS domain"


@query(
    "src11_load_sources",
    f"SELECT id, text, source, {DOMAIN_SQL} FROM texts",
)
def src11(v: Views):
    return CO.load_sources(v.texts.select("id", "text", "source"), KNOWN)


@query(
    "src11_load_sources_capped",
    f"""
SELECT id, source, {DOMAIN_SQL} FROM texts
QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 7""",
)
def src11_capped(v: Views):
    """The per-source sentence count as a request (srt-7)."""
    return CO.load_sources(v.texts.select("id", "source"), KNOWN, cap=7).select("id", "source", "domain")


@query(
    "src12_source_info",
    r"""
WITH c AS (SELECT source, lang AS split, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY 1, 2),
d AS (SELECT s AS source, concat('corpus ', s) AS description, l AS split FROM (SELECT DISTINCT source AS s FROM documents UNION ALL SELECT 'elsewhere') a, (VALUES ('en'), ('fr'), ('de'), ('es'), ('zh')) b(l))
SELECT d.source, d.split, description, n IS NOT NULL AS available, coalesce(n, 0) AS n_sentences FROM d LEFT JOIN c ON c.source = d.source AND c.split = d.split""",
)
def src12(v: Views):
    declared = [(s, f"corpus {s}") for s in [*KNOWN, "elsewhere"]]
    rows = v.texts.withColumnRenamed("language", "split")
    return CO.source_info(rows, declared, ["en", "fr", "de", "es", "zh"])


@query(
    "snk3_shards",
    """
WITH s AS (SELECT speaker, utt_id, (row_number() OVER (ORDER BY speaker, utt_id) - 1) // 100 AS shard_id FROM utterances)
SELECT shard_id, count(*) AS n, min(speaker) AS first_speaker, max(speaker) AS last_speaker FROM s GROUP BY 1""",
)
def snk3(v: Views):
    block = F.struct("speaker", block_of("utt_id").alias("b"))
    shards = CO.assign_shards(v.utterances, 100, ["speaker", "utt_id"], block)
    return shards.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("speaker").alias("first_speaker"), F.max("speaker").alias("last_speaker")
    )


@query(
    "snk3_write_shards",
    """SELECT utt_id, speaker, n_samples, n_syllables, (row_number() OVER (ORDER BY speaker, utt_id) - 1) // 100 AS shard_id, 1 AS n_files FROM utterances""",
)
def snk3_write(v: Views):
    """The rows as written, with their shard and the number of files it takes."""
    path = scratch_path(v.spark, "shards")
    CO.write_shards(v.utterances, path, 100)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.utterances.schema.fields)
    rows = v.spark.read.schema(f"{fields}, shard_id long").parquet(path)
    named = rows.select("shard_id", F.col("_metadata.file_name").alias("file"))
    files = named.groupBy("shard_id").agg(F.count_distinct("file").alias("n_files"))
    return rows.join(files, "shard_id")


@query(
    "snk4_write_synth",
    """
SELECT sentence_id, count(*) AS n_samples, count(*) FILTER (aug >= 0) AS n_augmented FROM sentences, (VALUES (1), (2)) v(x), range(-1, 2) r(aug) GROUP BY 1""",
)
def snk4(v: Views):
    path = scratch_path(v.spark, "synth")
    voices = ["economy", "large"]
    samples = expand_samples(v.sentences.select("sentence_id"), "sentence_id", voices, 2)
    stats = synth_stats(apply_sandhi(v.syllables, "sentence_id"), v.lexicon, "sentence_id", voices, 2)
    SY.write_synth(samples, stats, path)
    back = v.spark.read.schema(samples.schema).json(f"{path}/samples")
    return back.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if("augmented").alias("n_augmented"))


@query(
    "set2_train_split",
    f"""
SELECT id, CASE WHEN row_number() OVER (ORDER BY {draw_sql(42, "id")}, id) <= floor(count(*) OVER () * 0.8E0) THEN 'train' ELSE 'validation' END AS split FROM texts
UNION ALL SELECT item_id, 'test' FROM benchmark""",
)
def set2(v: Views):
    split = CO.train_split(v.texts, "id").select("id", "text", "split")
    whole = CO.add_test_split(split, v.table("benchmark").select(F.col("item_id").alias("id"), "text"))
    return whole.select("id", "split")


@query(
    "jn2_join_transcripts",
    """SELECT utt_id, speaker, u.n_samples, text FROM utterances u JOIN (SELECT doc_id AS utt_id, text FROM documents) t USING (utt_id)""",
)
def jn2(v: Views):
    transcripts = v.table("documents").select(F.col("doc_id").alias("utt_id"), "text")
    return CO.join_transcripts(v.utterances, transcripts).select("utt_id", "speaker", "n_samples", "text")


@query(
    "win21_stratified_sample",
    f"""
WITH r AS (SELECT sentence_id, CASE WHEN len(words) <= 3 THEN 0 WHEN len(words) <= 6 THEN 1 ELSE 2 END AS stratum, {draw_sql(42, "sentence_id")} AS h FROM sentences),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, sentence_id) <= 10 AS first FROM r)
SELECT sentence_id, stratum FROM k ORDER BY NOT first, CASE WHEN first THEN stratum END, h, sentence_id LIMIT 30""",
)
def win21(v: Views):
    """A 30-sentence sample over the word-count strata."""
    rows = v.sentences.select("sentence_id", F.size("words").alias("n"))
    return CO.stratified_sample(rows, "sentence_id", F.col("n"), 30).select("sentence_id", "stratum")
