"""Syllable lexicons: entry lists in JSON, or folders of wave files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingotide.operators.blocks import number_sorted
from lingotide.operators.corpus import latest_entries
from lingotide.sources.audio import read_headers

ENTRY = "struct<pinyin:string,tone:int,voice_id:string,audio_path:string,duration_ms:int>"
# documents of one lexicon are numbered by ``part`` so that later entries stay later
DOCUMENT = f"version string, part long, entries array<{ENTRY}>"
KEYS = ["voice_id", "base", "tone"]


def read_lexicon_v1(spark: SparkSession, path: str) -> DataFrame:
    """(voice_id, base, tone, audio_path, duration_ms); the last entry of a key wins, missing durations are 0."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    rows = docs.select(F.coalesce("part", F.lit(0)).alias("part"), F.posexplode("entries").alias("at", "e"))
    entries = rows.select(
        "e.voice_id", F.col("e.pinyin").alias("base"), "e.tone", "e.audio_path", "e.duration_ms", F.struct("part", "at").alias("pos")
    )
    return latest_entries(entries)


def write_lexicon(entries: DataFrame, path: str, max_entries: int = 1000, order: Sequence[str] = KEYS) -> None:
    """Write entries as JSON documents of at most ``max_entries`` each, one per file, in ``order``."""
    numbered = number_sorted(entries, list(order), "_no")
    entry = F.struct(F.col("base").alias("pinyin"), "tone", "voice_id", "audio_path", "duration_ms")
    pairs = F.collect_list(F.struct(F.col("_no").alias("n"), entry.alias("e")))
    docs = numbered.groupBy(F.floor(F.col("_no") / max_entries).alias("part")).agg(
        F.transform(F.array_sort(pairs), lambda p: p["e"]).alias("entries")
    )
    docs.select(F.lit("1.0").alias("version"), "part", "entries").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def lexicon_from_files(files: DataFrame, voices: DataFrame, tones: Sequence[int] | None = (0, 1, 2, 3, 4)) -> DataFrame:
    """Lexicon of ``<voice>/tone<N>/<syllable>.wav`` files of the declared voices and tones (``None``: any tone).

    ``files`` has relative, n_frames and sample_rate; unreadable files have duration 0.
    """
    pattern = "([^/]+)/tone([0-9]+)/([^/]+)\\.wav$"
    part = [F.regexp_extract("relative", pattern, k) for k in (1, 2, 3)]
    rows = files.filter(F.col("relative").rlike(pattern)).select(
        part[0].alias("voice_id"),
        part[2].alias("base"),
        part[1].cast("int").alias("tone"),
        F.concat(part[0], F.lit("/tone"), part[1], F.lit("/"), part[2], F.lit(".wav")).alias("audio_path"),
        F.coalesce((F.col("n_frames") / F.col("sample_rate") * 1000).cast("int"), F.lit(0)).alias("duration_ms"),
    )
    declared = rows if tones is None else rows.filter(F.col("tone").isin(list(tones)))
    return declared.join(voices.select("voice_id"), "voice_id", "left_semi")


def read_lexicon_v2(spark: SparkSession, root: str) -> DataFrame:
    """Lexicon folder with metadata.json (voices, optional tones) and wave files."""
    meta = spark.read.schema("voices map<string,string>, tones array<int>").option("multiLine", True).json(f"{root}/metadata.json")
    voices = meta.select(F.explode(F.map_keys("voices")).alias("voice_id"))
    tones = meta.select(F.explode(F.coalesce("tones", F.array(*[F.lit(t) for t in range(5)]))).alias("tone"))
    headers = read_headers(spark, root).drop("relative").withColumnRenamed("path", "relative")
    return lexicon_from_files(headers, voices, None).join(tones, "tone", "left_semi").select(*KEYS, "audio_path", "duration_ms")


def read_lexicon(spark: SparkSession, root: str) -> DataFrame:
    """The folder form where metadata.json exists, else lexicon.json."""
    meta = spark.read.format("binaryFile").option("pathGlobFilter", "metadata.json").load(root).select("path")
    return read_lexicon_v1(spark, f"{root}/lexicon.json") if meta.isEmpty() else read_lexicon_v2(spark, root)
