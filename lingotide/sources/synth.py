"""Sentence metadata of synthetic and TTS corpora, in their several JSON layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingotide.functions.pinyin import tone_of
from lingotide.operators.syllables import syllable_arrays
from lingotide.sources.audio import list_files, read_headers
from lingotide.sources.corpora import even_ranges

SYLLABLE = "struct<hanzi:string,pinyin:string,tone:int>"
SPAN = "struct<start_ms:double,end_ms:double>"
SYNTH_ITEM = (
    f"struct<id:string,text:string,romanization:string,audio_path:string,syllables:array<{SYLLABLE}>,"
    f"boundaries:string,ground_truth_spans:array<{SPAN}>>"
)
SYNTH_DOC = f"sample_rate int, sentences array<{SYNTH_ITEM}>, samples array<{SYNTH_ITEM}>"
TTS_ITEM = f"struct<id:string,text:string,audio_file:string,syllables:array<{SYLLABLE}>>"
TTS_DOC = f"sample_rate int, sentences array<{TTS_ITEM}>"


def _from_ms(span: Column, rate: Column) -> Column:
    def at(name: str) -> Column:
        return (F.coalesce(span[name], F.lit(0.0)) * rate / 1000).cast("long").alias(name.replace("_ms", ""))

    return F.struct(at("start_ms"), at("end_ms"))


def _boundaries(text: Column, rate: Column) -> Column:
    """Sample ranges of a JSON list whose elements are {start_ms, end_ms} objects or [start, end] pairs."""

    def one(element: Column) -> Column:
        pair = F.from_json(element, "array<bigint>")
        as_samples = F.struct(pair[0].alias("start"), pair[1].alias("end"))
        return F.when(element.startswith("{"), _from_ms(F.from_json(element, SPAN), rate)).when(F.size(pair) >= 2, as_samples)

    return F.array_compact(F.transform(F.from_json(text, "array<string>"), one))


def synth_items(docs: DataFrame) -> DataFrame:
    """(sample_rate, item) rows of metadata documents: ``sentences``, else the older ``samples``."""
    return docs.select(
        F.coalesce("sample_rate", F.lit(16000)).alias("sample_rate"), F.explode(F.coalesce("sentences", "samples")).alias("item")
    )


def parse_synth(items: DataFrame, files: DataFrame) -> DataFrame:
    """Sentence info rows: id, audio_path, text, syllables, boundaries (samples), sample_rate.

    Items without an audio file are dropped; ``files`` has the present paths as ``relative``. Items
    without syllables get them from text and romanization, and no boundaries means an empty list.
    """
    path = F.coalesce(F.translate("item.audio_path", "\\", "/"), F.concat(F.lit("audio/"), "item.id", F.lit(".wav")))
    rows = items.withColumn("_path", path).join(files.select(F.col("relative").alias("_path")), "_path", "left_semi")
    rate = F.col("sample_rate")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.transform("item.ground_truth_spans", lambda s: _from_ms(s, rate))
    flat = rows.select(
        F.col("item.id").alias("id"),
        F.col("_path").alias("audio_path"),
        F.coalesce("item.text", F.lit("")).alias("text"),
        F.col("item.romanization").alias("romanization"),
        F.transform(
            "item.syllables",
            lambda s: F.struct(
                F.coalesce(s["hanzi"], F.lit("")).alias("hanzi"),
                F.coalesce(s["pinyin"], F.lit("")).alias("pinyin"),
                F.coalesce(s["tone"], F.lit(0)).alias("tone"),
            ),
        ).alias("_given"),
        F.coalesce(F.when(F.col("item.boundaries").isNotNull(), _boundaries(F.col("item.boundaries"), rate)), spans, empty).alias(
            "boundaries"
        ),
        "sample_rate",
    )
    parsed = syllable_arrays(flat.filter("_given IS NULL"), "id").select("id", F.col("syllables").alias("_parsed"))
    with_tone = F.transform("_parsed", lambda s: F.struct(s["hanzi"].alias("hanzi"), s["pinyin"].alias("pinyin"), tone_of(s["pinyin"]).alias("tone")))
    none = F.array().cast(f"array<{SYLLABLE}>")
    return flat.join(parsed, "id", "left").select(
        "id", "audio_path", "text", F.coalesce("_given", with_tone, none).alias("syllables"), "boundaries", "sample_rate"
    )


def read_synth(spark: SparkSession, root: str) -> DataFrame:
    docs = spark.read.schema(SYNTH_DOC).option("multiLine", True).json(f"{root}/metadata.json")
    return parse_synth(synth_items(docs), list_files(spark, root))


def parse_tts(items: DataFrame, files: DataFrame) -> DataFrame:
    """Sentence info rows with even boundaries: id, audio_path, text, syllables, boundaries, sample_rate, total_samples.

    ``files`` has relative and n_frames. Items without audio, syllables or samples are dropped. A tone of
    0 is replaced by the trailing digit of the pinyin, whatever that digit is.
    """
    path = F.when(F.coalesce("item.audio_file", F.lit("")) != "", F.col("item.audio_file")).otherwise(
        F.concat(F.lit("audio/"), "item.id", F.lit(".wav"))
    )

    def syllable(s: Column) -> Column:
        pinyin, tone = F.coalesce(s["pinyin"], F.lit("")), F.coalesce(s["tone"], F.lit(0))
        digit = F.regexp_extract(pinyin, "([0-9])$", 1)
        found = (tone == 0) & (digit != "")
        return F.struct(
            F.coalesce(s["hanzi"], F.lit("")).alias("hanzi"),
            F.when(found, F.regexp_replace(pinyin, "[0-9]$", "")).otherwise(pinyin).alias("pinyin"),
            F.when(found, digit.cast("int")).otherwise(tone).alias("tone"),
        )

    rows = (
        items.withColumn("_path", path)
        .filter(F.size("item.syllables") > 0)
        .join(files.filter("n_frames > 0").select(F.col("relative").alias("_path"), F.col("n_frames").cast("long").alias("total_samples")), "_path")
        .withColumn("_n", F.size("item.syllables"))
    )
    return rows.select(
        F.col("item.id").alias("id"),
        F.col("_path").alias("audio_path"),
        F.coalesce("item.text", F.lit("")).alias("text"),
        F.transform("item.syllables", syllable).alias("syllables"),
        even_ranges("total_samples", "_n").alias("boundaries"),
        "sample_rate",
        "total_samples",
    )


def read_tts(spark: SparkSession, root: str) -> DataFrame:
    docs = spark.read.schema(TTS_DOC).option("multiLine", True).json(f"{root}/sentences.json")
    items = docs.select(F.coalesce("sample_rate", F.lit(16000)).alias("sample_rate"), F.explode("sentences").alias("item"))
    return parse_tts(items, read_headers(spark, root))


def write_synth(samples: DataFrame, stats: DataFrame, path: str) -> None:
    """Write planned samples (compressed, since each repeats its field names) and their statistics below a folder."""
    samples.write.mode("overwrite").option("compression", "gzip").json(f"{path}/samples")
    stats.write.mode("overwrite").json(f"{path}/stats")
