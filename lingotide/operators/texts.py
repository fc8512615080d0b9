"""Text jobs: scoring of recognized text, generated-record intake, synthesis work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingotide.functions import text as T
from lingotide.operators.blocks import number_sorted

METHOD = "asr_cer_v1"


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Distance, error rate, score and completeness of each (ref, hyp) after normalization."""
    n = pairs.withColumn("_r", T.normalize_text(F.col("ref"))).withColumn("_h", T.normalize_text(F.col("hyp")))
    n = n.withColumn("distance", T.edit_distance(F.col("_r"), F.col("_h")))
    n = n.withColumn("cer", T.error_rate(F.col("distance"), F.col("_r"), F.col("_h")))
    return n.select(
        *pairs.columns,
        "distance",
        "cer",
        T.error_score(F.col("cer")).alias("score"),
        T.completeness(F.col("distance"), F.col("_r"), F.col("_h")).alias("completeness"),
        F.length("_r").alias("ref_length"),
        F.length("_h").alias("hyp_length"),
    )


def asr_grade(pairs: DataFrame) -> DataFrame:
    """One grade per utterance; a failed recognition (null hyp) scores zero and carries an error."""
    scored = score_pairs(pairs)
    failed = F.col("hyp").isNull()
    return scored.select(
        "id",
        F.lit(METHOD).alias("method"),
        F.when(failed, 0).otherwise(F.col("score")).alias("overall"),
        F.when(failed, 0).otherwise(F.col("score")).alias("accuracy"),
        F.when(failed, 0).otherwise(F.col("completeness")).alias("completeness"),
        F.col("hyp").alias("recognized_text"),
        "cer",
        F.col("distance").alias("edit_distance"),
        F.when(~failed, F.col("ref_length")).alias("ref_length"),
        "hyp_length",
        F.when(failed, "recognition_failed").alias("error"),
    )


def corpus_error_rate(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Micro error rate over token id lists, and the share of exact matches, per group."""
    scored = pairs.withColumn("_d", T.token_distance(F.col("ref"), F.col("hyp")))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(F.sum("_d"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.size("ref")), F.lit(0)).alias("ref_tokens"),
        F.coalesce(F.try_divide(F.sum("_d"), F.sum(F.size("ref"))), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.avg((F.col("_d") == 0).cast("double")), F.lit(0.0)).alias("exact_share"),
    )


ITEM = "struct<text:string,romanization:string,translation:string,tags:array<string>,difficulty:int>"


def generated_items(batches: DataFrame) -> DataFrame:
    """(batch_id, language, response, items): the items of each generated JSON response, null where it holds none.

    A response holds its items under ``sentences`` or ``items``, or is itself a list or a single item.
    """
    doc = F.from_json("response", f"struct<sentences:array<{ITEM}>,items:array<{ITEM}>>")
    as_list = F.from_json("response", f"array<{ITEM}>")
    as_item = F.from_json("response", ITEM)
    given = F.when(F.size(doc["sentences"]) > 0, doc["sentences"]).when(F.size(doc["items"]) > 0, doc["items"])
    whole = F.when(F.ltrim("response").startswith("["), as_list).otherwise(F.array(as_item))
    # a malformed response or an empty list has no item
    items = F.filter(F.coalesce(given, whole), lambda item: item.isNotNull() & (F.to_json(item) != "{}"))
    return batches.select("batch_id", "language", "response", F.when(F.size(items) > 0, items).alias("items"))


def failed_batches(batches: DataFrame) -> DataFrame:
    """(batch_id, language, response, reason) of the responses that give no item, with the text as it came."""
    blank = F.coalesce(F.trim("response"), F.lit("")) == ""
    reason = F.when(blank, "no response").when(F.try_parse_json("response").isNull(), "no JSON").otherwise("no items")
    failed = generated_items(batches).filter(F.col("items").isNull())
    return failed.select("batch_id", "language", "response", reason.alias("reason"))


def normalize_generated(batches: DataFrame, start: int = 1) -> DataFrame:
    """Items of generated JSON responses as dataset rows with running ids.

    ``batches`` has batch_id, language and response. Ids run over batches in batch order; :func:`failed_batches` has the
    responses without any.
    """
    items = generated_items(batches).select("batch_id", "language", F.posexplode("items").alias("pos", "item"))
    numbered = number_sorted(items, ["batch_id", "pos"], "_no")
    stripped = T.strip(F.coalesce("item.text", F.lit("")))
    chinese = F.lower("language").startswith("zh")
    return numbered.select(
        F.format_string("ts_%06d", F.col("_no") + start).alias("id"),
        F.when(chinese, F.regexp_replace(stripped, f"[{T.TRAILING_PUNCTUATION}]+$", "")).otherwise(stripped).alias("text"),
        F.col("item.romanization").alias("romanization"),
        F.create_map(F.lit("en"), F.coalesce("item.translation", F.lit(""))).alias("gloss"),
        F.coalesce("item.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("item.difficulty", F.lit(1)).alias("difficulty"),
        "language",
    )


def numeric_pinyin_errors(items: DataFrame) -> DataFrame:
    """An error row for each item whose romanization uses tone numbers."""
    return items.filter(T.has_numeric_pinyin(F.col("romanization"))).select(
        "id", F.format_string("Numerical pinyin detected in '%s': '%s'", "text", "romanization").alias("message")
    )


def stale_audio(
    sequences: DataFrame, voices: Sequence[str], manifest: DataFrame, files: DataFrame
) -> DataFrame:
    """(id, voice) whose audio file is missing or whose recorded text hash is not the current one.

    The voices are a short parameter list exploded in place; manifest (voice, id, text_hash) and
    files (voice, id) join on both keys.
    """
    wanted = sequences.select(
        "id", F.sha2("text", 256).alias("text_hash"), F.explode(F.array(*[F.lit(v) for v in voices])).alias("voice")
    )
    known = manifest.select("voice", "id", F.col("text_hash").alias("known_hash"))
    present = files.select("voice", "id").distinct().withColumn("_present", F.lit(True))
    return (
        wanted.join(known, ["voice", "id"], "left")
        .join(present, ["voice", "id"], "left")
        .filter(F.col("_present").isNull() | ~F.col("known_hash").eqNullSafe(F.col("text_hash")))
        .select("id", "voice", "text_hash")
    )
