"""Conformance reports: dataset schema rules and recording checks, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the sentence dataset schema.
PATTERNS = {
    "schema_version": "^[0-9]+\\.[0-9]+\\.[0-9]+$",
    "dataset_id": "^[a-z0-9_]+$",
    "language": "^[a-z]{2}(-[A-Z]{2})?$",
    "id": "^ts_[0-9]{6}$",
    "uri": "^(assets|file|https?)://",
}


def _rule(broken: Column, name: str) -> Column:
    return F.when(broken, F.lit(name))


def validate_sentences(items: DataFrame) -> DataFrame:
    """(dataset_id, id, rule) for every broken rule of the dataset schema.

    ``items`` has the header columns, the item fields and ``voices``; a dataset without items is one
    row with a null ``id`` and null ``text``. Duplicate ids within a dataset are reported as well.
    """
    header = ["schema_version", "dataset_id", "language", "generated_at"]
    empty = F.col("id").isNull() & F.col("text").isNull()
    rules = [_rule(F.col(c).isNull(), f"{c}_required") for c in header]
    rules += [
        _rule(~F.col(c).rlike(PATTERNS[c]), f"{c}_pattern") for c in ("schema_version", "dataset_id", "language")
    ]
    rules += [
        _rule(empty, "items_empty"),
        _rule(~empty & F.col("id").isNull(), "id_required"),
        _rule(~F.col("id").rlike(PATTERNS["id"]), "id_pattern"),
        _rule(~empty & F.col("text").isNull(), "text_required"),
        _rule(F.length("text") == 0, "text_min_length"),
        _rule((F.col("difficulty") < 1) | (F.col("difficulty") > 5), "difficulty_range"),
        _rule(F.exists("voices", lambda v: v["id"].isNull()), "voice_id_required"),
        _rule(F.exists("voices", lambda v: v["uri"].isNull()), "voice_uri_required"),
        _rule(F.exists("voices", lambda v: ~v["uri"].rlike(PATTERNS["uri"])), "voice_uri_pattern"),
        _rule(F.exists("voices", lambda v: v["duration_ms"] < 0), "voice_duration_minimum"),
    ]
    broken = items.select("dataset_id", "id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    repeated = (
        items.filter("id IS NOT NULL")
        .groupBy("dataset_id", "id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("dataset_id", "id", F.lit("id_duplicate").alias("rule"))
    )
    return broken.union(repeated)


def validate_recordings(catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """(utt_id, check, passed, expected, actual) for the format and content checks of each recording.

    ``catalog`` has utt_id, sample_rate, channels, sample_width and n_samples; ``samples`` has utt_id and
    x in [-1, 1]. Content is reduced to one row per recording before the join.
    """
    content = samples.groupBy("utt_id").agg(
        F.max(F.abs("x")).alias("peak"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
        F.avg((F.abs("x") >= 0.99).cast("double")).alias("clipped"),
    )
    both = catalog.join(content, "utt_id", "left")
    seconds = F.when(F.col("sample_rate") > 0, F.col("n_samples") / F.col("sample_rate")).otherwise(0.0)
    checks = [
        ("sample_rate", F.col("sample_rate") == 16000, "16000", F.col("sample_rate")),
        ("channels", F.col("channels") == 1, "1", F.col("channels")),
        ("bit_depth", F.col("sample_width") == 2, "2", F.col("sample_width")),
        ("duration", (seconds >= 0.1) & (seconds <= 60), "0.1 to 60", seconds),
        ("amplitude", F.col("peak") <= 1.0, "<= 1.0", F.col("peak")),
        ("level", F.col("rms") >= 0.001, ">= 0.001", F.col("rms")),
        ("clipping", F.col("clipped") < 0.01, "< 0.01", F.col("clipped")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.coalesce(ok, F.lit(False)).alias("passed"),
                F.lit(expected).alias("expected"),
                actual.cast("double").alias("actual"),
            )
            for name, ok, expected, actual in checks
        ]
    )
    return both.select("utt_id", F.inline(rows))
