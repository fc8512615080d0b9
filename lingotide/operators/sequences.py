"""Filters and derived columns of the sentence dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.functions.text import romanization_style


def level_of(tags: Column, strict: bool = False) -> Column:
    """Level from the first ``hskN`` tag: the digit, or with ``strict`` the tag itself (levels 1..6)."""
    pattern = "^hsk[1-6]$" if strict else "^(?i)hsk[0-9]$"
    tag = F.try_element_at(F.filter(tags, lambda t: t.rlike(pattern)), F.lit(1))
    return tag if strict else F.substring(tag, 4, 1).cast("int")


def with_level(df: DataFrame, strict: bool = False, name: str = "level") -> DataFrame:
    return df.withColumn(name, level_of(F.col("tags"), strict))


def to_domain(items: DataFrame) -> DataFrame:
    """Fill the optional item fields and derive the level."""
    no_strings = F.array().cast("array<string>")
    filled = items.withColumns(
        {
            "gloss": F.coalesce("gloss", F.create_map().cast("map<string,string>")),
            "tokens": F.coalesce("tokens", no_strings),
            "tags": F.coalesce("tags", no_strings),
            "difficulty": F.coalesce("difficulty", F.lit(1)),
        }
    )
    if "voices" in items.columns:
        filled = filled.withColumn(
            "voices", F.coalesce("voices", F.array().cast(items.schema["voices"].dataType))
        )
    return with_level(filled)


def by_id(df: DataFrame, sequence_id) -> DataFrame:
    return df.filter(F.col("sequence_id") == sequence_id)


def by_tag(df: DataFrame, tag: str) -> DataFrame:
    """Rows carrying the tag; rows without tags never match."""
    return df.filter(F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def by_difficulty(df: DataFrame, difficulty: int) -> DataFrame:
    return df.filter(F.col("difficulty") == difficulty)


def by_level(df: DataFrame, level: int) -> DataFrame:
    return df.filter(F.col("level") == level)


def select_rows(
    df: DataFrame,
    ids: Sequence | None = None,
    levels: Sequence[str] | None = None,
    term: str = "",
    limit: int | None = None,
    shuffle_seed: int | None = None,
) -> DataFrame:
    """Review selection: id set, level-tag set and a case-insensitive term in text or romanization.

    Rows come sorted by id, or in a seeded shuffle; ``limit`` is the reviewer's page size.
    """
    chosen = with_level(df, strict=True, name="level_tag")
    if ids:
        chosen = chosen.filter(F.col("sequence_id").isin(list(ids)))
    if levels:
        chosen = chosen.filter(F.coalesce("level_tag", F.lit("")).isin([x.strip().lower() for x in levels]))
    if term.strip():
        needle = F.lit(term.strip().lower())
        in_text = F.contains(F.lower("text"), needle)
        in_romanization = F.coalesce(F.contains(F.lower("romanization"), needle), F.lit(False))
        chosen = chosen.filter(in_text | in_romanization)
    order = F.col("sequence_id") if shuffle_seed is None else F.xxhash64("sequence_id", F.lit(shuffle_seed))
    chosen = chosen.orderBy(order, "sequence_id")
    return chosen.limit(limit) if limit else chosen


def filter_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``wanted``."""
    return df.join(wanted.select(key), key, "left_semi")


def filter_speakers(df: DataFrame, speakers: Sequence) -> DataFrame:
    return df.filter(F.col("speaker").isin(list(speakers)))


def resolve_voice(voices: Column, selector: str, strict: bool = False) -> Column:
    """URI of the selected voice: a gender word or an exact id, else the first voice (none if ``strict``).

    A gender word matches the URI folder, or any part of the id or label; so ``male`` also
    matches ``female`` ids and labels.
    """
    wanted = selector.strip().lower()

    def matches(v: Column) -> Column:
        if strict:
            return v["id"] == selector
        if wanted in ("female", "male"):
            label = F.lower(F.coalesce(F.to_json(v["label"]), F.lit("{}")))
            return (
                F.contains(F.lower(F.coalesce(v["uri"], F.lit(""))), F.lit(f"/{wanted}/"))
                | F.contains(F.lower(F.coalesce(v["id"], F.lit(""))), F.lit(wanted))
                | F.contains(label, F.lit(wanted))
            )
        return F.lower(F.trim(F.coalesce(v["id"], F.lit("")))) == wanted

    first_match = F.try_element_at(F.filter(voices, matches), F.lit(1))["uri"]
    if strict:
        return first_match
    # a matching voice wins even when its URI is missing
    found = F.exists(voices, matches)
    return F.when(found, first_match).otherwise(F.try_element_at(voices, F.lit(1))["uri"])


def upsert_voice(voices: Column, voice: Column) -> Column:
    """Replace the voice with the same id, or append it."""
    return F.concat(F.filter(voices, lambda v: v["id"] != voice["id"]), F.array(voice))


def with_audio(df: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Rows that have a recording."""
    return df.join(catalog.select(key), key, "left_semi")


def missing_audio(df: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Rows that have no recording."""
    return df.join(catalog.select(key), key, "left_anti")


# Recording formats from most to least preferred.
FORMAT_ORDER = ["wav", "m4a"]


def join_recordings(sequences: DataFrame, catalog: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Each sequence with its preferred recording; sequences or files without a partner are dropped."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMAT_ORDER]), F.col("ext"))
    best = catalog.filter(rank > 0).groupBy(key).agg(F.min_by("path", F.struct(rank, F.col("path"))).alias("path"))
    return sequences.join(best, key)


def review_summary(rows: DataFrame, catalog: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Row count, rows without recording and rows not in tone-mark style."""
    present = catalog.select(key).distinct().withColumn("_present", F.lit(True))
    marked = rows.join(present, key, "left")
    return marked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("_present").isNull()).alias("missing_audio"),
        F.count_if(romanization_style(F.coalesce("romanization", F.lit(""))) != "tone-mark").alias("tone_mark_issues"),
    )
