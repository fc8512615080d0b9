"""Syllable annotation of sentences: romanization to syllable rows, tone sandhi, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.functions import pinyin as PY
from lingotide.functions.text import WHITESPACE, strip
from lingotide.operators.blocks import BLOCK_ROWS, halo, halo_window, own_rows


def _cut(df: DataFrame, key: str, text: str, romanization: str) -> DataFrame:
    """(key, _chars, _pieces) of texts with Chinese characters; there may be more or fewer pieces than characters."""
    given = F.coalesce(text, F.lit(""))
    # sought in the text itself, so that the characters are picked once
    rows = df.filter(given.rlike("[\\x{4E00}-\\x{9FFF}]"))
    chinese = F.regexp_replace(given, "[^\\x{4E00}-\\x{9FFF}]+", "")
    rows = rows.select(key, F.coalesce(romanization, F.lit("")).alias("_rom"), chinese.alias("_text")).select(
        key,
        "_rom",
        F.length("_text").alias("_n"),
        F.split("_text", "").alias("_chars"),
        F.split(strip(F.col("_rom")), f"[{WHITESPACE}]+").alias("_tokens"),
    )
    return PY.split_unspaced(rows, "_rom", "_tokens", "_n", "_pieces").select(key, "_chars", "_pieces")


def syllable_arrays(df: DataFrame, key: str, text: str = "text", romanization: str = "romanization") -> DataFrame:
    """Chinese characters of each text paired with their pinyin: (key, syllables array<struct<hanzi, pinyin>>).

    Where the romanization has one token per character its tokens are used; other rows are cut by expressions as well, so nothing
    leaves the plan. Missing pieces become '' and surplus ones are cut; texts without Chinese characters are left out.
    """
    cut = _cut(df, key, text, romanization)
    zipped = F.transform(
        F.arrays_zip("_chars", F.slice("_pieces", F.lit(1), F.size("_chars")).alias("_pieces")),
        lambda z: F.struct(z["_chars"].alias("hanzi"), F.coalesce(z["_pieces"], F.lit("")).alias("pinyin")),
    )
    return cut.select(key, zipped.alias("syllables"))


def explode_syllables(df: DataFrame, key: str, text: str = "text", romanization: str = "romanization") -> DataFrame:
    """One row per Chinese character with its pinyin: (key, idx, hanzi, pinyin, base, initial, final, tone).

    The rows are those of :func:`syllable_arrays`; a character takes its piece by its place, so no pairs are built.
    """
    # the arrays are never empty; the inner form would have Spark filter by their size and work them out twice
    rows = _cut(df, key, text, romanization).select(key, "_pieces", F.posexplode_outer("_chars").alias("idx", "hanzi"))
    rows = rows.select(key, "idx", "hanzi", F.coalesce(F.get("_pieces", F.col("idx")), F.lit("")).alias("pinyin"))
    return PY.with_parsed(rows, "pinyin").select(key, "idx", "hanzi", "pinyin", "base", "initial", "final", "tone")


def read_numbered(df: DataFrame, key: str, pinyin: str) -> DataFrame:
    """Syllable rows (key, idx, base, tone) of numbered pinyin text."""
    return df.select(key, F.posexplode(PY.parse_numbered(F.col(pinyin))).alias("idx", "s")).select(
        key, "idx", "s.base", "s.tone"
    )


def _third(surface: Column, following: Column) -> Column:
    return F.when((surface == 3) & (following == 3), 2).otherwise(surface)


def _yi(name: Column, underlying: Column, surface: Column, following: Column) -> Column:
    applies = (F.lower(name) == "yi") & (underlying == 1)
    return F.when(applies & (following == 4), 2).when(applies & following.isin(1, 2, 3), 4).otherwise(surface)


def _bu(name: Column, underlying: Column, surface: Column, following: Column) -> Column:
    applies = (F.lower(name) == "bu") & (underlying == 4)
    return F.when(applies & (following == 4), 2).otherwise(surface)


def apply_sandhi(
    syl: DataFrame,
    key: str,
    rules: tuple[str, ...] = ("third", "yi", "bu"),
    match_marked: bool = False,
    block: int = BLOCK_ROWS,
    keep_block: str | None = None,
) -> DataFrame:
    """Add ``surface`` tones: third-tone runs, then yi, then bu, each reading the tones left by the rule before.

    A rule looks one syllable ahead, so three following rows decide a row, and long sentences are worked
    in blocks. The rules share one shuffle. With ``match_marked`` the yi/bu rules compare
    the ``pinyin`` column as written instead of the base form. ``keep_block`` names a column for the block of a row, by which
    later steps can go on in the same order.
    """
    name = F.col("pinyin" if match_marked else "base")
    ahead = F.lead("surface").over(halo_window([key], "idx"))
    out = halo(syl.withColumn("surface", F.col("tone")), "idx", after=3, rows=block)
    for rule in rules:
        out = out.withColumn("_ahead", ahead)
        if rule == "third":
            new = _third(F.col("surface"), F.col("_ahead"))
        elif rule == "yi":
            new = _yi(name, F.col("tone"), F.col("surface"), F.col("_ahead"))
        else:
            new = _bu(name, F.col("tone"), F.col("surface"), F.col("_ahead"))
        out = out.withColumn("surface", new).drop("_ahead")
    return own_rows(out.withColumn(keep_block, F.col("_block")) if keep_block else out)


def training_rows(sentences: DataFrame, key: str, syllables: str = "syllables", max_position: int | None = None) -> DataFrame:
    """One row per syllable with target base and tone, sentence length and the bases before it.

    ``syllables`` is the nested array<struct<base, tone>> of a sentence, so no shuffle is needed.
    """
    rows = sentences.select(
        key,
        F.col(f"{syllables}.base").alias("_bases"),
        F.size(syllables).alias("n_syllables"),
        F.posexplode(syllables).alias("idx", "s"),
    )
    if max_position is not None:
        rows = rows.filter(F.col("idx") <= max_position)
    return rows.select(
        key,
        "idx",
        F.col("s.base").alias("target_base"),
        F.col("s.tone").alias("target_tone"),
        "n_syllables",
        F.slice("_bases", F.lit(1), F.col("idx")).alias("context"),
    )


def with_context(sentences: DataFrame, key: str, syllables: str = "syllables") -> DataFrame:
    """Each syllable with the ordered bases strictly before it."""
    return training_rows(sentences, key, syllables).select(key, "idx", F.col("target_base").alias("base"), "context")
