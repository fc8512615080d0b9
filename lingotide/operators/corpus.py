"""Lexicon lookups, coverage, vocabulary ids and synthetic-corpus planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingotide.functions.pinyin import base_pinyin
from lingotide.operators.blocks import BLOCK_ROWS, block_of, merge_rows, running_sum
from lingotide.session import staged

# Which initials combine with which finals.
GENERAL_INITIALS = ["b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "zh", "ch", "sh", "r", "z", "c", "s"]
I_INITIALS = ["b", "p", "m", "d", "t", "n", "l", "j", "q", "x"]
GENERAL_FINALS = ["a", "o", "e", "ai", "ei", "ao", "ou", "an", "en", "ang", "eng", "ong"]
I_FINALS = ["i", "ia", "ie", "iao", "iu", "ian", "in", "iang", "ing", "iong"]
U_FINALS = ["u", "ua", "uo", "uai", "ui", "uan", "un", "uang", "ueng"]
UMLAUT_FINALS = ["ü", "üe", "üan", "ün"]
# Syllables that stand without an initial.
STANDALONE = [
    "a", "o", "e", "ai", "ei", "ao", "ou", "an", "en", "ang", "eng", "er", "yi", "ya", "ye", "yao", "you",
    "yan", "yin", "yang", "ying", "yong", "wu", "wa", "wo", "wai", "wei", "wan", "wen", "wang", "weng", "yu", "yue", "yuan",
    "yun",
]
# sibilants and r take a bare i that no class above gives
BARE_I = ["zhi", "chi", "shi", "ri", "zi", "ci", "si"]
NOT_SYLLABLES = ["buo", "puo", "muo", "fuo", "fei", "gei", "kei", "hei", "zhei", "shei"]

COMBINATIONS = [
    (GENERAL_INITIALS, GENERAL_FINALS + U_FINALS),
    (I_INITIALS, I_FINALS),
    (["j", "q", "x"], ["u", "ue", "uan", "un"]),
    (["n", "l"], UMLAUT_FINALS),
    ([""], STANDALONE + BARE_I),
]


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def valid_syllables(spark: SparkSession) -> DataFrame:
    """All Mandarin base syllables: (syllable), distinct."""
    rules = F.array(
        *[F.struct(_strings(i).alias("initials"), _strings(f).alias("finals")) for i, f in COMBINATIONS]
    )
    combined = (
        spark.range(1)
        .select(F.explode(rules).alias("r"))
        .select(F.explode("r.initials").alias("initial"), F.col("r.finals").alias("finals"))
        .select("initial", F.explode("finals").alias("final"))
        .select(F.concat("initial", "final").alias("syllable"))
    )
    return combined.filter(~F.col("syllable").isin(NOT_SYLLABLES)).distinct()


def latest_entries(entries: DataFrame, position: str = "pos") -> DataFrame:
    """One lexicon entry per (voice_id, base, tone): the last one wins; a missing duration is 0."""
    keys = ["voice_id", "base", "tone"]
    rest = [c for c in entries.columns if c not in (*keys, position)]
    kept = entries.withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("e")).select(*keys, "e.*")


def _with_durations(syl: DataFrame, lexicon: DataFrame, voices: Sequence[str]) -> DataFrame:
    """Syllables with ``_duration_<k>`` of voice k: the entry of the surface tone, else of the underlying one, else null.

    The (at most five) tones of a base are folded into one map a voice, so a syllable meets the lexicon once for all voices.
    The folded lexicon is written once, since its size then tells Spark whether the syllables must move.
    """
    tones = lexicon.groupBy("voice_id", "base").agg(F.map_from_entries(F.collect_list(F.struct("tone", "duration_ms"))).alias("_tones"))
    folded = [F.first(F.when(F.col("voice_id") == v, F.col("_tones")), True).alias(f"_tones_{k}") for k, v in enumerate(voices)]
    by_base = tones.filter(F.col("voice_id").isin(list(voices))).groupBy("base").agg(*folded)
    joined = syl.join(staged(by_base, "lexicon-by-base"), "base", "left")

    def found(k: int) -> Column:
        return F.coalesce(F.try_element_at(f"_tones_{k}", F.col("surface")), F.try_element_at(f"_tones_{k}", F.col("tone")))

    return joined.select(*syl.columns, *[found(k).alias(f"_duration_{k}") for k in range(len(voices))])


def lookup_audio(syl: DataFrame, lexicon: DataFrame, voices: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """Syllables with the duration of their lexicon entry for each voice: surface tone, else underlying tone.

    Syllables found under neither tone are skipped unless ``keep_missing``.
    """
    each = [F.struct(F.lit(v).alias("voice_id"), F.col(f"_duration_{k}").alias("duration_ms")) for k, v in enumerate(voices)]
    rest = [c for c in syl.columns if c != "base"]
    rows = _with_durations(syl, lexicon, voices).withColumn("_v", F.explode(F.array(*each)))
    out = rows.select("_v.voice_id", "base", *rest, "_v.duration_ms")
    return out if keep_missing else out.filter("duration_ms IS NOT NULL")


def needed_keys(syl: DataFrame) -> DataFrame:
    """(base, tone) as spoken, with occurrence counts: surface tone, or the underlying one if that is neutral."""
    tone = F.when(F.col("surface") != 0, F.col("surface")).otherwise(F.col("tone"))
    return syl.groupBy("base", tone.alias("tone")).agg(F.count(F.lit(1)).alias("n"))


def syllable_frequency(syl: DataFrame) -> DataFrame:
    """Occurrences per base and tone, most frequent first."""
    return needed_keys(syl).orderBy(F.col("n").desc(), "base", "tone")


def covered_keys(syl: DataFrame, lexicon: DataFrame, voice: str) -> DataFrame:
    """Needed keys the voice has."""
    return needed_keys(syl).join(lexicon.filter(F.col("voice_id") == voice), ["base", "tone"], "left_semi")


def missing_keys(syl: DataFrame, lexicon: DataFrame, voice: str) -> DataFrame:
    """Needed keys the voice lacks."""
    return needed_keys(syl).join(lexicon.filter(F.col("voice_id") == voice), ["base", "tone"], "left_anti")


def _marked_keys(syl: DataFrame, lexicon: DataFrame, voice: str) -> DataFrame:
    have = lexicon.filter(F.col("voice_id") == voice).select("base", "tone").distinct().withColumn("_have", F.lit(True))
    return needed_keys(syl).join(have, ["base", "tone"], "left").withColumn("covered", F.col("_have").isNotNull()).drop("_have")


UNDER_REPRESENTED = 3


def coverage_summary(syl: DataFrame, lexicon: DataFrame, voice: str, n_sentences: DataFrame) -> DataFrame:
    """One row: unique keys, covered, missing, percentage, keys seen fewer than three times, totals.

    ``n_sentences`` is one row with ``total_sentences``, which also counts sentences without romanization.
    """
    summary = _marked_keys(syl, lexicon, voice).agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.count_if("covered").alias("n_covered"),
        F.count_if(~F.col("covered")).alias("n_missing"),
        F.coalesce(F.avg(F.col("covered").cast("double")) * 100, F.lit(0.0)).alias("coverage_pct"),
        F.count_if(F.col("covered") & (F.col("n") < UNDER_REPRESENTED)).alias("n_under_represented"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_occurrences"),
    )
    return merge_rows(summary, n_sentences)


def coverage_report(syl: DataFrame, lexicon: DataFrame, voice: str) -> DataFrame:
    """Rows of the coverage report: first 20 missing keys, 30 rarest under-represented ones, 20 most frequent."""
    keys = _marked_keys(syl, lexicon, voice)
    name = F.concat("base", F.col("tone").cast("string"))
    missing = keys.filter(~F.col("covered")).select(F.lit("missing").alias("section"), name.alias("syllable"), "n")
    rare = keys.filter(F.col("covered") & (F.col("n") < UNDER_REPRESENTED)).select(
        F.lit("under_represented").alias("section"), name.alias("syllable"), "n"
    )
    frequent = keys.select(F.lit("most_frequent").alias("section"), name.alias("syllable"), "n")
    return (
        missing.orderBy("syllable").limit(20)
        .union(rare.orderBy("n", "syllable").limit(30))
        .union(frequent.orderBy(F.col("n").desc(), "syllable").limit(20))
    )


def unique_syllables(syl: DataFrame) -> DataFrame:
    """Distinct (base, underlying tone), sorted."""
    return syl.select("base", "tone").distinct().orderBy("base", "tone")


def lexicon_counts(lexicon: DataFrame) -> DataFrame:
    """Entries per voice, tone, syllable key and base: (dimension, value, n)."""
    key = F.concat("base", F.col("tone").cast("string"))
    parts = {"voice": F.col("voice_id"), "tone": F.col("tone").cast("string"), "syllable": key, "base": F.col("base")}
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), c.alias("value")) for k, c in parts.items()])
    return lexicon.select(F.inline(rows)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def lexicon_stats(lexicon: DataFrame) -> DataFrame:
    """One row: entries, distinct syllables and bases and voices, and positive durations (0 when there are none)."""
    positive = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return lexicon.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_distinct("base", "tone").alias("n_syllables"),
        F.count_distinct("base").alias("n_bases"),
        F.count_distinct("voice_id").alias("n_voices"),
        F.coalesce(F.min(positive), F.lit(0)).alias("min_ms"),
        F.coalesce(F.max(positive), F.lit(0)).alias("max_ms"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("mean_ms"),
    )


# Special token ids.
PAD, BOS, FIRST_SYLLABLE = 0, 1, 2


def encode(syl: DataFrame, vocab: DataFrame, key: str, add_bos: bool = True) -> DataFrame:
    """Token ids of syllable rows: (key, pos, token_id); unknown syllables are 0, an optional 1 leads each sentence.

    ``vocab`` has syllable and token_id.
    """
    ids = vocab.select(F.col("syllable").alias("_name"), "token_id")
    joined = syl.withColumn("_name", base_pinyin(F.col("base"), "vocab")).join(ids, "_name", "left")
    token = F.struct(
        (F.col("idx") + (1 if add_bos else 0)).alias("pos"), F.coalesce("token_id", F.lit(PAD)).cast("int").alias("token_id")
    )
    if not add_bos:
        return joined.select(key, token.alias("t")).select(key, "t.*")
    lead = F.when(F.col("idx") == 0, F.struct(F.lit(0).alias("pos"), F.lit(BOS).alias("token_id")))
    return joined.select(key, F.inline(F.array_compact(F.array(lead, token))))


def decode(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add the syllable of each token_id, with names for the special and the unknown ids."""
    names = vocab.select("token_id", F.col("syllable").alias("_name"))
    name = F.when(F.col("token_id") == PAD, "<PAD>").when(F.col("token_id") == BOS, "<BOS>")
    return (
        ids.join(names, "token_id", "left")
        .withColumn("syllable", name.otherwise(F.coalesce("_name", F.lit("<UNK>"))))
        .drop("_name")
    )


def ctc_targets(syl: DataFrame, vocab: DataFrame, key: str, tone: Column | None = None) -> DataFrame:
    """Targets with blank 0: syllable ids shifted down by one (at least 1), tones shifted up by one."""
    ids = vocab.select(F.col("syllable").alias("_name"), "token_id")
    joined = syl.withColumn("_name", base_pinyin(F.col("base"), "vocab")).join(ids, "_name", "left")
    return joined.select(
        key,
        "idx",
        F.greatest(F.lit(1), F.coalesce("token_id", F.lit(PAD)) - 1).cast("int").alias("syllable_target"),
        ((tone if tone is not None else F.col("surface")) + 1).alias("tone_target"),
    )


def expand_samples(sentences: DataFrame, key: str, voices: Sequence[str], n_augmentations: int) -> DataFrame:
    """Planned samples: sentence x voice x (base, then n augmentations), with their ids and noise flag."""
    last = n_augmentations - 1
    rows = sentences.withColumn("voice_id", F.explode(_strings(voices))).withColumn(
        "aug", F.explode(F.sequence(F.lit(-1), F.lit(last)))
    )
    plain = F.concat_ws("_", F.col(key).cast("string"), "voice_id")
    return rows.withColumns(
        {
            "sample_id": F.when(F.col("aug") < 0, plain).otherwise(F.concat(plain, F.lit("_aug"), F.col("aug").cast("string"))),
            "augmented": F.col("aug") >= 0,
            "noisy": (F.col("aug") >= 0) & (F.col("aug") % 2 == 0),
        }
    )


def timeline(
    syl: DataFrame,
    lexicon: DataFrame,
    key: str,
    voices: Sequence[str],
    gap_ms: int = 0,
    crossfade_ms: int = 0,
    sample_rate: int = 16000,
    block: str | None = None,
) -> DataFrame:
    """Spans of looked-up syllables laid end to end, with gaps, or overlapping by a crossfade.

    A gap goes before every placed syllable whose original idx is above 0. With a crossfade every
    placed piece after the first overlaps its predecessor and gets no gap. Pieces must be at least as
    long as the crossfade; a shorter one fails the job. ``block`` names a column that holds the block of ``idx``, by which
    the syllables may already be dealt out.
    """
    keys = [key, "voice_id"]
    gap, overlap = gap_ms * sample_rate // 1000, crossfade_ms * sample_rate // 1000

    def length(duration: str) -> Column:
        return (F.col(duration) * sample_rate / 1000).cast("long")

    def fitting(length: str) -> Column:
        if not overlap:
            return F.col(length)
        return F.when(F.col(length) < overlap, F.raise_error(F.lit("piece shorter than the crossfade"))).otherwise(F.col(length))

    def step(length: str) -> Column:
        return F.col(length) - overlap if overlap else F.col(length) + F.when(F.col("idx") > 0, gap).otherwise(0)

    last = syl.agg(F.max("idx")).first()[0]
    if (last is None or last < BLOCK_ROWS) and not (overlap and gap):
        # every sentence is one block: the voices' sums run side by side, in the order in which the syllables already lie
        lengths = {c: length(c.replace("_len", "_duration")) for c in (f"_len_{k}" for k in range(len(voices)))}
        rows = _with_durations(syl, lexicon, voices).withColumns(lengths)
        rows = rows.withColumns({c: fitting(c) for c in lengths})
        so_far = Window.partitionBy(key, *([block] if block else [])).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        sums = [F.sum(step(c)).over(so_far).alias(c.replace("_len", "_end")) for c in lengths]
        each = [
            F.struct(F.lit(v).alias("voice_id"), F.col(f"_len_{k}").alias("_len"), (F.col(f"_end_{k}") + overlap).alias("_end"))
            for k, v in enumerate(voices)
        ]
        rows = rows.select(key, "idx", *lengths, *sums).select(key, "idx", F.explode(F.array(*each)).alias("_v"))
        ends = rows.select(key, "idx", "_v.*").filter(F.col(key).isNotNull() & F.col("_len").isNotNull())
    else:
        found = lookup_audio(syl, lexicon, voices)
        placed = staged(found.select(*keys, "idx", length("duration_ms").alias("_len")), "placed-syllables")
        placed, shift = placed.withColumn("_len", fitting("_len")), F.lit(overlap)
        if overlap and gap:
            # only the first placed piece can have a gap before it
            first = placed.groupBy(*keys).agg(F.min("idx").alias("_first"))
            placed = placed.join(first, keys)
            shift = shift + F.when(F.col("_first") > 0, gap).otherwise(0)
        ends = running_sum(placed, keys, "idx", step("_len"), "_end", block_of("idx")).withColumn("_end", F.col("_end") + shift)
    start = F.col("_end") - F.col("_len")
    return ends.select(
        *keys,
        "idx",
        (start / sample_rate * 1000).cast("int").alias("start_ms"),
        (F.col("_end") / sample_rate * 1000).cast("int").alias("end_ms"),
        F.lit(1.0).alias("confidence"),
    )


def synth_stats(syl: DataFrame, lexicon: DataFrame, key: str, voices: Sequence[str], n_augmentations: int) -> DataFrame:
    """Statistics of the planned set: (tone, n, pct, total_samples, total_syllables, failed) for tones 0..4.

    A sentence and voice without a single known syllable counts as failed and gives no samples.
    """
    flags = [F.max(F.col(f"_duration_{k}").isNotNull()).alias(f"_ok_{k}") for k in range(len(voices))]
    counts = [F.count_if(F.col("surface") == t).alias(f"t{t}") for t in range(5)]
    # the tones of a sentence are the same for every voice, so they are counted once
    per_sentence = _with_durations(syl, lexicon, voices).groupBy(key).agg(*flags, *counts)
    per_voice = per_sentence.withColumn("ok", F.explode(F.array(*[F.col(f"_ok_{k}") for k in range(len(voices))])))
    times = n_augmentations + 1
    totals = per_voice.agg(
        (F.count_if("ok") * times).alias("total_samples"),
        F.count_if(~F.col("ok")).alias("failed"),
        *[(F.coalesce(F.sum(F.when(F.col("ok"), F.col(f"t{t}"))), F.lit(0)) * times).alias(f"t{t}") for t in range(5)],
    )
    total = sum((F.col(f"t{t}") for t in range(1, 5)), F.col("t0"))
    tones = F.array(*[F.struct(F.lit(t).alias("tone"), F.col(f"t{t}").alias("n")) for t in range(5)])
    rows = totals.select(F.inline(tones), total.alias("total_syllables"), "total_samples", "failed")
    return rows.withColumn("pct", F.col("n") * 100.0 / F.greatest(F.col("total_syllables"), F.lit(1)))


def pair_by_position(targets: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Targets with the span or score at the same position; surplus rows on either side are dropped.

    The other side is first cut to the keys that the targets have, so that its size tells whether the targets must move.
    """
    wanted = other.join(targets.select(key).distinct(), key, "left_semi")
    return targets.join(staged(wanted, "paired"), [key, "idx"])
