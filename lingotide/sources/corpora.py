"""Corpus assembly: pairing, multi-source loading, inventories, splits, samples and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingotide.functions.draws import draw
from lingotide.functions.pinyin import parse_numbered
from lingotide.functions.units import HOP, WINDOW
from lingotide.operators.blocks import number_rows, number_sorted
from lingotide.sources.audio import read_headers
from lingotide.sources.transcripts import read_interleaved


def join_transcripts(files: DataFrame, transcripts: DataFrame, key: str = "utt_id") -> DataFrame:
    """Utterance files with their transcript; unmatched rows on either side are dropped."""
    return files.join(transcripts, key)


def pair_features(meta: DataFrame, feats: DataFrame, key: str = "utt_id", hop: int = HOP, window: int = WINDOW) -> DataFrame:
    """Metadata with features; rows without features or syllables are dropped.

    ``meta`` has n_syllables and audio_num_samples, ``feats`` has n_frames. The sample count falls back to
    what the frames cover.
    """
    covered = F.greatest(F.lit(0), (F.col("n_frames") - 1) * hop + window)
    given = F.col("audio_num_samples")
    return (
        meta.filter("n_syllables > 0")
        .join(feats, key)
        .withColumn("total_samples", F.when(given > 0, given).otherwise(covered).cast("long"))
    )


def even_ranges(total: str, n: str) -> Column:
    """array<struct<start, end>>: n even ranges of samples, the last one running to the end."""
    return F.expr(
        f"transform(sequence(0, {n} - 1), i -> named_struct('start', i * ({total} div {n}), 'end', if(i = {n} - 1, {total}, (i + 1) * ({total} div {n}))))"
    )


def native_sentences(transcripts: DataFrame, headers: DataFrame, speakers: Sequence[str] | None = None) -> DataFrame:
    """Native recordings in the common shape: id, speaker, audio_path, text, syllables, boundaries, sample_rate, total_samples.

    ``transcripts`` has utt_id, hanzi and numbered pinyin; ``headers`` are those of the waves below ``<speaker>/<utt>.wav``. A syllable is
    (hanzi, pinyin, tone), its character being that of its place; without pinyin every Chinese character is a syllable without a tone.
    Boundaries are even. Recordings without transcript, syllables or samples are dropped, as are those of other ``speakers``.
    """
    at = "([^/]+)/([^/]+)\\.wav$"
    files = headers.filter("n_frames > 0").select(
        F.regexp_extract("path", at, 1).alias("speaker"), F.regexp_extract("path", at, 2).alias("utt_id"), F.col("path").alias("audio_path"),
        "sample_rate", F.col("n_frames").cast("long").alias("total_samples"),
    )
    if speakers is not None:
        files = files.filter(F.col("speaker").isin(list(speakers)))
    characters = F.split("hanzi", "")
    # both lists are built once a row; surplus characters are cut by the number of syllables
    spoken = F.zip_with(
        F.col("_parsed"),
        F.slice(characters, F.lit(1), F.size("_parsed")),
        lambda p, c: F.struct(F.coalesce(c, F.lit("")).alias("hanzi"), p["base"].alias("pinyin"), p["tone"].alias("tone")),
    )
    unspoken = F.transform(
        F.filter(characters, lambda c: c.rlike("^[\\x{4E00}-\\x{9FFF}]$")),
        lambda c: F.struct(c.alias("hanzi"), F.lit("").alias("pinyin"), F.lit(0).alias("tone")),
    )
    rows = join_transcripts(files, transcripts.select("utt_id", "hanzi", "pinyin"))
    rows = rows.withColumn("_parsed", F.when(F.trim("pinyin") != "", parse_numbered(F.col("pinyin"))))
    # a generated row holds the syllables, so that their number is not asked of lists built anew
    rows = rows.withColumn("syllables", F.explode(F.array(F.when(F.trim("pinyin") == "", unspoken).otherwise(spoken))))
    rows = rows.filter(F.size("syllables") > 0).withColumn("_n", F.size("syllables"))
    return rows.select(
        F.col("utt_id").alias("id"), "speaker", "audio_path", F.col("hanzi").alias("text"), "syllables",
        even_ranges("total_samples", "_n").alias("boundaries"), "sample_rate", "total_samples",
    )


def read_native(spark: SparkSession, root: str, speakers: Sequence[str] | None = None) -> DataFrame:
    """A corpus folder of native recordings: ``content.txt`` with interleaved transcripts, waves below ``wav/<speaker>/``."""
    return native_sentences(read_interleaved(spark, f"{root}/content.txt"), read_headers(spark, f"{root}/wav"), speakers)


# Corpus domains, native recordings and synthetic speech.
NATIVE, TTS = 0, 1


def load_sources(
    sources: DataFrame | Sequence[tuple[str, DataFrame]], known: dict[str, int], key: str = "id", cap: int | None = None
) -> DataFrame:
    """Known sources in one shape, with ``source`` and ``domain`` labels; unknown names are skipped.

    ``sources`` is one frame with a ``source`` column, read once, or separate frames by name, which are put together
    by column names. ``cap`` is the requested number of sentences per source: None means all, 0 none; the first ones
    by key are taken, and each task keeps no more than that of a source before they meet.
    """
    if isinstance(sources, DataFrame):
        domains = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        rows = sources.filter(F.col("source").isin(list(known))).withColumn("domain", F.element_at(domains, F.col("source")))
        if cap is None:
            return rows
        place = F.row_number().over(Window.partitionBy("source").orderBy(key))
        return rows.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
    out = None
    for name, df in sources:
        if name not in known:
            continue
        part = df if cap is None else df.orderBy(key).limit(cap)
        part = part.withColumn("source", F.lit(name)).withColumn("domain", F.lit(known[name]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no known source was given")
    return out


def source_info(df: DataFrame, declared: Sequence[tuple[str, str]], splits: Sequence[str], text: str = "text") -> DataFrame:
    """Inventory of the declared sources: (source, split, description, available, n_sentences); blank lines do not count."""
    counts = df.filter(F.trim(text) != "").groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(d).alias("description")) for n, d in declared])
    names = df.sparkSession.range(1).select(F.inline(rows)).withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    found = names.join(counts, ["source", "split"], "left")
    return found.select(
        "source", "split", "description", F.col("n").isNotNull().alias("available"), F.coalesce("n", F.lit(0)).alias("n_sentences")
    )


# bits of a draw, and rows of the bucket with the cut that are put in order
HASH_BITS = 60
CUT_ROWS = 1 << 20


def train_split(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``split`` ('train' or 'validation'): exactly int(n * fraction) train rows, by hash order of the unique key.

    One aggregation counts the rows by the leading bits of their hash, at most 65,536 counters whatever the input. They tell the bucket
    with the cut, and the rows of that bucket alone are put in order. A bucket that is still large is counted by its next bits first.
    The rows themselves are labelled in one pass without a shuffle.
    """
    hashed = draw(seed, key)
    inside, shift = df.select(hashed.alias("_h"), key), HASH_BITS
    need: int | None = None
    while True:
        shift -= 16
        counts = inside.groupBy(F.shiftright("_h", shift).alias("_b")).agg(F.count(F.lit(1)).alias("_n")).toPandas().sort_values("_b")
        upto = counts["_n"].cumsum()
        need = int(counts["_n"].sum() * fraction) if need is None else need
        if need == 0:
            return df.withColumn("split", F.lit("validation"))
        at = int(upto.searchsorted(need))
        bucket, rows = int(counts["_b"].iloc[at]), int(counts["_n"].iloc[at])
        need -= int(upto.iloc[at]) - rows
        inside = inside.filter(F.shiftright("_h", shift) == bucket)
        if rows <= CUT_ROWS or shift < 16:
            break
    # keys that share the hash at the cut are told apart by the key
    last = inside.orderBy("_h", key).limit(need).agg(F.max(F.struct("_h", key)).alias("last")).first()["last"]
    train = (hashed < last["_h"]) | ((hashed == last["_h"]) & (F.col(key) <= last[key]))
    return df.withColumn("split", F.when(train, "train").otherwise("validation"))


def add_test_split(split: DataFrame, official: DataFrame) -> DataFrame:
    """Append a separate official test set."""
    return split.unionByName(official.withColumn("split", F.lit("test")), allowMissingColumns=True)


def stratified_sample(df: DataFrame, key: str, words: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows: a third from each word-count stratum (up to 3, 4 to 6, above 6), topped up from the rest.

    Each stratum gives its first n rows in hash order (every task keeps n of its own), and the pick is
    made among those.
    """
    stratum = F.when(words <= 3, 0).when(words <= 6, 1).otherwise(2)
    rows = df.withColumn("stratum", stratum).withColumn("_h", draw(seed, key))
    strata = [rows.filter(F.col("stratum") == k).orderBy("_h", key).limit(n) for k in range(3)]
    candidates = strata[0].union(strata[1]).union(strata[2])
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("_h", key))
    first = F.col("_rank") <= max(1, n // 3)
    order = [~first, F.when(first, F.col("stratum")), "_h", key]
    return candidates.withColumn("_rank", rank).orderBy(*order).limit(n).drop("_h", "_rank")


def assign_shards(utts: DataFrame, size: int, order: Sequence[str], block: Column) -> DataFrame:
    """Add ``shard_id``: consecutive runs of ``size`` utterances in order, the last one partial."""
    numbered = number_rows(utts, [], list(order), block, "_no")
    return numbered.withColumn("shard_id", F.floor(F.col("_no") / size)).drop("_no")


def write_shards(utts: DataFrame, path: str, size: int = 1000, order: Sequence[str] = ("speaker", "utt_id")) -> None:
    """Write utterances in order as shards of exactly ``size`` rows, the last one partial, replacing earlier output.

    Each shard is one folder ``shard_id=<n>`` with one file: all its rows are dealt to one task.
    """
    numbered = number_sorted(utts, list(order), "_no").withColumn("shard_id", F.floor(F.col("_no") / size))
    dealt = numbered.drop("_no").repartition("shard_id").sortWithinPartitions("shard_id", *order)
    dealt.write.mode("overwrite").partitionBy("shard_id").parquet(path)
