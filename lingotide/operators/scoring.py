"""Grading: class probabilities, frame decoding, target scores, tone and sentence scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.operators.blocks import BLOCK_ROWS, block_of, halo, halo_window, number_rows, own_rows

# Penalty by (expected, predicted) tone; any other confusion costs 0.5.
CONFUSION_PENALTIES = {
    (2, 3): 0.3,
    (3, 2): 0.3,
    (1, 4): 0.4,
    (4, 1): 0.4,
    (0, 1): 0.2,
    (0, 2): 0.3,
    (0, 3): 0.3,
    (0, 4): 0.2,
    (1, 0): 0.2,
    (2, 0): 0.3,
    (3, 0): 0.3,
    (4, 0): 0.2,
}
DEFAULT_PENALTY = 0.5
SEGMENTAL_SCORE = 0.7
TONE_WEIGHT, SEGMENTAL_WEIGHT = 0.7, 0.3
# placeholder fusion: tone, segmental and fluency weights over constant 0.5 scores
PLACEHOLDER_WEIGHTS, PLACEHOLDER_SCORE = (0.5, 0.4, 0.1), 0.5


def softmax(logits: Column) -> Column:
    """Probabilities of an array of class scores.

    Maximum and sum enter as arrays: named inside a lambda they would be worked out once per element.
    """
    n = F.size(logits)
    exps = F.zip_with(logits, F.array_repeat(F.array_max(logits), n), lambda x, top: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(exps, F.array_repeat(total, n), lambda x, t: x / t)


def argmax(values: Column) -> Column:
    """Position of the first largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def with_probs(frames: DataFrame, logits: str = "logits", name: str = "probs") -> DataFrame:
    """Add softmax probabilities; the class scores of a frame are one array, so this needs no shuffle."""
    return frames.withColumn(name, softmax(F.col(logits)))


def target_ranks(frames: DataFrame, probs: str = "probs", target: str = "target") -> DataFrame:
    """Add the probability of the target class and its rank: one more than the classes strictly above it."""
    at = F.try_element_at(probs, F.col(target) + 1)
    return frames.withColumn("target_prob", at).withColumn(
        "target_rank", (F.size(F.filter(probs, lambda p: p > F.col("target_prob"))) + 1)
    )


def ctc_decode(frames: DataFrame, key: str, token: str = "token", prob: str = "prob", block: int = BLOCK_ROWS) -> DataFrame:
    """Greedy decoding of per-frame tokens: repeats collapse, then blanks (0) go: (key, pos, frame_idx, token, prob).

    ``prob`` is taken at the first frame of each run. ``frame_idx`` must be dense.
    """
    previous = F.lag(token).over(halo_window([key], "frame_idx"))
    marked = halo(frames.select(key, "frame_idx", token, prob), "frame_idx", before=1, rows=block).withColumn("_previous", previous)
    kept = own_rows(marked).filter(
        (F.col("_previous").isNull() | (F.col("_previous") != F.col(token))) & (F.col(token) != 0)
    )
    return number_rows(kept.drop("_previous"), [key], ["frame_idx"], block_of("frame_idx", block), "pos")


def score_targets(targets: DataFrame, frames: DataFrame, key: str, probs: str = "probs") -> DataFrame:
    """Best probability of each target token over all frames of its utterance: (key, pos, token, score).

    Frames are reduced to one maximum per (utterance, token) before they meet the targets.
    """
    best = (
        frames.select(key, F.posexplode(probs).alias("token", "_p"))
        .groupBy(key, "token")
        .agg(F.max("_p").alias("score"))
    )
    return targets.join(best, [key, "token"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


class _AlignedWalk:
    """The monotone search of one utterance, fed with its frames in stretches.

    Carries the next target, the frame after the last match and the frames from there on. A target is decided as soon as its whole
    window has come in, so what is held is one window, not the utterance.
    """

    def __init__(self, tokens: list[int], n_frames: int) -> None:
        self.tokens, self.columns = np.unique(tokens, return_inverse=True)
        self.n_frames = n_frames
        self.scores: list[float] = []
        self.at = 0
        self.held: list[np.ndarray] = []
        self.first = self.come = 0

    def feed(self, block: np.ndarray) -> None:
        """Take the next frames, a row of class probabilities each; classes that have none score 0."""
        n = len(self.columns)
        if len(self.scores) == n:
            return
        known = (self.tokens >= 0) & (self.tokens < block.shape[1])
        own = np.zeros((len(block), len(self.tokens)))
        own[:, known] = block[:, self.tokens[known]]
        self.held.append(own)
        self.come += len(block)
        while len(self.scores) < n:
            share = (self.n_frames - self.at) // (n - len(self.scores))
            stop = max(self.at + 1, min(self.n_frames, self.at + share))
            if self.come < min(stop, self.n_frames):
                return
            window = self._rows(stop)[:, self.columns[len(self.scores)]]
            best = max(0.0, float(window.max(initial=0.0)))
            self.scores.append(best)
            self.at += 1 + (int(np.argmax(window)) if best > 0 else 0)

    def _rows(self, stop: int) -> np.ndarray:
        """Frames from the one after the last match up to ``stop``; earlier ones are let go."""
        rows = self.held[0] if len(self.held) == 1 else np.concatenate(self.held)
        rows = rows[max(0, self.at - self.first):]
        self.held, self.first = [rows], max(self.at, self.first)
        return rows[: max(0, stop - self.first)]


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column, the shorter ones filled up with 0; null counts as 0."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False)
    width = lengths.max(initial=0)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None] < lengths[:, None]] = values
    return out


def _walk_aligned(key: str):
    """Sorted rows of many utterances, each headed by a row with its targets, to (key, pos, score)."""

    def scores(owner, kind: pa.DataType, walk: _AlignedWalk) -> pa.RecordBatch:
        n = len(walk.scores)
        columns = [pa.array([owner] * n, type=kind), pa.array(range(n), pa.int32()), pa.array(walk.scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[key, "pos", "score"])

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = kind = walk = None
        for batch in batches:
            kind = batch.schema.field(key).type
            heads = np.flatnonzero(batch.column("_tokens").is_valid().to_numpy(zero_copy_only=False)).tolist()
            edges = sorted({0, *heads, batch.num_rows})
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                if start in heads:
                    if walk is not None:
                        yield scores(owner, kind, walk)
                    owner = part.column(key)[0].as_py()
                    walk = _AlignedWalk(part.column("_tokens")[0].as_py(), part.column("_n_frames")[0].as_py())
                    part = part.slice(1)
                # frames of utterances without targets are passed over; more frames than the utterance has are never looked at
                if part.num_rows and walk is not None and part.column(key)[0].as_py() == owner:
                    walk.feed(_matrix(part.column("_p")))
        if walk is not None:
            yield scores(owner, kind, walk)

    return walk_all


def score_aligned(targets: DataFrame, frames: DataFrame, key: str, probs: str = "probs") -> DataFrame:
    """Monotone greedy scores: (key, pos, score).

    Target i looks from the frame after the previous match through its proportional share of the
    remaining frames and takes the first best one; with no frames left it scores 0. Utterances without frames or without targets give nothing.

    The search is sequential within an utterance: its targets and then its frames pass through one task in order, in the one shuffle
    that there is, and only the state of the search is handed from batch to batch. What a task holds is
    one target's share of the frames, so recordings of any length pass.
    """
    lengths = frames.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("_n_frames"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"])
    heads = targets.groupBy(key).agg(tokens.alias("_tokens")).join(lengths, key)
    rows = (
        frames.select(key, "frame", F.col(probs).cast("array<double>").alias("_p"))
        .unionByName(heads, allowMissingColumns=True)
        .select(key, "frame", "_p", "_n_frames", "_tokens")
    )
    # dealt by a hash of the key's hash: a union of two sides that are dealt by the key alone already keeps their partitions, and
    # adaptive execution may then read each side in its own way
    ordered = rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, F.col("frame").asc_nulls_first())
    kind = targets.schema[key].dataType.simpleString()
    return ordered.drop("frame").mapInArrow(_walk_aligned(key), f"{key} {kind}, pos int, score double")


def map_to_characters(scores: Column, n_chars: Column) -> Column:
    """Spread syllable scores over characters: repeat when there are more characters, cut when there are fewer."""
    n = F.size(scores)
    spread = F.transform(
        F.sequence(F.lit(0), n_chars - 1), lambda i: F.element_at(scores, (F.floor(i * n / n_chars) + 1).cast("int"))
    )
    return (
        F.when(n_chars <= 0, F.array().cast("array<double>"))
        .when(n == 0, F.array_repeat(F.lit(0.0), n_chars))
        .when(n_chars > n, spread)
        .otherwise(F.slice(scores, F.lit(1), F.greatest(n_chars, F.lit(0))))
    )


def tone_score(expected: Column, predicted: Column, confidence: Column) -> Column:
    """0.7 + 0.3 confidence on a match, else 0.4 (1 - penalty) confidence."""
    arms = [F.lit(e * 10 + p) for e, p in CONFUSION_PENALTIES], [F.lit(v) for v in CONFUSION_PENALTIES.values()]
    table = F.create_map(*[x for pair in zip(*arms) for x in pair])
    penalty = F.coalesce(F.try_element_at(table, expected * 10 + predicted), F.lit(DEFAULT_PENALTY))
    miss = F.greatest(F.lit(0.0), (F.lit(1.0) - penalty) * 0.4 * confidence)
    return F.when(expected == predicted, confidence * 0.3 + 0.7).otherwise(miss)


def syllable_scores(pred: DataFrame) -> DataFrame:
    """Add tone score, overall syllable score and the mismatch tag of each prediction."""
    scored = pred.withColumn("tone_score", tone_score(F.col("expected"), F.col("predicted"), F.col("confidence")))
    tag = F.concat(F.lit("tone_"), F.col("predicted").cast("string"), F.lit("_vs_"), F.col("expected").cast("string"))
    return scored.withColumn(
        "overall", F.col("tone_score") * TONE_WEIGHT + SEGMENTAL_WEIGHT * SEGMENTAL_SCORE
    ).withColumn("tag", F.when(F.col("expected") != F.col("predicted"), tag))


def placeholder_scores(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sentence score of the constant placeholder scorer, 0..100."""
    overall = sum(w * PLACEHOLDER_SCORE for w in PLACEHOLDER_WEIGHTS)
    return targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.lit(overall)) * 100).alias("overall"))


def sentence_score(scores: DataFrame, keys: Sequence[str], score: str = "overall") -> DataFrame:
    """Weighted mean x 100 per sentence, the lowest 30 % (at least one) of the syllables weighing 1.5."""
    numbered = number_rows(
        scores.select(*keys, F.col(score).alias("_s")), keys, ["_s"], F.floor(F.col("_s") * 1024), "_rank"
    )
    sizes = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_syllables"))
    low = F.greatest(F.lit(1), F.floor(F.col("n_syllables") * 0.3))
    weight = F.when(F.col("_rank") < low, 1.5).otherwise(1.0)
    return (
        numbered.join(sizes, list(keys))
        .withColumn("_w", weight)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_syllables"),
            (F.sum(F.col("_s") * F.col("_w")) / F.sum("_w") * 100).alias("score"),
        )
    )


def with_empty_sentences(sentences: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All sentences with their score; those without targets score 0 and carry a warning."""
    return sentences.select(*keys).join(scores, list(keys), "left").select(
        *keys,
        F.coalesce("n_syllables", F.lit(0)).alias("n_syllables"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(F.col("score").isNull(), "no_targets").alias("warning"),
    )


def sentence_grade(scores: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Rounded mean of the character scores x 100."""
    return scores.groupBy(*keys).agg(F.coalesce(F.round(F.avg(score) * 100), F.lit(0.0)).cast("int").alias("grade"))
