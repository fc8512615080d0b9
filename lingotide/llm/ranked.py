"""Ranked search of sentence texts by words, over posting lists cut into blocks of similar sentences."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingotide.session import staged

# fixed by the contract: what stands between terms, and the letters that are lower-cased
_BYTES = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _BYTES[_b] = ord(_c.lower()) if _c.isalnum() else 0x20
TERMS = bytes(_BYTES)
# saturation of counts and share of the length in it, in thousandths and percent
PEAK, SLOPE, PER_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75

# texts of the items that one pass over the sentences serves
ITEM_BYTES = 1 << 24
# cells of a segment's table of sentences by terms, and sentences in it at most
SEGMENT_CELLS, SEGMENT_ROWS = 1 << 22, 1024
# sentences of a posting block at most, and groups of similar sentences in a segment
BLOCK, GROUPS = 16, 32
# sentences whose scores give the first bounds
DRAWN = 4096


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8: runs of ASCII letters and digits and of all that is not ASCII, A to Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERMS).split()


@dataclass(frozen=True)
class Items:
    """The items of one pass: their distinct terms with the number of repeats, by number in the vocabulary."""

    rows: pd.DataFrame  # item_no, item_id
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def read_items(items: pd.DataFrame) -> Items:
    vocabulary: dict[bytes, int] = {}
    terms, repeats = [], []
    for text in items["text"]:
        counted = Counter(terms_of(text))
        terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counted], dtype=np.int64))
        repeats.append(np.array(list(counted.values()), dtype=np.int64))
    return Items(items[["item_no", "item_id"]], vocabulary, terms, repeats)


def count_terms(sentences: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts): each sentence's number of terms and how often those of ``vocabulary`` occur; without terms it is left out."""
    kind = sentences.schema["id"].dataType.simpleString()
    shared = sentences.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch):
                kept, lengths, terms, counts = [], [], [], []
                for k, text in enumerate(part.column("text")):
                    found = terms_of(text.as_py())
                    if not found:
                        continue
                    held = [(known[t], c) for t, c in Counter(found).items() if t in known]
                    kept.append(k)
                    lengths.append(len(found))
                    terms.append([t for t, _ in held])
                    counts.append([c for _, c in held])
                ids = part.column("id").take(pa.array(kept, type=pa.int64()))
                columns = [ids, pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "counts"])

    return sentences.select("id", "text").mapInArrow(count, f"id {kind}, n long, terms array<int>, counts array<int>")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in stretches, so that only some whole texts are Python strings at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@dataclass(frozen=True)
class Weights:
    """Statistics of all sentences that a score needs: their number, terms in all, and the weight of each term of the vocabulary."""

    sentences: int
    length: int
    weight: np.ndarray


def term_weights(counted: DataFrame, size: int) -> Weights:
    """Statistics over all counted sentences; one number per term of the vocabulary, which is bounded, reaches the driver."""
    n, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()
    frequency = np.zeros(size, dtype=np.int64)
    frequency[held["term"]] = held["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in frequency], dtype=np.int64)
    return Weights(n, length, weight)


class Segment:
    """Some sentences in memory: a table of what each term adds per unit of weight, and posting lists in blocks.

    A term's list is ordered by groups of similar sentences and cut into blocks within them. A block's summary holds, for
    every term, the most that any of its sentences has.
    """

    def __init__(self, lengths: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: Weights) -> None:
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths.astype(np.int64) * weights.sentences) // max(1, weights.length)
        gains = (PEAK * counts.astype(np.int64)) // (SLOPE * counts.astype(np.int64) + PER_LENGTH * m[rows])
        self.weights = weights
        self.gain = np.zeros((len(lengths), len(weights.weight)), dtype=np.int32)
        self.gain[rows, terms] = gains
        self.top = self.gain.max(axis=0, initial=0).astype(np.int64)
        self.group = self._groups()
        order = np.lexsort((rows, self.group[rows], terms))
        self.rows, self.terms = rows[order], terms[order]
        self.starts = np.searchsorted(self.terms, np.arange(len(weights.weight) + 1))
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.summaries: dict[int, np.ndarray] = {}

    def _groups(self) -> np.ndarray:
        """Number of the sentence, of some evenly spaced ones, to which each is most similar by the angle of weighted terms."""
        n = len(self.gain)
        if n <= BLOCK:
            return np.zeros(n, dtype=np.int64)
        weighted = self.gain.astype(np.float32) * (self.weights.weight.astype(np.float32) * np.float32(1e-9))
        weighted /= np.sqrt((weighted**2).sum(1, keepdims=True)) + np.float32(1e-9)
        centres = weighted[np.linspace(0, n - 1, min(GROUPS, n)).astype(int)]
        return np.argmax(weighted @ centres.T, axis=1)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Sentences of a term and where its blocks start: after BLOCK sentences or where a new group begins."""
        if term not in self.blocks:
            rows = self.rows[self.starts[term] : self.starts[term + 1]]
            group = self.group[rows]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(rows) else np.zeros(0, dtype=int)
            inside = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
            self.blocks[term] = rows, np.flatnonzero(inside % BLOCK == 0)
        return self.blocks[term]

    def summary(self, term: int) -> np.ndarray:
        """Coordinatewise largest gains of each block of a term's list, kept for the items that follow."""
        if term not in self.summaries:
            rows, starts = self.list_of(term)
            self.summaries[term] = np.maximum.reduceat(self.gain[rows], starts, axis=0) if len(rows) else self.gain[:0]
        return self.summaries[term]

    def search(self, terms: np.ndarray, repeats: np.ndarray, least: int, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the sentences that may be among the ``k`` best of an item, all scores being exact.

        ``least`` is a score that k sentences reach. Lists are walked from the term that can add most; the walk ends where the terms that are left
        cannot reach the bound together, and blocks are passed over where their summaries cannot.
        """
        factor = self.weights.weight[terms] * repeats
        most = factor * self.top[terms]
        order = np.argsort(-most, kind="stable")
        rest = np.r_[np.cumsum(most[order][::-1])[::-1], 0]
        seen = np.zeros(len(self.gain), dtype=bool)
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least = max(1, least)
        for step, at in enumerate(order):
            # a sentence without any of the terms before has at most what is left
            if rest[step] < least:
                break
            listed, starts = self.list_of(int(terms[at]))
            if len(listed) > BLOCK:
                bound = self.summary(int(terms[at]))[:, terms].astype(np.int64) @ factor
                open_ = np.repeat(bound >= least, np.diff(np.r_[starts, len(listed)]))
                listed = listed[open_]
            fresh = listed[~seen[listed]]
            if not len(fresh):
                continue
            seen[fresh] = True
            own = self.gain[fresh][:, terms].astype(np.int64) @ factor
            good = own >= least
            rows, scores = np.r_[rows, fresh[good]], np.r_[scores, own[good]]
            if len(rows) > k:
                best = best_rows(ids[rows], scores, k)
                rows, scores = rows[best], scores[best]
                least = max(least, int(scores[-1]))
        return rows, scores


def search_counted(counted: DataFrame, items: Items, weights: Weights, least: np.ndarray, k: int) -> DataFrame:
    """(item_no, id, score): from every task, its best sentences of each item with at least the score ``least``.

    Segments are built where the counted sentences lie, so no sentence moves; the bounds rise from segment to segment.
    """
    kind = counted.schema["id"].dataType.simpleString()
    size = len(items.vocabulary)
    shared = counted.sparkSession.sparkContext.broadcast((items.terms, items.repeats, items.rows["item_no"].to_numpy(), weights, least))
    segment_rows = max(16, min(SEGMENT_ROWS, SEGMENT_CELLS // max(1, size)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, repeats, numbers, stats, bounds = shared.value
        bounds = bounds.copy()
        # per item the best rows of this task so far
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, segment_rows):
                ids = part.column("id").to_pandas().to_numpy()
                lists = part.column("terms")
                rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
                segment = Segment(part.column("n").to_numpy(), rows, lists.flatten().to_numpy(), part.column("counts").flatten().to_numpy(), stats)
                for i in range(len(terms)):
                    found, scores = segment.search(terms[i], repeats[i], int(bounds[i]), k, ids)
                    if len(found):
                        before = kept.get(i, (ids[:0], scores[:0]))
                        all_ids, all_scores = np.concatenate([before[0], ids[found]]), np.concatenate([before[1], scores])
                        best = best_rows(all_ids, all_scores, k)
                        kept[i] = all_ids[best], all_scores[best]
                        if len(best) == k:
                            bounds[i] = max(bounds[i], kept[i][1][-1])
        for i, (ids, scores) in kept.items():
            frame = pd.DataFrame({"item_no": numbers[i], "id": ids, "score": scores})
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return counted.mapInArrow(search, f"item_no long, id {kind}, score long")


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; equal ones by ascending id of any type."""
    return np.lexsort((np.unique(ids, return_inverse=True)[1], -scores))[:k]


def best_of(found: DataFrame, k: int, keys: Sequence[str] = ("item_no",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_sentences(sentences: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """For each item (item_id, text) its ``k`` best of the sentence texts (id, text) by weighted, saturating counts of its terms.

    Terms are runs of ASCII letters and digits and of all that is not ASCII, A to Z in lower case. Among N sentences with terms, a
    term of df of them weighs floor(1000 ln((2N + 2) / (2df + 1))). It adds its weight times (10^9 tf) div (1000 tf + 8m) for its tf
    occurrences in a sentence of n terms, m being 25 + (75 n N) div L with L terms in all sentences; repeats in the item count.

    All sentences are counted once, for the terms of the items only. The counted sentences are indexed in segments
    where they lie: every term's posting list is ordered by similarity of its sentences and cut into blocks whose summaries hold the
    largest gain of each term. A list is walked only while its terms can reach the k-th best score, and a block is skipped only when the exact
    bound of its summary cannot. First bounds come from sentences drawn by hash; they change the time, never the result.

    Items whose texts exceed ITEM_BYTES together are served in several passes. Returns item_id, rank (from 1), id, score; equal scores by ascending
    id; fewer rows where fewer sentences score above 0. Null texts have no terms; rows without id take no part in either table, though
    sentences without id count in N, L and df; repeated sentences are ranked each; a repeated item with the same text counts
    once, one with another text is ranked for itself under the same item_id. Empty tables give an empty result.
    """
    spark = sentences.sparkSession
    kind, item_kind = sentences.schema["id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    asked = items.filter("item_id IS NOT NULL").select("item_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["item_id", "text"])
    asked = staged(asked.withColumn("item_no", F.monotonically_increasing_id()), "search-items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    passes = -(-size // ITEM_BYTES)
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, id {kind}, score long")
    for at in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("item_no"), F.lit(passes)) == at).orderBy("item_no").toPandas()
        out = out.unionByName(_one_pass(spark, sentences, read_items(own), asked, k))
    return out


def _one_pass(spark: SparkSession, sentences: DataFrame, items: Items, asked: DataFrame, k: int) -> DataFrame:
    counted = staged(count_terms(sentences, items.vocabulary), "search-counts")
    weights = term_weights(counted, len(items.vocabulary))
    counted = counted.filter("id IS NOT NULL AND size(terms) > 0")
    nothing = np.zeros(len(items.rows), dtype=np.int64)
    share = min(1.0, DRAWN / max(1, weights.sentences))
    drawn = counted.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    first = best_of(search_counted(drawn, items, weights, nothing, k), k).groupBy("item_no")
    known = first.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).toPandas()
    least = nothing.copy()
    least[np.searchsorted(items.rows["item_no"].to_numpy(), known["item_no"].to_numpy())] = known["least"]
    found = staged(search_counted(counted, items, weights, least, k), "search-found")
    return best_of(found, k).join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "id", "score")
