"""Byte pair encoding of sentence texts with a given vocabulary, and decoding."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingotide.llm.common import whole

# pieces remembered per worker and their ids; beyond it the memory starts afresh
MEMORY = 1 << 17
# so many characters of texts are worked on at once
BATCH_CHARS = 1 << 20
# rows of an Arrow batch that are Python strings at once
ROWS = 256
_NONE = np.int64(1) << 62
_PLACES = 32  # bits below a pair's rank that hold its place
_BLANKS = regex.compile(r"\p{White_Space}+")
# str.split takes these for blanks, the vocabulary's expressions do not
_SEPARATORS = "\x1c\x1d\x1e\x1f"


@dataclass(frozen=True)
class BpeRules:
    """A vocabulary file of the ``tokenizers`` format, reduced to what encoding needs; a few megabytes."""

    tokens: np.ndarray  # id -> token
    plain: np.ndarray  # byte -> id within a piece
    final: np.ndarray  # byte -> id at a piece's end
    pairs: np.ndarray  # sorted first << 32 | second
    ranks: np.ndarray  # rank of each pair
    merged: np.ndarray  # id by rank
    split: str
    special: dict[str, int]


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where visible, else the next free from 256."""
    visible = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def load_rules(path: str) -> BpeRules:
    """Read a byte-level BPE file whose words end with a suffix and whose text is composed and lower-cased first."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    pretokens = spec["pre_tokenizer"]["pretokenizers"]
    if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pretokens] != ["Split", "ByteLevel"]:
        raise ValueError("only composed, lower-cased, byte-level vocabularies are supported")
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = np.empty(max([*vocab.values(), *special.values()]) + 1, dtype=object)
    for token, number in [*vocab.items(), *special.items()]:
        tokens[number] = token
    letters = byte_letters()
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in model["merges"]], dtype=np.int64)
    order = np.argsort(keys)
    return BpeRules(
        tokens,
        np.array([vocab[c] for c in letters], dtype=np.int64),
        np.array([vocab[c + suffix] for c in letters], dtype=np.int64),
        keys[order],
        order.astype(np.int64),
        np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int64),
        pretokens[0]["pattern"]["Regex"],
        special,
    )


class PairTrees:
    """Merges many pieces side by side, each over a segment tree of its adjacent pairs.

    A leaf holds rank and place of the pair that begins at its symbol, an inner node the least of its children, so the
    root names the leftmost pair of lowest rank. A merge changes three leaves and their paths to the root; a piece is
    done once its root holds no pair.
    """

    def __init__(self, rules: BpeRules):
        self.rules = rules

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, their number per piece, and the order the pieces come in; similar lengths share a step."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        ids, counts, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in np.unique(widths):
            members = np.flatnonzero(widths == width)
            most = max(1, (1 << 20) // int(width))
            for at in range(0, len(members), most):
                rows = members[at : at + most]
                flat, kept = self._merge([pieces[i] for i in rows], int(width))
                ids.append(flat)
                counts.append(kept)
                order.append(rows)
        return np.concatenate(ids), np.concatenate(counts), np.concatenate(order)

    def _keys(self, first: np.ndarray, second: np.ndarray, place: np.ndarray) -> np.ndarray:
        wanted = first << 32 | np.maximum(second, 0)
        at = np.minimum(np.searchsorted(self.rules.pairs, wanted), len(self.rules.pairs) - 1)
        known = (self.rules.pairs[at] == wanted) & (first >= 0) & (second >= 0)
        return np.where(known, self.rules.ranks[at] << _PLACES | place, _NONE)

    def _merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        count = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(count, width)
        symbols = np.full((count, width + 1), -1, dtype=np.int64)
        inside = np.arange(width) < size[:, None]
        symbols[:, :width][inside] = self.rules.plain[raw[inside]]
        row = np.arange(count)
        symbols[row, size - 1] = self.rules.final[raw[row, size - 1]]
        # place ``width`` stands for no neighbour on either side
        after = np.minimum(np.arange(1, width + 2), width) * np.ones((count, 1), dtype=np.int64)
        before = np.arange(-1, width) * np.ones((count, 1), dtype=np.int64)
        before[:, 0] = width
        after = np.where(after < size[:, None], after, width)
        tree = np.full((count, 2 * width), _NONE)
        places = np.broadcast_to(np.arange(width), (count, width))
        tree[:, width:] = self._keys(symbols[:, :width], np.take_along_axis(symbols, after[:, :width], 1), places)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        gone = np.zeros((count, width + 1), dtype=bool)
        busy = np.flatnonzero(tree[:, 1] < _NONE)
        while len(busy):
            best = tree[busy, 1]
            place = best & ((1 << _PLACES) - 1)
            right = after[busy, place]
            symbols[busy, place] = self.rules.merged[best >> _PLACES]
            gone[busy, right] = True
            far = after[busy, right]
            after[busy, place] = far
            linked = far < width
            before[busy[linked], far[linked]] = place[linked]
            left = before[busy, place]
            new = self._keys(symbols[busy, place], symbols[busy, far], place)
            self._set(tree, busy, right, np.full(len(busy), _NONE), width)
            self._set(tree, busy, place, new, width)
            has = left < width
            rows, at = busy[has], left[has]
            self._set(tree, rows, at, self._keys(symbols[rows, at], symbols[rows, place[has]], at), width)
            busy = busy[tree[busy, 1] < _NONE]
        kept = inside & ~gone[:, :width]
        return symbols[:, :width][kept].astype(np.int32), kept.sum(1)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[rows, node] = value
        node = node >> 1
        while width > 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node, width = node >> 1, width >> 1


class BpeEncoder:
    """Encodes whole texts; blank-free stretches and their pieces are merged once and remembered."""

    def __init__(self, rules: BpeRules):
        self.rules, self.trees = rules, PairTrees(rules)
        self.pattern = regex.compile(rules.split)
        self.marks = regex.compile("|".join(map(regex.escape, rules.special))) if rules.special else None
        self._start()

    def _start(self) -> None:
        # stretches and pieces share one memory: a piece that stands alone is a stretch with the same ids
        self.place: dict[str, int] = {}
        self.begin = np.zeros(1 << 12, dtype=np.int64)
        self.length = np.zeros(1 << 12, dtype=np.int64)
        self.flat = np.zeros(1 << 14, dtype=np.int32)
        self.known = self.used = 0

    def _store(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Append the ids of several stretches; the first one's place."""
        first = self.known
        self.known += len(counts)
        while self.known > len(self.begin):
            self.begin, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first : self.known] = self.used + np.cumsum(counts) - counts
        self.length[first : self.known] = counts
        self.used += len(ids)
        return first

    def _ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches at ``places``, one after another, and where each ends."""
        lengths = self.length[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.begin[places] - ends[:-1], lengths) + np.arange(ends[-1])], ends

    def _stretches(self, text: str) -> list[str]:
        if self.marks and "<" in text and self.marks.search(text):
            out: list[str] = []
            at = 0
            # a special token in the text is one id, and what stands around it is normalized by itself
            for mark in self.marks.finditer(text):
                out += [*self._stretches(text[at : mark.start()]), "\0" + mark[0]]
                at = mark.end()
            return out + self._stretches(text[at:])
        text = unicodedata.normalize("NFC", text)
        if any(c in text for c in _SEPARATORS):
            return [s for s in _BLANKS.split(text) if s]
        return text.split()

    def _learn(self, stretches: list[str]) -> None:
        new = list({s: None for s in stretches if s not in self.place})
        if len(self.place) + len(new) > MEMORY:
            self._start()
            new = list(dict.fromkeys(stretches))
        marks = [s for s in new if s[0] == "\0" and s[1:] in self.rules.special]
        if marks:
            numbers = np.array([self.rules.special[s[1:]] for s in marks], dtype=np.int32)
            first = self._store(numbers, np.ones(len(marks), dtype=np.int64))
            self.place.update(zip(marks, range(first, self.known)))
        # letters are lowered one by one, so a final sigma is an ordinary one
        cut = {s: self.pattern.findall(s.replace("Σ", "σ").lower()) for s in new if s not in self.place}
        pieces = list({p: None for parts in cut.values() for p in parts if p not in self.place})
        ids, counts, order = self.trees.encode([p.encode("utf-8", "surrogatepass") for p in pieces])
        first = self._store(ids, counts)
        self.place.update((pieces[i], first + n) for n, i in enumerate(order.tolist()))
        several = {s: parts for s, parts in cut.items() if s not in self.place}
        parts = [self.place[p] for each in several.values() for p in each]
        ids, ends = self._ids(np.array(parts, dtype=np.int64))
        bounds = ends[np.concatenate([[0], np.cumsum([len(v) for v in several.values()])]).astype(np.int64)]
        first = self._store(ids, np.diff(bounds))
        self.place.update(zip(several, range(first, self.known)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another and the number of each text's ids."""
        stretches: list[str] = []
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            stretches += self._stretches(text)
            bounds[i + 1] = len(stretches)
        try:
            places = np.fromiter(map(self.place.__getitem__, stretches), dtype=np.int64, count=len(stretches))
        except KeyError:
            self._learn(stretches)
            places = np.fromiter(map(self.place.__getitem__, stretches), dtype=np.int64, count=len(stretches))
        ids, ends = self._ids(places)
        return ids, np.diff(ends[bounds])

    def batches(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same in parts of bounded size."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            yield self.encode(texts[at:end])
            at = end


def encoder(spark: SparkSession, rules: BpeRules):
    """A column function from texts to arrays of ids; the rules reach each executor once."""
    shared = spark.sparkContext.broadcast(rules)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = BpeEncoder(shared.value)
        for batch in batches:
            parts = [p for at in range(0, len(batch), ROWS) for p in held.batches(batch.slice(at, ROWS).to_pylist())]
            flat = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
            counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return encode


def decoder(spark: SparkSession, rules: BpeRules):
    """A column function from arrays of ids to their tokens, joined by blanks (these vocabularies name no other way)."""
    shared = spark.sparkContext.broadcast(rules.tokens)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = shared.value
        for batch in batches:
            done = [pa.array([], type=pa.string())]
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                flat = tokens[part.flatten().to_numpy()]
                ends = part.offsets.to_numpy()
                ends = ends - ends[0]
                done.append(pa.array([" ".join(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], type=pa.string()))
            yield pa.concat_arrays(done)

    return decode


def encode_texts(texts: DataFrame, rules: BpeRules) -> DataFrame:
    """Token ids of sentence texts (id, text): id, token_ids array<int>, as many rows as came in, none moved.

    The ids are those of the vocabulary's own library without special tokens added; the strings of special tokens in a
    text become their ids. A null or empty text has no ids; other columns are left out.
    """
    encode = encoder(texts.sparkSession, rules)
    return texts.select("id", encode(whole("text")).alias("token_ids"))


def decode_tokens(tokens: DataFrame, rules: BpeRules) -> DataFrame:
    """Texts of token ids (id, token_ids): id, token_ids, decoded. No ids give an empty text; null ids count as none."""
    decode = decoder(tokens.sparkSession, rules)
    ids = F.coalesce("token_ids", F.array().cast("array<int>"))
    return tokens.select("id", "token_ids", decode(ids).alias("decoded"))
