"""Sentence texts whose word shingles overlap: an exact Jaccard join over count vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingotide.llm.common import free_finished, whole
from lingotide.llm.components import components
from lingotide.session import staged

# groups whose counts make up a point of the tree, at least
GROUPS = 256
# shingles in a group on average, beyond which a point has twice as many groups, up to MOST_GROUPS: counts of fuller groups are alike by chance
DENSE = 4
MOST_GROUPS = 4096
# the largest count, reached by texts of some 16 million words
FULL = 65535
# points in a leaf of the tree
LEAF = 16
# points that meet in one task
CELL_ROWS = 2048
# shingles of the sets on either side of a cell of pairs
CELL_SHINGLES = 1 << 20
# words and sets remembered per worker; beyond it the memory starts afresh
MEMORY = 1 << 20
# marks of a task's texts that are sorted and packed together
CHUNK_MARKS = 1 << 21
# leading bits of a mark that are kept; marks alike in them by chance only add candidates
MARK_BITS = 44
# marks that meet in one task
PART_MARKS = 1 << 20
# texts of a chunk that may share a mark; of more only the smallest id is packed, all are joined by the mark
CROWD = 32
# texts with fewer shingles use a group per shingle
SMALL = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; two texts link when ``den * intersection >= num * union``."""

    words: int = 4
    num: int = 85
    den: int = 100

    def most_different(self, n: int) -> int:
        """Shingles that a set of ``n`` and any set linked with it can have apart, at most."""
        return n * (self.den - self.num) // self.num

    def groups(self, size_class: int) -> int | None:
        """Groups for sets of ``2 ** size_class`` shingles up to twice as many: few, but more than can differ."""
        if 1 << size_class < SMALL:
            return None
        n = 2 << size_class
        for bits in range(max(1, size_class - 3), size_class + 4):
            if (1 << bits) * (1 - np.exp(-n / (1 << bits))) >= 1.2 * (self.most_different(n) + 2):
                return 1 << bits
        return None


class Shingler:
    """Hashes of a text's distinct word shingles."""

    def __init__(self, words: int):
        self.words = words
        self._start()

    def _start(self) -> None:
        self._place: dict[bytes, int] = {}
        self._codes = np.zeros(1 << 12, dtype=np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        for w in words:
            if w not in self._place:
                at = len(self._place)
                if at == len(self._codes):
                    self._codes = np.concatenate([self._codes, np.zeros_like(self._codes)])
                self._codes[at] = xxhash.xxh64_intdigest(w)
                self._place[w] = at

    def shingles(self, text: str) -> np.ndarray:
        """Sorted 64-bit hashes; a text with fewer words than a shingle is one shingle, without words there are none."""
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self._place) > MEMORY:
            self._start()
        try:
            at = np.fromiter(map(self._place.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            self._learn(words)
            at = np.fromiter(map(self._place.__getitem__, words), dtype=np.int64, count=len(words))
        codes = self._codes[at]
        k = min(self.words, len(codes))
        with np.errstate(over="ignore"):
            h = np.full(len(codes) - k + 1, np.uint64(k))
            for i in range(k):
                h = (h ^ (h >> np.uint64(29))) * _MULT + codes[i : len(codes) - k + 1 + i]
            h ^= h >> np.uint64(32)
            h *= _MULT
            h ^= h >> np.uint64(29)
        return np.unique(h)


def marks(rule: Rule, shingles: np.ndarray) -> np.ndarray:
    """Keys of which any two linked sets share at least one.

    Shingles fall into fine groups. Two linked sets differ in at most ``most_different`` shingles, so of one more
    non-empty groups, taken in order, at least one is equal in both: its point in that subspace lies at distance 0 of
    the other's. The key is that group's content. Sets near the end of their size class use the next class as well.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, dtype=np.int64)
    most = rule.most_different(n) + 1
    low = n.bit_length() - 1
    classes = [low, low + 1] if rule.den * n >= rule.num * (2 << low) else [low]
    out = []
    with np.errstate(over="ignore"):
        for size_class in classes:
            groups = rule.groups(size_class)
            if groups is None:
                content = shingles[:most]
            else:
                group = shingles & np.uint64(groups - 1)
                order = np.argsort(group, kind="stable")
                ordered = group[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                content = (np.add.reduceat(shingles[order] * _MULT, first) ^ ordered[first])[:most]
            out.append((content ^ np.uint64(size_class)) * _MULT)
    return np.concatenate(out).view(np.int64)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return first, np.diff(np.append(first, len(ordered)))


def _packed(marks: np.ndarray, ids: np.ndarray) -> dict:
    """Ascending marks as byte planes of their steps, and for each the place of its text in ``ids``."""
    texts, whose = np.unique(ids, return_inverse=True)
    steps = np.diff(marks, prepend=marks[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return {"ids": texts, "first": int(marks[0]), "steps": planes.tobytes(), "whose": whose.astype("<u2").tobytes()}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The marks and ids of ``_packed``."""
    whose = np.frombuffer(row["whose"], dtype="<u2")
    planes = np.frombuffer(row["steps"], dtype=np.uint8).reshape(-1, len(whose))
    steps = np.zeros((len(whose), 8), dtype=np.uint8)
    steps[:, : len(planes)] = planes.T
    return np.cumsum(steps.view("<u8").reshape(-1)) + np.uint64(row["first"]), np.asarray(row["ids"], dtype=np.int64)[whose]


def _chunk(keys: list[int], held: list[np.ndarray], crowd_of: int) -> dict:
    """The marks of some texts, packed; those that more than ``crowd_of`` share also as (``crowd_marks``, ``crowd_ids``)."""
    marks_, ids = np.concatenate(held).view(np.uint64) >> np.uint64(64 - MARK_BITS), np.repeat(keys, list(map(len, held)))
    order = np.argsort(marks_, kind="stable")
    marks_, ids = marks_[order], ids[order]
    first, counts = _runs(marks_)
    stays, crowded = np.ones(len(marks_), dtype=bool), np.zeros(len(marks_), dtype=bool)
    for begin, n in zip(first[counts > crowd_of].tolist(), counts[counts > crowd_of].tolist()):
        crowded[begin : begin + n], stays[begin : begin + n] = True, False
        stays[begin + int(np.argmin(ids[begin : begin + n]))] = True
    crowd = {"crowd_marks": marks_[crowded].view(np.int64), "crowd_ids": ids[crowded]}
    return _packed(marks_[stays], ids[stays]) | crowd | {"n_marks": int(stays.sum())}


def groups_of(n: np.ndarray | int) -> np.ndarray:
    """Groups of the points of sets of ``n`` shingles."""
    n, groups, more = np.asarray(n), np.full(np.shape(n), GROUPS), GROUPS
    while more < MOST_GROUPS:
        groups, more = np.where(n > DENSE * more, 2 * more, groups), 2 * more
    return groups


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts of the shingles by group; ``FULL`` and more are one value."""
    groups = int(groups_of(len(shingles)))
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)
    return np.minimum(counts, FULL).astype(np.uint16)


def _folded(points: np.ndarray, groups: int) -> np.ndarray:
    """The points of the same sets in fewer groups."""
    while points.shape[1] > groups:
        half = points.shape[1] // 2
        points = np.minimum(points[:, :half].astype(np.uint32) + points[:, half:], FULL).astype(np.uint16)
    return points


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of coordinate minima per row, which two sets' overlap cannot exceed; two full counts leave it open."""
    least = np.minimum(a, b)
    bound = least.sum(1, dtype=np.int64)
    if least.size and least.max() == FULL:
        bound += (least == FULL).any(1) * np.int64(1 << 40)
    return bound


class CountTree:
    """An R-tree over count vectors, bulk-loaded by halving along the widest coordinate.

    A box's upper corner bounds the overlap with any point in it: the sum of coordinate minima.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rule: Rule):
        self.points, self.sizes, self.rule = points, sizes, rule
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        own = self.points[rows]
        box = own.max(0)
        least = self.sizes[rows].min()
        if len(rows) <= LEAF:
            return box, least, rows, None
        axis = np.argmax(box - own.min(0))
        order = rows[np.argsort(own[:, axis], kind="stable")]
        half = len(order) // 2
        return box, least, None, (self._build(order[:half]), self._build(order[half:]))

    def _possible(self, overlap: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
        return (self.rule.den + self.rule.num) * overlap >= self.rule.num * (sizes + others)

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, bound of their overlap) of the pairs whose bound reaches the rule."""
        found_q, found_r, found_o = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            (box, least, rows, children), asked = todo.pop()
            bound = overlap_bound(points[asked], box)
            asked = asked[self._possible(bound, sizes[asked], least)]
            if not len(asked):
                continue
            if rows is None:
                todo += [(child, asked) for child in children]
                continue
            for row in rows:
                exact = overlap_bound(points[asked], self.points[row])
                hit = self._possible(exact, sizes[asked], self.sizes[row])
                found_q.append(asked[hit])
                found_r.append(np.full(int(hit.sum()), row))
                found_o.append(exact[hit])
        return np.concatenate(found_q), np.concatenate(found_r), np.concatenate(found_o)


def _point_bytes(counts: np.ndarray) -> bytes:
    """Counts in four bits each where all fit, else in eight or sixteen."""
    most = counts.max()
    if most < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.uint8 if most < 256 else "<u2").tobytes()


def _vectors(column: pd.Series, groups: int = GROUPS) -> np.ndarray:
    lengths = np.fromiter(map(len, column), dtype=np.int64, count=len(column))
    out = np.zeros((len(column), groups), dtype=np.uint16)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        flat = np.frombuffer(b"".join(column.iloc[rows]), dtype="<u2" if length == 2 * groups else np.uint8).reshape(len(rows), -1)
        if length * 2 == groups:
            flat = np.stack([flat & 15, flat >> 4], axis=2).reshape(len(rows), -1)
        out[rows] = flat
    return out


def sketches(texts: DataFrame, rule: Rule) -> DataFrame:
    """(id, n_shingles, same_as, point, digest) of each text, and rows with ``n_marks`` for the packed marks of many.

    Rows whose set occurred before in the same task carry that row's id as ``same_as`` and nothing else, so a text
    repeated very often is worked on once per task.
    """

    chunk_marks, crowd_of = CHUNK_MARKS, CROWD

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(rule.words), {}
        keys: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            out = []
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                s = shingler.shingles(text)
                if not len(s) or key is None:
                    out.append((key, len(s), None, None, None))
                    continue
                with np.errstate(over="ignore"):
                    whole_set = (len(s), int(s.sum()), int((s * (s >> np.uint64(7) | np.uint64(1))).sum()))
                if len(seen) > MEMORY:
                    seen.clear()
                first = seen.setdefault(whole_set, key)
                if first != key:
                    out.append((key, len(s), first, None, None))
                else:
                    out.append((key, len(s), None, _point_bytes(point(s)), np.array(whole_set[1:], dtype="<u8").tobytes()))
                    keys.append(key)
                    held.append(marks(rule, s))
                    size += len(held[-1])
                    if size >= chunk_marks or len(keys) == 1 << 16:
                        yield _sketch_batch([_chunk(keys, held, crowd_of)])
                        keys, held, size = [], [], 0
                if len(out) >= 512:
                    yield _sketch_batch(_texts(out))
                    out = []
            if out:
                yield _sketch_batch(_texts(out))
        if held:
            yield _sketch_batch([_chunk(keys, held, crowd_of)])

    schema = (
        "id long, n_shingles long, same_as long, point binary, digest binary, n_marks long, ids array<long>, first long, "
        "steps binary, whose binary, crowd_marks array<long>, crowd_ids array<long>"
    )
    return texts.select("id", whole("text").alias("text")).mapInArrow(sketch, schema)


_SKETCH = pa.schema([
    ("id", pa.int64()), ("n_shingles", pa.int64()), ("same_as", pa.int64()), ("point", pa.binary()), ("digest", pa.binary()),
    ("n_marks", pa.int64()), ("ids", pa.list_(pa.int64())), ("first", pa.int64()), ("steps", pa.binary()), ("whose", pa.binary()),
    ("crowd_marks", pa.list_(pa.int64())), ("crowd_ids", pa.list_(pa.int64())),
])


def _texts(rows: list[tuple]) -> list[dict]:
    return [dict(zip(_SKETCH.names, row)) for row in rows]


def _sketch_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _SKETCH], schema=_SKETCH)


def shingle_sets(texts: DataFrame, rule: Rule) -> DataFrame:
    """(id, n_shingles, shingles) of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule.words)
        for batch in batches:
            found = [shingler.shingles(t).view(np.int64) for t in batch["text"].to_pylist()]
            for at in range(0, len(found), 512):
                part = found[at : at + 512]
                columns = [batch["id"].slice(at, 512), pa.array(map(len, part), pa.int64()), pa.array(part, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "shingles"])

    return texts.select("id", whole("text").alias("text")).mapInArrow(sets, "id long, n_shingles long, shingles array<long>")


def _cells(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(slot, x, y, a, b) of the pairs (a, b, home): the cell in which a pair meets, given the ``sizes`` (id, n_shingles) of sets.

    Homes are dealt into slots and the ids of a slot into buckets of some ``CELL_SHINGLES`` shingles; a cell is two buckets. So a
    set belongs to no more cells than its slot has buckets, and to one where the slot is small, however many pairs it is in.
    """
    ends = staged(pairs.select("home", F.explode(F.array("a", "b")).alias("id")).distinct().join(sizes, "id"), "pair-ends")
    slots = int((ends.agg(F.sum("n_shingles")).first()[0] or 0) // CELL_SHINGLES) + 1
    slot = F.pmod(F.xxhash64("home"), F.lit(slots)).alias("slot")
    buckets = ends.select(slot, "id", "n_shingles").distinct().groupBy("slot").agg(F.ceil(F.sum("n_shingles") / CELL_SHINGLES).alias("_n"))
    dealt = pairs.select(slot, "a", "b").join(buckets, "slot")
    x, y = (F.pmod(F.xxhash64(F.lit("bucket"), end), F.greatest("_n", F.lit(1))) for end in ("a", "b"))
    return dealt.select("slot", F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "a", "b")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of (a, b, home) whose sets link; a set moves once to each cell of its pairs, not with every pair."""
    cell = ["slot", "x", "y"]
    met = staged(_cells(pairs, sets.select("id", "n_shingles")), "pair-cells")
    asked = met.select(*cell, F.col("a").alias("id"), F.col("b").alias("other"), F.lit(None).cast("array<long>").alias("shingles"))
    ends = met.select(*cell, F.explode(F.array("a", "b")).alias("id")).distinct()
    held = ends.join(sets.select("id", "shingles"), "id").select(*cell, "id", F.lit(None).cast("long").alias("other"), "shingles")

    def compare(rows: pa.Table) -> pa.Table:
        asks = pc.is_valid(rows["other"])
        own, found = rows.filter(pc.invert(asks)).combine_chunks(), rows.filter(asks)
        lists = own["shingles"].combine_chunks()
        first, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        by: dict[int, list[np.ndarray]] = {}
        for at, key in enumerate(own["id"].to_pylist()):
            by.setdefault(key, []).append(values[first[at] : first[at + 1]])

        def links(a: np.ndarray, b: np.ndarray) -> bool:
            both = len(np.intersect1d(a, b, assume_unique=True))
            return (rule.den + rule.num) * both >= rule.num * (len(a) + len(b))

        ids = zip(found["id"].to_pylist(), found["other"].to_pylist())
        linked = [any(links(s, t) for s in by.get(a, ()) for t in by.get(b, ())) for a, b in ids]
        found = found.filter(pa.array(linked, pa.bool_()))
        return pa.table({"a": found["id"], "b": found["other"]})

    return asked.unionByName(held).groupBy(*cell).applyInArrow(compare, "a long, b long").distinct()


def _bound_reached(rule: Rule):
    @F.pandas_udf("boolean")
    def reached(a: pd.Series, n_a: pd.Series, b: pd.Series, n_b: pd.Series) -> pd.Series:
        sizes, out = n_a.to_numpy() + n_b.to_numpy(), np.zeros(len(a), dtype=bool)
        groups = np.stack([groups_of(n_a.to_numpy()), groups_of(n_b.to_numpy())], axis=1)
        for of_a, of_b in np.unique(groups, axis=0).tolist():
            alike, few = np.flatnonzero((groups == [of_a, of_b]).all(1)), min(of_a, of_b)
            for rows in np.array_split(alike, len(alike) * max(of_a, of_b) // (1 << 20) + 1):
                overlap = overlap_bound(_folded(_vectors(a.iloc[rows], of_a), few), _folded(_vectors(b.iloc[rows], of_b), few))
                out[rows] = (rule.den + rule.num) * overlap >= rule.num * sizes[rows]
        return pd.Series(out)

    return reached


def candidate_homes(sketched: DataFrame) -> DataFrame:
    """(home, id): texts that share a mark, under the smallest id that has it; homes alone with themselves are left out.

    Marks move packed, once, cut into ranges of which each meets in one task. A chunk gives few ids to a mark; the others of a
    mark that very many texts share are joined to its home as rows.
    """
    spark = sketched.sparkSession
    chunks = sketched.filter("n_marks IS NOT NULL")
    parts = max(2 * spark.sparkContext.defaultParallelism, int((chunks.agg(F.sum("n_marks")).first()[0] or 0) // PART_MARKS) + 1)
    edges = np.array([-((-k << MARK_BITS) // parts) for k in range(1, parts)], dtype=np.uint64)
    packet = pa.schema([("part", pa.int32()), *[_SKETCH.field(n) for n in ("ids", "first", "steps", "whose", "crowd_marks")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                marks_, ids = _unpacked(row)
                crowd = np.unique(np.asarray(row["crowd_marks"], dtype=np.int64))
                ends, crowd_ends = np.searchsorted(marks_, edges), np.searchsorted(crowd.view(np.uint64), edges)
                out = []
                for part, (m, i, c) in enumerate(zip(np.split(marks_, ends), np.split(ids, ends), np.split(crowd, crowd_ends))):
                    if len(m):
                        out.append({"part": part, "crowd_marks": c} | _packed(m, i))
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in packet], schema=packet)

    def meet(packets: pa.Table) -> pa.Table:
        rows = packets.to_pylist()
        marks_, ids = (np.concatenate(x) for x in zip(*map(_unpacked, rows)))
        order = np.argsort(marks_, kind="stable")
        marks_, ids = marks_[order], ids[order]
        first, counts = _runs(marks_)
        least = np.minimum.reduceat(ids, first)
        home = np.repeat(least, counts)
        pairs = np.unique(np.stack([home, ids])[:, home != ids], axis=1)
        crowd = np.unique(np.concatenate([np.asarray(r["crowd_marks"], dtype=np.int64) for r in rows]))
        at = np.searchsorted(marks_[first], crowd.view(np.uint64))
        return pa.table({
            "home": pa.array(np.concatenate([pairs[0], least[at]])),
            "id": pa.concat_arrays([pa.array(pairs[1]), pa.nulls(len(crowd), pa.int64())]),
            "mark": pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(crowd)]),
        })

    sent = chunks.select("ids", "first", "steps", "whose", "crowd_marks").mapInArrow(
        cut, "part int, ids array<long>, first long, steps binary, whose binary, crowd_marks array<long>"
    )
    met = staged(sent.groupBy("part").applyInArrow(meet, "home long, id long, mark long"), "met")
    crowds = chunks.select(F.explode(F.arrays_zip("crowd_marks", "crowd_ids")).alias("c"))
    crowds = crowds.select(F.col("c.crowd_marks").alias("mark"), F.col("c.crowd_ids").alias("id"))
    crowded = crowds.join(met.filter("mark IS NOT NULL").select("mark", "home"), "mark").filter("id <> home")
    return met.filter("mark IS NULL").select("home", "id").unionByName(crowded.select("home", "id")).distinct()


def connect(texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(id, component) of sentence texts (id, text) that links connect to smaller ids, and (id, n_shingles) of all.

    Texts that share a mark meet under the smallest id among them, their home, so every linked pair meets somewhere.
    First each is compared with its home alone: the bound of the count vectors, then the sets. Pairs that both link
    with their home are connected and need no comparison. The others are searched in an R-tree of all texts of that
    home, in cells of bounded size. What passes the bound is verified by the sets in rounds, each text's likeliest pairs
    first; pairs that the links so far connect are dropped, all others are verified in the end. So no linked pair
    stays unconnected, and sets move in proportion to the texts in such groups, not to their pairs.
    """
    both = staged(sketches(texts, rule), "sketches")
    sketched = both.filter("n_marks IS NULL")
    points = sketched.filter("point IS NOT NULL").select("id", "n_shingles", "point", "digest")
    homes = staged(candidate_homes(both), "homes")
    free_finished(texts.sparkSession)
    # each text under each of its homes, and each home under itself
    placed = homes.unionByName(homes.select("home", F.col("home").alias("id")).distinct())
    members = staged(placed.join(points, "id"), "members")
    own = members.filter("home = id").select("home", *[F.col(c).alias(f"home_{c}") for c in ("n_shingles", "point", "digest")])
    members = members.filter("home <> id")
    asked = members.join(own, "home")
    near = _bound_reached(rule)("point", "n_shingles", "home_point", "home_n_shingles")
    equal = F.expr("n_shingles = home_n_shingles AND digest = home_digest").alias("equal")
    tested = staged(asked.filter(near).select(F.col("home").alias("a"), F.col("id").alias("b"), equal).distinct(), "star-pairs")
    stars = tested.select("a", "b").distinct()
    # equal sets link; only the sets of other pairs move
    unlike = tested.filter("NOT equal").select("a", "b", F.col("a").alias("home"))

    star_ends = staged(_ends(unlike), "star-ends")
    star_sets = staged(shingle_sets(_only(texts, star_ends), rule), "star-sets")
    free_finished(texts.sparkSession)
    alike = tested.filter("equal").select("a", "b")
    star_links = staged(alike.unionByName(verified(unlike, star_sets, rule)).distinct(), "star-links")
    free_finished(texts.sparkSession)

    loose = homes.join(star_links.select(F.col("a").alias("home"), F.col("b").alias("id")), ["home", "id"], "left_anti")
    pairs = staged(_tree_pairs(homes, loose, members, rule).join(stars, ["a", "b"], "left_anti"), "tree-pairs")
    copies = sketched.filter("same_as IS NOT NULL").select(F.col("same_as").alias("a"), F.col("id").alias("b"))
    first = staged(components(copies.unionByName(star_links)), "connected")
    # from here on components stand for their texts
    of = lambda end: first.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    placed = placed.withColumn("ca", F.coalesce("_a", "a")).withColumn("cb", F.coalesce("_b", "b")).drop("_a", "_b")
    pairs = staged(placed.filter("ca <> cb"), "open-pairs")
    lacking = staged(_ends(pairs).join(star_ends, "id", "left_anti"), "lacking-ends")
    sets = star_sets.unionByName(staged(shingle_sets(_only(texts, lacking), rule), "tree-sets"))
    links = pairs.select("ca", "cb").limit(0)
    merged = first.limit(0)
    width = 1
    while not pairs.isEmpty():
        ends = pairs.withColumn("end", F.explode(F.array("a", "b")))
        best = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("likely"), "a", "b"))
        tried = staged(ends.withColumn("_n", best).filter(F.col("_n") <= width).select("a", "b", "home").distinct(), "tried-pairs")
        found = verified(tried, sets, rule).join(pairs, ["a", "b"]).select("ca", "cb")
        links = staged(links.unionByName(found).distinct(), "links")
        merged = staged(components(links.toDF("a", "b")), "merged")
        rest = pairs.join(tried, ["a", "b"], "left_anti")
        for end in ("ca", "cb"):
            rest = rest.join(merged.toDF(end, "_to"), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        pairs = staged(rest.filter("ca <> cb"), "open-pairs")
        width *= 8
        free_finished(texts.sparkSession)
    every = sketched.select("id").distinct().join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    final = every.join(merged.toDF("component", "_to"), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return final, sketched.select("id", "n_shingles")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    return texts.select("id", "text").join(ids, "id", "left_semi")


def _tree_pairs(homes: DataFrame, loose: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, likely, home), a < b, both under one home, at least one loose there, whose bound reaches the rule; ``likely`` is its Jaccard."""
    sizes = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("all_cells"), F.count(F.lit(1)).alias("_n"))
    asks = loose.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("ask_cells"))
    # a home with one text besides itself has been compared already
    grid = staged(sizes.filter("_n > 1").join(asks, "home").drop("_n"), "home-cells")
    cell = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (
        members.join(grid, "home")
        .withColumn("all_cell", F.pmod(cell, "all_cells").cast("int")).withColumn("ask_cell", every("ask_cells"))
        .select("home", "ask_cell", "all_cell", F.lit(False).alias("asks"), "id", "n_shingles", "point")
    )
    asking = (
        members.join(loose, ["home", "id"], "left_semi").join(grid, "home")
        .withColumn("ask_cell", F.pmod(cell, "ask_cells").cast("int")).withColumn("all_cell", every("all_cells"))
        .select("home", "ask_cell", "all_cell", F.lit(True).alias("asks"), "id", "n_shingles", "point")
    )

    def search(cell_rows: pd.DataFrame) -> pd.DataFrame:
        asks = cell_rows["asks"].to_numpy()
        ids, sizes, points = cell_rows["id"].to_numpy(), cell_rows["n_shingles"].to_numpy(), cell_rows["point"]
        groups, found = groups_of(sizes), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for own in np.unique(groups[~asks]).tolist():
            rows = np.flatnonzero(~asks & (groups == own))
            vectors = _vectors(points.iloc[rows], own)
            for asking in np.unique(groups[asks]).tolist():
                asked, few = np.flatnonzero(asks & (groups == asking)), min(own, asking)
                if min(sizes[rows].max(), sizes[asked].max()) * rule.den < max(sizes[rows].min(), sizes[asked].min()) * rule.num:
                    continue
                tree = CountTree(_folded(vectors, few), sizes[rows], rule)
                q, r, overlap = tree.search(_folded(_vectors(points.iloc[asked], asking), few), sizes[asked])
                q, r = asked[q], rows[r]
                found.append((ids[q], ids[r], overlap / np.maximum(1, sizes[q] + sizes[r] - overlap)))
        left, right, likely = map(np.concatenate, zip(*found))
        out = pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right), "likely": likely, "home": cell_rows["home"].iloc[0]})
        return out[out["a"] < out["b"]].drop_duplicates(["a", "b"])

    met = rows.unionByName(asking).groupBy("home", "ask_cell", "all_cell").applyInPandas(search, "a long, b long, likely double, home long")
    return met.groupBy("a", "b").agg(F.max("likely").alias("likely"), F.min("home").alias("home"))


def overlap_groups(texts: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Groups of sentence texts (id, text) connected by overlapping shingles: id, n_shingles, component_id.

    ``component_id`` is the smallest id that links lead to, the row's own where there are none. Words are lower-cased
    (A to Z) and parted by ASCII white space. Null or empty texts and texts without words have no shingles and link
    with nothing; rows without id link with nothing and have no component; rows that share an id are one vertex that has
    the links of all of them. Repeated rows repeat in the result; other columns are left out. The join is exact up to
    collisions of 64-bit hashes.
    """
    found, sketched = connect(texts, rule)
    return sketched.join(found, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
