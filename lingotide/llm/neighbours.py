"""Nearest contours by learned partitions of a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingotide.llm.common import uniform
from lingotide.session import staged

# the index is fitted on at most so many contours, those with the smallest hash of their ids
SAMPLE = 8192
# neighbours per sampled contour in the graph
DEGREE = 10
# a partition is meant to hold about so many contours while the sample allows that many partitions
PART_ROWS = 512
MOST_PARTS = 128
# share of true neighbours that the probed partitions must hold on the sample
RECALL = 0.95
# contours and queries that meet in one task
CELL_ROWS = 4096


@dataclass(frozen=True)
class Partitioner:
    """A softmax classifier over partitions and how many of them a query visits."""

    weights: np.ndarray  # (dimensions + 1) x partitions
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.weights[:-1] + self.weights[-1]

    def home(self, vectors: np.ndarray) -> np.ndarray:
        return np.argmax(self.scores(vectors), axis=1)

    def visits(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, : self.probes]


def neighbour_graph(vectors: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The ``degree`` nearest rows of each row, without itself."""
    squares = (vectors**2).sum(1)
    out = []
    for at in range(0, len(vectors), 1024):
        part = vectors[at : at + 1024]
        d = squares[None] - 2 * part @ vectors.T
        d[np.arange(len(part)), at + np.arange(len(part))] = np.inf
        near = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def bisect(vectors: np.ndarray, graph: list[np.ndarray], members: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Split ``members`` in two equal halves that cut few edges: True for the second half.

    Starts from the median along the widest direction, then exchanges equally many members whose edges mostly lead
    across, as long as the cut shrinks.
    """
    own = vectors[members] - vectors[members].mean(0)
    direction = np.linalg.svd(own[: 4 * own.shape[1] + 64], full_matrices=False)[2][0]
    side = np.zeros(len(members), dtype=bool)
    side[np.argsort(own @ direction, kind="stable")[len(members) // 2 :]] = True
    place = np.full(len(vectors), -1)
    place[members] = np.arange(len(members))
    edges = np.array([(place[m], place[n]) for m in members for n in graph[m] if place[n] >= 0], dtype=np.int64).reshape(-1, 2)
    if not len(edges):
        return side
    cut = (side[edges[:, 0]] != side[edges[:, 1]]).sum()
    for _ in range(rounds):
        across = np.where(side[edges[:, 0]] != side[edges[:, 1]], 1, -1)
        gain = np.bincount(edges[:, 0], across, len(members)) + np.bincount(edges[:, 1], across, len(members))
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        worth = int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 2
        if not worth:
            break
        trial = side.copy()
        trial[left[:worth]], trial[right[:worth]] = True, False
        now = (trial[edges[:, 0]] != trial[edges[:, 1]]).sum()
        if now >= cut:
            break
        side, cut = trial, now
    return side


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Label each row with one of ``parts`` (a power of two) groups of equal size, by repeated bisection."""
    label = np.zeros(len(vectors), dtype=np.int64)
    links = list(graph)
    for _ in range(int(np.log2(parts))):
        finer = label * 2
        for group in np.unique(label):
            members = np.flatnonzero(label == group)
            if len(members) > 1:
                finer[members] += bisect(vectors, links, members)
        label = finer
    return label


def fit_classifier(vectors: np.ndarray, label: np.ndarray, parts: int, steps: int = 120) -> np.ndarray:
    """Softmax regression by full-batch gradient steps with momentum and per-weight scale; returns weights with bias row."""
    x = np.hstack([vectors, np.ones((len(vectors), 1))])
    w = np.zeros((x.shape[1], parts))
    mean, scale = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(parts)[label]
    for step in range(1, steps + 1):
        z = x @ w
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - target) / len(x) + 1e-5 * w
        mean, scale = 0.9 * mean + 0.1 * g, 0.999 * scale + 0.001 * g * g
        w -= 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-9)
    return w


def fit_partitions(sample: np.ndarray, rows: int, recall: float = RECALL) -> Partitioner:
    """Learn partitions on distinct sampled vectors for a table of ``rows``.

    Probes are the fewest most probable partitions that hold ``recall`` of the sample's own nearest neighbours.
    """
    sample = np.unique(sample, axis=0)
    parts = 1
    while parts * 2 <= min(MOST_PARTS, len(sample) // 32, max(1, rows // PART_ROWS)):
        parts *= 2
    if parts == 1:
        return Partitioner(np.zeros((sample.shape[1] + 1, 1)), 1)
    graph = neighbour_graph(sample, min(DEGREE, len(sample) - 1))
    label = balanced_parts(sample, graph, parts)
    model = Partitioner(fit_classifier(sample, label, parts), parts)
    home, visits = model.home(sample), model.visits(sample)
    rank = np.empty_like(visits)
    np.put_along_axis(rank, visits, np.arange(parts)[None].repeat(len(sample), 0), 1)
    needed = np.sort(np.take_along_axis(rank, home[graph], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Partitioner(model.weights, probes)


def usable(contours: DataFrame, components: int | None = None) -> DataFrame:
    """(id, f0_norm as doubles) of contours with an id and a vector that is not null, not zero and finite throughout.

    Vectors of another length than ``components``, or than most, have no distance to them and take no part either.
    """
    wide = contours.select("id", F.col("f0_norm").cast("array<double>").alias("f0_norm")).filter(
        "id IS NOT NULL AND f0_norm IS NOT NULL AND size(f0_norm) > 0 AND exists(f0_norm, x -> x <> 0)"
        " AND forall(f0_norm, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    if components is None:
        sizes = wide.groupBy(F.size("f0_norm").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        components = sizes[0]["n"] if sizes else 0
    return wide.filter(F.size("f0_norm") == components)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def best_of_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query; a fast product bounds the distances, those near the bound are worked out exactly."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(queries) or not len(rows):
        return empty
    q, r = _matrix(queries["vector"]), _matrix(rows["vector"])
    q_ids, r_ids = queries["id"].to_numpy(), rows["id"].to_numpy()
    r_squares, out = (r**2).sum(1), []
    for at in range(0, len(q), 256):
        part, ids = q[at : at + 256], q_ids[at : at + 256]
        squares = (part**2).sum(1)
        rough = squares[:, None] + r_squares[None] - 2 * part @ r.T
        rough[ids[:, None] == r_ids[None]] = np.inf
        most = min(k, len(r)) - 1
        bound = np.partition(rough, most, axis=1)[:, most]
        slack = 1e-9 * (squares + r_squares.max())
        which, found = np.nonzero((rough <= (bound + slack)[:, None]) & np.isfinite(rough))
        exact = np.sqrt(((part[which] - r[found]) ** 2).sum(1))
        order = np.lexsort((r_ids[found], exact, which))
        which, found, exact = which[order], found[order], exact[order]
        nth = np.arange(len(which)) - np.searchsorted(which, which)
        kept = nth < k
        out.append(pd.DataFrame({"query_id": ids[which[kept]], "id": r_ids[found[kept]], "score": exact[kept]}))
    return pd.concat(out) if out else empty


def nearest_contours(contours: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """For each query contour its ``k`` nearest among (id, f0_norm), by Euclidean distance in double precision.

    A sample's neighbour graph is cut into balanced partitions, a classifier learns them, every contour goes to its most probable partition
    and every query to its several most probable ones, where all members are ranked by their exact distance. Partitions are dealt out in cells of bounded
    size, so one that holds a large share of the rows (equal vectors) is many tasks. Missed neighbours lie in partitions
    not visited; ``recall`` sets how many may.

    Returns query_id, rank (from 1), id, score; ties go to the smaller id; fewer rows where there are fewer contours.
    Rows with the query's id are not its neighbours; other repeated ids count as often as they occur. Null, zero and
    non-finite vectors, vectors of unusual length and rows without id take no part; empty tables give an empty result.
    """
    spark = contours.sparkSession
    rows = usable(contours)
    total = rows.count()
    # only about twice as many rows as are drawn take part in the ordering, whatever the table's size
    known = rows.withColumn("_u", uniform("id", 29)).filter(F.col("_u") < min(1.0, 2.0 * SAMPLE / max(1, total)))
    drawn = known.orderBy("_u", "id").limit(SAMPLE).select("f0_norm").toPandas()["f0_norm"]
    sample = _matrix(drawn) if len(drawn) else np.zeros((1, 1))
    asked = usable(queries, sample.shape[1] if len(drawn) else 0)
    model = spark.sparkContext.broadcast(fit_partitions(sample, total, recall))

    @F.pandas_udf("int")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.value.home(_matrix(batch)) if len(batch) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def visits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(model.value.visits(_matrix(batch)).astype(np.int32)) if len(batch) else [], dtype=object)

    placed = staged(rows.select("id", F.col("f0_norm").alias("vector"), home("f0_norm").alias("part")), "contour-parts")
    visiting = staged(
        asked.select("id", F.col("f0_norm").alias("vector"), F.explode(visits("f0_norm")).alias("part")), "contour-visits"
    )
    # one row per partition, of which there are at most MOST_PARTS
    cells = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("rows_in"))
    asks = visiting.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("asks_in"))
    grid = staged(cells.join(asks, "part"), "contour-cells")
    every_ask = F.explode(F.sequence(F.lit(0), F.col("asks_in") - 1))
    every_row = F.explode(F.sequence(F.lit(0), F.col("rows_in") - 1))
    r = placed.join(grid, "part").withColumn("row_cell", F.pmod(F.xxhash64("id"), "rows_in").cast("int")).withColumn("ask_cell", every_ask)
    q = visiting.join(grid, "part").withColumn("ask_cell", F.pmod(F.xxhash64("id"), "asks_in").cast("int")).withColumn("row_cell", every_row)
    keys = ["part", "row_cell", "ask_cell"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_of_cell(left, right, k)

    found = (
        q.select(*keys, "id", "vector").groupBy(*keys)
        .cogroup(r.select(*keys, "id", "vector").groupBy(*keys))
        .applyInPandas(compare, "query_id long, id long, score double")
    )
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
