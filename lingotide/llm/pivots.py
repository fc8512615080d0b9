"""Exact highest inner products between contours by a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingotide.llm.common import uniform
from lingotide.operators.blocks import number_sorted
from lingotide.session import staged

# pivots are chosen among at most so many contours, those with the smallest hash of their ids
SAMPLE = 4096
PIVOTS = 64
# contours of an annulus at most, and queries that meet one in a task
ANNULUS_ROWS = 2048
QUERY_ROWS = 2048
# annuli a query opens in its first rounds; the last round opens all that its bounds still admit
ROUNDS = (1, 8)
LARGEST = (1 << 63) - 1


def whole_components(vector: str | Column, scale: float = 1024.0) -> Column:
    """Each component as the whole number below ``scale`` times it, kept in a double, which holds it exactly."""
    return F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: _floor(x.cast("double") * scale))


def _floor(x: Column) -> Column:
    # floor() gives a long; beyond 2^53 a double has no fraction
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def usable(contours: DataFrame, vector: str = "f0_norm") -> DataFrame:
    """(id, vector as doubles) of contours with an id and a vector that holds no null and nothing non-finite after scaling."""
    wide = contours.select("id", F.col(vector).cast("array<double>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    return wide.filter("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def inner_products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows as 64-bit integers; beyond that range they stop at its ends."""
    if not q.shape[1]:
        return np.zeros((len(q), len(r)), dtype=np.int64)
    # sums of at most 2^53 are exact in doubles
    if np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * q.shape[1] < float(1 << 53):
        return (q @ r.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in r], dtype=object).T
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


@dataclass(frozen=True)
class Pivots:
    """Pivot vectors by number of components, and of each pivot the largest squared length among its contours."""

    points: dict[int, np.ndarray]
    first: dict[int, int]  # number of the first pivot of a length
    reach: dict[int, float] = field(default_factory=dict)

    def nearest(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Number of each vector's nearest pivot; lengths without pivots have -1, the origin."""
        part = np.full(len(vectors), -1, dtype=np.int64)
        for n, rows in by_length(vectors).items():
            if n in self.points:
                x, p = np.stack([vectors[k] for k in rows]), self.points[n]
                part[rows] = self.first[n] + np.argmin((p**2).sum(1)[None] - 2 * x @ p.T, axis=1)
        return part

    def at(self, part: int, n: int) -> np.ndarray:
        """The pivot with the coordinate that lifts it to the reach of its contours."""
        p = self.points[n][part - self.first[n]] if part >= 0 else np.zeros(n)
        return np.r_[p, np.sqrt(max(0.0, self.reach.get(part, 0.0) - p @ p))]

    def distances(self, vectors: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
        """Distance of each contour to its pivot, both lifted to equal length."""
        out = np.zeros(len(vectors))
        for n, rows in by_length(vectors).items():
            x = np.stack([vectors[k] for k in rows])
            for part in np.unique(parts[rows]):
                own = parts[rows] == part
                lift = np.sqrt(np.maximum(0.0, self.reach[int(part)] - (x[own] ** 2).sum(1)))
                out[rows[own]] = np.linalg.norm(np.c_[x[own], lift] - self.at(int(part), n), axis=1)
        return out


def by_length(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    lengths = np.array([len(v) for v in vectors])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def choose_pivots(sample: list[np.ndarray], most: int = PIVOTS) -> Pivots:
    """Pivots far from each other: starting from the longest vector, the one farthest from all chosen ones follows.

    All lengths together get ``most`` of them, each according to its share of the sample.
    """
    points, first, count = {}, {}, 0
    for n, rows in by_length(sample).items():
        share = min(len(rows) // 16, most * len(rows) // max(1, len(sample)))
        if not n or not share:
            continue
        x = np.stack([sample[k] for k in rows])
        chosen = [int(np.argmax((x**2).sum(1)))]
        gap = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < share and gap.max() > 0:
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        points[n], first[n] = x[chosen], count
        count += len(chosen)
    return Pivots(points, first)


def annulus_bounds(q: np.ndarray, lifted: np.ndarray, reach: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest inner product that a contour of each annulus can have with ``q``, never too small.

    The lifted contours of a pivot are equally long, so the nearest has the highest inner product; by the triangle inequality none
    of an annulus is nearer than the gap between the query's and the annulus' distances to the pivot.
    """
    d = np.linalg.norm(np.r_[q, 0.0] - lifted)
    gap = np.maximum(0.0, np.maximum(d - high, low - d))
    squares = q @ q + reach
    # rounding of distances is relative to the lengths involved
    return (squares - gap**2) / 2 + 1e-9 * squares + 1e-6


def top_contours(contours: DataFrame, queries: DataFrame, k: int = 10, vector: str = "f0_norm", scale: float = 1024.0) -> DataFrame:
    """For each query contour the ``k`` contours with the highest inner product of whole-numbered components.

    ``contours`` and ``queries`` have id and ``vector``, such as normalized pitch contours; a component x counts as
    floor(``scale`` * x). The result is exact.

    Pivots are chosen on a bounded sample. Every contour is keyed by its nearest pivot and its distance to it, and the contours of a pivot
    are cut along that distance into annuli of at most ANNULUS_ROWS. One more coordinate lifts the contours of a pivot to equal length,
    so that the highest inner product belongs to the nearest contour. A query opens the annulus with the best bound, then the
    next ones, then all whose triangle-inequality bound reaches its k-th best score so far, and never the others. A pivot that holds most rows is many
    annuli, and queries are dealt over tasks in blocks.

    Returns query_id, rank (from 1), id, score (long); ties go to the smaller id; fewer rows where there are fewer contours.
    Rows with the query's id are not its candidates; other repeated ids count as often as they occur. Contours of different lengths are not
    compared. Scores beyond 64 bits stop at the ends of that range. Vectors null or holding null or non-finite components and
    rows without id take no part; zero and empty vectors do; empty tables give an empty result.
    """
    spark = contours.sparkSession
    rows = staged(usable(contours, vector).select("id", whole_components("vector", scale).alias("vector")), "contour-components")
    # distinct queries: repeated rows of one id and vector ask once
    asked = usable(queries, vector).select("id", whole_components("vector", scale).alias("vector")).dropDuplicates(["id", "vector"])
    asked = staged(asked.select(F.xxhash64("id", "vector").alias("ask"), "id", "vector"), "contour-queries")
    kind = rows.schema["id"].dataType.simpleString()
    total = rows.count()
    # only about twice as many rows as are drawn take part in the ordering, whatever the table's size
    known = rows.withColumn("_u", uniform("id", 31)).filter(F.col("_u") < min(1.0, 2.0 * SAMPLE / max(1, total)))
    drawn = known.orderBy("_u", "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    pivots = choose_pivots([np.asarray(v, dtype=np.float64) for v in drawn])

    @F.pandas_udf("long")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(pivots.nearest(batch.to_list()), dtype="int64")

    placed = staged(rows.withColumn("part", nearest("vector")), "contour-pivots")
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    # one row per pivot, of which there are at most PIVOTS and the origin
    reach = {r["part"]: r["reach"] for r in placed.groupBy("part").agg((F.max(squares) * (1 + 1e-12)).alias("reach")).collect()}
    lifted = Pivots(pivots.points, pivots.first, reach)

    @F.pandas_udf("double")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, parts in batches:
            yield pd.Series(lifted.distances(vectors.to_list(), parts.to_numpy()), dtype="float64")

    keyed = placed.withColumn("distance", distance("vector", "part")).withColumn("n", F.size("vector"))
    # sorted by pivot and distance; annuli are stretches of that order within a pivot and length
    sorted_rows = number_sorted(keyed, ["part", "n", "distance", "id"], "_no")
    sorted_rows = staged(sorted_rows.withColumn("annulus", F.floor(F.col("_no") / ANNULUS_ROWS)).drop("_no"), "contour-annuli")
    ring = ["part", "n", "annulus"]
    rings = staged(
        sorted_rows.groupBy(*ring).agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("_rows")), "contour-rings"
    )
    # annuli of one length meet its queries in stretches, each summed up in arrays of bounded size
    stretch = rings.withColumn("_at", F.floor(F.col("annulus") / 4096)).groupBy("n", "_at").agg(
        *[F.collect_list(c).alias(c) for c in ("part", "annulus", "low", "high")]
    )
    slices = 1 + asked.count() // (4 * QUERY_ROWS)
    best: DataFrame | None = None
    opened: DataFrame | None = None

    def admitted(most: int | None, bound: DataFrame | None, before: DataFrame | None) -> DataFrame:
        """(ask, ring): annuli whose bound reaches the query's k-th score, without those opened before; at most ``most`` a query."""
        asks = asked.withColumn("n", F.size("vector"))
        asks = asks.withColumn("least", F.lit(None).cast("long")) if bound is None else asks.join(bound, "ask", "left")

        @F.pandas_udf("array<struct<part long, annulus long, bound double>>")
        def open_annuli(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for vectors, least, parts, numbers, lows, highs in batches:
                out = []
                for q, floor, part, number, low, high in zip(vectors, least, parts, numbers, lows, highs):
                    limit = np.empty(len(part))
                    for p in np.unique(part):
                        own = part == p
                        limit[own] = annulus_bounds(q, lifted.at(int(p), len(q)), lifted.reach[int(p)], low[own], high[own])
                    # a bound that is no number keeps its annulus
                    keep = np.ones(len(part), dtype=bool) if pd.isna(floor) or floor <= -LARGEST else ~(limit < float(floor))
                    order = np.flatnonzero(keep)
                    order = order[np.argsort(-limit[order], kind="stable")][:most]
                    out.append([(int(part[i]), int(number[i]), float(limit[i])) for i in order])
                yield pd.Series(out, dtype=object)

        # so many queries at most share a copy of the annuli's distances
        asks = asks.withColumn("_slice", F.pmod(F.col("ask"), F.lit(slices)))
        copies = stretch.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
        found = asks.join(copies, ["n", "_slice"]).select("ask", "n", F.explode(open_annuli("vector", "least", "part", "annulus", "low", "high")).alias("a"))
        found = found.select("ask", "n", "a.*")
        if before is not None:
            found = found.join(before, ["ask", *ring], "left_anti")
        if most is not None:
            w = Window.partitionBy("ask").orderBy(F.desc("bound"), "part", "annulus")
            found = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
        return staged(found.select("ask", *ring), "contour-openings")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_of_annulus(left, right, k)

    result = f"ask long, query_id {kind}, id {kind}, score long"
    top = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    for most in (*ROUNDS, None):
        # a query with k results opens only what may hold a better one
        bound = None if best is None else best.groupBy("ask").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        # bounded rounds may take what was opened before, so so many more are ranked
        opening = admitted(None if most is None else most + sum(m for m in ROUNDS if m < most), bound, opened)
        opened = opening if opened is None else opened.unionByName(opening)
        blocks = opening.groupBy(*ring).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
        q = opening.join(asked, "ask").join(blocks, ring).withColumn("block", F.pmod(F.xxhash64("ask"), "blocks").cast("int"))
        r = sorted_rows.join(blocks, ring).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = [*ring, "block"]
        found = (
            q.select(*keys, "ask", "id", "vector").groupBy(*keys)
            .cogroup(r.select(*keys, "id", "vector").groupBy(*keys))
            .applyInPandas(compare, result)
        )
        found = found if best is None else found.unionByName(best)
        best = staged(found.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k).drop("_r"), "contour-best")
    ranked = best.withColumn("rank", F.row_number().over(top))
    return ranked.select("query_id", "rank", "id", "score")


def best_of_annulus(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k highest inner products of each query with the rows of one annulus; ties go to the smaller id."""
    empty = pd.DataFrame({"ask": [], "query_id": [], "id": [], "score": []})
    if not len(queries) or not len(rows):
        return empty
    rows = rows.sort_values("id", ignore_index=True)
    q, r = matrix(queries["vector"]), matrix(rows["vector"])
    asks, q_ids, r_ids, out = queries["ask"].to_numpy(), queries["id"].to_numpy(), rows["id"].to_numpy(), []
    for at in range(0, len(q), 256):
        ids = q_ids[at : at + 256]
        scores = inner_products(q[at : at + 256], r)
        other = ids[:, None] != r_ids[None]
        most = min(k, len(r))
        # the k-th highest of each query among others; own rows stand below all
        held = np.where(other, scores, -LARGEST - 1)
        bound = -np.partition(-held.astype(np.float64), most - 1, axis=1)[:, most - 1]
        which, found = np.nonzero(other & (held.astype(np.float64) >= bound[:, None]))
        score = scores[which, found]
        order = np.lexsort((found, -score, which))
        which, found, score = which[order], found[order], score[order]
        kept = np.arange(len(which)) - np.searchsorted(which, which) < k
        out.append(pd.DataFrame({"ask": asks[at : at + 256][which[kept]], "query_id": ids[which[kept]], "id": r_ids[found[kept]], "score": score[kept]}))
    return pd.concat(out)
