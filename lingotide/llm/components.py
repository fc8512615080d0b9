"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingotide.session import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of either kind: each vertex ties its (larger or smaller) neighbours to the smallest it knows.

    Links (a, b) have a < b before and after, so a vertex finds its smaller neighbours where it is ``b`` and its larger ones
    where it is ``a``. One grouping and one join a step: plans that grow with every step cost the driver memory.
    """
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    if large:
        kept = edges.join(least, edges["a"] == least["u"], "left").select(F.coalesce("m", "a").alias("a"), "b")
    else:
        tied = edges.join(least, edges["b"] == least["u"])
        kept = tied.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b")
    return kept.distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b): the smallest id that links lead to.

    Large-star and small-star steps alternate until the links are stars around the smallest ids, which takes a number of rounds
    near the logarithm of the longest chain. Each round is written to the shared folder; only a count and a checksum
    come to the driver. Vertices with very many links are joins on one key, which adaptive execution splits.
    """
    edges = staged(links.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        edges = staged(_star(_star(edges, True), False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
