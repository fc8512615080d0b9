"""Block helpers against plain windows, with one key holding most rows and blocks far smaller than it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lingotide.operators import blocks as B


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 700), ("a", 1), ("b", 9), ("c", 64)):
        rows += [(key, i, float(x), bool(f)) for i, (x, f) in enumerate(zip(rng.normal(size=n).round(2), rng.random(n) < 0.6))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["key", "i", "x", "f"])).repartition(5).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_halo_matches_plain_window(skewed):
    plain = Window.partitionBy("key").orderBy("i")
    want = skewed.select("key", "i", F.lag("x", 2).over(plain).alias("l"), F.lead("x", 3).over(plain).alias("r"))
    w = B.halo_window(["key"], "i")
    got = B.halo(skewed, "i", before=2, after=3, rows=8)
    got = B.own_rows(got.withColumn("l", F.lag("x", 2).over(w)).withColumn("r", F.lead("x", 3).over(w))).select("key", "i", "l", "r")
    assert rows_of(got.fillna(-99.0)) == rows_of(want.fillna(-99.0))


def test_number_rows(skewed):
    want = skewed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("x", "i")) - 1).select("key", "i", "n")
    got = B.number_rows(skewed, ["key"], ["x", "i"], F.floor(F.col("x") * 2), "n").select("key", "i", "n")
    assert rows_of(got) == rows_of(want)


def test_number_rows_without_key(skewed):
    got = B.number_rows(skewed, [], ["key", "i"], F.struct("key", B.block_of("i", 16).alias("b")), "n")
    assert [r.n for r in got.orderBy("key", "i").collect()] == list(range(774))


def test_totals_of_many_blocks_are_summed_in_spans(skewed):
    totals = skewed.select("key", F.col("i").alias("_block"), "x")
    w = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    want = totals.select("key", "_block", F.round(F.coalesce(F.sum("x").over(w), F.lit(0)), 6))
    got = B._before(totals, ["key"], "x", span=16)
    assert rows_of(got.select("key", "_block", F.round("_before", 6))) == rows_of(want)


def test_number_sorted(skewed, spark):
    got = B.number_sorted(skewed, [F.desc("x"), "key", "i"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(774))
    assert [(-r.x, r.key, r.i) for r in got] == sorted((-r.x, r.key, r.i) for r in got)
    odd = spark.createDataFrame([(None,), (2,), (2,), (None,)], "v int")
    assert sorted(r.n for r in B.number_sorted(odd, ["v"], "n").collect()) == [0, 1, 2, 3]
    assert B.number_sorted(odd.filter("v > 5"), ["v"], "n").count() == 0


def test_running_sum(skewed):
    w = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("key", "i", F.round(F.sum("x").over(w), 6).alias("s"))
    got = B.running_sum(skewed, ["key"], "i", F.col("x"), "s", B.block_of("i", 8)).select("key", "i", F.round("s", 6).alias("s"))
    assert rows_of(got) == rows_of(want)


def test_runs(skewed):
    want = []
    for key, part in skewed.toPandas().sort_values(["key", "i"]).groupby("key"):
        group = (part["f"] != part["f"].shift()).cumsum()
        found = [(g["i"].min(), g["i"].max()) for _, g in part.groupby(group) if g["f"].iloc[0]]
        want += [(key, n + 1, int(a), int(b)) for n, (a, b) in enumerate(found)]
    assert rows_of(B.runs(skewed, ["key"], "i", F.col("f"), rows=8)) == sorted(want)


def test_exact_median(skewed):
    want = {k: round(float(np.median(g)), 9) for k, g in skewed.toPandas().groupby("key")["x"]}
    got = {r.key: round(r.m, 9) for r in B.exact_median(skewed, ["key"], "x", 0.05, "m").collect()}
    assert got == want
    whole = B.exact_median(skewed, [], "x", 0.05, "m").collect()
    assert round(whole[0].m, 9) == round(float(np.median(skewed.toPandas()["x"])), 9)


def test_median_of_equal_values(spark):
    rows = spark.createDataFrame([("k", 2.0)] * 50 + [("k", 3.0)] * 50, "key string, x double")
    assert B.exact_median(rows, ["key"], "x", 1.0, "m").first().m == 2.5
