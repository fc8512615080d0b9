"""Quality of sentence texts: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.llm.common import packed, uniform, whole
from lingotide.llm.ngrams import NgramHasher

BITS = 18
# the model is fitted on at most so many labelled texts, drawn by a hash of their ids
SAMPLE = 3000
EPOCHS = 4


@dataclass(frozen=True)
class QualityModel:
    """Weights by slot and the bias."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, hasher: NgramHasher, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(hasher.dot(self.weights, text) + self.bias, -35, 35))))


def ftrl(
    samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS,
    alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> QualityModel:
    """One coordinate-wise FTRL-proximal pass per epoch over sparse samples, in a fixed order.

    A slot's weight is worked out when a sample touches it: zero within ``l1`` of no gradient, else the closed form of
    the regularised leader. Classes are weighted to equal mass. Without samples the model scores every text 0.5.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def leader(slots: np.ndarray) -> np.ndarray:
        s = z[slots]
        return np.where(np.abs(s) <= l1, 0.0, -(s - np.sign(s) * l1) / ((beta + np.sqrt(n[slots])) / alpha + l2))

    positive = max(1.0, float(labels.sum()))
    mass = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * max(1.0, len(labels) - positive)))
    # each sample's last slot is the bias
    ready = [(np.append(s, size - 1), np.append(v, 1.0)) for s, v in samples]
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(ready)):
            slots, values = ready[i]
            w = leader(slots)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - labels[i]) * mass[i] * values
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            z[slots] += g - sigma * w
            n[slots] += g * g
    weights = leader(np.arange(size))
    return QualityModel(weights[:-1], float(weights[-1]), bits)


def fit_quality(texts: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> QualityModel:
    """Fit on labelled sentence texts: (id, text) with (id, quality 0 or 1).

    At most ``sample`` texts are used, those with the smallest hash of their id among rows for which ``usable``, an
    expression over id, holds: as many of either class, since good texts outnumber bad ones. They are the only rows
    that reach the driver. Null or other qualities and null ids are left out; an id labelled twice counts once, with
    the smaller label; of repeated texts of an id the smallest counts. Texts count whole.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("id").isNotNull())
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = []
    for label in (0, 1):
        of = known.filter(F.col("quality") == label).withColumn("_u", uniform("id", 23))
        drawn.append(of.orderBy("_u", "id").limit(sample // 2))
    picked = drawn[0].unionByName(drawn[1])
    rows = (
        texts.select("id", whole("text").alias("text"))
        .join(F.broadcast(picked), "id")
        .groupBy("id", "quality", "_u")
        .agg(F.min("text").alias("text"))
        .orderBy("_u", "id")
        .select("text", "quality")
        .toPandas()
    )
    hasher = NgramHasher(BITS)
    return ftrl([hasher.vector(t) for t in rows["text"]], rows["quality"].to_numpy(dtype=float))


def scorer(df: DataFrame, model: QualityModel):
    """A pandas function from texts to scores; the weights reach each executor once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        hasher = NgramHasher(model.bits)
        for batch in batches:
            yield pd.Series([model.score(hasher, t) for t in batch], dtype="float64")

    return score


def score_quality(texts: DataFrame, model: QualityModel) -> DataFrame:
    """Scores of sentence texts (id, text): id, score between 0 and 1, 1 for good.

    Whole texts are scored as sparse dot products; a null or empty text gets the bias alone. Repeated rows repeat,
    ids may be null, other columns are left out.
    """
    score = scorer(texts, model)
    return texts.select("id", score(whole("text")).alias("score"))


def keep_good(documents: DataFrame, model: QualityModel, column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` whose ``column`` scores at least ``threshold``; columns are unchanged."""
    score = scorer(documents, model)
    scored = packed(documents, score(whole(column)).alias("_score"))
    return scored.filter(F.col("_score") >= threshold).select("_row.*")
