"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts where the texts are. The trees are fitted on a bounded sample of labelled
rows (TRAIN_DOCS, drawn by a hash) and flattened into arrays, one row per tree in heap order, so that a batch walks all
of them with a few array operations a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, unit_hash
from .docstats import FEATURES, features

TRAIN_DOCS = 12_000
TREES, DEPTH, RATE, BINS, SHRINK, LEAST = 80, 4, 0.15, 64, 1.0, 10.0


@dataclass
class Forest:
    feature: np.ndarray  # trees by inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees by leaves
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees grown level by level on binned columns, with Newton leaf values."""
    inner = 2**DEPTH - 1
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    if not len(y) or len(set(y.tolist())) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = x.shape[1]
    column = np.arange(width) * BINS
    raw = np.full(len(y), start)
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            at = (((node - first)[:, None] * width * BINS) + column + binned).ravel()
            sums = [np.bincount(at, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS).cumsum(axis=2) for v in (g, h)]
            g_all, h_all = sums[0][:, :, -1:], sums[1][:, :, -1:]
            g_right, h_right = g_all - sums[0], h_all - sums[1]
            gain = sums[0] ** 2 / (sums[1] + SHRINK) + g_right**2 / (h_right + SHRINK) - g_all**2 / (h_all + SHRINK)
            gain[(sums[1] < LEAST / 4) | (h_right < LEAST / 4)] = -np.inf
            best = gain.reshape(many, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            feature[t, first : first + many] = f
            threshold[t, first : first + many] = [edges[f[i]][b[i]] if good[i] and b[i] < len(edges[f[i]]) else np.inf for i in range(many)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        own = node - inner
        leaf[t] = -RATE * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + SHRINK)
        raw += leaf[t, own]
    return Forest(feature, threshold, leaf, start)


def document_features():
    return F.pandas_udf(lambda text: pd.Series([features(t) for t in text]), "array<double>")


def scorer(forest: Forest):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(forest.scores(np.array([features(t) for t in batch], float).reshape(len(batch), len(FEATURES))))

    return score


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Forest:
    """Trees from labelled documents outside fold 1 of 3. Of several labels of one id the smallest counts; null labels none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter((fold(F.col("doc_id"), 3) != 1) & F.col("quality").isNotNull())
    n = known.count()
    chosen = known.filter(unit_hash(F.col("doc_id")) < min(1.0, train_docs / max(n, 1))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.join(chosen, "doc_id").select("doc_id", "quality", document_features()("text").alias("x")).toPandas().sort_values("doc_id", ignore_index=True)
    return fit(np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["quality"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts have all statistics zero and get the score of those. Repeated rows get equal scores. Without
    a usable label every score is the prior. An empty table gives no rows; other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = named.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), scorer(train(named, labels, train_docs))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
