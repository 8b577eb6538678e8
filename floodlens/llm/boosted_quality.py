"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents (about `sample_rows`, chosen by a
hash of their id) whose statistics are binned once; every split is found on histograms of
gradients. A fitted ensemble is a few flat arrays, and a batch of documents walks down all trees
at once with numpy. Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.llm.doc_stats import COUNTS, with_counts
from floodlens.llm.quality_rules import FEATURES, feature_matrix
from floodlens.llm.sampling import hashed_sample
from floodlens.session import staged

SAMPLE_ROWS = 40_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Ensemble:
    """Trees of equal depth as arrays [tree, node]; node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1 of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                right = x[rows, feature[node]] > threshold[node]
                node = 2 * node + 1 + right
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        return 1 / (1 + np.exp(-self.raw(x)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def fit_trees(x: np.ndarray, label: np.ndarray, rounds: int = 80, depth: int = 4,
              rate: float = 0.1, bins: int = 64, smoothing: float = 1.0,
              min_gain: float = 1e-6) -> Ensemble:
    """Boosted trees for logistic loss. Without rows every score is one half."""
    inner = 2 ** depth - 1
    count = label.sum()
    start = float(np.log((count + 1) / (len(label) - count + 1)))
    if not len(x):
        rounds = 0
    edges = _edges(x, bins) if rounds else []
    widest = max([len(e) + 1 for e in edges], default=1)
    binned = (np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)
              if rounds else np.empty((0, 0), np.int64))
    slots = binned + np.arange(len(edges)) * widest  # bin number across all features
    raw = np.full(len(x), start)
    features = np.zeros((rounds, inner), dtype=np.int64)
    thresholds = np.full((rounds, inner), np.inf)
    leaves = np.zeros((rounds, inner + 1))
    for tree in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = label - p, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            base, width = 2 ** level - 1, 2 ** level
            size = len(edges) * widest
            place = ((node - base)[:, None] * size + slots).ravel()
            sums = [np.bincount(place, np.repeat(v, len(edges)), width * size)
                    .reshape(width, len(edges), widest) for v in (gradient, weight)]
            left = [np.cumsum(s, axis=2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            worth = lambda g, h: g * g / (h + smoothing)
            gain = (worth(*left) + worth(whole[0] - left[0], whole[1] - left[1])
                    - worth(*whole))
            for f, e in enumerate(edges):
                gain[:, f, len(e):] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), widest)
                if gain[k, f, b] > min_gain:
                    features[tree, base + k] = f
                    thresholds[tree, base + k] = edges[f][b]
            right = x[np.arange(len(x)), features[tree, node]] > thresholds[tree, node]
            node = 2 * node + 1 + right
        place = node - inner
        g, h = np.bincount(place, gradient, inner + 1), np.bincount(place, weight, inner + 1)
        leaves[tree] = rate * g / (h + smoothing)
        raw += leaves[tree][place]
    return Ensemble(features, thresholds, leaves, start)


def fit(counts: DataFrame, labels: DataFrame, held_out: Column,
        sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Trees for labelled documents that are not held out. Rows with a null id or label, and ids
    labelled in two ways, take no part."""
    known = (labels.where("quality in (0, 1) and doc_id is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").alias("label"), F.max("quality").alias("high"))
             .where("label = high").select("doc_id", "label"))
    rows = hashed_sample(counts.where(~held_out).join(known, "doc_id"), "doc_id",
                         [*COUNTS, "label"], sample_rows)
    if rows.empty:
        return fit_trees(np.empty((0, len(FEATURES))), np.empty(0))
    x = feature_matrix({name: rows[name].to_numpy() for name in COUNTS})
    return fit_trees(x, rows["label"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` up).

    `held_out` is a condition on doc_id; labels of such documents are not learned from, and it is
    false for a null id. A null text is scored as empty; repeated rows are scored one by one.
    Other columns of `docs` play no part.
    """
    ids = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    counts = staged(with_counts(ids), "score-counts")
    held = F.coalesce(held_out, F.lit(False))
    trees = fit(counts, labels, held, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix({name: batch.column(name).to_numpy() for name in COUNTS})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(trees.score(x))],
                names=["doc_id", "held_out", "score"])

    scored = counts.withColumn("held_out", held).mapInArrow(
        run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
