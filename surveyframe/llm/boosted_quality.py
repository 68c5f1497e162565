"""Quality scores: histogram gradient-boosted trees over document statistics.

The statistics are shares and logarithms of counts of the text alone.  Values are cut into BINS bins by quantiles of the
fitting rows; every level of a tree is chosen from histograms of gradients per (node, statistic, bin).  The trees are
complete binary trees of DEPTH levels, flattened into arrays of statistics, cutoffs and leaves, so that a batch of
documents is scored by numpy indexing level by level.

The trees are fitted on at most about `max_rows` labelled rows that are not held out, picked by a hash of the id; their
statistics (`max_rows` short rows) are what reaches the driver.  Defined cases: a NULL or empty text has all statistics
0 and is scored like any other; with no labels every score is 0.5; of conflicting labels of a doc_id the larger counts;
repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, held_out, label_sample, need
from .text_stats import batch_stats

MAX_ROWS, TREES, DEPTH, BINS, RATE, SMOOTH, MIN_ROWS = 20_000, 80, 4, 64, 0.15, 5.0, 8
FEATURES = ["log_words", "word_length", "symbols", "equal_lines", "repeats", "distinct", "capitals", "digits", "bangs", "bars", "stops", "commas", "wide",
            "long_words", "short_words", "words_per_line", "words_per_stop"]


def feature_matrix(column: pa.Array) -> np.ndarray:
    """Rows x FEATURES."""
    c = {k: v.astype(float) for k, v in batch_stats(column).items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    share = {"log_words": np.log1p(c["n_words"]), "word_length": c["word_chars"] / words, "symbols": c["n_symbols"] / chars, "equal_lines": c["n_dup_lines"] / lines,
             "repeats": c["n_repeat_words"] / words, "distinct": c["n_distinct_words"] / words, "capitals": c["n_upper"] / chars, "digits": c["n_digits"] / chars,
             "bangs": c["n_bangs"] / words, "bars": c["n_bars"] / words, "stops": c["n_stops"] / words, "commas": c["n_commas"] / words, "wide": c["n_wide"] / chars,
             "long_words": c["n_long_words"] / words, "short_words": c["n_short_words"] / words, "words_per_line": np.log1p(c["n_words"] / lines),
             "words_per_stop": np.log1p(c["n_words"] / np.maximum(c["n_stops"], 1))}
    return np.column_stack([share[f] for f in FEATURES])


@dataclass(frozen=True)
class Trees:
    """Flat trees: statistic and cutoff of every inner node in level order, value of every leaf, and the start score."""

    feature: np.ndarray
    cutoff: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        s, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, cutoff, leaf in zip(self.feature, self.cutoff, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cutoff[node])
            s += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-s))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosting of the logistic loss."""
    n, n_features = x.shape
    if n == 0 or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
        none = np.zeros((0, 0))
        return Trees(none, none, none, float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])      # bin b: value <= edges[b]
    start = float(np.log(y.mean() / (1 - y.mean())))
    s = np.full(n, start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, cutoff, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    cells = np.arange(n_features) * BINS + binned
    for t in range(trees):
        p = 1 / (1 + np.exp(-s))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            base, width = (1 << d) - 1, 1 << d
            at = ((node - base)[:, None] * (n_features * BINS) + cells).ravel()
            size = width * n_features * BINS
            sums = [np.bincount(at, np.repeat(v, n_features), size).reshape(width, n_features, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            gl, hl, nl = sums
            gt, ht, nt = (v[:, :, -1:] for v in sums)
            gain = gl ** 2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt ** 2 / (ht + SMOOTH)
            gain = np.where((nl >= MIN_ROWS) & (nt - nl >= MIN_ROWS), gain, 0.0).reshape(width, -1)
            best = gain.argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, best[k]] > 1e-9 and b < len(edges[f]):
                    feature[t, base + k], cutoff[t, base + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > cutoff[t][node])
        at = node - inner
        leaf[t] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + SMOOTH)
        s += leaf[t][at]
    return Trees(feature, cutoff, leaf, start)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    rows = need(docs, "doc_id", "text").join(F.broadcast(label_sample(labels, label, max_rows)), "doc_id").select("doc_id", "y", "text")

    def run(b: pa.RecordBatch):
        x = feature_matrix(b.column("text"))
        yield {"h": b.column("doc_id").cast(pa.string()), "y": b.column("y"), "x": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))}

    got = arrow_map(rows, run, "h string, y int, x array<double>").toPandas().sort_values("h", kind="stable")
    return fit_trees(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["y"].to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    trees = fit(docs, labels, max_rows=max_rows)
    d = need(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")

    def run(b: pa.RecordBatch):
        p = trees.scores(feature_matrix(b.column("text")))
        yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": p, "predicted": (p >= 0.3).astype(np.int32)}

    return arrow_map(d, run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
                                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
