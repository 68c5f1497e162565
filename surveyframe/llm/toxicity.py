"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, its pairs of neighbouring words and its pairs with one or two words
left out, hashed into a fixed number of buckets (words apart from pairs).  FTRL-proximal keeps per coordinate a sum z
of gradients and a sum n of their squares; n gives every coordinate its own rate and the L1 term leaves most weights
at exactly 0.  Labelled rows are cut into SHARDS by hash; in every round each shard makes one pass from the common
state and the states are averaged, so fitting runs on the executors, and what travels is bounded by the buckets.  The
examples are dealt to their shards once, two bytes a bucket, and every round reads them where they lie.

At most about `max_rows` labelled rows that are not held out are used, picked by a hash of the id.  Defined cases: a
NULL or empty text has no features and gets the score of the bias; with no labels every score is 0.5; of conflicting
labels of a doc_id the larger counts; repeated rows are scored each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTER, arrow_map, checkpointed, held_out, label_sample, mix, need, row_slices, text_buffer, word_hashes

WORD_BUCKETS, BUCKETS = 1 << 16, 1 << 18
MAX_ROWS, SHARDS, ROUNDS = 10_000, 8, 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0


def _features(words: np.ndarray, first: np.ndarray):
    """(row, bucket) arrays of every word and pair of a slice, kind by kind."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield row, (words >> np.uint64(48)).astype(np.int64)
    for gap, factor in ((1, 3), (2, 5), (3, 7)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            h = mix(words[:-gap] * np.uint64(factor) + words[gap:])
            yield row[gap:][same], (WORD_BUCKETS + (h % np.uint64(BUCKETS - WORD_BUCKETS)).astype(np.int64))[same]


def _slices(column: pa.Array):
    data, off = text_buffer(column, lower=True)
    for lo, hi in row_slices(off):
        yield lo, hi, *word_hashes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], LETTER)


def _packed(buckets: np.ndarray) -> bytes:
    """Ascending buckets in two bytes each, behind the number of them in each block of 2^16."""
    many = np.diff(np.searchsorted(buckets, np.arange(0, BUCKETS + 1, 1 << 16)))
    return many.astype("<u4").tobytes() + (buckets & 0xFFFF).astype("<u2").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    blocks = BUCKETS >> 16
    many = np.frombuffer(packed, "<u4", blocks)
    return np.repeat(np.arange(blocks, dtype=np.int64) << 16, many) + np.frombuffer(packed, "<u2", offset=4 * blocks)


def _examples(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """y, a hash that orders the rows, their shard, and the distinct buckets of each sampled text."""
    d = docs.join(F.broadcast(sample), "doc_id").select("y", F.xxhash64("doc_id").alias("h"), "text")

    def run(b: pa.RecordBatch):
        for lo, hi, words, first in _slices(b.column("text")):
            code = np.unique(np.concatenate([(r << 18) | i for r, i in _features(words, first)]))
            cut = np.searchsorted(code >> 18, np.arange(hi - lo + 1))
            buckets = code & (BUCKETS - 1)
            yield {"y": b.column("y").slice(lo, hi - lo), "h": b.column("h").slice(lo, hi - lo),
                   "x": pa.array([_packed(buckets[at:to]) for at, to in zip(cut, cut[1:])], pa.binary())}

    x = arrow_map(d, run, "y int, h long, x binary")
    return x.withColumn("shard", F.pmod("h", F.lit(SHARDS)))


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _pass(z0: np.ndarray, n0: np.ndarray, round_: int):
    """One pass of FTRL-proximal over each shard of a partition; the last coordinate is the bias, which is not penalised."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(frames)
        for _, shard in pd.concat(frames).groupby("shard") if frames else ():
            yield one(shard)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n = z0.copy(), n0.copy()
        order = np.argsort((pdf["h"].to_numpy().view(np.uint64) * np.uint64(2 * round_ + 1)) >> np.uint64(7), kind="stable")
        xs, ys = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        for i in order:
            x = np.append(_unpacked(xs[i]), BUCKETS)
            zx, nx = z[x], n[x]
            w = weights_of(zx, nx)
            w[-1] = -zx[-1] * ALPHA / (BETA + math.sqrt(nx[-1]))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum()))))
            g = p - ys[i]
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
        at = np.flatnonzero((n != n0) | (z != z0))
        return pd.DataFrame({"at": at.astype(np.int32), "dz": (z - z0)[at], "dn": (n - n0)[at]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of all buckets (mostly 0) and the bias."""
    rows = checkpointed(_examples(need(docs, "doc_id", "text"), label_sample(labels, label, max_rows)).repartition(SHARDS, "shard"))      # a shard is in one partition
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in range(rounds):
        moved = rows.mapInPandas(_pass(z, n, r), "at int, dz double, dn double")
        step = moved.groupBy("at").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toPandas().sort_values("at")     # bounded by the buckets
        z[step["at"]] += step["dz"] / SHARDS
        n[step["at"]] += step["dn"] / SHARDS
    return weights_of(z[:-1], n[:-1]).astype(np.float32), float(-z[-1] * ALPHA / (BETA + math.sqrt(n[-1])))


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    d = need(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    at = np.flatnonzero(weights)            # what is sent: the few weights that are not 0
    value = weights[at]

    def run(b: pa.RecordBatch):
        w = np.zeros(BUCKETS, np.float32)
        w[at] = value
        s = np.full(b.num_rows, bias)
        for lo, hi, words, first in _slices(b.column("text")):
            hits = [((r << 18) | i)[w[i] != 0] for r, i in _features(words, first)]
            code = np.unique(np.concatenate(hits))
            s[lo:hi] += np.bincount(code >> 18, weights=w[code & (BUCKETS - 1)], minlength=hi - lo)
        p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
        yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return arrow_map(d, run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
                                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return score(docs, *fit(docs, labels, max_rows=max_rows))
