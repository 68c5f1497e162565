"""Exact neighbours, twins and silhouettes of fixed-length vectors by blocks.

Rows are cut into blocks of bounded size, every pair of blocks meets in one task as two small matrices,
and only the best few rows or the sums per label leave it.  The pairs themselves are never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.operators.scale import attach_row, top_rows

BLOCK_ROWS = 2000
BLOCKS, MOST_ROWS = 32, 32_000                    # blocks of a large table, rows of a block
CELLS, FOUND = 1 << 18, 1 << 22                   # distances made at a time, so that they stay in the cache; candidates held at a time


def _meetings(df: DataFrame, row: str, within: list[str], block: int) -> DataFrame:
    """Add (_a, _b) block pairs: each row goes to every meeting its block takes part in, on side _a or _b or both.

    Blocks are cut by hash inside each `within` group, so a large group has many blocks and no task holds more than two.
    """
    sizes = df.groupBy(*within).agg(F.count("*").alias("_n")) if within else df.agg(F.count("*").alias("_n"))
    j = df.join(sizes, within) if within else attach_row(df, sizes)
    k = F.ceil(F.col("_n") / block).cast("int")
    j = j.withColumn("_c", F.pmod(F.xxhash64(row), k).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), k - 1)))
    return j.withColumn("_a", F.least("_c", "_o")).withColumn("_b", F.greatest("_c", "_o")).drop("_n", "_o")


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[pd.DataFrame, pd.DataFrame]]]:
    a = pdf[pdf["_c"] == pdf["_a"].iloc[0]]
    if pdf["_a"].iloc[0] == pdf["_b"].iloc[0]:
        return a, [(a, a)]
    b = pdf[pdf["_c"] == pdf["_b"].iloc[0]]
    return a, [(a, b), (b, a)]


def _unit(x: np.ndarray, centred: bool) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True) if centred else x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def _first_of(i: np.ndarray, j: np.ndarray, d: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of every i in the order (d, others[j])."""
    order = np.lexsort((others[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    kept = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))) < k
    return i[kept], j[kept], d[kept]


def _edge(d2: np.ndarray, k: int, axis: int) -> np.ndarray:
    """A bound that at least k squared distances along the axis do not pass, with room for rounding: the k-th of the least of each of many pieces."""
    n, pieces = d2.shape[axis], max(64, 4 * k)
    if n > pieces:
        d2 = np.minimum.reduceat(d2, np.arange(pieces) * n // pieces, axis=axis)
    elif n < k:
        return np.full(d2.shape[1 - axis], np.inf)
    return (np.sqrt(np.maximum(np.partition(d2, k - 1, axis=axis).take(k - 1, axis=axis), 0)) + 2e-9) ** 2


def nearest(df: DataFrame, row: str, vector: str, k: int, carry: str, exclude: str | None = None, block: int | None = None) -> DataFrame:
    """row, other, distance, <carry>_other for the k nearest rows by Euclidean distance; `exclude` must differ.

    The number of blocks is fixed until they hold MOST_ROWS, so that what travels follows the rows; a task holds two
    blocks and the distances of some rows of one to the other, which serve both sides; only those within a bound are ordered.
    """
    cols = [row, vector, carry, *([exclude] if exclude and exclude != carry else [])]
    if block is None:
        block = min(MOST_ROWS, max(BLOCK_ROWS, -(-df.count() // BLOCKS)))
    meet = _meetings(df.select(*cols), row, [], block)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []

        def add(q: pd.DataFrame, r: pd.DataFrame, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
            out.append(pd.DataFrame({row: q[row].to_numpy()[i], "other": r[row].to_numpy()[j], "distance": d, f"{carry}_other": r[carry].to_numpy()[j]}))

        def within(d2: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, j = np.divmod(np.flatnonzero(d2 <= edge), d2.shape[1])
            seen = np.isfinite(d2[i, j])
            i, j = i[seen], j[seen]
            return i, j, np.round(np.sqrt(np.maximum(d2[i, j], 0)), 9)

        q, sides = _sides(pdf)
        r = sides[0][1]
        if len(q) and len(r):
            alone = q is r
            q, r = (f.sort_values(exclude, kind="stable") if exclude else f for f in (q, r))
            x, y = (np.stack(f[vector].to_numpy()).astype(float) for f in (q, r))
            xx, yy, step, y = (x * x).sum(1), (y * y).sum(1), max(1, CELLS // len(r)), -2 * y.T
            own, other = q[row].to_numpy(), r[row].to_numpy()
            back, held = [], 0
            if not alone:                                          # bounds of the other side from some rows of this one
                some = np.unique(np.linspace(0, len(q) - 1, max(4 * k, FOUND // len(r))).astype(int))
                d2 = x[some] @ y + xx[some, None] + yy
                if exclude:
                    d2[q[exclude].to_numpy()[some, None] == r[exclude].to_numpy()] = np.inf
                edge = _edge(d2, k, 0)
            for lo in range(0, len(q), step):
                d2 = x[lo:lo + step] @ y
                d2 += xx[lo:lo + step, None]
                d2 += yy
                if exclude:                                        # both are in its order: rectangles
                    values, first = np.unique(q[exclude].to_numpy()[lo:lo + step], return_index=True)
                    for v, f, t in zip(values, first, [*first[1:], len(d2)]):
                        d2[f:t, slice(*(np.searchsorted(r[exclude].to_numpy(), v, side) for side in ("left", "right")))] = np.inf
                if alone:                                          # a row is in one block
                    d2[own[lo:lo + step, None] == other] = np.inf
                i, j, d = within(d2, _edge(d2, k, 1)[:, None])
                add(q, r, *_first_of(i + lo, j, d, other, k))
                if not alone:
                    i, j, d = within(d2, edge)
                    back.append((j, i + lo, d))
                    held += len(j)
                    if held > FOUND:
                        back = [_first_of(*(np.concatenate(c) for c in zip(*back)), own, k)]
                        many, held = np.bincount(back[0][0], minlength=len(r)), len(back[0][0])
                        full = many >= k
                        edge[full] = np.minimum(edge[full], (back[0][2][np.cumsum(many)[full] - 1] + 2e-9) ** 2)
            if back:
                add(r, q, *_first_of(*(np.concatenate(c) for c in zip(*back)), own, k))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[row, "other", "distance", f"{carry}_other"])

    types = dict(df.dtypes)
    schema = f"{row} {types[row]}, other {types[row]}, distance double, {carry}_other {types[carry]}"
    found = meet.groupBy("_a", "_b").applyInPandas(best, schema)
    return top_rows(found, [row], [F.col("distance").asc(), F.col("other").asc()], k)


def knn_accuracy(df: DataFrame, row: str, vector: str, label: str, fold: str, k: int) -> DataFrame:
    """Majority vote of the k nearest rows of other folds, per fold; a shuffled label gives the control."""
    near = nearest(df, row, vector, k, label, fold)
    votes = near.groupBy(row, f"{label}_other").agg(F.count("*").alias("_n"))
    pred = votes.groupBy(row).agg(F.min_by(f"{label}_other", F.struct(-F.col("_n"), F.col(f"{label}_other"))).alias("pred"))
    j = df.select(row, label, fold).join(pred, row)
    return j.groupBy(fold).agg(F.avg((F.col(label) == F.col("pred")).cast("int")).alias("accuracy"), F.count("*").alias("rows"))


def silhouette(df: DataFrame, row: str, vector: str, label: str, block: int = BLOCK_ROWS) -> DataFrame:
    """label, silhouette, rows from exact Euclidean distances; each task emits distance sums per row and label."""
    meet = _meetings(df.select(row, vector, label), row, [], block)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, r in _sides(pdf)[1]:
            x, y = np.stack(q[vector].to_numpy()).astype(float), np.stack(r[vector].to_numpy()).astype(float)
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
            d[q[row].to_numpy()[:, None] == r[row].to_numpy()[None]] = 0.0
            for lab in np.unique(r[label].to_numpy()):
                out.append(pd.DataFrame({row: q[row].to_numpy(), label: q[label].to_numpy(), "to": lab, "s": d[:, r[label].to_numpy() == lab].sum(1)}))
        return pd.concat(out, ignore_index=True)

    types = dict(df.dtypes)
    part = meet.groupBy("_a", "_b").applyInPandas(sums, f"{row} {types[row]}, {label} {types[label]}, to {types[label]}, s double")
    n = df.groupBy(F.col(label).alias("to")).agg(F.count("*").alias("_n"))
    t = part.groupBy(row, label, "to").agg(F.sum("s").alias("s")).join(n, "to")
    own = F.col(label) == F.col("to")
    g = t.groupBy(row, label).agg(F.max(F.when(own & (F.col("_n") > 1), F.col("s") / (F.col("_n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("_n"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return g.groupBy(label).agg(F.avg(s).alias("silhouette"), F.count("*").alias("rows"))


def sibling_correlation(df: DataFrame, key: str, row: str, vector: str, limit: float = 0.99, block: int = BLOCK_ROWS) -> DataFrame:
    """key, row, max_corr (largest |Pearson r| with another row of the key), distinct."""
    meet = _meetings(df.select(key, row, vector), row, [key], block)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, r in _sides(pdf)[1]:
            c = np.abs(_unit(np.stack(q[vector].to_numpy()).astype(float), True) @ _unit(np.stack(r[vector].to_numpy()).astype(float), True).T)
            c[q[row].to_numpy()[:, None] == r[row].to_numpy()[None]] = -1.0
            out.append(pd.DataFrame({key: q[key].to_numpy(), row: q[row].to_numpy(), "c": c.max(axis=1)}))
        return pd.concat(out, ignore_index=True)

    types = dict(df.dtypes)
    part = meet.groupBy(key, "_a", "_b").applyInPandas(best, f"{key} {types[key]}, {row} {types[row]}, c double")
    g = part.groupBy(key, row).agg(F.max(F.when(F.col("c") >= 0, F.col("c"))).alias("max_corr"))
    return g.withColumn("distinct", F.coalesce(F.col("max_corr") < limit, F.lit(True)))
