"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size gives every document the same fractional number of copies.  Whole copies are
taken at once; the fractional parts are rounded dependently: two documents are paired and words are moved from
one to the other, in a random direction that keeps each one's expectation, until one of them is integral.  The
words of a pair never change, so a group of documents keeps its total and hands on at most one fractional
document.  Groups are cut by a hash of the row, their residuals meet 256 at a time in a reduction tree, and the
last one of a source is decided by its own draw.  A source thus misses its target by one document at most.

Defined cases: a NULL text has size 0 and a size of 0 takes 0 words; NULL is a source, the last one; repeated
rows are documents of their own; an empty table gives no rows; other columns are ignored.  Draws depend on the
rows alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, need, stored

WEIGHTS, BUDGET, MOST_COPIES = (3, 1, 2), 1.5, 2
ROWS_PER_GROUP, FAN_IN = 4096, 256


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a hash h of the row."""
    d = need(docs, "doc_id", "text", "source")
    return d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                    F.xxhash64("doc_id", "text").alias("h"))


def numbered(src: DataFrame) -> DataFrame:
    """Position k of every source in code point order, NULL last, without a one-task sort."""
    cut = stored(src.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    w = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)     # one row per partition
    ahead = cut.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return cut.withColumn("k", F.row_number().over(w)).join(ahead, "part").withColumn("k", F.col("k") + F.col("ahead") - 1).drop("part", "ahead")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """source, k, n_docs, source_size, target: shares of budget x all words by weight, none above most x its size."""
    src = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    src = stored(src.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")))
    total, all_weight = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    words = budget * total
    rate, full = (words / all_weight if all_weight else 0.0), 0
    while True:     # the full sources only grow in number, so this ends
        over = F.col("cap") < F.lit(rate) * F.col("weight")
        n, held, open_weight = src.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        full, rate = n, (words - held) / open_weight
    return src.select("source", "k", "n_docs", "source_size", F.least(F.col("cap").cast("double"), F.lit(rate) * F.col("weight")).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Round p in place, keeping sum(p * size); returns the index that stays fractional, or -1."""
    draws = rng.random(len(p))
    held = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        u, v = a * p[held], b * p[j]
        up, down = min(a - u, v), min(u, b - v)         # words j -> held, and held -> j
        if draws[j] * (up + down) < down:
            if a - u <= v:
                p[held], p[j] = 1.0, min(1.0, (v - (a - u)) / b)
            else:
                p[held], p[j] = (u + v) / a, 0.0
        elif u <= b - v:
            p[held], p[j] = 0.0, min(1.0, (u + v) / b)
        else:
            p[held], p[j] = (u - (b - v)) / a, 1.0
        held = held if 0.0 < p[held] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return held


def _round(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "size"], kind="stable").reset_index(drop=True)
        p, size = pdf["p"].to_numpy(copy=True), pdf["size"].to_numpy(float)
        seed = np.array([pdf["k"].iloc[0], pdf["bucket"].iloc[0], len(pdf), pdf["h"].iloc[0]], np.int64).view(np.uint64)
        rng = np.random.default_rng(seed)
        held = pivot(p, size, rng)
        if held >= 0 and last:
            p[held] = float(rng.random() < p[held])
        return pdf.assign(p=p)

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES,
        rows_per_group: int = ROWS_PER_GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies of every document."""
    sized = stored(sizes(docs))
    goal = stored(targets(sized, weights, budget, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (sized.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
            .withColumn("whole", F.floor(rate).cast("long"))
            .withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
            .withColumn("bucket", F.pmod("h", F.ceil(F.col("n_docs") / rows_per_group))))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "whole", "p", "k", "bucket", "h")
    groups = goal.agg(F.max(F.ceil(F.col("n_docs") / rows_per_group))).first()[0] or 1
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done = rows.filter(~open_)
    rows = rows.filter(open_)
    while True:
        out = stored(rows.groupBy("k", "bucket").applyInPandas(_round(groups == 1), T.StructType(rows.schema.fields)))
        done = done.unionByName(out.filter(~open_))
        if groups == 1:
            break
        rows = out.filter(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        groups = -(-groups // fan_in)
    copies = F.col("whole") + F.col("p").cast("long")
    return done.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))
