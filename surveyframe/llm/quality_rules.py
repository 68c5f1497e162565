"""Quality rules with risk-controlled cutoffs.

Two fixed base rules reject very short and very repetitive texts.  Beyond them, rules on shares (symbols, capitals,
equal lines, repeated words, word length, ...) get cutoffs per stratum (language) from labelled rows.  One half of
the labelled rows proposes: per rule the cutoff, among quantiles of the good texts, that catches most bad texts at
a price of PRICE bad texts per good one, and from these a fixed sequence of ever sharper rule sets.  The other half
certifies: going down the sequence, a set stands while the exact (Clopper-Pearson) upper bound of its false
rejections among good texts is at most `risk`, at confidence 1 - delta / (number of strata).  A fixed sequence needs
no correction of its own and the strata share delta (Bonferroni), so with probability 1 - delta no stratum loses more
than `risk` of its good texts.  A stratum without enough labels gets no cutoff.

Defined cases: a NULL text has no words and fails the base rules; a NULL stratum is a stratum; of conflicting labels
of a doc_id the lower counts, NULL ids and labels do not count; repeated rows are judged each; an empty table gives no
rows; other columns are ignored by the scores and kept by `accept`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_name, need, stored
from .text_stats import STATS, batch_stats

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
RISK, DELTA, PRICE = 0.05, 0.05, 10
#: Shares of good texts beyond a proposed cutoff, from mild to sharp.
LEVELS = [0.0, 0.001, 0.0025, 0.005, 0.01, 0.02]
#: Rules: a value is bad when it is above its cutoff.
RULES = {"symbols": ("n_symbols", "word_chars", 1), "capitals": ("n_upper", "word_chars", 1), "equal_lines": ("n_dup_lines", "n_lines", 1),
         "repeats": ("n_repeat_words", "n_words", 1), "long_words": ("word_chars", "n_words", 1), "short_words": ("word_chars", "n_words", -1),
         "digits": ("n_digits", "word_chars", 1), "bangs": ("n_bangs", "word_chars", 1), "few_distinct": ("n_distinct_words", "n_words", -1)}


def document_stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every text."""
    d = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")

    def run(b: pa.RecordBatch):
        yield {"doc_id": b.column("doc_id"), "stratum": b.column("stratum")} | batch_stats(b.column("text"))

    return arrow_map(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, stratum string, " + ", ".join(f"{c} long" for c in STATS))


def base_failed(s: str = "") -> Column:
    words, repeated = F.col(f"{s}n_words"), F.col(f"{s}n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def _values(s: str = "") -> Column:
    return F.array(*[F.lit(float(sign)) * F.col(f"{s}{a}") / F.greatest(F.col(f"{s}{b}"), F.lit(1)) for a, b, sign in RULES.values()])


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a binomial rate after k of n, by bisection of the lower tail."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    head = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])
    lo, hi = k / n, 1.0
    for _ in range(60):
        u = (lo + hi) / 2
        tail = np.exp(head + i * math.log(max(u, 1e-300)) + (n - i) * math.log1p(-min(u, 1 - 1e-16))).sum()
        lo, hi = (u, hi) if tail > delta else (lo, u)
    return hi


def _propose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per stratum the cutoffs of every step of the sequence: step j uses each rule at its level or at j, the milder."""
    steps = []
    for row in pdf.itertuples():
        q = np.array(row.cut).reshape(len(RULES), len(LEVELS))
        bad, good = (np.array(x).reshape(q.shape) for x in (row.bad, row.good))
        gain = bad - PRICE * good
        best = np.where(gain.max(1) > 0, gain.argmax(1), -1)
        seq = [[float(q[r, min(best[r], j)]) if best[r] >= 0 else math.inf for r in range(len(RULES))] for j in range(len(LEVELS))]
        steps.append(np.array(seq).ravel().tolist())
    return pd.DataFrame({"stratum": pdf["stratum"], "steps": steps})


def _certify(risk: float, delta: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in pdf.itertuples():
            seq, k, chosen, bound = np.array(row.steps).reshape(len(LEVELS), len(RULES)), list(row.false), -1, 1.0
            for j in range(len(LEVELS)):
                u = upper_bound(int(k[j]), int(row.n), delta / row.n_strata)
                if u > risk:
                    break
                chosen, bound = j, u
            cut = seq[chosen].tolist() if chosen >= 0 else [math.inf] * len(RULES)
            rows.append((row.stratum, cut, int(row.n), int(k[max(chosen, 0)]), bound, chosen))
        return pd.DataFrame(rows, columns=["stratum", "cutoffs", "n_holdout", "n_false", "bound", "step"])

    return lambda it: (run(p) for p in it)


def fit_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs (in the order of RULES), n_holdout, n_false, bound, step; all labelled rows count."""
    y = (labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
         .groupBy("doc_id").agg(F.min("y").alias("y")))
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2))
    lab = stored(stats.filter(~base_failed()).withColumn("v", _values()).join(y, "doc_id").select("stratum", "y", half.alias("half"), "v"))
    tune, hold = lab.filter("half = 0"), lab.filter("half = 1 and y = 1")
    quantile = lambda r: F.percentile_approx(F.col("v")[r], [1 - x for x in LEVELS], 10000)
    cut = tune.filter("y = 1").groupBy("stratum").agg(F.flatten(F.array(*[quantile(r) for r in range(len(RULES))])).alias("cut"))
    cells = [(r, r * len(LEVELS) + j) for r in range(len(RULES)) for j in range(len(LEVELS))]
    named = cut.withColumnRenamed("stratum", "_s")
    over = tune.join(named, F.col("stratum").eqNullSafe(F.col("_s")))
    count = lambda label: F.array(*[F.sum(((F.col("v")[r] > F.col("cut")[c]) & (F.col("y") == label)).cast("long")) for r, c in cells])
    both = over.groupBy("stratum").agg(F.first("cut").alias("cut"), count(0).alias("bad"), count(1).alias("good"))
    steps = stored(both.mapInPandas(lambda it: (_propose(p) for p in it), "stratum string, steps array<double>"))
    hit = lambda j: F.exists(F.arrays_zip(F.col("v").alias("v"), F.slice("steps", j * len(RULES) + 1, len(RULES)).alias("t")), lambda x: x["v"] > x["t"])
    named = steps.withColumnRenamed("stratum", "_s")
    false = (hold.join(named, F.col("stratum").eqNullSafe(F.col("_s"))).groupBy("stratum")
             .agg(F.first("steps").alias("steps"), F.count("*").alias("n"), F.array(*[F.sum(hit(j).cast("long")) for j in range(len(LEVELS))]).alias("false")))
    n_strata = max(1, steps.count())
    out = false.withColumn("n_strata", F.lit(n_strata)).mapInPandas(
        _certify(risk, delta), "stratum string, cutoffs array<double>, n_holdout long, n_false long, bound double, step int")
    return stored(out)


def judge(stats: DataFrame, cutoffs: DataFrame, s: str = "") -> DataFrame:
    """Add base_failed, failed_rules (names) and kept; `s` prefixes the columns of the counts."""
    cut = cutoffs.select(F.col("stratum").alias("_cut_stratum"), F.col("cutoffs").alias("_cut"))
    names = F.array(*[F.lit(r) for r in RULES])
    joined = stats.join(cut, F.col(f"{s}stratum").eqNullSafe(F.col("_cut_stratum")), "left")
    zipped = F.arrays_zip(names.alias("n"), _values(s).alias("v"), F.coalesce("_cut", F.array(*[F.lit(math.inf)] * len(RULES))).alias("t"))
    failed = F.transform(F.filter(zipped, lambda x: x["v"] > x["t"]), lambda x: x["n"])
    return (joined.withColumn("base_failed", base_failed(s)).withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cut_stratum", "_cut"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules and kept of every text."""
    stats = stored(document_stats(docs, stratum))
    return judge(stats, fit_cutoffs(stats, labels, risk, delta))


def accept(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns; texts are read twice and never shuffled."""
    cutoffs = fit_cutoffs(stored(document_stats(need(docs, "doc_id", "text", stratum), stratum)), labels, risk, delta)
    row = free_name(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    fields = packed.schema[row].dataType
    packed = packed.withColumn("text", F.col(row)["text"]).withColumn("stratum", F.col(row)[stratum].cast("string"))

    def run(b: pa.RecordBatch):
        yield {row: b.column(row), "stratum": b.column("stratum")} | batch_stats(b.column("text"))

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(row, fields), T.StructField("stratum", T.StringType()), *[T.StructField(c, T.LongType()) for c in STATS]])
    return judge(arrow_map(packed, run, schema), cutoffs).filter("kept").select(f"{row}.*")
