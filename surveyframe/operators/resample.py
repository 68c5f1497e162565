"""Cluster bootstrap, paired differences, permutation tests, leave-one-out rates and few-label correction.

A hashed draw picks whole groups for every (replicate, slot), and the picks collapse to weights per (replicate, group).
Tables whose numbers fit in a task are held there once for a share of the replicates, so rows travel once per task.  For
larger ones replicates are rows, and a statistic is an ordinary weighted aggregate keyed by replicate.  Rows are reduced
to one per (group, label, score) before they meet the replicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.basics import uniform
from surveyframe.functions.stats import prior_shift
from surveyframe.operators.metrics import auc_from_counts, ece_equal_count, roc_auc
from surveyframe.operators.scale import attach_row, cumulative, fits_in_task, fits_packed, materialise, salted_join, spread

REPLICATES = 2000  # fixed value: replicates per interval in use; tests and queries pass fewer


def numbered_units(df: DataFrame, unit: str, keys: Sequence[str] = (), seed: int = 77) -> DataFrame:
    """keys, unit, idx: distinct units numbered from 0 in a hashed order."""
    u = df.select(*keys, unit).distinct().withColumn("_u", uniform(unit, seed))
    return cumulative(u, "_u", {"_rn": F.lit(1).cast("bigint")}, keys, tie=unit).select(*keys, unit, (F.col("_rn") - 1).alias("idx"))


def replicate_weights(df: DataFrame, unit: str, replicates: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, b, unit, w: how often each unit is drawn in each replicate (as many draws as units)."""
    units = numbered_units(df, unit, keys)
    n = units.groupBy(*keys).agg(F.count("*").alias("_n"))
    slots = salted_join(units, n, list(keys)) if keys else attach_row(units, n)
    drawn = slots.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<bigint>")).alias("b"), "idx", "_n")
    picked = drawn.select(*keys, "b", F.floor(uniform("b", "idx", *keys, seed) * F.col("_n")).cast("bigint").alias("idx"))
    w = picked.groupBy(*keys, "b", "idx").agg(F.count("*").alias("w"))
    return w.join(units, [*keys, "idx"]).drop("idx")


def _picked(b: int, n: int, key: str | None, seed: int) -> np.ndarray:
    """How often each of n units is drawn in replicate b: the draws of `replicate_weights`."""
    md5, tail = hashlib.md5, f"|{key}|{seed}" if key is not None else f"|{seed}"
    digests = b"".join([md5(f"{b}|{i}{tail}".encode()).digest()[:8] for i in range(n)])
    u = (np.frombuffer(digests, ">u8") >> np.uint64(12)).astype(float) / 2.0 ** 52
    return np.bincount(np.floor(u * n).astype(np.int64), minlength=n)


def in_tasks(rows: DataFrame, unit: str, replicates: int, seed: int, work: Callable, columns: Sequence[str], key: str | None = None) -> DataFrame | None:
    """b and the columns: a row per replicate and group of the key; None if the rows do not fit in a task.

    A task has the rows of one group and a share of the replicates; `work(table)` gives the function that makes the
    columns of a replicate from the weight of every row.
    """
    keys = [key] if key else []
    if not fits_packed(rows, rows.count()):
        return None
    units = numbered_units(rows, unit, keys)
    n = units.groupBy(*keys).agg(F.count("*").alias("_units"))
    units = salted_join(units, n, keys) if keys else attach_row(units, n)
    text = F.col(key).cast("string") if key else F.lit(None).cast("string")
    tasks = max(1, min(replicates, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.join(units, [*keys, unit]).drop(unit).withColumn("_key", text).withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    fields = pa.schema([("b", pa.int64()), *[(c, pa.float64()) for c in columns]])

    def run(table: pa.Table) -> pa.Table:
        one = lambda c: table.column(c)[0].as_py()
        slot, n, text, mine = table.column("idx").to_numpy(), one("_units"), one("_key"), range(one("_task"), replicates, tasks)
        value = work(table)
        got = np.array([value(_picked(b, n, text, seed)[slot]) for b in mine], float).reshape(len(mine), len(columns))
        return pa.table([pa.array(list(mine), pa.int64()), *[pa.array(c, pa.float64(), from_pandas=True) for c in got.T]], schema=fields)

    return spread(dealt, 1 << 30, *keys, "_task").groupBy(*keys, "_task").applyInArrow(run, "b long, " + ", ".join(f"{c} double" for c in columns))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of the distinct values from 1, NaN the largest; 0 for NULL."""
    known = column.is_valid().to_numpy()
    out = np.zeros(len(known), np.int64)
    out[known] = np.unique(column.to_numpy()[known], return_inverse=True)[1] + 1
    return out


def _auc_in_task(table: pa.Table, y: str, score: str) -> Callable[[np.ndarray], float]:
    """The AUC of weighted rows, as `weighted_auc` gives it."""
    code = _codes(table.column(score))
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    label = table.column(y).to_numpy(zero_copy_only=False)[order] == 1
    rows = table.column("_rows").to_numpy()[order]

    def auc(w: np.ndarray) -> float:
        w = w[order] * rows
        pos, neg = (np.add.reduceat(np.where(side, w, 0), first).astype(float) for side in (label, ~label))
        pairs = pos.sum() * neg.sum()
        return float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs > 0 else np.nan
    return auc


def bootstrap(df: DataFrame, unit: str, statistic: Callable[[DataFrame], DataFrame], replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Replicate values of `statistic`, which maps rows with (b, w) to one row per b."""
    return statistic(salted_join(df, replicate_weights(df, unit, replicates, seed), [unit]))


def weighted_auc(y: str, score: str) -> Callable[[DataFrame], DataFrame]:
    def stat(rows: DataFrame) -> DataFrame:
        c = rows.groupBy("b", F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, F.col("w") * F.col("_rows")).otherwise(0)).cast("double").alias("pos"),
                                                         F.sum(F.when(F.col(y) == 1, 0).otherwise(F.col("w") * F.col("_rows"))).cast("double").alias("neg"))
        return auc_from_counts(c, ["b"]).select("b", F.col("auc").alias("value"))
    return stat


def _reduced(df: DataFrame, *cols: str | Column) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("_rows"))


def interval(values: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval over replicate values; replicates without a value are skipped."""
    a = (1 - level) / 2
    return values.filter("value is not null").agg(F.percentile("value", a).alias("low"), F.percentile("value", 1 - a).alias("high"),
                                                  F.count("*").alias("replicates"))


def auc_interval(df: DataFrame, unit: str, y: str, score: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    rows = _reduced(df, unit, y, F.col(score).cast("double").alias(score))

    def work(table):
        auc = _auc_in_task(table, y, score)
        return lambda w: (auc(w),)

    values = in_tasks(rows, unit, replicates, seed, work, ["value"])
    got = interval(bootstrap(rows, unit, weighted_auc(y, score), replicates, seed) if values is None else values)
    return got.withColumn("auc", roc_auc(df, y, score).select("auc").scalar())


def paired_auc_difference(df: DataFrame, unit: str, y: str, a: str, b: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Difference of two AUCs on the same replicates, its interval and whether that excludes zero."""
    reduced = _reduced(df, unit, y, *[F.col(c).cast("double").alias(c) for c in (a, b)])

    def work(table):
        one, other = _auc_in_task(table, y, a), _auc_in_task(table, y, b)
        return lambda w: (one(w) - other(w),)

    diff = in_tasks(reduced, unit, replicates, seed, work, ["value"])
    if diff is None:
        rows = salted_join(reduced, replicate_weights(df, unit, replicates, seed), [unit])
        one = lambda s, n: weighted_auc(y, s)(rows).withColumnRenamed("value", n)
        diff = one(a, "_a").join(one(b, "_b"), "b").select("b", (F.col("_a") - F.col("_b")).alias("value"))
    auc = lambda s: roc_auc(df, y, s).select("auc").scalar()
    return interval(diff).withColumn("delta", auc(a) - auc(b)).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def weighted_medians(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """keys, median of the multiset in which each value counts `weight` times."""
    c = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    fits = fits_in_task(c, keys)
    c = cumulative(c, "_v", {"_cum": F.col("_w")}, keys, fits=fits)
    total = c.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    j = salted_join(c, total, list(keys), fits=fits)
    at = (F.col("_total") - 1) / 2
    lo = F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v")))
    hi = F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v")))
    return j.groupBy(*keys).agg(((lo + hi) / 2).alias("median"))


def _median_in_task(table: pa.Table, column: str) -> Callable[[np.ndarray], float]:
    """The median of rows counted by weight, as `weighted_medians` gives it: NULL stands below all values and is never one."""
    code = _codes(table.column(column))
    order = np.argsort(code, kind="stable")
    values, missing = table.column(column).to_numpy()[order], int((code == 0).sum())

    def median(w: np.ndarray) -> float:
        cum = np.cumsum(w[order])
        at = (cum[-1] - 1) / 2
        least = cum[missing - 1] if missing else 0
        lo, hi = (int(np.searchsorted(cum, max(f(at), least), "right")) for f in (np.floor, np.ceil))
        return (values[lo] + values[hi]) / 2 if cum[-1] and hi < len(values) else np.nan
    return median


def median_gap_change(df: DataFrame, unit: str, group: str, new: str, old: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Interval of the change in (median of group 1 minus median of group 0) from `old` to `new`, resampling each group's rows."""
    rows = df.select(group, unit, *[F.col(c).cast("double").alias(c) for c in (new, old)]).filter(F.col(group).isNotNull())

    def work(table):
        sides = [_median_in_task(table, c) for c in (new, old)]
        sign = 1 if table.column(group)[0].as_py() == 1 else -1
        return lambda w: (sign * sides[0](w), -sign * sides[1](w))

    made = in_tasks(rows, unit, replicates, seed, work, ["up", "down"], group)
    if made is not None:
        each = made.select("b", F.explode(F.array("up", "down")).alias("m"))
        return interval(each.groupBy("b").agg(F.sum("m").alias("value")))
    w = replicate_weights(df, unit, replicates, seed, [group])
    long = df.select(group, unit, F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col(new).alias("v")), F.struct(F.lit(-1).alias("side"), F.col(old).alias("v")))))
    med = weighted_medians(salted_join(long, w, [group, unit]), ["b", "side", group], "v", "w")
    sign = F.col("side") * F.when(F.col(group) == 1, 1).otherwise(-1)
    return interval(med.groupBy("b").agg(F.sum(sign * F.col("median")).alias("value")))


PERMUTATIONS, PER_CHUNK, FAN = 100_000, 1000, 1024     # fixed value: permutations in use; those drawn together; children of a node


def _taken(rng: np.random.Generator, good: int, bad: int, n: np.ndarray) -> np.ndarray:
    """How many of n draws without replacement are good; beyond numpy's 10^9 rows a normal draw of the same mean and variance, rounded."""
    if good + bad < 1_000_000_000:
        return rng.hypergeometric(good, bad, n)
    all_, share = float(good + bad), good / float(good + bad)
    sd = np.sqrt(n * share * (1 - share) * np.maximum(all_ - n, 0) / (all_ - 1))
    return np.clip(np.rint(rng.normal(n * share, sd)), np.maximum(n - bad, 0), np.minimum(n, good)).astype(np.int64)


def dealt(rng: np.random.Generator, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[i] draws without replacement from groups of the given sizes, by halves: groups x len(n)."""
    if len(counts) == 1:
        return n[None, :]
    half = len(counts) // 2
    left = _taken(rng, int(counts[:half].sum()), int(counts[half:].sum()), n)
    return np.concatenate((dealt(rng, counts[:half], left), dealt(rng, counts[half:], n - left)))


def permutation_p(df: DataFrame, y: str, score: str, permutations: int = PERMUTATIONS, seed: int = 1, fan: int = FAN) -> DataFrame:
    """Share of random relabellings whose AUC reaches the observed one: p, permutations, auc.

    The AUC needs only the number of positives at each distinct score.  Over all relabellings these are the counts of
    a draw without replacement, so a permutation is dealt down a tree over the scores: every node passes its positives
    on to its children.  The work is distinct scores times permutations; no row is repeated and a task holds one node's
    children and one chunk of permutations.  Rows without a label or a score are left out.
    """
    known = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    c = known.groupBy(score).agg(F.count("*").alias("n"), F.sum(y).cast("double").alias("_pos"))
    c = cumulative(c, score, {"_cum": F.col("n"), "id": F.lit(1).cast("bigint")})
    leaves = materialise(c.select((F.col("id") - 1).alias("id"), "n", (F.col("_cum") - (F.col("n") - 1) / 2).alias("rank"), "_pos"))
    n1, rows, obs, values = leaves.agg(F.sum("_pos"), F.sum("n"), F.sum(F.col("_pos") * F.col("rank")), F.count("*")).first()
    spark = df.sparkSession
    if not n1 or n1 == rows:
        return spark.createDataFrame([(None, 0, None)], "p double, permutations long, auc double")
    levels = [leaves.select("id", F.floor(F.col("id") / fan).alias("parent"), "n", "rank")]
    while values > fan:
        values = -(-values // fan)
        up = levels[-1].groupBy(F.col("parent").alias("id")).agg(F.sum("n").alias("n"))
        levels.append(up.select("id", F.floor(F.col("id") / fan).alias("parent"), "n", F.lit(0.0).alias("rank")))
    chunks = -(-permutations // PER_CHUNK)

    def rng_of(level: int, node: int, chunk: int) -> np.random.Generator:
        return np.random.default_rng([seed, level, node, chunk])

    def pass_on(level: int):
        def run(frames):
            for f in frames:
                for node, chunk, pos, kids in zip(f["node"], f["chunk"], f["pos"], f["kids"]):
                    got = dealt(rng_of(level, node, chunk), np.array([k["n"] for k in kids]), np.frombuffer(pos, np.int64))
                    yield pd.DataFrame({"node": [k["id"] for k in kids], "chunk": chunk, "pos": [g.tobytes() for g in got]})
        return run

    def add_up(frames):
        total: dict[int, np.ndarray] = {}
        for f in frames:
            for node, chunk, pos, kids in zip(f["node"], f["chunk"], f["pos"], f["kids"]):
                got = dealt(rng_of(0, node, chunk), np.array([k["n"] for k in kids]), np.frombuffer(pos, np.int64))
                total[chunk] = total.get(chunk, 0) + np.array([k["rank"] for k in kids]) @ got
        for chunk, s in total.items():
            yield pd.DataFrame({"b": chunk * PER_CHUNK + np.arange(len(s)), "s": s})

    def start(frames):
        for f in frames:
            for chunk in f["id"]:
                n = min(PER_CHUNK, permutations - chunk * PER_CHUNK)
                yield pd.DataFrame({"node": [0], "chunk": [chunk], "pos": [np.full(n, int(n1), np.int64).tobytes()]})

    state = spark.range(chunks, numPartitions=min(chunks, max(1, spark.sparkContext.defaultParallelism))).mapInPandas(start, "node long, chunk long, pos binary")
    for i in range(len(levels) - 1, -1, -1):
        kids = levels[i].groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("id", "n", "rank"))).alias("kids"))
        met = state.join(kids, F.col("node") == F.col("parent")).drop("parent")
        met = spread(met, 1 << 30, "node", "chunk")
        state = met.mapInPandas(pass_on(i), "node long, chunk long, pos binary") if i else met.mapInPandas(add_up, "b long, s double")
    sums = state.groupBy("b").agg(F.sum("s").alias("s"))
    n0 = rows - n1
    auc = lambda s: (s - n1 * (n1 + 1) / 2) / (n1 * n0)
    return sums.agg(F.avg((auc(F.col("s")) >= auc(obs) - 1e-12).cast("double")).alias("p"), F.count("*").alias("permutations"), F.lit(auc(obs)).alias("auc"))


def leave_one_out_rate(df: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Base rate of the other rows: (sum - own) / (n - 1)."""
    t = df.groupBy(*keys).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    j = salted_join(df, t, list(keys)) if keys else attach_row(df, t)
    return j.withColumn("loo_rate", F.when(F.col("_n") > 1, (F.col("_s") - F.col(y)) / (F.col("_n") - 1))).drop("_s", "_n")


KINDS = ("few", "oracle", "frozen")


def _ece_and_auc(q: np.ndarray, y: np.ndarray, bins: int = 10) -> tuple[float, float]:
    """Equal-count calibration error and AUC of rows in the order of their scores, as `ece_equal_count` and `roc_auc` give them."""
    each, rest = divmod(len(q), bins)
    size = np.array([each + 1] * rest + [each] * (bins - rest))
    size = size[size > 0]
    ece = np.abs(np.add.reduceat(y - q, np.cumsum(size) - size)).sum() / len(q)
    first = np.flatnonzero(np.diff(q, prepend=-1.0))
    pos, neg = (np.add.reduceat(side.astype(float), first) for side in (y == 1, y != 1))
    pairs = pos.sum() * neg.sum()
    return ece, float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs > 0 else np.nan


def _few_label_in_task(table: pa.Table, stratum: str, y: str, p: str, row: str, m: int, seed: int) -> Callable[[int], list[tuple[float, float]]]:
    """ECE and AUC of every kind for one draw.  Only the few-label scores depend on the draw, the others are ordered once."""
    table = table.sort_by(row)
    text = [f"|{r}|{seed}".encode() for r in table.column(row).to_pylist()]
    score, label, pi_s, pi_true = (table.column(c).to_numpy().astype(float) for c in (p, y, "pi_s", "pi_true"))
    groups = [np.flatnonzero(code) for s in np.unique(table.column(stratum).to_numpy()) for code in [table.column(stratum).to_numpy() == s]]

    def shifted(to: np.ndarray) -> np.ndarray:
        s, t = np.clip(pi_s, 0.01, 0.99), np.clip(to, 0.01, 0.99)
        good, bad = t / s * score, (1 - t) / (1 - s) * (1 - score)
        return good / (good + bad)

    fixed = [(q, np.argsort(q, kind="stable")) for q in (shifted(pi_true), score)]

    def draw(b: int) -> list[tuple[float, float]]:
        start = hashlib.md5(str(b).encode())

        def digest(t: bytes) -> bytes:
            h = start.copy()
            h.update(t)
            return h.digest()[:8]

        u = np.frombuffer(b"".join([digest(t) for t in text]), ">u8") >> np.uint64(12)
        held, rate = np.ones(len(u), bool), pi_s.copy()
        for rows in groups:
            if len(rows) > m:
                near = rows[u[rows] <= np.partition(u[rows], m - 1)[m - 1]]
                known = near[np.argsort(u[near], kind="stable")[:m]]
                held[known], rate[rows] = False, label[known].mean()
        if not held.any():
            return []
        q = shifted(rate)
        orders = [(q, np.argsort(q, kind="stable")), *fixed]
        return [_ece_and_auc(q[o], label[o]) for q, order in orders for o in [order[held[order]]]]
    return draw


def _few_label_draws(rows: DataFrame, stratum: str, y: str, p: str, row: str, m: int, draws: int, seed: int) -> DataFrame:
    """b, kind, ece, auc: every task has all rows, a few numbers each, and a share of the draws."""
    tasks = max(1, min(draws, 2 * rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    fields = pa.schema([("b", pa.int64()), ("kind", pa.string()), ("ece", pa.float64()), ("auc", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        draw = _few_label_in_task(table, stratum, y, p, row, m, seed)
        got = [(b, kind, *found) for b in range(table.column("_task")[0].as_py(), draws, tasks) for kind, found in zip(KINDS, draw(b))]
        b, kind, ece, auc = zip(*got) if got else ((), (), (), ())
        return pa.table([pa.array(b, pa.int64()), pa.array(kind, pa.string()), pa.array(ece, pa.float64()), pa.array(np.array(auc, float), pa.float64(), from_pandas=True)], schema=fields)

    return spread(dealt, 1 << 30, "_task").groupBy("_task").applyInArrow(run, "b long, kind string, ece double, auc double")


def few_label(target: DataFrame, source: DataFrame, stratum: str, y: str, p: str, row: str, m: int, draws: int, seed: int = 1) -> DataFrame:
    """Held-out ECE and AUC, as medians over draws, after base rates are re-estimated from m labels per stratum.

    Strata with at most m rows keep the source rate; labelled rows are left out of the score.  Tables that a task can hold
    meet their draws there; in larger ones, and where values are missing, draws are rows.
    """
    prior = source.groupBy(stratum).agg(F.avg(y).alias("pi_s"))
    overall = source.agg(F.avg(y)).scalar()
    truth = target.groupBy(stratum).agg(F.avg(y).alias("pi_true"), F.count("*").alias("_size"))
    rates = truth.join(prior, stratum, "left").withColumn("pi_s", F.coalesce("pi_s", overall))
    gap = F.col(row).isNull() | F.col(stratum).isNull() | F.col(y).isNull() | F.col(p).isNull() | F.isnan(F.col(p).cast("double"))
    size, gaps = target.agg(F.count("*"), F.count_if(gap)).first()
    if not gaps and fits_packed(target, size) and m > 0 and target.schema[row].dataType.typeName() in ("long", "integer", "string"):
        rows = target.select(row, stratum, y, p).join(F.broadcast(rates.select(stratum, "pi_s", "pi_true")), stratum)
        return _few_label_summary(_few_label_draws(rows, stratum, y, p, row, m, draws, seed))
    many = target.select(row, stratum, y, p, F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>")).alias("b"))
    fits = fits_in_task(many, ["b", stratum])
    many = cumulative(many.withColumn("_u", uniform("b", row, seed)), "_u", {"_rn": F.lit(1).cast("bigint")}, ["b", stratum], tie=row, fits=fits)
    j = many.join(F.broadcast(rates), stratum)
    j = j.withColumn("lab", (F.col("_rn") <= m) & (F.col("_size") > m))
    est = j.groupBy("b", stratum).agg(F.avg(F.when(F.col("lab"), F.col(y))).alias("est"))
    j = salted_join(j, est, ["b", stratum], fits=fits).filter("not lab")
    j = j.select("b", row, y, F.inline(F.array(
        F.struct(F.lit("few").alias("kind"), prior_shift(p, "pi_s", F.coalesce("est", "pi_s")).alias("q")),
        F.struct(F.lit("oracle").alias("kind"), prior_shift(p, "pi_s", "pi_true").alias("q")),
        F.struct(F.lit("frozen").alias("kind"), F.col(p).alias("q")))))
    ece = ece_equal_count(j, y, "q", row, keys=["b", "kind"])
    auc = roc_auc(j, y, "q", ["b", "kind"]).select("b", "kind", "auc")
    return _few_label_summary(ece.join(auc, ["b", "kind"]))


def _few_label_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.percentile("ece", 0.5).alias("ece"), F.percentile("auc", 0.5).alias("auc"), F.count("*").alias("draws"))
