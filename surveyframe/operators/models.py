"""Baselines, calibration and small-matrix fits: pyspark.ml where it has the model, sums and blocks elsewhere."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.stats import logit, sigmoid
from surveyframe.operators.scale import materialise, salted_join, scalar_of, spread


def majority_baseline(df: DataFrame, label: str, train: Column) -> DataFrame:
    """accuracy of always calling the commonest training class (first by name on ties)."""
    counts = df.filter(train).groupBy(label).agg(F.count("*").alias("n"))
    best = counts.agg(F.min_by(label, F.struct(-F.col("n"), label))).scalar()
    hits = df.filter(~train).groupBy((F.col(label) == best).alias("_hit")).agg(F.count("*").alias("n"))
    return hits.agg((F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("rows"))


def _prepare(features: Sequence[str]) -> list:
    filled = [f"{c}_f" for c in features]
    return [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]


def baseline(kind: str, features: Sequence[str], label: str, weight: str | None = None, trees: int = 20, seed: int = 1) -> Pipeline:
    w = {"weightCol": weight} if weight else {}
    model = {"logistic": lambda: LogisticRegression(labelCol=label, maxIter=30, **w),
             "forest": lambda: RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=6, seed=seed, **w),
             "boosted": lambda: GBTClassifier(labelCol=label, maxIter=trees // 2, maxDepth=3, seed=seed, **w)}[kind]()
    return Pipeline(stages=[*_prepare(features), model])


def scored(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def permutation_importance(model, df: DataFrame, features: Sequence[str], label: str, row: str, seed: int = 1, repeats: int = 5) -> DataFrame:
    """column, drop, spread: accuracy lost when a column's values are dealt to other rows, mean and deviation of the repeats.

    Largest loss first.
    """
    from surveyframe.operators.screens import permuted

    acc = lambda d: model.transform(d).agg(F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("a"))
    base = acc(df).scalar()
    out = None
    for i in range(repeats):
        for c in features:
            p = permuted(df, c, row, seed + i, "_p").drop(c).withColumnRenamed("_p", c)
            one = acc(p).select(F.lit(c).alias("column"), (base - F.col("a")).alias("d"))
            out = one if out is None else out.unionByName(one)
    got = out.groupBy("column").agg(F.avg("d").alias("drop"), F.stddev_pop("d").alias("spread"))
    return got.orderBy(F.col("drop").desc(), "column")


# ---- calibration -----------------------------------------------------------------------------------

def fit_platt(df: DataFrame, y: str, score: str) -> tuple[float, float]:
    x = df.select(F.col(y).cast("double").alias("label"), array_to_vector(F.array(logit(score))).alias("features"))
    m = LogisticRegression(regParam=0.0, maxIter=100, tol=1e-10).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


def fit_isotonic(df: DataFrame, y: str, score: str):
    return IsotonicRegression(featuresCol="x").fit(df.select(F.col(y).cast("double").alias("label"), F.col(score).alias("x")))


def calibrate(df: DataFrame, method: str, fitted, score: str) -> DataFrame:
    """Add `calibrated`."""
    if method == "none":
        return df.withColumn("calibrated", F.col(score))
    if method == "platt":
        a, b = fitted
        return df.withColumn("calibrated", sigmoid(a * logit(score) + b))
    got = fitted.transform(df.withColumn("x", F.col(score)))
    return got.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("x", "prediction")


METHODS = ("none", "platt", "isotonic")


def cross_validated_calibration(df: DataFrame, fold: str, y: str, score: str, folds: int) -> DataFrame:
    """method, brier, log_loss, chosen: out-of-fold scores of every method; the best Brier score is chosen."""
    from surveyframe.operators.metrics import log_loss_of

    out = None
    for k in range(folds):
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        for m in METHODS:
            f = {"none": lambda: None, "platt": lambda: fit_platt(train, y, score), "isotonic": lambda: fit_isotonic(train, y, score)}[m]()  # noqa: B023
            part = calibrate(test, m, f, score).select(F.lit(m).alias("method"), y, "calibrated")
            out = part if out is None else out.unionByName(part)
    got = out.groupBy("method").agg(F.avg(F.pow(F.col("calibrated") - F.col(y), 2)).alias("brier"), F.avg(log_loss_of(y, "calibrated")).alias("log_loss"))
    best = got.agg(F.min_by("method", "brier")).scalar()
    return got.withColumn("chosen", F.col("method") == best)


# ---- leave-one-out fits ----------------------------------------------------------------------------

ORDER, ALLOWED = 5, 1e-10       # terms of the expansion round the full fit; the error of a held row's log odds up to which it is used


def _full_platt(base: DataFrame, ridge: float) -> tuple[float, float] | None:
    """Slope and intercept of the ridge logistic fit to all rows; None where Newton's method does not settle."""
    a = b = 0.0
    for _ in range(25):
        p = sigmoid(a * F.col("_x") + b)
        r, w, x = F.col("_n") * (p - F.col("_y")), F.col("_n") * p * (1 - p), F.col("_x")
        g0, g1, h00, h01, h11 = base.agg(*[F.sum(v) for v in (r, r * x, w, w * x, w * x * x)]).first()
        if g0 is None or not math.isfinite(g0 + g1 + h11) or h00 * (h11 + ridge) - h01 * h01 <= 0:
            return None
        g1, h11 = g1 + ridge * a, h11 + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-9:
            return a, b
    return None


def _near_full_fit(base: DataFrame, ridge: float, steps: int) -> DataFrame | None:
    """_id, _x, _y, a, b, _ok: held fits from the sums of all rows expanded round the full fit, the held row's own term exact.

    One row moves a fit to many others little, so the sums over all rows at its parameters follow from their derivatives
    at the full fit, a few moments made in one pass.  _ok says that the fit has settled and that the first term left out,
    bounded by moments too, moves the held row's log odds by less than ALLOWED.
    """
    full = _full_platt(base, ridge)
    if full is None or base.filter(F.col("_x").isNull() | F.col("_y").isNull()).count():
        return None
    a0, b0 = full
    last = ORDER + 1                                  # an even power
    kinds = [(d, j) for d in range(ORDER + 1) for j in range(d + 2)] + [("x", j) for j in range(last + 3)]

    def moments(frames):
        total = np.zeros(len(kinds))
        for f in frames:
            x, y, n = (f[c].to_numpy() for c in ("_x", "_y", "_n"))
            p, poly = 1 / (1 + np.exp(-(a0 * x + b0))), np.polynomial.Polynomial([0.0, 1.0])
            for d in range(ORDER + 1):
                v = n * (poly(p) - (y if d == 0 else 0.0))
                for j in range(d + 2):
                    total[kinds.index((d, j))] += (v * x ** j).sum()
                poly = poly.deriv() * np.polynomial.Polynomial([0.0, 1.0, -1.0])       # the next derivative by the log odds
            for j in range(last + 3):
                total[kinds.index(("x", j))] += (n * x ** j).sum()
        yield pd.DataFrame({"i": np.arange(len(kinds)), "v": total})

    got = base.mapInPandas(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    m = {kinds[r["i"]]: r["v"] for r in got}

    def at(da, db, derivative, power):
        out = 0.0
        for d in range(ORDER + 1 - derivative):
            for j in range(d + 1):
                out = out + m[d + derivative, j + power] / (math.factorial(j) * math.factorial(d - j)) * da ** j * db ** (d - j)
        return out

    def left_out(da, db, power):
        """The sum of x^power times the change of the log odds to the first power left out, by its factorial; no derivative passes 1."""
        return sum(m["x", j + power] / (math.factorial(j) * math.factorial(last - j)) * da ** j * db ** (last - j) for j in range(last + 1))

    def fit(frames):
        for f in frames:
            x, y = f["_x"].to_numpy(), f["_y"].to_numpy()
            da, db, moved = np.zeros(len(f)), np.zeros(len(f)), np.full(len(f), np.inf)
            with np.errstate(all="ignore"):
                for _ in range(steps):
                    p = 1 / (1 + np.exp(-((a0 + da) * x + b0 + db)))
                    r, w = p - y, p * (1 - p)
                    g0, g1 = at(da, db, 0, 0) - r, at(da, db, 0, 1) - r * x + ridge * (a0 + da)
                    h00, h01, h11 = at(da, db, 1, 0) - w, at(da, db, 1, 1) - w * x, at(da, db, 1, 2) - w * x * x + ridge
                    det = h00 * h11 - h01 * h01
                    sa, sb = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
                    da, db, moved = da - sa, db - sb, np.abs(sa * x) + np.abs(sb)
                e0 = left_out(da, db, 0)
                e1 = (e0 + left_out(da, db, 2)) / 2            # |x| is at most (1 + x^2) / 2
                error = (np.abs(x) * (h00 * e1 + np.abs(h01) * e0) + h11 * e0 + np.abs(h01) * e1) / det
                ok = (np.abs(error) <= ALLOWED) & (det > 0) & (moved < ALLOWED)
            yield pd.DataFrame({"_id": f["_id"], "_x": x, "_y": y, "a": a0 + da, "b": b0 + db, "_ok": ok})

    return base.select("_id", "_x", "_y").mapInPandas(fit, "_id long, _x double, _y double, a double, b double, _ok boolean")


def leave_one_out_platt(df: DataFrame, row: str, y: str, score: str, ridge: float = 1.0, steps: int = 8, block: int = 4000) -> DataFrame:
    """row, y, p_loo: each row's probability from a ridge logistic fit to all other rows.

    Rows with the same score and label have the same fit, so distinct (score, label) pairs with their counts stand for
    them: one held fit per pair, and the work follows the distinct values.  Newton's method runs for all held pairs at
    once.  Tables beyond a block take the sums over all rows from their expansion round the full fit, so each pair costs
    a few numbers.  Pairs too far from the full fit for that, and all pairs of small tables, meet every training pair:
    in every step blocks of held pairs meet blocks of training pairs as small matrices and only five sums per held
    pair leave a task.  One row's own term is taken out of the sums.
    """
    rows = df.select(row, F.col(y).cast("double").alias("_y"), logit(score).alias("_x"))
    base = materialise(rows.groupBy("_x", "_y").agg(F.count("*").cast("double").alias("_n")).withColumn("_id", F.xxhash64("_x", "_y")))
    pairs = base.count()
    near = _near_full_fit(base, ridge, steps) if pairs > block else None
    if near is None:
        held = _held_fits(base, base.select("_id", "_x", "_y"), pairs, pairs, ridge, steps, block)
    else:
        near = materialise(near)
        far = near.filter(~F.col("_ok")).count()
        held = near.filter("_ok").drop("_ok")
        if far:
            held = held.unionByName(_held_fits(base, near.filter(~F.col("_ok")).select("_id", "_x", "_y"), pairs, far, ridge, steps, block))
    fits = held.select(F.col("_x").alias("_hx"), F.col("_y").alias("_hy"), sigmoid(F.col("a") * F.col("_x") + F.col("b")).alias("p_loo"))
    same = F.col("_x").eqNullSafe(F.col("_hx")) & F.col("_y").eqNullSafe(F.col("_hy"))
    return rows.join(fits, same).select(row, F.col("_y").alias("y"), "p_loo")


def _held_fits(base: DataFrame, pairs: DataFrame, n_base: int, n_pairs: int, ridge: float, steps: int, block: int) -> DataFrame:
    """_id, _x, _y, a, b of held pairs that meet every training pair of base."""
    k, kh = (max(1, math.ceil(n / block)) for n in (n_base, n_pairs))
    meet = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    train = base.select(F.pmod("_id", F.lit(k)).alias("_t"), "_x", "_y", "_n").withColumn("_h", meet(kh))
    held = pairs.select("_id", "_x", "_y", F.pmod("_id", F.lit(kh)).alias("_h"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def sums(h: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if h.empty or t.empty:
            return pd.DataFrame({"_id": h["_id"][:0], "g0": [], "g1": [], "h00": [], "h01": [], "h11": []})
        x, yy, n = (t[c].to_numpy() for c in ("_x", "_y", "_n"))
        out = {c: [] for c in ("g0", "g1", "h00", "h01", "h11")}
        a, b = h["a"].to_numpy(), h["b"].to_numpy()
        for i in range(0, len(h), 500):
            p = 1 / (1 + np.exp(-(a[i:i + 500, None] * x[None] + b[i:i + 500, None])))
            r, w = n * (p - yy[None]), n * p * (1 - p)
            for c, v in (("g0", r), ("g1", r * x), ("h00", w), ("h01", w * x), ("h11", w * x * x)):
                out[c].append(v.sum(1))
        return pd.DataFrame({"_id": h["_id"].to_numpy(), **{c: np.concatenate(v) for c, v in out.items()}})

    schema = "_id long, g0 double, g1 double, h00 double, h01 double, h11 double"
    for _ in range(steps):
        left = held.withColumn("_t", meet(k))
        got = left.groupBy("_h", "_t").cogroup(train.groupBy("_h", "_t")).applyInPandas(sums, schema)
        g = held.join(got.groupBy("_id").agg(*[F.sum(c).alias(c) for c in ("g0", "g1", "h00", "h01", "h11")]), "_id")
        p = sigmoid(F.col("a") * F.col("_x") + F.col("b"))
        r, w, x = p - F.col("_y"), p * (1 - p), F.col("_x")
        g0, g1 = F.col("g0") - r, F.col("g1") - r * x + ridge * F.col("a")
        h00, h01, h11 = F.col("h00") - w, F.col("h01") - w * x, F.col("h11") - w * x * x + ridge
        det = h00 * h11 - h01 * h01
        held = materialise(g.select("_id", "_x", "_y", "_h", (F.col("a") - (h00 * g1 - h01 * g0) / det).alias("a"), (F.col("b") - (h11 * g0 - h01 * g1) / det).alias("b")))
    return held.drop("_h")


def log_score_against_base(loo: DataFrame, y: str = "y", p: str = "p_loo") -> DataFrame:
    """Mean log score of leave-one-out probabilities and of the leave-one-out base rate."""
    from surveyframe.functions.basics import clip

    t = scalar_of(loo, s=F.sum(y), n=F.count("*"))
    base = (t["s"] - F.col(y)) / (t["n"] - 1)
    score = lambda q: F.avg(F.col(y) * F.ln(clip(q, 1e-6, 1 - 1e-6)) + (1 - F.col(y)) * F.ln(1 - clip(q, 1e-6, 1 - 1e-6)))
    return loo.withColumn("_b", base).agg(score(F.col(p)).alias("fitted"), score(F.col("_b")).alias("base_rate"))


def exclusion_folds(rows: DataFrame, anchor: str, donor: str, y: str, row: str) -> DataFrame:
    """held, n_test, n_train, pos_train, one_class: training rows anchored on or borrowing from the held object are removed.

    Each fold is the whole minus what touches the held object, so no row is repeated per fold.
    """
    touch = rows.select(row, y, F.explode(F.array_distinct(F.array(anchor, donor))).alias("held"))
    own = rows.groupBy(F.col(anchor).alias("held")).agg(F.count("*").alias("n_test"))
    out = touch.groupBy("held").agg(F.count("*").alias("_n"), F.sum(y).alias("_p"))
    t = scalar_of(rows, n=F.count("*"), p=F.sum(y))
    j = own.join(out, "held").select("held", "n_test", (t["n"] - F.col("_n")).alias("n_train"), (t["p"] - F.col("_p")).alias("pos_train"))
    return j.withColumn("one_class", (F.col("pos_train") == 0) | (F.col("pos_train") == F.col("n_train")))


FOLDS_PER_PASS, NEWTON_STEPS = 256, 30     # held objects fitted together; most Newton steps


def held_out_scores(df: DataFrame, held: str, anchor: str, donor: str, features: Sequence[str], y: str, steps: int = NEWTON_STEPS, tolerance: float = 1e-8) -> DataFrame:
    """held, y, score: each object's rows scored by a logistic fit without rows anchored on or borrowing from it.

    The objects come from the data, NULL among them.  All folds are fitted together: in a Newton step every task sums
    each fold's gradient and curvature over its rows, leaving out the rows that touch the held object, so a step is one
    pass and no row is repeated.  Missing features take the mean of the fold's training rows.  A fold whose training
    rows have one class scores that class, one without training rows 0.5.
    """
    k, keys = len(features), ["_held", "_anchor", "_donor"]
    base = df.select(*[F.col(c).alias(n) for c, n in zip((held, anchor, donor), keys)], F.col(y).cast("double").alias("_y"),
                     *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(features)])
    base = materialise(base)
    names = [f"x{i}" for i in range(k)]
    spread = base.agg(*[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names]).first()
    centre = np.array([spread[f"m{c}"] or 0.0 for c in names])
    scale = np.array([spread[f"s{c}"] or 1.0 for c in names])
    objects = [r[0] for r in base.select("_held").distinct().collect()]          # one number per object and parameter is kept anyway
    kind = base.schema["_held"].dataType.simpleString()

    def rows_of(f: pd.DataFrame):
        x = (f[names].to_numpy(float) - centre) / scale
        return np.nan_to_num(x), np.isnan(x), f["_y"].to_numpy(float)

    def same(column: pd.Series, o) -> np.ndarray:
        return column.isna().to_numpy() if o is None else (column == o).to_numpy()

    def summed(fold_sums, size: int, n: int) -> np.ndarray:
        def run(frames):
            total = np.zeros((n, size))
            for f in frames:
                x, gap, yy = rows_of(f)
                for j in range(n):
                    total[j] += fold_sums(j, f, x, gap, yy)
            yield pd.DataFrame({"j": np.repeat(np.arange(n), size), "i": np.tile(np.arange(size), n), "v": total.ravel()})

        out = np.zeros((n, size))
        for r in base.mapInPandas(run, "j int, i int, v double").groupBy("j", "i").agg(F.sum("v").alias("v")).collect():
            out[r["j"], r["i"]] = r["v"]
        return out

    parts = None
    for at in range(0, len(objects), FOLDS_PER_PASS):
        held_now = objects[at:at + FOLDS_PER_PASS]
        n = len(held_now)

        def trained(j, f, held_now=held_now):
            return ~(same(f["_anchor"], held_now[j]) | same(f["_donor"], held_now[j]))

        def first_sums(j, f, x, gap, yy, trained=trained):
            w = trained(j, f)
            return np.concatenate(([w.sum(), yy[w].sum()], x[w].sum(0), (~gap[w]).sum(0)))

        first = summed(first_sums, 2 + 2 * k, n)
        mean = first[:, 2:2 + k] / np.maximum(first[:, 2 + k:], 1)
        theta = np.zeros((n, k + 1))
        live = (first[:, 1] > 0) & (first[:, 1] < first[:, 0])

        def design(x, gap, j, mean=mean):
            return np.column_stack([np.ones(len(x)), x + gap * mean[j]])

        for _ in range(steps if live.any() else 0):
            def newton_sums(j, f, x, gap, yy, theta=theta, live=live, trained=trained, design=design):
                if not live[j]:
                    return 0.0
                w = trained(j, f)
                z = design(x[w], gap[w], j)
                p = 1 / (1 + np.exp(-np.clip(z @ theta[j], -500, 500)))
                return np.concatenate((z.T @ (p - yy[w]), ((z * (p * (1 - p))[:, None]).T @ z).ravel()))

            got = summed(newton_sums, (k + 1) * (k + 2), n)
            moved = np.zeros(n)
            for j in np.flatnonzero(live):
                g, h = got[j, :k + 1], got[j, k + 1:].reshape(k + 1, k + 1)
                step = np.linalg.lstsq(h + 1e-9 * max(first[j, 0], 1) * np.eye(k + 1), g, rcond=None)[0]
                step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))          # separable classes walk off slowly
                theta[j], moved[j] = theta[j] - step, np.abs(step).max()
            if moved.max() < tolerance:
                break

        def score(frames, held_now=held_now, theta=theta, live=live, first=first, design=design):
            for f in frames:
                x, gap, yy = rows_of(f)
                for j, o in enumerate(held_now):
                    mine = same(f["_held"], o)
                    if mine.any():
                        p = 1 / (1 + np.exp(-np.clip(design(x[mine], gap[mine], j) @ theta[j], -500, 500)))
                        known = p if live[j] else np.full(mine.sum(), 0.5 if not first[j, 0] else float(first[j, 1] > 0))
                        yield pd.DataFrame({"held": f["_held"][mine].to_numpy(), "y": yy[mine], "score": known})

        one = base.mapInPandas(score, f"held {kind}, y double, score double")
        parts = one if parts is None else parts.unionByName(one)
    out = parts if parts is not None else base.select(F.col("_held").alias("held"), F.col("_y").alias("y"), F.lit(0.5).alias("score"))
    return out.select("held", F.col("y").alias(y), "score")


# ---- principal components --------------------------------------------------------------------------

def group_moments(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, i, v: the flattened second-moment matrix (with a leading 1) of each group; one partial matrix per task and batch."""
    types = dict(df.dtypes)

    def partial(batches):
        for pdf in batches:
            for g, sub in pdf.groupby(group):
                x = np.column_stack([np.ones(len(sub)), np.stack(sub[vector].to_numpy()).astype(float)])
                m = (x.T @ x).ravel()
                yield pd.DataFrame({group: g, "i": np.arange(len(m)), "v": m})

    return df.select(group, vector).mapInPandas(partial, f"{group} {types[group]}, i int, v double").groupBy(group, "i").agg(F.sum("v").alias("v"))


def _components(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = int(math.isqrt(len(m)))
    m = m.reshape(d, d)
    n, s = m[0, 0], m[0, 1:]
    cov = m[1:, 1:] / n - np.outer(s, s) / (n * n)
    w, v = np.linalg.eigh(cov)
    return s / n, v[:, np.argsort(-w)[:k]]


def leave_group_out_reconstruction(df: DataFrame, row: str, group: str, vector: str, k: int = 3) -> DataFrame:
    """row, group, error: RMS distance of each row to the k-component plane fitted to the other groups.

    All folds come from one pass: the moments without a group are the total minus the group's own.
    """
    mom = materialise(group_moments(df, group, vector))
    total = np.array([r["v"] for r in mom.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])  # (d + 1)^2 numbers
    types = dict(df.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("i")["v"].to_numpy()
        mean, comp = _components(total - own, k)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "_mean": [mean.tolist()], "_comp": [comp.T.ravel().tolist()]})

    planes = mom.groupBy(group).applyInPandas(fit, f"{group} {types[group]}, _mean array<double>, _comp array<double>")
    j = salted_join(df.select(row, group, vector), planes, [group])

    @F.pandas_udf("double")
    def error(x: pd.Series, mean: pd.Series, comp: pd.Series) -> pd.Series:
        out = []
        for a, m, c in zip(x, mean, comp):
            d = np.asarray(a, float) - np.asarray(m)
            p = np.asarray(c).reshape(k, len(d))
            r = d - p.T @ (p @ d)
            out.append(float(np.sqrt(np.mean(r * r))))
        return pd.Series(out)

    return j.select(row, group, error(vector, "_mean", "_comp").alias("error"))


def two_means(df: DataFrame, row: str, vector: str, k: int = 2, components: int = 3, seed: int = 1) -> DataFrame:
    """Add `cluster` from k-means on leading principal components."""
    from pyspark.ml.feature import PCA

    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    pca = PCA(k=components, inputCol="_v", outputCol="_pc").fit(v)
    x = pca.transform(v)
    return KMeans(k=k, seed=seed, featuresCol="_pc", predictionCol="cluster").fit(x).transform(x).drop("_v", "_pc")


def cluster_agreement(df: DataFrame, cluster: str, physical: Column) -> DataFrame:
    """Share of rows on the diagonal of the better of the two labelings."""
    same = F.avg((F.col(cluster) == physical.cast("int")).cast("int"))
    return df.agg(F.greatest(same, 1 - same).alias("agreement"), F.count("*").alias("rows"))


# ---- correlated-noise information ------------------------------------------------------------------

def marginal_information(s: np.ndarray, basis: np.ndarray, cov: np.ndarray) -> float:
    """Expected squared signal-to-noise of the amplitude of s when the basis amplitudes are free."""
    u = np.linalg.solve(cov, np.column_stack([s, basis]))
    ss, bs, bb = s @ u[:, 0], basis.T @ u[:, 0], basis.T @ u[:, 1:]
    return float(ss - bs @ np.linalg.solve(bb, bs))


def visit_information(binned: DataFrame, visit: str, x: str, signal: str, sigma: str, basis: Sequence[str], amplitude: float, length: float) -> DataFrame:
    """visit, points, info_white, info_correlated per visit.

    `binned` holds a visit on a fixed grid (at most a few hundred rows), so one visit is one small matrix.
    """
    types = dict(binned.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(x)
        s, sg = p[signal].to_numpy(float), p[sigma].to_numpy(float)
        b = np.column_stack([np.ones(len(p)), *[p[c].to_numpy(float) for c in basis]])
        if len(p) <= b.shape[1]:
            return pd.DataFrame({visit: [p[visit].iloc[0]], "points": [len(p)], "info_white": [None], "info_correlated": [None]})
        t = p[x].to_numpy(float)
        k = amplitude ** 2 * np.exp(-0.5 * ((t[:, None] - t[None]) / length) ** 2)
        white = np.diag(sg ** 2)
        return pd.DataFrame({visit: [p[visit].iloc[0]], "points": [len(p)], "info_white": [marginal_information(s, b, white)],
                             "info_correlated": [marginal_information(s, b, white + k)]})

    return binned.groupBy(visit).applyInPandas(fit, f"{visit} {types[visit]}, points long, info_white double, info_correlated double")


LOG_AMPLITUDES, GRID = (-4.5, 0.0), 361     # fixed values: range of the logarithm of the amplitude, points of its profile


class NoiseProfile:
    """Likelihood of residuals under base + amplitude^2 x shape, for any amplitude at the cost of a sum.

    With base = L L', the eigenvectors of L^-1 shape L'^-1 turn the residuals into independent terms whose variances
    are 1 + amplitude^2 x eigenvalue, whatever the amplitude.  Visits of equal length may be stacked: residuals of shape
    (visits, n), base and shape of (visits, n, n); the results then have one element per visit.
    """

    def __init__(self, residual: np.ndarray, base: np.ndarray, shape: np.ndarray):
        n = residual.shape[-1]
        low = np.linalg.cholesky(base + 1e-9 * np.eye(n))
        inner = np.linalg.solve(low, np.linalg.solve(low, shape).swapaxes(-1, -2))
        self.eigen, turn = np.linalg.eigh((inner + inner.swapaxes(-1, -2)) / 2)
        self.eigen = np.maximum(self.eigen, 0.0)
        white = np.linalg.solve(low, residual[..., None])
        self.z2 = (turn.swapaxes(-1, -2) @ white)[..., 0] ** 2
        self.constant = -np.log(np.diagonal(low, axis1=-2, axis2=-1)).sum(axis=-1) - 0.5 * n * math.log(2 * math.pi)

    def _at(self, log10_amplitude: np.ndarray) -> np.ndarray:
        """At one logarithm of the amplitude per visit."""
        v = 1 + 10.0 ** (2 * np.asarray(log10_amplitude, float))[..., None] * self.eigen
        return self.constant - 0.5 * (self.z2 / v + np.log(v)).sum(axis=-1)

    def log_likelihood(self, log10_amplitude) -> np.ndarray:
        """At one or many logarithms of the amplitude, which come first in the result; minus infinity is an amplitude of zero."""
        x = np.asarray(log10_amplitude, float)
        return np.stack([self._at(np.full(self.eigen.shape[:-1], a)) for a in x.ravel()]).reshape(x.shape + self.eigen.shape[:-1])

    def best(self, bounds: tuple[float, float] = LOG_AMPLITUDES, steps: int = GRID) -> tuple[np.ndarray, ...]:
        """(log10 amplitude, lnL there, lnL without, low, high): where the likelihood stays within 0.5 of its best.

        The amplitude is 0 (minus infinity) where none improves on it; low is minus infinity where the range's start is inside.
        """
        grid = np.linspace(*bounds, steps)
        profile = self.log_likelihood(grid)
        i = profile.argmax(axis=0)
        lo, hi = grid[np.maximum(i - 1, 0)], grid[np.minimum(i + 1, steps - 1)]
        for _ in range(60):                      # the peak is single inside one cell
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            up = self._at(a) < self._at(b)
            lo, hi = np.where(up, a, lo), np.where(up, hi, b)
        at, none = (lo + hi) / 2, self._at(np.full(np.shape(lo), -np.inf))
        top = self._at(at)
        better = top > none
        at, top = np.where(better, at, -np.inf), np.where(better, top, none)
        inside = profile >= top - 0.5
        first, last = grid[inside.argmax(axis=0)], grid[steps - 1 - inside[::-1].argmax(axis=0)]
        some = inside.any(axis=0)
        low = np.where(some & (first > bounds[0] + 1e-9), first, -np.inf)
        return at, top, none, low, np.where(some, last, -np.inf)


VISITS, CELLS = 256, 1_000_000                   # visits of equal length that are fitted together, and elements of their matrices, at most


def amplitude_profile(points: DataFrame, visit: str, x: str, y: str, sigma: str, level: str, templates: dict[str, float], offset_sd: float, length: float,
                      weight: str | None = None, bounds: tuple[float, float] = LOG_AMPLITUDES, steps: int = GRID) -> DataFrame:
    """visit, points, log10_amplitude, lnl, lnl_none, low, high: noise correlated over `length` in x, fitted to each visit.

    The base noise is sigma plus the templates (columns, with the prior deviation of their amplitudes, in units of
    `level`) and a free offset; the correlated part follows `level` and, where given, the column `weight`.  A visit is
    a fixed grid of at most a few hundred rows, so it is one small eigenproblem and travels as one row; those of a batch
    that are equally long are solved together.
    """
    kind = dict(points.dtypes)[visit]
    columns = list(dict.fromkeys([x, y, sigma, level, *templates, *([weight] if weight else [])]))
    rows = points.groupBy(visit).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]))).alias("_p"))
    packed = rows.select(F.col(visit).alias("_visit"), *[F.col("_p")[c].alias(f"_{i}") for i, c in enumerate(columns)])

    def fit(stack: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        t, d = stack[x], stack[level]
        basis = np.stack([*[d * stack[c] for c in templates], np.ones_like(d)], axis=-1)
        prior = np.array([*templates.values(), offset_sd]) ** 2
        base = (basis * prior) @ basis.swapaxes(-1, -2)
        base += stack[sigma][..., None] ** 2 * np.eye(t.shape[-1])
        w = d * (stack[weight] if weight else 1.0)
        shape = w[:, :, None] * w[:, None, :] * np.exp(-0.5 * ((t[:, :, None] - t[:, None, :]) / length) ** 2)
        return NoiseProfile(stack[y] - d, base, shape).best(bounds, steps)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = f["_0"].map(len).to_numpy()
            for n in np.unique(size):
                same = f[size == n]
                step = max(1, min(VISITS, CELLS // n ** 2))
                for lo in range(0, len(same), step):
                    part = same.iloc[lo:lo + step]
                    found = fit({c: np.stack(part[f"_{i}"].to_list()).astype(float) for i, c in enumerate(columns)})
                    yield pd.DataFrame({visit: part["_visit"].to_numpy(), "points": n, **dict(zip(("log10_amplitude", "lnl", "lnl_none", "low", "high"), found))})

    return spread(packed, 1 << 30).mapInPandas(run, f"{visit} {kind}, points long, log10_amplitude double, lnl double, lnl_none double, low double, high double")


def joint_information(points: DataFrame, keys: Sequence[str], signal: str, weight: str) -> DataFrame:
    """Squared signal-to-noise with one free offset, from weighted sums."""
    w, s = F.col(weight), F.col(signal)
    g = points.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * s).alias("_s"), F.sum(w * s * s).alias("_q"))
    return g.select(*keys, (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_w")).alias("information"))


def regularised_fit(points: DataFrame, keys: Sequence[str], y: str, sigma: str, basis: Sequence[str], prior_sd: Sequence[float]) -> DataFrame:
    """keys, coefficients, chi2 of a ridge fit per key, from sums of products (no row leaves its task)."""
    cols = list(basis)
    w = 1 / (F.col(sigma) * F.col(sigma))
    aggs = [F.sum(w * F.col(a) * F.col(b)).alias(f"_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    aggs += [F.sum(w * F.col(a) * F.col(y)).alias(f"_y{i}") for i, a in enumerate(cols)] + [F.sum(w * F.col(y) * F.col(y)).alias("_yy")]
    g = points.groupBy(*keys).agg(*aggs)
    n, lam = len(cols), [1 / (s * s) for s in prior_sd]
    names = [f"_{i}_{j}" for i in range(n) for j in range(i, n)]

    @F.pandas_udf("struct<coefficients: array<double>, chi2: double>")
    def solve(m: pd.DataFrame) -> pd.DataFrame:
        coef, chi = [], []
        for r in m.itertuples(index=False):
            v = dict(zip(m.columns, r))
            a0 = np.array([[v[f"_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
            b = np.array([v[f"_y{i}"] for i in range(n)])
            t = np.linalg.solve(a0 + np.diag(lam), b)
            coef.append(t.tolist())
            chi.append(float(v["_yy"] - 2 * t @ b + t @ a0 @ t))
        return pd.DataFrame({"coefficients": coef, "chi2": chi})

    packed = F.struct(*[F.col(c) for c in [*names, *[f"_y{i}" for i in range(n)], "_yy"]])
    return g.select(*keys, solve(packed).alias("f")).select(*keys, "f.*")
