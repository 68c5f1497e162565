"""Splits without leakage: grouped stratified hold-outs, folds, nested fractions, checks and weights."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surveyframe.functions.basics import CheckFailed, uniform
from surveyframe.operators.scale import cumulative, fits_in_task, quantiles, salted_join, scalar_of

MAX_FOLDS = 20            # fixed value: finest fraction used for a hold-out
UNLABELED = "UNLABELED"   # stratum of rows without a label


def group_table(df: DataFrame, group: str, label: str) -> DataFrame:
    """One row per group: rows and dominant stratum (most rows, then first by name)."""
    counts = df.groupBy(group, F.coalesce(label, F.lit(UNLABELED)).alias("stratum")).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.sum("n").alias("rows"), F.min_by("stratum", F.struct(-F.col("n"), "stratum")).alias("stratum"))


def assign_folds(groups: DataFrame, group: str, n: int, seed: int, name: str = "fold", fits: bool | None = None,
                 within: tuple[str, ...] = ("stratum",)) -> DataFrame:
    """Fold of each group: its place in the cumulative row share of a hashed order inside its stratum."""
    keys = list(within)
    fits = fits_in_task(groups, keys) if fits is None else fits
    drawn = groups.withColumn("_u", uniform(group, seed))
    placed = cumulative(drawn, "_u", {"_cum": F.col("rows")}, keys, group, fits)
    if fits:
        placed = placed.withColumn("_total", F.sum("rows").over(W.partitionBy(*keys)))
    else:
        placed = placed.join(groups.groupBy(*keys).agg(F.sum("rows").alias("_total")), keys)
    at = (F.col("_cum") - F.col("rows")) * n / F.col("_total")
    return placed.withColumn(name, F.least(F.floor(at), F.lit(n - 1)).cast("int")).drop("_u", "_cum", "_total")


def fold_share(fraction: float) -> tuple[int, int]:
    """A fraction as k of n folds."""
    f = Fraction(fraction).limit_denominator(MAX_FOLDS)
    if not 0 < f.numerator < f.denominator:
        raise CheckFailed(f"fraction {fraction} is not k/n with 0 < k < n <= {MAX_FOLDS}")
    return f.numerator, f.denominator


def hold_out(groups: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Add `held`: whole groups with about `fraction` of the rows, as k of n folds."""
    k, n = fold_share(fraction)
    return assign_folds(groups, group, n, seed).withColumn("held", F.col("fold") < k).drop("fold")


def grouped_split(df: DataFrame, group: str, label: str, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """group -> split; test first, then val from what is left.  Whole groups only; a blank label is a stratum."""
    groups = group_table(df, group, label)
    fits = fits_in_task(groups, ["stratum"])
    (k1, n1), (k2, n2) = fold_share(test), fold_share(val / (1 - test))
    first = assign_folds(groups, group, n1, seed, "_f1", fits).withColumn("_held", F.col("_f1") < k1)
    second = assign_folds(first, group, n2, seed + 1, "_f2", fits or None, ("stratum", "_held"))
    return second.select(group, F.when(F.col("_held"), "test").when(F.col("_f2") < k2, "val").otherwise("train").alias("split"))


def apply_split(df: DataFrame, split: DataFrame, group: str) -> DataFrame:
    return salted_join(df, split, [group])


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups present in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).filter("splits > 1")


def check_leakage(df: DataFrame, group: str, n_rows: int | None = None, split: str = "split") -> None:
    bad = leakage(df, group, split).limit(10).collect()
    if bad:
        raise CheckFailed(f"groups in two splits: {[r[group] for r in bad]}")
    if n_rows is not None and df.count() != n_rows:
        raise CheckFailed("rows were lost or doubled by the split")


def pairs_across(pairs: DataFrame, split: DataFrame, row: str) -> DataFrame:
    """Twin pairs whose two rows lie in different splits."""
    a = split.select(F.col(row).alias("a_id"), F.col("split").alias("a_split"))
    b = split.select(F.col(row).alias("b_id"), F.col("split").alias("b_split"))
    return pairs.join(a, "a_id").join(b, "b_id").filter("a_split <> b_split")


def drop_bridging(df: DataFrame, family: str, labelled: Column, split: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """Unlabelled members of families whose labelled members span several splits are removed; others inherit or draw a split."""
    known = df.filter(labelled).select(family, split).distinct().groupBy(family).agg(F.count(split).alias("_n"), F.min(split).alias("_s"))
    j = salted_join(df, known, [family], "left")
    kept = j.filter(labelled | F.col("_n").isNull() | (F.col("_n") <= 1))
    u, low, drawn = uniform(family, seed), 0.0, F
    for name, share in shares.items():
        drawn = drawn.when(u < low + share, F.lit(name))
        low += share
    drawn = drawn.otherwise(F.lit(name))
    return kept.withColumn(split, F.when(labelled, F.col(split)).otherwise(F.coalesce("_s", drawn))).drop("_n", "_s")


def sharing_summary(df: DataFrame, group: str) -> DataFrame:
    per = df.groupBy(group).agg(F.count("*").alias("n"))
    multi = F.col("n") > 1
    return per.agg(F.sum("n").alias("total_rows"), F.count("*").alias("groups"), F.count_if(multi).alias("multi_row_groups"),
                   (100 * F.sum(F.when(multi, F.col("n")).otherwise(0)) / F.sum("n")).alias("pct_rows_on_multi"),
                   F.max("n").alias("max_rows"), F.min_by(group, F.struct(-F.col("n"), group)).alias("busiest"))


def class_balance(df: DataFrame, split: str, label: str, classes: list[str]) -> DataFrame:
    """split, class, rows, pct with zero cells kept and an extra 'all' split."""
    counts = df.groupBy(F.coalesce(label, F.lit(UNLABELED)).alias("class"), split).agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.col(split), F.lit("all")))
    return counts.withColumn("_s", both).groupBy("_s").agg(F.array(*[
        F.struct(F.lit(c).alias("class"), F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias("rows"),
                 F.sum("n").alias("total")) for c in classes]).alias("cells")).select(F.col("_s").alias(split), F.inline("cells")).select(
        split, "class", "rows", (100 * F.col("rows") / F.col("total")).alias("pct"))


def class_weights(df: DataFrame, label: str, scheme: str = "inverse") -> DataFrame:
    """label, weight: mean class count over class count, its square root, or 1."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    mean = scalar_of(counts, m=F.avg("n"))["m"]
    w = {"inverse": mean / F.col("n"), "sqrt": F.sqrt(mean / F.col("n")), "none": F.lit(1.0)}[scheme]
    return counts.select(label, w.alias("weight"))


def equal_group_weights(df: DataFrame, group: str) -> DataFrame:
    n = df.groupBy(group).agg((1 / F.count("*")).alias("weight"))
    return salted_join(df, n, [group])


def strata_balance_weights(df: DataFrame, value: str, label: str, bins: int = 10, lo: float = 0.2, hi: float = 10.0) -> DataFrame:
    """weight = P(class) / P(class | value decile), clipped, scaled to mean 1."""
    edges = quantiles(df, [], {f"q{i}": (value, i / bins) for i in range(1, bins)}).select(F.struct("*").alias("s")).scalar()
    # right-closed quantile bins: the bin number is how many inner edges lie below the value
    k = sum((F.when(F.col(value) > edges[f"q{i}"], 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    b = df.withColumn("_bin", k)
    cells = b.groupBy("_bin").agg(F.avg(label).alias("pb"), F.count("*").alias("n"), F.sum(label).alias("pos"))
    p = scalar_of(df, p=F.avg(label))["p"]
    raw = lambda y: F.greatest(F.lit(lo), F.least(F.lit(hi), F.when(y, p / F.col("pb")).otherwise((1 - p) / (1 - F.col("pb")))))
    cells = cells.withColumn("w1", raw(F.lit(True))).withColumn("w0", raw(F.lit(False)))
    part = lambda n, w: F.when(n > 0, n * w).otherwise(0.0)
    mean = scalar_of(cells, m=F.sum(part(F.col("pos"), F.col("w1")) + part(F.col("n") - F.col("pos"), F.col("w0"))) / F.sum("n"))["m"]
    return b.join(F.broadcast(cells), "_bin").withColumn(
        "weight", F.when(F.col(label) == 1, F.col("w1")).otherwise(F.col("w0")) / mean).drop("pb", "n", "pos", "w1", "w0")


def nested_fraction(groups: DataFrame, group: str, fold: str, seed: int) -> DataFrame:
    """Add `rank_share` in one hashed order of groups per fold, so that smaller fractions are subsets of larger ones."""
    ranked = cumulative(groups.withColumn("_u", uniform(group, seed)), "_u", {"_rn": F.lit(1).cast("bigint")}, [fold], tie=group)
    n = groups.groupBy(fold).agg(F.count("*").alias("_n"))
    return ranked.join(n, fold).withColumn("rank_share", F.col("_rn") / F.col("_n")).drop("_u", "_rn", "_n")


def out_of_fold(rows: DataFrame, scores: DataFrame, row: str, fold: str, model_fold: str) -> DataFrame:
    """Each row's score from the model that did not see its fold; a row without one is an error."""
    own = salted_join(rows, scores, [row], "left").filter(F.col(fold) == F.col(model_fold))
    missing = rows.select(row).join(own.select(row), row, "left_anti").limit(1).collect()
    if missing:
        raise CheckFailed(f"no out-of-fold score for {missing[0][row]}")
    return own.drop(model_fold)
