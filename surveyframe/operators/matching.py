"""Joins: validated lookups, fallbacks, completion, intervals, interpolation, overlaps and scenario grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.basics import no_nan, require_empty
from surveyframe.operators.cleaning import duplicates
from surveyframe.operators.scale import cumulative, fits_in_task, medians, salted_join, top_rows


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Left join that refuses a right side with repeated keys; `matched` tells which rows found one."""
    if check:
        require_empty(duplicates(right, keys), "right side of a many-to-one join repeats a key")
    return salted_join(left, right.withColumn("matched", F.lit(True)), list(keys), "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False)))


def match_counts(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("rows"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))


def fallback_chain(base: DataFrame, key: str, value: str, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Value of the first source that has one, and that source's name; sources are (name, df(key, value))."""
    out = base
    for i, (_, s) in enumerate(sources):
        out = salted_join(out, s.select(key, F.col(value).alias(f"_v{i}")), [key], "left")
    names = [F.when(F.col(f"_v{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(sources)]
    values = [F.col(f"_v{i}") for i in range(len(sources))]
    return out.select(*base.columns, F.coalesce(*values).alias(value), F.coalesce(*names, F.lit("missing")).alias(f"{value}_source"))


def complete_from(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str], other_name: str,
                  check: str | None = None, ratio: float = 3.0) -> DataFrame:
    """Fill blank columns from a second catalogue with notes; flag rows where `check` differs by more than `ratio`."""
    j = salted_join(df, other.select(key, *[F.col(c).alias(f"_o_{c}") for c in other.columns if c != key]), [key], "left")
    notes = [F.when(F.col(c).isNull() & F.col(f"_o_{c}").isNotNull(), F.lit(f"{c} from {other_name}")) for c in columns]
    flag = F.lit(False)
    if check:
        q = F.col(check) / F.nullif(F.col(f"_o_{check}"), F.lit(0.0))
        flag = F.coalesce((q > ratio) | (q < 1 / ratio), F.lit(False))
        notes.append(F.when(flag, F.lit(f"{check} conflicts with {other_name}")))
    filled = [F.coalesce(F.col(c), F.col(f"_o_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return j.select(*filled, F.concat_ws("; ", *notes).alias("notes"), flag.alias("conflict"))


def first_by_key(names: DataFrame, name: str, alternatives: str | None, sep: str, key_of, order: str, value: str) -> DataFrame:
    """key -> value over names and exploded alternative names; the first row of a key wins, main names before alternatives."""
    rows = names.select(F.col(name).alias("_n"), F.lit(0).alias("_rank"), order, value)
    if alternatives:
        alt = names.filter(F.col(alternatives).isNotNull()).select(
            F.explode(F.split(alternatives, sep)).alias("_n"), F.lit(1).alias("_rank"), order, value)
        rows = rows.unionByName(alt)
    rows = rows.withColumn("name_key", key_of("_n"))
    return rows.groupBy("name_key").agg(F.min_by(value, F.struct("_rank", order)).alias(value))


def best_match(df: DataFrame, key: str, difference: str, coverage: str, tie: str) -> DataFrame:
    return top_rows(df, [key], [F.col(difference).asc_nulls_last(), F.col(coverage).desc(), F.col(tie).asc()])


def presence(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the left side with and without a partner."""
    keys = right.select(key).distinct()
    return left.join(keys, key, "left_semi"), left.join(keys, key, "left_anti")


def paired_subset(a: DataFrame, b: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    return salted_join(a, b, [key]).dropna(subset=list(required))


def weight_grid(df: DataFrame, names: Sequence[str], steps: int) -> DataFrame:
    """Repeat each row for every weight vector on a simplex grid; a bounded literal set, generated per row."""
    import itertools

    points = [p for p in itertools.product(range(steps + 1), repeat=len(names)) if sum(p) == steps]
    grid = F.array(*[F.struct(*[F.lit(v / steps).alias(n) for n, v in zip(names, p)]) for p in points])
    return df.select("*", F.inline(grid))


def scenario_rows(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Repeat each row for every combination of literal axis values."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


# ---- intervals -------------------------------------------------------------------------------------

def interval_index(queries: DataFrame, x: str, knots: DataFrame, kx: str) -> DataFrame:
    """Add `_i`, the number of knots at or below x; NULL where x is NULL or NaN.

    The distinct values of both sides are merged and the knots counted by a running total.
    """
    at_x = no_nan(F.col(x).cast("double"))
    marks = knots.select(no_nan(F.col(kx).cast("double")).alias("_x"), F.lit(1).alias("_k")).distinct().unionByName(
        queries.select(at_x.alias("_x"), F.lit(0).alias("_k")))
    marks = marks.filter(F.col("_x").isNotNull()).groupBy("_x").agg(F.max("_k").alias("_k"))
    at = cumulative(marks, "_x", {"_i": F.col("_k").cast("bigint")}).select("_x", "_i")
    return salted_join(queries.withColumn("_x", at_x), at, ["_x"], "left").drop("_x")


def interpolate(queries: DataFrame, x: str, knots: DataFrame, kx: str, ky: str, out: str) -> DataFrame:
    """Piecewise-linear lookup, clamped at the ends; NULL for a NULL or NaN x, knots without a number do not count."""
    k = knots.groupBy(no_nan(F.col(kx).cast("double")).alias("x0")).agg(F.avg(ky).alias("y0")).filter(F.col("x0").isNotNull())
    k = cumulative(k, "x0", {"_i": F.lit(1).cast("bigint")})
    nxt = k.select((F.col("_i") - 1).alias("_i"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    seg = k.join(nxt, "_i", "full_outer")
    tagged = interval_index(queries, x, knots, kx)
    j = salted_join(tagged, seg, ["_i"], "left")
    inside = F.col("y0") + (F.col(x) - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    y = F.when(F.col("y0").isNull(), F.col("y1")).when(F.col("y1").isNull(), F.col("y0")).otherwise(inside)
    return j.withColumn(out, y).drop("_i", "x0", "y0", "x1", "y1")


def overlap_bins(points: DataFrame, bins: DataFrame, keys: Sequence[str], x: str, centre: str, half: str, width: float,
                 how: str = "left") -> DataFrame:
    """Pair every bin [centre - half, centre + half) with the points inside it.

    Both sides are keyed by grid cell of the given width (at least the widest bin, so a bin covers two or
    three cells); only points of those cells meet the bin.
    """
    cell = lambda v: F.floor(v / F.lit(width)).cast("bigint")
    b = bins.withColumn("_cell", F.explode(F.sequence(cell(F.col(centre) - F.col(half)), cell(F.col(centre) + F.col(half)))))
    p = points.withColumn("_cell", cell(F.col(x)))
    j = salted_join(p, b, [*keys, "_cell"])
    return j.filter((F.col(x) >= F.col(centre) - F.col(half)) & (F.col(x) < F.col(centre) + F.col(half))).drop("_cell")


def compare_grids(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], x: str, y: str, e: str, bin_id: str,
                  centre: str, half: str, cy: str, ce: str, width: float) -> DataFrame:
    """Per key: coverage, median offset, normalised differences and correlation of a fine on a coarse grid."""
    pairs = overlap_bins(fine.filter(F.col(e) > 0), coarse, keys, x, centre, half, width)
    w = 1 / F.pow(F.col(e), 2)
    binned = pairs.groupBy(*keys, bin_id).agg((F.sum(w * F.col(y)) / F.sum(w)).alias("_fine"), F.first(cy).alias("_coarse"),
                                              F.first(ce).alias("_sigma"))
    binned = binned.withColumn("_diff", F.col("_coarse") - F.col("_fine")).withColumn("_nd", F.abs("_diff") / F.col("_sigma"))
    n = coarse.groupBy(*keys).agg(F.count("*").alias("n_coarse"))
    got = binned.groupBy(*keys).agg(F.count("*").alias("n_compared"), F.corr("_coarse", "_fine").alias("corr"))
    fits = fits_in_task(coarse, keys)   # a key has at most as many compared bins as coarse bins
    med = medians(binned, keys, fits, median_offset="_diff", norm_diff="_nd")
    after = binned.join(med.select(*keys, "median_offset"), list(keys)).withColumn(
        "_na", F.abs(F.col("_diff") - F.col("median_offset")) / F.col("_sigma"))
    after = medians(after, keys, fits, norm_diff_after_offset="_na")
    k = list(keys)
    return (n.join(got, k, "left").join(med, k, "left").join(after, k, "left")
            .withColumn("n_compared", F.coalesce("n_compared", F.lit(0)))
            .withColumn("coverage", F.col("n_compared") / F.col("n_coarse")))


def match_verdict(n: Column, coverage: Column, diff: Column, diff_after: Column) -> Column:
    return (F.when(n == 0, "no overlap")
            .when((coverage >= 0.8) & (diff <= 0.25), "same data (re-binned)")
            .when((coverage >= 0.8) & (diff_after <= 0.25), "same data up to a constant depth offset")
            .when((coverage >= 0.5) & (diff <= 1.0), "consistent within errors (different reduction or binning)")
            .otherwise("INCONSISTENT"))
