"""Rank, running total, neighbour, quantile and join building blocks that hold under skew.

Each one first asks whether any group is larger than one task should sort.  If none is, the plain
Spark window or aggregate is used.  If some are, the rows of those groups are cut into value ranges:
every range is ordered on its own and the totals of the ranges before it are added.  No group is
ever ordered in a single task, and nothing is dropped or sampled from the result; sampling only
chooses where the ranges are cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyframe.functions.basics import CheckFailed

ROWS_PER_TASK = "spark.surveyframe.rowsPerTask"
FEW = 10_000                       # rows of a table that is sent to every task
PACKED = 4                         # rows that a task holds as a few numbers each where it would sort one


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK, "2000000"))


def fits_packed(df: DataFrame, rows: int) -> bool:
    """Whether a task can hold the numbers of all rows, a few columns of 8 bytes."""
    return rows <= PACKED * rows_per_task(df.sparkSession)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder the cluster names; only a local session gets one of our own."""
    spark = df.sparkSession
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if conf_dir is None and not sc.master.startswith("local"):
            raise CheckFailed("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(conf_dir or tempfile.mkdtemp(prefix="surveyframe-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, pieces: int, *columns: str) -> DataFrame:
    """Deal few rows of much work over the cluster: a fixed number of partitions, which Spark does not merge for their small size."""
    spark = df.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(pieces, most)), *columns)


def scalar_of(df: DataFrame, **aggs: Column) -> Column:
    """Global aggregates as one struct column usable inside any projection (a scalar subquery)."""
    return df.agg(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("s")).scalar()


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery instead of a join."""
    s = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return df.select("*", *[s[c].alias(c) for c in one_row.columns])


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys with more rows than one task should hold, with their row count `_n`; None if there are none."""
    limit = limit or rows_per_task(df.sparkSession)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    return None if hot.isEmpty() else hot


def fits_in_task(df: DataFrame, keys: Sequence[str] = ()) -> bool:
    """Whether every group is small enough for one task; ask once and pass the answer on as `fits`."""
    return hot_groups(df, keys) is None


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on keys where NULL equals NULL; the right side's key columns are dropped."""
    if not keys:
        return attach_row(left, right)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _is_number(df: DataFrame, value: str) -> bool:
    return isinstance(df.schema[value].dataType, (T.NumericType, T.BooleanType))


def _edges(df: DataFrame, value: str, n: int) -> tuple[list, list]:
    """Range cuts near the n-quantiles, and the values so frequent that they need a range of their own.

    Numbers are cut by approximate quantiles, other types in their own order by a bounded sample of the values.
    """
    if not _is_number(df, value):
        rows = df.select(F.col(value).alias("v")).filter("v is not null").orderBy(F.rand(7)).limit(50 * n).collect()
        seen = sorted(r["v"] for r in rows)
        cuts = seen[50::50] if len(seen) > 50 else seen[1:]
        return sorted(set(cuts)), sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    probs = [i / n for i in range(1, n)]
    approx = F.percentile_approx(F.col(value).cast("double"), probs, max(10000, 20 * n))
    edges = [e for e in (df.agg(approx.alias("e")).first()["e"] or []) if math.isfinite(e)]
    heavy = sorted({a for a, b in zip(edges, edges[1:]) if a == b})
    cuts = sorted(set(edges) | {math.nextafter(v, math.inf) for v in heavy})
    return cuts, heavy


def _number(df: DataFrame, value: str, cuts: list, out: str) -> DataFrame:
    """Index of the range [cut, next cut) a value lies in; 0 when there are no cuts."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    if not _is_number(df, value):
        at = F.array(*[F.lit(c) for c in cuts])
        return df.withColumn(out, F.coalesce(F.size(F.filter(at, lambda c: c <= F.col(value))), F.lit(0)))
    cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_cutv", outputCol="_cutb", handleInvalid="keep")
    df = cutter.transform(df.withColumn("_cutv", F.col(value).cast("double")))
    return df.withColumn(out, F.coalesce(F.col("_cutb").cast("int"), F.lit(0))).drop("_cutv", "_cutb")


def split_ranges(df: DataFrame, value: str, keys: Sequence[str] = (), tie: str | None = None) -> DataFrame | None:
    """Add `_part`, rising with (value, tie) inside hot groups and 0 elsewhere; None if no group is hot.

    `value` must not be NULL; any type that can be ordered will do.  Frequent values are cut again by `tie`.
    """
    keys = list(keys)
    limit = rows_per_task(df.sparkSession)
    hot = hot_groups(df, keys, limit)
    if hot is None:
        return None
    size = hot.agg(F.sum("_n").alias("rows")).first()["rows"]
    n = max(2, 2 * math.ceil(size / limit))
    tagged = null_safe_join(df, hot.withColumnRenamed("_n", "_hot_n"), keys) if keys else df.withColumn("_hot_n", F.lit(size))
    cuts, heavy = _edges(tagged.filter(F.col("_hot_n").isNotNull()), value, n)
    tagged = _number(tagged, value, cuts, "_part")
    part = F.col("_part").cast("long")
    if tie is not None and heavy:
        in_heavy = (F.col(value).cast("double") if _is_number(tagged, value) else F.col(value)).isin(heavy)
        tie_cuts, _ = _edges(tagged.filter(in_heavy), tie, n)
        tagged = _number(tagged, tie, tie_cuts, "_sub")
        part = part * F.lit(len(tie_cuts) + 2) + F.when(in_heavy, F.col("_sub")).otherwise(0)
    tagged = tagged.withColumn("_part", F.when(F.col("_hot_n").isNotNull(), part).otherwise(F.lit(0)))
    return tagged.drop("_sub", "_hot_n")


def cumulative(df: DataFrame, value: str, sums: dict[str, Column], keys: Sequence[str] = (),
               tie: str | None = None, fits: bool | None = None) -> DataFrame:
    """Add inclusive running totals `name -> sum(expr)` in the order (value, tie) within keys.

    `fits` here and below: True when the caller already knows that no group (or coarser group) is hot.
    """
    keys = list(keys)
    order = [F.col(value).asc(), *([F.col(tie).asc()] if tie else [])]
    parts = None if fits else split_ranges(df, value, keys, tie)
    if parts is None:
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(e).over(w).alias(n) for n, e in sums.items()])
    inner = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(e).over(inner).alias(n) for n, e in sums.items()])
    totals = parts.groupBy(*keys, "_part").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, "_part", *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums])
    joined = null_safe_join(local, carried, [*keys, "_part"])
    done = [(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums]
    return joined.select(*df.columns, *done)


def neighbour(df: DataFrame, value: str, cols: dict[str, str], keys: Sequence[str] = (),
              tie: str | None = None, forward: bool = False, fits: bool | None = None) -> DataFrame:
    """Add columns `name -> column` of the row before (or after) in the order (value, tie) within keys."""
    keys = list(keys)
    order = [F.col(value).asc(), *([F.col(tie).asc()] if tie else [])]
    near = F.lead if forward else F.lag
    taken = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    parts = None if fits else split_ranges(df, value, keys, tie)
    if parts is None:
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return df.select("*", *[near(c).over(w).alias(n) for n, c in cols.items()])
    inner = W.partitionBy(*keys, "_part").orderBy(*order)
    local = parts.withColumn("_near", near(taken).over(inner))
    rank = F.struct(value, *([tie] if tie else []))
    ends = parts.groupBy(*keys, "_part").agg((F.min_by if forward else F.max_by)(taken, rank).alias("_end"))
    across = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")
    ends = ends.select(*keys, "_part", near("_end").over(across).alias("_over"))
    joined = null_safe_join(local, ends, [*keys, "_part"])
    got = F.coalesce("_near", "_over")
    return joined.select(*df.columns, *[got[n].alias(n) for n in cols])


def quantiles(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, float]], fits: bool | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles `name -> (column, p)` per key; NULL values are left out."""
    keys = list(keys)
    hot = None if fits else hot_groups(df, keys)
    direct = [F.percentile(F.col(c), p).alias(n) for n, (c, p) in specs.items()]
    if hot is None:
        return df.groupBy(*keys).agg(*direct)
    if keys:
        marked = null_safe_join(df, hot, keys)
        cold = marked.filter(F.col("_n").isNull()).groupBy(*keys).agg(*direct)
        rows = marked.filter(F.col("_n").isNotNull()).drop("_n")
    else:
        cold, rows = None, df
    out = rows.select(*keys).distinct() if keys else None
    for column in dict.fromkeys(c for c, _ in specs.values()):
        found = _hot_quantiles(rows, keys, column, {n: p for n, (c, p) in specs.items() if c == column})
        out = found if out is None else (null_safe_join(out, found, keys) if keys else attach_row(out, found))
    return out if cold is None else cold.unionByName(out)


def _hot_quantiles(df: DataFrame, keys: list[str], column: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from counts of distinct values: the value at a rank is the first whose running count passes it."""
    counts = (df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v"))
              .agg(F.count("*").alias("_c")))
    running = cumulative(counts, "_v", {"_cum": F.col("_c")}, keys)
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    running = null_safe_join(running, total, keys)
    picks = []
    for i, p in enumerate(probs.values()):
        at = F.lit(p) * (F.col("_total") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}"))
    found = running.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    cols = []
    for i, (n, p) in enumerate(probs.items()):
        at = F.lit(p) * (F.col("_total") - 1)
        frac = at - F.floor(at)
        cols.append((F.col(f"_lo{i}") * (1 - frac) + F.col(f"_hi{i}") * frac).alias(n))
    return found.select(*keys, *cols)


def medians(df: DataFrame, keys: Sequence[str], fits: bool | None = None, **columns: str) -> DataFrame:
    return quantiles(df, keys, {n: (c, 0.5) for n, c in columns.items()}, fits)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows per key.  Spark keeps only n rows per key and task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", fits: bool | None = None) -> DataFrame:
    """Equi-join under skew: Spark's adaptive skew join splits the partitions of hot keys while the query runs.

    Nothing is counted while the plan is built.  `fits` is accepted for callers that know their groups and has no effect.
    """
    return left.join(right, list(on), how)


def small_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join with a stored table of few rows: sent to the tasks, so that the rows of a few large keys stay where they are."""
    few = right.limit(FEW + 1).count() <= FEW
    return left.join(F.broadcast(right) if few else right, list(on), how)
