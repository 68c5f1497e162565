"""Ranking, calibration and agreement statistics over (label, score) rows, optionally per key and weighted.

Everything that depends on the order of scores first collapses equal scores to one row with counts and
then uses running totals, so ties cost nothing and no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surveyframe.functions.basics import bin_index, clip, count_where
from surveyframe.functions.stats import normal_tail, wilson
from surveyframe.operators.scale import FEW, attach_row, cumulative, fits_in_task, materialise, null_safe_join, quantiles, salted_join, scalar_of


def score_counts(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys, s, pos, neg: weight of positive and negative rows per distinct score; NULL labels are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("neg"))


def auc_from_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, auc, n_pos, n_neg; ties get half credit, one class only gives NULL."""
    c = cumulative(counts, "s", {"_below": F.col("neg")}, keys)
    got = c.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("_below") - F.col("neg") / 2)).alias("_u"),
                               F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return got.select(*keys, F.when(pairs > 0, F.col("_u") / pairs).alias("auc"), "n_pos", "n_neg")


def roc_auc(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return auc_from_counts(score_counts(df, y, score, keys, weight), keys)


def curve(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, threshold, tp, fp, precision, recall, fpr: one point per distinct score, from the highest down."""
    c = score_counts(df, y, score, keys).withColumn("_down", -F.col("s"))
    fits = fits_in_task(c, keys)
    c = cumulative(c, "_down", {"tp": F.col("pos"), "fp": F.col("neg")}, keys, fits=fits)
    total = c.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    j = salted_join(c, total, list(keys), fits=fits) if keys else attach_row(c, total)
    return j.select(*keys, F.col("s").alias("threshold"), "pos", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.nullif("_p", F.lit(0.0))).alias("recall"), (F.col("fp") / F.nullif("_n", F.lit(0.0))).alias("fpr"),
                    F.col("_p").alias("n_pos"), F.col("_n").alias("n_neg"))


def average_precision(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-sum average precision, base rate and lift."""
    c = curve(df, y, score, keys)
    rate = F.max("n_pos") / (F.max("n_pos") + F.max("n_neg"))
    ap = F.sum(F.col("precision") * F.col("pos")) / F.nullif(F.max("n_pos"), F.lit(0.0))
    return c.groupBy(*keys).agg(ap.alias("average_precision"), rate.alias("base_rate"), (ap - rate).alias("lift"))


def precision_at_recall(df: DataFrame, y: str, score: str, targets: Sequence[float]) -> DataFrame:
    """Best precision among points with recall at or above each target; the lowest such threshold on ties."""
    c = curve(df, y, score).withColumn("target_recall", F.explode(F.array(*[F.lit(t) for t in targets])))
    ok = F.col("recall") >= F.col("target_recall")
    best = F.min_by(F.struct("precision", "recall", "threshold"), F.when(ok, F.struct(-F.col("precision"), F.col("threshold"))))
    return c.groupBy("target_recall").agg(F.bool_or(ok).alias("achievable"), best.alias("b")).select(
        "target_recall", "achievable", *[F.when(F.col("achievable"), F.col(f"b.{n}")).alias(n) for n in ("precision", "recall", "threshold")])


def threshold_at_recall(df: DataFrame, y: str, score: str, recall: float) -> DataFrame:
    """The (1 - recall) quantile of the positives' scores."""
    return quantiles(df.filter(F.col(y) == 1), [], {"threshold": (score, 1 - recall)})


def threshold_sweep(df: DataFrame, y: str, score: str, points: int = 201) -> DataFrame:
    """Counts and rates at evenly spaced thresholds; rows are first counted per threshold step they reach."""
    m = points - 1
    s = F.col(score)
    k = F.floor(s * m)
    k = F.when((k + 1) / m <= s, k + 1).when(k / m > s, k - 1).otherwise(k)
    steps = df.filter(F.col(y).isNotNull()).groupBy(F.least(F.greatest(k, F.lit(-1)), F.lit(m)).cast("bigint").alias("i")).agg(
        count_where(F.col(y) == 1).alias("p"), count_where(F.col(y) != 1).alias("n"))
    grid = df.sparkSession.range(-1, points).withColumnRenamed("id", "i").join(steps, "i", "left").na.fill(0)
    down = W.partitionBy(F.lit(0)).orderBy(F.col("i").desc())   # at most `points` + 1 rows
    everything = W.partitionBy(F.lit(0))
    g = grid.select("i", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"),
                    F.sum("p").over(everything).alias("P"), F.sum("n").over(everything).alias("N")).filter("i >= 0")
    prec, rec = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif("P", F.lit(0))
    f1 = F.when(prec.isNotNull() & rec.isNotNull(), F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0))
    return g.select((F.col("i") / m).alias("threshold"), "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    ((F.col("tp") + F.col("N") - F.col("fp")) / (F.col("P") + F.col("N"))).alias("accuracy"))


def at_threshold(df: DataFrame, y: str, score: str, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    one = lambda c: F.greatest(c, F.lit(1))
    tp, fp, fn, neg = count_where(hit & pos), count_where(hit & ~pos), count_where(~hit & pos), count_where(~pos)
    return df.groupBy(*keys).agg((tp / one(tp + fp)).alias("precision"), (tp / one(tp + fn)).alias("recall"),
                                 (fp / one(neg)).alias("false_positive_rate"))


def argmax_class(scores: str | Column) -> Column:
    """Index of the first largest element."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(y, pred).agg(F.count("*").alias("rows"))


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """class, support, precision, recall, f1 (0 when undefined) and overall accuracy, from one pass of pair counts."""
    pairs = confusion(df, y, pred)
    long = pairs.select(F.inline(F.array(
        F.struct(F.col(y).alias("class"), F.col("rows").alias("actual"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col(y) == F.col(pred), F.col("rows")).otherwise(0).alias("right")),
        F.struct(F.col(pred).alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("rows").alias("called"), F.lit(0).cast("bigint").alias("right")))))
    per = long.groupBy("class").agg(F.sum("actual").alias("support"), F.sum("called").alias("called"), F.sum("right").alias("right"))
    acc = scalar_of(pairs, a=F.sum(F.when(F.col(y) == F.col(pred), F.col("rows")).otherwise(0)) / F.sum("rows"))["a"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.col("right") / F.nullif("called", F.lit(0))), zero(F.col("right") / F.nullif("support", F.lit(0)))
    return per.select("class", "support", p.alias("precision"), r.alias("recall"), zero(2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), acc.alias("accuracy"))


# ---- calibration -----------------------------------------------------------------------------------

def ece_equal_width(df: DataFrame, y: str, p: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    b = df.groupBy(*keys, bin_index(p, bins).alias("_b")).agg(F.abs(F.sum(y) - F.sum(p)).alias("_d"), F.count("*").alias("_n"))
    return b.groupBy(*keys).agg((F.sum("_d") / F.sum("_n")).alias("ece"))


def equal_count_bins(df: DataFrame, value: str, tie: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Add `_b`: equal-count bins in the order (value, tie); the first bins take the remainder."""
    fits = fits_in_task(df, keys)
    ranked = cumulative(df, value, {"_rn": F.lit(1).cast("bigint")}, keys, tie, fits)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    j = salted_join(ranked, n, list(keys), fits=fits) if keys else attach_row(ranked, n)
    q, r, i = F.floor(F.col("_n") / bins), F.col("_n") % bins, F.col("_rn") - 1
    head = r * (q + 1)
    b = F.when(i < head, F.floor(i / (q + 1))).otherwise(r + F.floor((i - head) / F.greatest(q, F.lit(1))))
    return j.withColumn("_b", b.cast("int")).drop("_rn", "_n")


def ece_equal_count(df: DataFrame, y: str, p: str, tie: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    b = equal_count_bins(df, p, tie, bins, keys).groupBy(*keys, "_b").agg(
        F.abs(F.sum(y) - F.sum(p)).alias("_d"), F.count("*").alias("_n"))
    return b.groupBy(*keys).agg((F.sum("_d") / F.sum("_n")).alias("ece"))


def reliability_curve(df: DataFrame, y: str, p: str, bins: int = 10, at_least: int = 5) -> DataFrame:
    b = df.groupBy(bin_index(p, bins).alias("bin")).agg(F.avg(p).alias("predicted"), F.avg(y).alias("observed"), F.count("*").alias("rows"))
    return b.filter(F.col("rows") >= at_least)


def log_loss_of(y: str | Column, p: str | Column, eps: float = 1e-6) -> Column:
    y, q = (F.col(y) if isinstance(y, str) else y), clip(p, eps, 1 - eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def probability_scores(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(log_loss_of(y, p)).alias("log_loss"),
                                 F.avg(y).alias("base_rate"), F.count("*").alias("rows"))


# ---- ranks and tests -------------------------------------------------------------------------------

def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, value, rank, ties: the mean rank of every distinct value."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    c = cumulative(c, value, {"_cum": F.col("ties")}, keys)
    return c.select(*keys, value, (F.col("_cum") - (F.col("ties") - 1) / 2).alias("rank"), "ties")


def with_mean_rank(df: DataFrame, value: str, name: str, keys: Sequence[str] = (), fits: bool | None = None) -> DataFrame:
    if fits if fits is not None else fits_in_task(df, keys):
        w = W.partitionBy(*(keys or [F.lit(0)]))
        ties = F.count("*").over(W.partitionBy(*keys, value))
        return df.filter(F.col(value).isNotNull()).withColumn(name, F.rank().over(w.orderBy(value)) + (ties - 1) / 2)
    ranks = value_ranks(df, value, keys).withColumnRenamed("rank", name).drop("ties")
    return null_safe_join(df.filter(F.col(value).isNotNull()), ranks, [*keys, value], "inner")


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, spearman, rows; NULL where one column has a single value in groups beyond a task.

    Such groups are summed up per value of b, so rows meet the ranks of a only; a with few values is the cheaper way round.
    """
    keys = list(keys)
    both = df.select(*keys, a, b).dropna(subset=[a, b])
    if fits_in_task(both, keys):
        ranked = with_mean_rank(with_mean_rank(both, a, "_ra", keys, True), b, "_rb", keys, True)
        return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("rows"))
    both = df.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).dropna(subset=["_a", "_b"])
    counts = materialise(both.groupBy(*keys, "_a").agg(F.count("*").alias("_n")))
    size = counts.groupBy(*keys).agg(F.sum("_n").alias("_rows"))

    def centred(values: DataFrame, value: str) -> DataFrame:
        """The mean rank of every value, less that of its group, as `_r`."""
        ranked = null_safe_join(cumulative(values, value, {"_cum": F.col("_n")}, keys), size, keys)
        return ranked.withColumn("_r", F.col("_cum") - (F.col("_n") - 1) / 2 - (F.col("_rows") + 1) / 2).drop("_cum", "_rows")

    at_a = centred(counts, "_a")
    ranks = at_a.select(*keys, "_a", "_r")
    few = counts.limit(FEW + 1).count() <= FEW
    met = null_safe_join(both, F.broadcast(ranks) if few else ranks, [*keys, "_a"], "inner")
    at_b = centred(materialise(met.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.sum("_r").alias("_s"))), "_b")
    spread_a = at_a.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_r") * F.col("_r")).alias("_va"))
    sums = at_b.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_r")).alias("_ab"), F.sum(F.col("_n") * F.col("_r") * F.col("_r")).alias("_vb"), F.sum("_n").alias("rows"))
    out = null_safe_join(sums, spread_a, keys)
    return out.select(*keys, (F.col("_ab") / F.nullif(F.sqrt("_va") * F.sqrt("_vb"), F.lit(0.0))).alias("spearman"), "rows")


def correlations_with(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """column, r, best: Pearson correlation of each column with a target, in one pass."""
    rs = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.corr(c, target).alias("r")) for c in columns]).alias("c")).select(F.inline("c"))
    top = rs.select(F.max_by("column", F.abs("r"))).scalar()
    return rs.withColumn("best", F.col("column") == top)


def mann_whitney(df: DataFrame, group: Column, value: str) -> DataFrame:
    """U of the rows where `group` holds, z with tie correction, and the one-sided p that they are lower."""
    c = df.filter(F.col(value).isNotNull() & group.isNotNull()).groupBy(F.col(value).alias("s")).agg(
        count_where(group).cast("double").alias("a"), count_where(~group).cast("double").alias("b"))
    c = cumulative(c, "s", {"_below": F.col("b")})
    t = F.col("a") + F.col("b")
    g = c.agg(F.sum(F.col("a") * (F.col("_below") - F.col("b") / 2)).alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n2"),
              F.sum(t * t * t - t).alias("_ties"))
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("_ties") / (n * (n - 1)))
    z = (F.col("u") - F.col("n1") * F.col("n2") / 2 + 0.5) / F.sqrt(var)
    return g.select("u", "n1", "n2", z.alias("z"), normal_tail(-z).alias("p_lower"))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """Signed-rank sums of non-zero differences."""
    d = df.filter(F.col(difference) != 0).select(F.abs(difference).alias("_a"), (F.col(difference) > 0).alias("_up"))
    c = d.groupBy("_a").agg(F.count("*").alias("_t"), F.count_if("_up").alias("_p"))
    c = cumulative(c, "_a", {"_cum": F.col("_t")}).withColumn("_r", F.col("_cum") - (F.col("_t") - 1) / 2)
    return c.agg(F.sum(F.col("_r") * F.col("_p")).alias("w_plus"), F.sum(F.col("_r") * (F.col("_t") - F.col("_p"))).alias("w_minus"),
                 F.sum("_t").alias("pairs"))


def kolmogorov_smirnov(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest gap of two empirical distributions."""
    u = a.select(F.col(value).alias("s"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).unionByName(
        b.select(F.col(value).alias("s"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b")))
    c = cumulative(u.groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "s", {"ca": F.col("a"), "cb": F.col("b")})
    n = scalar_of(u, a=F.sum("a"), b=F.sum("b"))
    return c.agg(F.max(F.abs(F.col("ca") / n["a"] - F.col("cb") / n["b"])).alias("ks"))


def holm(df: DataFrame, p: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values: running maximum of (m - i) p, at most 1.  For report-sized families of tests."""
    w = W.partitionBy(*(keys or [F.lit(0)]))
    order = w.orderBy(p, name)
    step = F.least(F.lit(1.0), (F.count("*").over(w) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def group_rates(df: DataFrame, group: str, hit: Column) -> DataFrame:
    g = df.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(hit).alias("hits"))
    rate, lo, hi = wilson("hits", "rows")
    return g.select(group, "rows", "hits", rate.alias("rate"), lo.alias("low"), hi.alias("high"))


def exclusive_flags(flags: Sequence[str]) -> Column:
    """'<flag> only', 'two or more' or 'none'."""
    n = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    expr = F.when(n >= 2, "two or more").when(n == 0, "none")
    for f in flags:
        expr = expr.when(F.col(f), F.lit(f"{f} only"))
    return expr


def band_of(value: str | Column, edges: Sequence[float]) -> Column:
    """Left-closed band number: edges[i] <= value < edges[i + 1]."""
    v = F.col(value) if isinstance(value, str) else value
    expr = F
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        expr = expr.when((v >= a) & (v < b), F.lit(i))
    return expr


def selective_prediction(df: DataFrame, wrong: Column, spread: str, row: str, shares: Sequence[float]) -> DataFrame:
    """coverage, kept, error rate after keeping the most certain rows."""
    ranked = cumulative(df.withColumn("_w", wrong.cast("int")), spread, {"_rn": F.lit(1).cast("bigint"), "_err": F.col("_w")}, tie=row)
    n = scalar_of(df, n=F.count("*"))["n"]
    picks = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    return ranked.select("_rn", "_err", picks.alias("coverage"), n.alias("_n")).filter(
        F.col("_rn") == F.bround(F.col("coverage") * F.col("_n")).cast("bigint")).select(
        "coverage", F.col("_rn").alias("kept"), (F.col("_err") / F.col("_rn")).alias("error_rate"))


def selective_auc(df: DataFrame, y: str, score: str, wrong: Column, spread: str, row: str, shares: Sequence[float]) -> DataFrame:
    """coverage, auc of the rows kept, and error_auc: how well the spread ranks errors above right answers."""
    ranked = cumulative(df.withColumn("_w", wrong.cast("int")), spread, {"_rn": F.lit(1).cast("bigint")}, tie=row)
    n = scalar_of(df, n=F.count("*"))["n"]
    picks = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    kept = ranked.select(y, score, "_rn", picks.alias("coverage"), n.alias("_n")).filter(F.col("_rn") <= F.bround(F.col("coverage") * F.col("_n")).cast("bigint"))
    of_errors = roc_auc(df.withColumn("_w", wrong.cast("int")), "_w", spread).select("auc").scalar()
    return roc_auc(kept, y, score, ["coverage"]).select("coverage", "auc", of_errors.alias("error_auc"))


def top_k_overlap(df: DataFrame, a: str, b: str, key: str, k: int) -> DataFrame:
    """How many of the k best by a are also among the k best by b."""
    best = lambda c: df.orderBy(F.col(c).desc(), F.col(key).asc()).limit(k).select(key)
    return best(a).intersect(best(b)).agg(F.count("*").alias("shared"))
