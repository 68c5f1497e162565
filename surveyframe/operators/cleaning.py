"""Filters, labels, keys, ordered deduplication, set algebra, sampling and sinks for catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.basics import CheckFailed, count_where, require_empty, uniform
from surveyframe.operators.scale import cumulative, medians, neighbour, quantiles, salted_join, scalar_of, top_rows


# ---- filters and labels ----------------------------------------------------------------------------

def filter_counts(df: DataFrame, config: dict) -> DataFrame:
    """How many rows remain after each {column: value} condition, in order."""
    keep, steps = F.lit(True), [F.struct(F.lit(0).alias("step"), F.lit("all").alias("condition"), F.lit(True).alias("kept"))]
    for i, (c, v) in enumerate(config.items(), 1):
        keep = keep & F.coalesce(F.col(c) == F.lit(v), F.lit(False))
        steps.append(F.struct(F.lit(i).alias("step"), F.lit(f"{c} = {v}").alias("condition"), keep.alias("kept")))
    return (df.select(F.inline(F.array(*steps))).groupBy("step", "condition")
            .agg(F.count_if("kept").alias("rows")))


def apply_row_filter(df: DataFrame, config: dict) -> DataFrame:
    for c, v in config.items():
        df = df.filter(F.col(c) == F.lit(v))
    return df


def harmonize_labels(df: DataFrame, column: str, mapping: dict[str, str], check: bool = True) -> DataFrame:
    """Add `label_harmonized`; NULL stays NULL, any other unmapped code raises."""
    if check:
        unknown = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(mapping))).select(column).distinct()
        require_empty(unknown, f"unmapped values in {column}")
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn("label_harmonized", F.try_element_at(F.create_map(*pairs), F.col(column)))


def mapping_table(df: DataFrame, old: str, new: str = "label_harmonized") -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("<blank>"))
    return df.groupBy(blank(old).alias("old_value"), blank(new).alias("new_value")).agg(F.count("*").alias("rows"))


def add_group_key(df: DataFrame, column: str, fallback: str | None = None, name: str = "star_group_id",
                  check: bool = True) -> DataFrame:
    """String group key, with `fallback:value` where the first column is NULL; NULL keys raise."""
    key = F.col(column).cast("string")
    if fallback:
        key = F.coalesce(key, F.concat(F.lit(f"{fallback}:"), F.col(fallback).cast("string")))
    out = df.withColumn(name, key)
    if check:
        require_empty(out.filter(F.col(name).isNull()), f"rows without a key in {column}")
    return out


def hashed_group_key(text_parts: Sequence[Column], prefix: str = "star_", digits: int = 40) -> Column:
    """Key of a parameter set: parts joined by '|', SHA-1 in hex.  Fewer digits can merge unrelated sets."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *text_parts)), 1, digits))


def three_valued_rule(conditions: dict[str, Column], inputs: Sequence[Column]) -> Column:
    """1 when every condition holds, 0 when one fails, NULL when any input is blank."""
    blank, ok = F.lit(False), F.lit(True)
    for c in inputs:
        blank = blank | c.isNull()
    for c in conditions.values():
        ok = ok & c
    return F.when(~blank, ok.cast("tinyint"))


def exclusions_lookup(df: DataFrame, key: str, lists: dict[str, DataFrame]) -> DataFrame:
    """Category, reason and note of curated exclusions; a key on two lists is an error."""
    merged = None
    for category, entries in lists.items():
        part = entries.select(key, F.lit(category).alias("category"), "reason", "note")
        merged = part if merged is None else merged.unionByName(part)
    require_empty(merged.groupBy(key).count().filter("count > 1"), "keys on two exclusion lists")
    return salted_join(df, merged, [key], "left")


def classify_failure(stage: str | Column, message: str | Column, kind: str | Column) -> Column:
    """Failure category from the stage, the error kind and its text."""
    s, m, k = (F.col(c) if isinstance(c, str) else c for c in (stage, message, kind))
    return (F.when(k == "NotImplementedError", "unsupported mission")
            .when(s == "fetch", F.when(k == "LookupError", "api: no light curve found").otherwise("api fetch failure"))
            .when((k == "ValueError") & m.rlike("invalid (period|epoch|duration)"), "missing/invalid ephemeris")
            .when(s == "flatten", F.when(m.contains("usable cadences"), "insufficient data after masking")
                  .otherwise(F.concat(F.lit("flatten failure ("), k, F.lit(")"))))
            .otherwise(F.concat(F.lit("other ("), k, F.lit(")"))))


def error_bucket(snr: str, noise: str, noisy_cut: Column, detection: float = 7.1) -> Column:
    return (F.when(F.col(snr).isNull(), "unknown").when(F.col(snr) < detection, "below detection")
            .when(F.col(noise) > noisy_cut, "noise-dominated").otherwise("genuine miss"))


MODE_RULES = "MIRI_LRS NIRISS_SOSS NIRSpec_PRISM NIRSpec_G395".split()  # fixed values: instrument modes


def infer_mode(instrument: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """Instrument mode from its name and the wavelength range covered."""
    i, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (instrument, lo, hi))
    return (F.when(i.contains("MIRI"), F.when(hi > 9, MODE_RULES[0]))
            .when(i.contains("NIRISS"), MODE_RULES[1])
            .when(i.contains("NIRSpec"), F.when((lo < 1.2) & (hi > 4.5), MODE_RULES[2])
                  .when((lo > 2.5) & (hi > 4.5), MODE_RULES[3])))


def match_by_suffix(rows: DataFrame, files: DataFrame, base: str, file: str, check: bool = True) -> DataFrame:
    """Match each row's base name to the one file that equals it or ends in '_' + base.

    Every '_'-delimited suffix of a file name becomes a key, so this is an equi-join.
    """
    parts = F.split(file, "_")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    keyed = files.select(file, F.explode(suffixes).alias(base))
    hits = rows.join(keyed, base, "left").groupBy(*rows.columns).agg(
        F.count(file).alias("n_matches"), F.min(file).alias(file))
    if check:
        require_empty(hits.filter("n_matches <> 1"), "rows without exactly one file")
    return hits


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, n_null, n_distinct, mean, sd, min, max, skew (bias-corrected) in one pass per table."""
    stats = []
    for c in columns:
        n = F.count(c)
        skew = F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2)
        stats.append(F.struct(F.lit(c).alias("column"), n.alias("n"), (F.count("*") - n).alias("n_null"),
                              F.count_distinct(c).alias("n_distinct"), F.avg(c).cast("double").alias("mean"),
                              F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("min"),
                              F.max(c).cast("double").alias("max"), skew.alias("skew")))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def select_features(df: DataFrame, train: Column, verdict_pattern: str, leaky: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """column, constant, reason: verdict-like names, reviewed leaks, ids, text and columns constant in train are left out.

    A column is constant when its smallest and largest value agree, so no distinct count is needed.
    """
    types = dict(df.dtypes)
    flat = df.filter(train).agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in df.columns])
    entries = []
    for c in df.columns:
        numeric = types[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")
        reason = (F.when(F.lit(c).rlike(verdict_pattern), "verdict column").when(F.lit(c in leaky), "review list")
                  .when(F.lit(c in ids), "identifier").when(F.lit(not numeric), "not numeric")
                  .when(F.col(c), "constant in train").otherwise("used"))
        entries.append(F.struct(F.lit(c).alias("column"), F.col(c).alias("constant"), reason.alias("reason")))
    return flat.select(F.inline(F.array(*entries)))


def scan_columns(tables: dict[str, DataFrame], pattern: str) -> list[tuple[str, str]]:
    import re

    return [(t, c) for t, df in tables.items() for c in df.columns if re.search(pattern, c)]


def sum_check(columns: Sequence[str], tolerance: float, target: float = 1.0) -> Column:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return F.abs(total - target) > tolerance


# ---- ordered deduplication -------------------------------------------------------------------------

def filled_count(columns: Sequence[str]) -> Column:
    return sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))


def ordered_dedup(df: DataFrame, key: str, core: Column, year: Column, filled: Column, row: str) -> DataFrame:
    """One row per key: complete core, newest year (missing loses), most filled fields, earliest row."""
    return top_rows(df, [key], [core.desc(), F.coalesce(year, F.lit(-1)).desc(), filled.desc(), F.col(row).asc()])


TIE_STAGES = ["core", "year", "filled", "row"]


def tie_break_report(df: DataFrame, key: str, core: Column, year: Column, filled: Column) -> DataFrame:
    """How many multi-row keys each tie-break stage decides; counts per ranking value, never rows, are grouped."""
    ranked = df.groupBy(key, core.cast("int").alias("core"), F.coalesce(year, F.lit(-1)).alias("year"),
                        filled.alias("filled")).agg(F.count("*").alias("n"))
    best = ranked.groupBy(key).agg(F.max(F.struct("core", "year", "filled")).alias("b"), F.sum("n").alias("rows"))
    j = ranked.join(best.filter("rows > 1"), key)
    same1 = F.col("core") == F.col("b.core")
    same2 = same1 & (F.col("year") == F.col("b.year"))
    same3 = same2 & (F.col("filled") == F.col("b.filled"))
    left = j.groupBy(key).agg(*[F.sum(F.when(s, F.col("n")).otherwise(0)).alias(f"s{i}") for i, s in enumerate((same1, same2, same3))])
    stage = F.when(F.col("s0") == 1, 0).when(F.col("s1") == 1, 1).when(F.col("s2") == 1, 2).otherwise(3)
    flags = [F.struct(F.lit(n).alias("stage"), F.count_if(stage == i).alias("keys_decided")) for i, n in enumerate(TIE_STAGES)]
    return left.agg(F.array(*flags).alias("f")).select(F.inline("f"))


def latest_record(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last record per key as a hash aggregate with a one-row state."""
    pick = F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    return df.groupBy(key).agg(pick).select(key, "r.*")


def first_value_set(df: DataFrame, key: str, value: str, default: Column, updated: str, row: str) -> DataFrame:
    """The default set's value if present, else the most recently updated other set's, and where it came from."""
    got = df.filter(F.col(value).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(F.col(value).alias("v"), default.cast("int").alias("d")),
                 F.struct(default.cast("int"), F.col(updated), -F.col(row))).alias("r"))
    return got.select(key, F.col("r.v").alias(value),
                      F.when(F.col("r.d") == 1, "catalogue").otherwise("other set").alias(f"{value}_source"))


def later_overrides(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources in which the last source naming a key wins."""
    merged = None
    for i, s in enumerate(sources):
        part = s.withColumn("_src", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    rest = [c for c in merged.columns if c not in (key, "_src")]
    return merged.groupBy(key).agg(F.max_by(F.struct(*rest, F.col("_src").alias("source_no")), F.col("_src")).alias("r")).select(key, "r.*")


# ---- set algebra -----------------------------------------------------------------------------------

def both_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one set only, with the side, from one shuffle of presence flags."""
    flags = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = flags.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return seen.filter("a <> b").select(key, F.when(F.col("a") == 1, "only left").otherwise("only right").alias("side"))


def membership_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    flags = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = flags.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return seen.agg(count_where((F.col("a") == 1) & (F.col("b") == 1)).alias("in_both"),
                    count_where(F.col("b") == 0).alias("only_left"), count_where(F.col("a") == 0).alias("only_right"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def singles_and_combinations(df: DataFrame, member: str, group: Sequence[str]) -> DataFrame:
    """Every member alone, and again inside a combined input per group with at least two members."""
    members = df.select(*group, member).distinct()
    sizes = members.groupBy(*group).agg(F.count("*").alias("n")).filter("n >= 2")
    alone = members.select(*group, member, F.lit("single").alias("input"), F.lit(1).cast("bigint").alias("members"))
    combined = salted_join(members, sizes, list(group)).select(*group, member, F.lit("combined").alias("input"), F.col("n").alias("members"))
    return alone.unionByName(combined)


def merge_exclusions(old: DataFrame, previous_auto: DataFrame, auto: DataFrame, key: str) -> DataFrame:
    """Merge a derived exclusion list into a kept one.

    old(key, reason), previous_auto(key), auto(key, reason).  Manual entries stay manual, derived ones are
    replaced, and a reason already given is never overwritten.
    """
    o = old.select(key, F.col("reason").alias("old_reason"), F.lit(True).alias("was"))
    p = previous_auto.select(key, F.lit(True).alias("prev"))
    a = auto.select(key, F.col("reason").alias("auto_reason"), F.lit(True).alias("now"))
    m = o.join(p, key, "full_outer").join(a, key, "full_outer")
    manual = F.coalesce(F.col("was"), F.lit(False)) & ~F.coalesce(F.col("prev"), F.lit(False))
    now = F.coalesce(F.col("now"), F.lit(False))
    return m.filter(manual | now).select(key, F.when(manual, "manual").otherwise("derived").alias("kind"),
                                         F.coalesce("old_reason", "auto_reason").alias("reason"))


# ---- plans, sinks and samples ----------------------------------------------------------------------

def build_plan(wanted: DataFrame, finished: DataFrame, failed: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """key, action: skip finished, retry failed, never process excluded, process the rest (a dry run's answer)."""
    flag = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(True))
    j = (wanted.select(key).join(flag(excluded, "x"), key, "left").join(flag(finished, "d"), key, "left")
         .join(flag(failed, "f"), key, "left"))
    return j.select(key, F.when(F.col("x"), "excluded").when(F.col("d"), "skip").when(F.col("f"), "retry")
                    .otherwise("process").alias("action"))


def rebuild_index(wanted: DataFrame, log: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    last = latest_record(log, key, order, [status])
    return wanted.select(key).join(last, key, "left").withColumn(status, F.coalesce(status, F.lit("not processed")))


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    """Write a table partitioned by split; a row without a split is an error."""
    require_empty(df.filter(F.col(column).isNull()), "rows without a split")
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def relayout(rows: DataFrame, split: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their new split, coverage per split); a source id met twice is an error."""
    require_empty(duplicates(rows, [key]), "source ids met twice")
    placed = rows.join(split, key)
    have = rows.select(key, F.lit(1).alias("have"))
    coverage = split.join(have, key, "left").groupBy("split").agg(
        F.count("*").alias("wanted"), F.count("have").alias("found"))
    return placed, coverage


def refresh_selection(current: DataFrame, snapshot: DataFrame, key: str, name: str) -> DataFrame:
    """Rows new since a snapshot, with a file-safe name."""
    return current.join(snapshot.select(key), key, "left_anti").withColumn("safe_name", safe_name(name))


def safe_name(c: str | Column, keep: str = "A-Za-z0-9.") -> Column:
    return F.regexp_replace(c, f"[^{keep}]+", "_")


def retirable(df: DataFrame, key: str, final: Column) -> DataFrame:
    return df.groupBy(key).agg(F.bool_and(final).alias("safe"), F.count_if(~final).alias("open_records"))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows per stratum in a fixed hashed order."""
    draw = uniform(key, seed)
    return top_rows(df, list(strata), [draw.asc(), F.col(key).asc()], n)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.withColumn("draw", uniform(key, seed)).orderBy("draw", key).limit(n)


def quota_sample(df: DataFrame, group: str, key: str, share: float, seed: int) -> DataFrame:
    """The first floor(share * size) rows of every group in hashed order."""
    quota = df.groupBy(group).agg(F.floor(F.count("*") * F.lit(share)).cast("bigint").alias("quota"))
    ranked = cumulative(df.withColumn("draw", uniform(key, seed)), "draw", {"rn": F.lit(1)}, [group], tie=key)
    return ranked.join(F.broadcast(quota) if _few(quota) else quota, group).filter("rn <= quota").drop("quota", "draw")


def _few(df: DataFrame, limit: int = 100000) -> bool:
    """Whether a small table really is small enough to broadcast."""
    return df.limit(limit + 1).count() <= limit


def round_robin(df: DataFrame, classes: str, survey: str, coverage: Column, key: str, n: int) -> DataFrame:
    """n picks per class, taking the best of each survey before any survey's second."""
    from pyspark.sql import Window as W

    best = top_rows(df, [classes, survey], [coverage.desc(), F.col(key).asc()], n)
    w = W.partitionBy(classes, survey).orderBy(coverage.desc(), F.col(key).asc())
    turn = best.withColumn("turn", F.row_number().over(w))
    pick = W.partitionBy(classes).orderBy("turn", survey)
    return turn.withColumn("pick", F.row_number().over(pick).cast("bigint")).filter(F.col("pick") <= n)
