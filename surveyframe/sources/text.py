"""Line-oriented tables: comment-aware catalogues, column-headed archive spectra, fixed-width and numeric text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions.basics import CheckFailed, no_nan, require_empty
from surveyframe.operators.scale import fits_in_task, materialise, neighbour, quantiles, salted_join, small_join


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Catalogue CSVs with a pinned schema; '#' starts a comment only in files that open with one."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).alias("at"),
        F.ltrim("value").startswith("#").alias("comment"))
    opens = {r["file"]: r["comment"] for r in lines.groupBy("file").agg(F.min_by("comment", "at").alias("comment")).collect()}    # one short row per file
    out = None
    for comment in (False, True):
        files = sorted(f for f, c in opens.items() if c == comment)
        if files or (comment is False and not opens):
            reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            part = (reader.option("comment", "#") if comment else reader).csv(files or path)
            out = part if out is None else out.unionByName(part)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq, line: `(block, seq)` orders the lines of a file however the file was cut into tasks."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def _in_order(c: str) -> Column:
    """Values of a column as an array in file order (for the few header lines of a file only)."""
    rows = F.array_sort(F.collect_list(F.struct("block", "seq", c)))
    return F.transform(rows, lambda r: r[c])


def _once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Columns made once a row: those of a generator are not folded into whatever reads them, nor filtered before it."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def ipac_points(spectra: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split the lines of column-headed files into (values per row, units per file)."""
    header = spectra.filter(F.col("line").startswith("|"))
    heads = header.groupBy("file").agg(_in_order("line").alias("h"))
    cells = F.split(F.expr("substring(h[0], 2, length(h[0]) - 2)"), "\\|", -1)
    starts = F.aggregate(cells, F.array(F.lit(2)),
                         lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(c) + 1)))
    heads = heads.select("file", F.transform(cells, lambda c: F.trim(c)).alias("names"), starts.alias("starts"),
                         F.transform(F.split(F.expr("substring(h[2], 2, length(h[2]) - 2)"), "\\|", -1), lambda c: F.trim(c)).alias("units"))
    body = spectra.filter(~F.col("line").startswith("\\") & ~F.col("line").startswith("|") & (F.trim("line") != ""))
    heads = materialise(heads)
    at = lambda name: F.array_position("names", name).cast("int")
    places = [F.struct(F.get("starts", at(n) - 1).alias("from"), (F.get("starts", at(n)) - F.get("starts", at(n) - 1)).alias("len")).alias(f"_{n}") for n in names]
    joined = small_join(body, heads.select("file", *[F.when(at(n) > 0, p).alias(f"_{n}") for n, p in zip(names, places)]), ["file"])
    key = ["file", "block", "seq"]
    texts = _once(joined, key, {n: F.trim(F.col("line").substr(F.col(f"_{n}.from"), F.col(f"_{n}.len"))) for n in names})
    numbers = _once(texts, key, {n: F.when(F.col(n) != "", F.col(n).try_cast("double")) for n in names})     # an empty cell is told from its length, not by a failed cast
    rows = numbers.select(*key, *[no_nan(n).alias(n) for n in names])
    units = heads.select("file", *[F.get("units", F.array_position("names", n).cast("int") - 1).alias(n) for n in names])
    return rows, units


IPAC_COLUMNS = ["CENTRALWAVELNG", "PL_TRANDEP", "PL_TRANDEPERR1", "PL_TRANDEPERR2",
                "PL_RATROR", "PL_RATRORERR1", "PL_RATRORERR2"]


def artefact_kind(x: str | Column, y: str | Column, e1: str | Column, e2: str | Column) -> Column:
    """'all null', 'all zero', 'partial' or NULL for a usable row."""
    x, y, e1, e2 = (F.col(c) if isinstance(c, str) else c for c in (x, y, e1, e2))
    zero = lambda c, missing: F.coalesce(c, F.lit(missing)) == 0
    return (F.when(x.isNull() & y.isNull(), "all null")
            .when(zero(x, 1.0) & zero(y, 1.0) & zero(e1, 0.0) & zero(e2, 0.0), "all zero")
            .when(x.isNull() | y.isNull(), "partial"))


def read_archive_spectra(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return archive_spectra(read_lines(spark, path))


def archive_spectra(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points: file, wl, depth_ppm, err_ppm; report per file) from column-headed archive tables.

    Depth in percent; files with only a radius ratio r get 100 r^2 and errors 200 r |dr|.
    """
    rows, units = ipac_points(lines, IPAC_COLUMNS)
    has_depth = materialise(rows.groupBy("file").agg(F.bool_or(F.col("PL_TRANDEP").isNotNull()).alias("has_depth"),
                                                     F.bool_or(F.col("PL_RATROR").isNotNull()).alias("has_ratio")))
    bad = has_depth.join(units, "file").filter(
        ~F.coalesce(F.col("CENTRALWAVELNG").contains("micron"), F.lit(False))
        | (F.col("has_depth") & ~F.coalesce(F.trim("PL_TRANDEP").isin("%", "percent"), F.lit(False)))
        | (~F.col("has_depth") & ~F.col("has_ratio")))
    require_empty(bad.select("file", "CENTRALWAVELNG", "PL_TRANDEP"), "unexpected units or no depth column")
    r = F.col("PL_RATROR")
    pick = lambda own, other: F.when(F.col("has_depth"), F.col(own)).otherwise(other)
    rows = small_join(rows, has_depth, ["file"]).select(
        "file", F.col("CENTRALWAVELNG").alias("wl"), pick("PL_TRANDEP", 100 * r * r).alias("depth"),
        F.abs(pick("PL_TRANDEPERR1", 200 * r * F.abs("PL_RATRORERR1"))).alias("e1"),
        F.abs(pick("PL_TRANDEPERR2", 200 * r * F.abs("PL_RATRORERR2"))).alias("e2"), "has_depth")
    rows = rows.withColumn("artefact", artefact_kind("wl", "depth", "e1", "e2"))
    err = F.when(F.col("e1").isNotNull() & F.col("e2").isNotNull(), (F.col("e1") + F.col("e2")) / 2).otherwise(
        F.coalesce("e1", "e2"))
    points = rows.filter(F.col("artefact").isNull()).select(
        "file", "wl", (F.col("depth") * 1e4).alias("depth_ppm"), (err * 1e4).alias("err_ppm"))
    report = rows.groupBy("file").agg(
        F.count("*").alias("rows_raw"), F.count_if(F.col("artefact") == "all null").alias("all_null"),
        F.count_if(F.col("artefact") == "all zero").alias("all_zero"),
        F.count_if(F.col("artefact") == "partial").alias("partial"),
        F.count_if(F.col("artefact").isNull()).alias("rows_kept"), F.bool_and("has_depth").alias("own_depth"))
    return points, report


def read_fixed_width(spark: SparkSession, path: str, layout: list[tuple[int, int, str, str]]) -> DataFrame:
    return fixed_width(read_lines(spark, path), layout)


def fixed_width(lines: DataFrame, layout: list[tuple[int, int, str, str]]) -> DataFrame:
    """Rows after the last dashed line of each file; layout is (start, end, name, type) with 0-based ends."""
    rule = lines.filter(F.col("line").startswith("-----")).groupBy("file").agg(
        F.max(F.struct("block", "seq")).alias("rule"))
    body = salted_join(lines, rule, ["file"]).filter(
        (F.struct("block", "seq") > F.col("rule")) & (F.trim("line") != ""))
    text = lambda a, b: F.trim(F.substring("line", a + 1, b - a))
    return body.select("file", *[(text(a, b) if t == "string" else text(a, b).try_cast(t)).alias(n)
                                 for a, b, n, t in layout])


def read_numeric_spectra(spark: SparkSession, path: str, catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, report per file) from four-column numeric text.

    A file's second column is a bin end when its median exceeds 0.5 and it is above the first column on
    every row, otherwise a half width.  Missing half widths come from the neighbours.  `catalogue` has
    (file, depth_percent) and is used to tell ppm, percent and fraction apart.
    """
    lines = read_lines(spark, path).withColumn("line", F.trim("line")).filter(F.col("line") != "")
    comments = lines.filter(F.col("line").startswith("#")).groupBy("file").agg(
        F.count("*").alias("comment_lines"), F.bool_or(F.lower("line").contains("ppm")).alias("says_ppm"),
        F.bool_or(F.lower("line").rlike("%|percent")).alias("says_percent"))
    data = lines.filter(~F.col("line").startswith("#")).withColumn("c", F.split("line", "\\s+"))
    require_empty(data.filter(F.size("c") != 4).select("file", "line"), "expected four numeric columns")
    v = lambda i: F.col("c")[i].cast("double")
    data = data.select("file", "block", "seq", v(0).alias("c0"), v(1).alias("c1"), v(2).alias("depth_ppm"), v(3).alias("err_ppm"))
    layout = quantiles(data, ["file"], {"m1": ("c1", 0.5)}).join(
        data.groupBy("file").agg(F.bool_and(F.col("c1") > F.col("c0")).alias("above"), F.count("*").alias("rows")), "file")
    layout = layout.select("file", "rows", ((F.col("m1") > 0.5) & F.col("above")).alias("edges"))
    data = salted_join(data, layout, ["file"]).select(
        "file", "block", "seq", "depth_ppm", "err_ppm", "edges",
        F.when(F.col("edges"), (F.col("c0") + F.col("c1")) / 2).otherwise(F.col("c0")).alias("wl"),
        F.when(F.col("edges"), (F.col("c1") - F.col("c0")) / 2).otherwise(F.col("c1")).alias("hw"), "c0")
    data = with_half_widths(data, "wl", ["file"], tie="seq")
    derived = ~F.coalesce(F.col("hw") > 0, F.lit(False))
    data = data.withColumn("half_width_um", F.when(derived, F.col("spacing_hw")).otherwise(F.col("hw"))).withColumn(
        "half_width_derived", derived)
    good = (F.col("err_ppm") > 0) & ~F.isnan("err_ppm") & F.col("wl").isNotNull() & F.col("depth_ppm").isNotNull()
    points = data.filter(good).select("file", "wl", "depth_ppm", "err_ppm", "half_width_um", "half_width_derived")
    report = data.groupBy("file").agg(
        F.count("*").alias("rows"), F.bool_or("edges").alias("edges"), F.count_if(derived).alias("half_width_zero_rows"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"))
    report = report.join(comments, "file", "left").withColumn(
        "declared_units", F.when(F.col("says_ppm"), "ppm").when(F.col("says_percent"), "%").otherwise("not stated")).drop(
        "says_ppm", "says_percent")
    restarts = neighbour(data.withColumn("pos", F.col("block") * F.lit(1e6) + F.col("seq")), "pos", {"before": "c0"}, ["file"])
    report = report.join(restarts.groupBy("file").agg(F.count_if(F.col("c0") < F.col("before")).alias("restarts")), "file")
    if catalogue is not None:
        depth = quantiles(points, ["file"], {"median_depth": ("depth_ppm", 0.5)})
        ratio = F.col("median_depth") / (F.col("depth_percent") * 1e4)
        report = report.join(depth, "file").join(catalogue, "file", "left").withColumn(
            "numeric_units", F.when(ratio.between(0.3, 3), "ppm").when(ratio.between(0.3e-4, 3e-4), "%")
            .when(ratio.between(0.3e-6, 3e-6), "fraction").otherwise("UNRESOLVED")).drop("median_depth", "depth_percent")
    return points, report


def with_half_widths(df: DataFrame, x: str, keys: list[str], tie: str | None = None) -> DataFrame:
    """Half the mean distance to both neighbours (`spacing_hw`); the smaller gap is `smaller_gap`.  Zero gaps count as none."""
    fits = fits_in_task(df, keys)
    both = neighbour(df, x, {"_before": x}, keys, tie, fits=fits)
    both = neighbour(both, x, {"_after": x}, keys, tie, forward=True, fits=fits)
    left, right = (F.nullif(g, F.lit(0.0)) for g in (F.col(x) - F.col("_before"), F.col("_after") - F.col(x)))
    mean = F.when(left.isNotNull() & right.isNotNull(), (left + right) / 2).otherwise(F.coalesce(left, right))
    return both.withColumn("spacing_hw", mean / 2).withColumn("smaller_gap", F.least(left, right)).drop("_before", "_after")


UNIT_FACTOR = {"ppm": 1.0, "percent": 1e4, "fraction": 1e6}  # fixed values: factor to ppm


def read_point_table(spark: SparkSession, path: str, columns: tuple[int, int, int] = (0, 1, 2), unit: str = "ppm",
                     delimiter: str = "\\s+") -> DataFrame:
    return point_table(read_lines(spark, path), columns, unit, delimiter)


def point_table(lines: DataFrame, columns: tuple[int, int, int] = (0, 1, 2), unit: str = "ppm", delimiter: str = "\\s+") -> DataFrame:
    """wl, depth_ppm, err_ppm of one or several parts, from chosen column positions; parts stack by wavelength."""
    if unit not in UNIT_FACTOR:
        raise CheckFailed(f"unknown unit {unit}")
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter(F.col("line") != "")
    cells = F.split("line", delimiter)
    value = lambda i: cells[columns[i]].cast("double")
    f = UNIT_FACTOR[unit]
    return lines.select("file", value(0).alias("wl"), (value(1) * f).alias("depth_ppm"), (value(2) * f).alias("err_ppm"))


def parse_json_records(df: DataFrame, column: str, schema: str, required: str) -> DataFrame:
    """JSON text to columns; blank, truncated and non-object lines give NULL and are left out."""
    parsed = df.withColumn("_j", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col(f"_j.{required}").isNotNull()).select("*", "_j.*").drop("_j")


def read_run_log(spark: SparkSession, path: str, schema: str, required: str = "object_id") -> DataFrame:
    lines = spark.read.text(path)
    return parse_json_records(lines, "value", schema, required).drop("value")
