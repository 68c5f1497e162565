"""Spectra in long form: calibration points, binned means, band statistics, comparison of grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surveyframe.operators.scale import attach_row, cumulative, fits_in_task, medians, salted_join


def calibration_points(points: DataFrame, hosts: DataFrame, host: str, spectrum: Sequence[str], in_range: Column,
                       at_least: int = 5) -> DataFrame:
    """Points of known hosts inside the mode's range, for spectra with enough of them (counted, then joined back)."""
    rows = salted_join(points.filter(in_range), hosts, [host])
    enough = rows.groupBy(*spectrum).agg(F.count("*").alias("_n")).filter(F.col("_n") >= at_least).drop("_n")
    return salted_join(rows, enough, list(spectrum), "left_semi")


# Absorption bands (microns), grid of binned spectra, least bins and points per band.
BANDS = {
    "H2O": [(1.30, 1.50), (1.80, 2.00), (2.60, 3.00)],
    "CH4": [(2.20, 2.40), (3.20, 3.45)],
    "CO2": [(1.95, 2.10), (4.20, 4.45)],
    "SO2": [(3.95, 4.15)],
    "CO": [(4.50, 4.90)],
}
GRID_MIN, GRID_MAX, N_BINS = 1.0, 5.0, 100
MIN_BAND_BINS, MIN_POINTS, CONT_WINDOW = 3, 3, 0.5


# ---- binning ---------------------------------------------------------------------------------------

def resample(points: DataFrame, keys: Sequence[str], wl: str, depth: str, err: str, lo: float = GRID_MIN, hi: float = GRID_MAX,
             n: int = N_BINS) -> DataFrame:
    """keys, bin, depth, unc: inverse-variance mean per covered bin; with a bad error in the bin, plain mean and scatter error."""
    i = F.floor((F.col(wl) - lo) / ((hi - lo) / n)).cast("int")
    p = points.filter(F.col(depth).isNotNull() & (F.col(wl) >= lo) & (F.col(wl) < hi)).withColumn("bin", i)
    good = F.coalesce(F.col(err) > 0, F.lit(False))
    w = F.when(good, 1 / (F.col(err) * F.col(err)))
    g = p.groupBy(*keys, "bin").agg(F.bool_and(good).alias("_all"), F.sum(w * F.col(depth)).alias("_wd"), F.sum(w).alias("_w"), F.avg(depth).alias("_mean"),
                                    F.avg(F.when(good, F.col(err))).alias("_e"), F.count_if(good).alias("_ng"), F.count("*").alias("_n"), F.stddev_pop(depth).alias("_sd"))
    plain = F.when(F.col("_ng") > 0, F.col("_e") / F.sqrt("_ng")).when(F.col("_n") > 1, F.col("_sd") / F.sqrt("_n"))
    return g.select(*keys, "bin", F.when(F.col("_all"), F.col("_wd") / F.col("_w")).otherwise(F.col("_mean")).alias("depth"),
                    F.when(F.col("_all"), 1 / F.sqrt("_w")).otherwise(plain).alias("unc"), F.col("_n").alias("points"))


def prepare(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Depth minus its median over covered bins; missing uncertainties take the median one.  Bins per key are bounded."""
    m = binned.groupBy(*keys).agg(F.percentile("depth", 0.5).alias("_md"), F.percentile("unc", 0.5).alias("_mu"))
    return salted_join(binned, m, list(keys)).select(*keys, "bin", (F.col("depth") - F.col("_md")).alias("depth"),
                                                     F.coalesce("unc", "_mu").alias("unc"), "points")


def as_channels(binned: DataFrame, keys: Sequence[str], n: int = N_BINS) -> DataFrame:
    """Three arrays of length n per key: depth, unc and coverage mask, 0 outside coverage."""
    rows = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("depth", "unc"))))
    m = binned.groupBy(*keys).agg(rows.alias("_m"))
    grid = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda f: F.transform(grid, lambda i: F.coalesce(F.try_element_at("_m", i)[f], F.lit(0.0)))
    return m.select(*keys, at("depth").alias("depth"), at("unc").alias("unc"),
                    F.transform(grid, lambda i: F.try_element_at("_m", i).isNotNull().cast("int")).alias("mask"))


def bin_centre(lo: float, hi: float, n: int) -> Column:
    return F.lit(lo) + (F.col("bin") + 0.5) * ((hi - lo) / n)


def _windows(bands: dict[str, list[tuple[float, float]]]) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("molecule"), F.lit(i).alias("window"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))
                     for m, ws in bands.items() for i, (a, b) in enumerate(ws)])


def inside(x: Column, windows: Sequence[tuple[float, float]]) -> Column:
    """Closed-interval membership in any window."""
    hit = F.lit(False)
    for a, b in windows:
        hit = hit | ((x >= a) & (x <= b))
    return hit


def band_observable(binned: DataFrame, keys: Sequence[str], bands: dict = BANDS, lo: float = GRID_MIN, hi: float = GRID_MAX, n: int = N_BINS) -> DataFrame:
    """keys, molecule, observable: at least three covered bins in one of the molecule's windows."""
    c = bin_centre(lo, hi, n)
    w = binned.withColumn("_c", c).select(*keys, "_c", F.inline(_windows(bands)))
    per = w.groupBy(*keys, "molecule", "window").agg(F.count_if((F.col("_c") >= F.col("a")) & (F.col("_c") <= F.col("b"))).alias("_n"))
    return per.groupBy(*keys, "molecule").agg((F.max("_n") >= MIN_BAND_BINS).alias("observable"))


def band_index(binned: DataFrame, keys: Sequence[str], band: tuple[float, float], continua: Sequence[tuple[float, float]], lo: float, hi: float, n: int) -> DataFrame:
    """keys, index, error, n_band: mean in the band minus mean in the continuum; NULL unless both have two bins."""
    c = bin_centre(lo, hi, n)
    b, k = inside(c, [band]), inside(c, continua)
    mean = lambda m: F.avg(F.when(m, F.col("depth")))
    err = lambda m: F.sqrt(F.sum(F.when(m, F.col("unc") * F.col("unc")))) / F.count_if(m)
    ok = (F.count_if(b) >= 2) & (F.count_if(k) >= 2)
    return binned.groupBy(*keys).agg(F.when(ok, mean(b) - mean(k)).alias("index"), F.when(ok, F.hypot(err(b), err(k))).alias("error"), F.count_if(b).alias("n_band"))


# ---- band statistics on points ---------------------------------------------------------------------

def band_test(points: DataFrame, keys: Sequence[str], wl: str, depth: str, err: str, bands: dict = BANDS, window: float = CONT_WINDOW) -> DataFrame:
    """keys, molecule and the band statistic: weighted in-band minus local continuum, z, chi-square, inflated error, 3-sigma limit.

    One pass: chi-square about two weighted means follows from sums of w, w d and w d^2.
    """
    x, d = F.col(wl), F.col(depth)
    any_band = inside(x, [w for ws in bands.values() for w in ws])
    role = F.array(*[F.struct(F.lit(m).alias("molecule"), inside(x, ws).alias("band"),
                              (inside(x, [(a - window, b + window) for a, b in ws]) & ~any_band).alias("cont")) for m, ws in bands.items()])
    p = points.filter(F.col(err) > 0).select(*keys, d.alias("_d"), (1 / (F.col(err) * F.col(err))).alias("_w"),
                                             F.inline(F.filter(role, lambda r: r["band"] | r["cont"])))
    s = lambda flag, v: F.sum(F.when(F.col(flag), v))
    w, d = F.col("_w"), F.col("_d")
    g = p.groupBy(*keys, "molecule").agg(F.count_if("band").alias("n_band"), F.count_if("cont").alias("n_cont"), s("band", w).alias("_wb"), s("cont", w).alias("_wc"),
                                         s("band", w * d).alias("_db"), s("cont", w * d).alias("_dc"), F.sum(w * d * d).alias("_q"))
    ok = (F.col("n_band") >= MIN_POINTS) & (F.col("n_cont") >= MIN_POINTS)
    delta = F.col("_db") / F.col("_wb") - F.col("_dc") / F.col("_wc")
    sigma = F.sqrt(1 / F.col("_wb") + 1 / F.col("_wc"))
    chi2 = (F.col("_q") - F.col("_db") * F.col("_db") / F.col("_wb") - F.col("_dc") * F.col("_dc") / F.col("_wc")) / F.greatest(
        F.col("n_band") + F.col("n_cont") - 2, F.lit(1))
    g = g.withColumn("evaluable", ok).withColumn("delta", F.when(ok, delta)).withColumn("sigma", F.when(ok, sigma)).withColumn("chi2_red", F.when(ok, chi2))
    wide = F.col("sigma") * F.sqrt(F.greatest("chi2_red", F.lit(1.0)))
    return g.select(*keys, "molecule", "n_band", "n_cont", "evaluable", "delta", "sigma", (F.col("delta") / F.col("sigma")).alias("z"), "chi2_red",
                    wide.alias("sigma_inflated"), (F.col("delta") / wide).alias("z_inflated"), (F.greatest("delta", F.lit(0.0)) + 3 * wide).alias("limit3"))


def injection_recovery(points: DataFrame, keys: Sequence[str], wl: str, depth: str, err: str, molecule: str, bands: dict = BANDS, n_sigma: float = 5.0,
                       window: float = CONT_WINDOW) -> DataFrame:
    """keys, recovered: change of z after n_sigma errors are added inside the band."""
    base = band_test(points, keys, wl, depth, err, bands, window).filter((F.col("molecule") == molecule) & F.col("evaluable")).select(*keys, F.col("z").alias("_z0"), F.col("sigma").alias("_s0"))
    up = salted_join(points, base, list(keys)).withColumn(depth, F.col(depth) + F.when(inside(F.col(wl), bands[molecule]), n_sigma * F.col("_s0")).otherwise(0.0))
    again = band_test(up, keys, wl, depth, err, bands, window).filter(F.col("molecule") == molecule).select(*keys, "z")
    return again.join(base, list(keys)).select(*keys, (F.col("z") - F.col("_z0")).alias("recovered"))


def continuum_excess(points: DataFrame, keys: Sequence[str], wl: str, depth: str, err: str, bands: dict, band: tuple[float, float], at_least: int = 4) -> DataFrame:
    """keys, slope, excess, sigma: weighted straight line through points outside every band, and the band's mean above it."""
    x, y = F.col(wl), F.col(depth)
    out = ~inside(x, [w for ws in bands.values() for w in ws])
    hit = inside(x, [band])
    w = 1 / (F.col(err) * F.col(err))
    s = lambda m, v: F.sum(F.when(m, v))
    g = points.filter(F.col(err) > 0).groupBy(*keys).agg(F.count_if(out).alias("_n"), F.count_if(hit).alias("_nb"), s(out, w).alias("_s"), s(out, w * x).alias("_sx"), s(out, w * x * x).alias("_sxx"),
                                                        s(out, w * y).alias("_sy"), s(out, w * x * y).alias("_sxy"), s(hit, w).alias("_b"), s(hit, w * x).alias("_bx"), s(hit, w * y).alias("_by"))
    c = lambda n: F.col(n)
    det = c("_s") * c("_sxx") - c("_sx") * c("_sx")
    a, b = (c("_sxx") * c("_sy") - c("_sx") * c("_sxy")) / det, (c("_s") * c("_sxy") - c("_sx") * c("_sy")) / det
    xb = c("_bx") / c("_b")
    var = 1 / c("_b") + (c("_sxx") - 2 * xb * c("_sx") + xb * xb * c("_s")) / det
    return g.filter((c("_n") >= at_least) & (c("_nb") >= MIN_POINTS)).select(*keys, b.alias("slope"), (c("_by") / c("_b") - a - b * xb).alias("excess"), F.sqrt(var).alias("sigma"))


def band_profile(points: DataFrame, keys: Sequence[str], wl: str, depth: str, err: str, step: float) -> DataFrame:
    """Weighted mean and error in steps of wavelength."""
    w = 1 / (F.col(err) * F.col(err))
    return points.filter(F.col(err) > 0).groupBy(*keys, F.floor(F.col(wl) / step).cast("bigint").alias("step")).agg(
        (F.sum(w * F.col(depth)) / F.sum(w)).alias("mean"), (1 / F.sqrt(F.sum(w))).alias("error"), F.count("*").alias("points"))


def sensitivity(tests: DataFrame, amplitudes: DataFrame, keys: Sequence[str], sizes: Sequence[float] = (2.0, 5.0), n_sigma: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(requirements, best band per spectrum): improvement and repeats needed to see a feature of each size."""
    j = tests.filter("evaluable").join(amplitudes, list(keys)).withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    f = F.col("sigma_inflated") * n_sigma / (F.col("size") * F.col("amplitude"))
    need = j.select(*keys, "molecule", "size", (F.col("sigma_inflated") / F.col("amplitude")).alias("sigma_in_h"), f.alias("improve"), (f * f).alias("repeats"))
    best = need.groupBy(*keys).agg(F.min_by("molecule", F.struct("sigma_in_h", "molecule")).alias("best_band"), F.min("sigma_in_h").alias("sigma_in_h"))
    return need, best


def spread_over_inputs(tests: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Spread of a statistic over alternative inputs of a key."""
    known = tests.filter(F.col(value).isNotNull())
    g = known.groupBy(*keys).agg(F.count("*").alias("inputs"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("sd"))
    return g.join(medians(known, keys, median=value), list(keys))


def feature_strength(points: DataFrame, keys: Sequence[str], depth: str, err: str) -> DataFrame:
    """Mean squared residual about the weighted mean, in errors; from single-pass sums."""
    w = 1 / (F.col(err) * F.col(err))
    g = points.filter(F.col(err) > 0).groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * F.col(depth)).alias("_d"), F.sum(w * F.col(depth) * F.col(depth)).alias("_q"), F.count("*").alias("points"))
    return g.select(*keys, ((F.col("_q") - F.col("_d") * F.col("_d") / F.col("_w")) / F.col("points")).alias("strength"), "points")


def matched_filter(data: DataFrame, template: DataFrame, keys: Sequence[str], bin_: str, signal: str, err: str) -> DataFrame:
    """keys, snr of a template against per-bin errors, its weighted mean removed."""
    w = 1 / (F.col(err) * F.col(err))
    s = F.col(signal)
    j = data.filter(F.col(err) > 0).join(template, bin_).groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * s).alias("_s"), F.sum(w * s * s).alias("_q"))
    return j.select(*keys, F.sqrt(F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_w"), F.lit(0.0))).alias("snr"))


# ---- noise calibration -----------------------------------------------------------------------------

def interp_array(x: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation in two short sorted arrays, clamped at the ends."""
    i = F.size(F.filter(xs, lambda v: v <= x))
    n = F.size(xs)
    at = lambda a, k: F.get(a, k)
    x0, x1, y0, y1 = at(xs, i - 1), at(xs, i), at(ys, i - 1), at(ys, i)
    return F.when(i == 0, at(ys, F.lit(0))).when(i >= n, at(ys, n - 1)).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))


def _filled_curve(curve: DataFrame, keys: Sequence[str], n: int, lo: float, hi: float) -> DataFrame:
    """keys, xs, ys with every one of the n bins filled by interpolation between those that have data."""
    step = (hi - lo) / n
    rows = F.array_sort(F.collect_list(F.struct((F.lit(lo) + (F.col("b") + 0.5) * step).alias("x"), F.col("v").alias("y"))))
    c = curve.filter("v is not null").groupBy(*keys).agg(rows.alias("_r"))
    kx, ky = F.transform("_r", lambda r: r["x"]), F.transform("_r", lambda r: r["y"])
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(lo) + (i + 0.5) * step)
    c = c.select(*keys, kx.alias("_kx"), ky.alias("_ky"), grid.alias("xs"))
    return c.select(*keys, "xs", F.transform("xs", lambda x: interp_array(x, F.col("_kx"), F.col("_ky"))).alias("ys"))


def host_medians(points: DataFrame, mode: str, host: str, spectrum: str, x: str, value: str, lo: float, hi: float, n: int) -> DataFrame:
    """mode, host, b, v: per spectrum and bin, then per host and bin."""
    b = F.floor((F.col(x) - lo) / ((hi - lo) / n)).cast("int")
    p = points.filter((F.col(x) >= lo) & (F.col(x) < hi)).withColumn("b", b)
    fits = fits_in_task(p, [mode, host]) or None
    spec = medians(p, [mode, host, spectrum, "b"], fits, v=value)
    return medians(spec, [mode, host, "b"], fits, v="v")


def fit_curve(points: DataFrame, mode: str, host: str, spectrum: str, x: str, value: str, lo: float, hi: float, n: int) -> DataFrame:
    """Curve per mode: median over hosts of each host's binned median, empty bins interpolated."""
    per = host_medians(points, mode, host, spectrum, x, value, lo, hi, n)
    return _filled_curve(medians(per, [mode, "b"], v="v"), [mode], n, lo, hi)


def leave_one_host_out(points: DataFrame, mode: str, host: str, spectrum: str, x: str, value: str, lo: float, hi: float, n: int) -> DataFrame:
    """mode, host, log_ratio: each host against the curve of the others.

    Removing one value from a ranked list shifts its median to a neighbouring rank, so the curves without
    each host follow from the values around the middle of every bin: no host meets every other host.
    """
    per = host_medians(points, mode, host, spectrum, x, value, lo, hi, n)
    fits = fits_in_task(per, [mode, "b"])
    ranked = cumulative(per.filter("v is not null"), "v", {"_r": F.lit(1).cast("bigint")}, [mode, "b"], tie=host, fits=fits)
    size = ranked.groupBy(mode, "b").agg(F.count("*").alias("_n"))
    j = salted_join(ranked, size, [mode, "b"], fits=fits)
    at_lo, at_hi = F.floor(F.col("_n") / 2), F.floor((F.col("_n") - 1) / 2) + 1
    pick = lambda p: F.max(F.when(F.col("_r") == p, F.col("v")))
    mids = j.groupBy(mode, "b").agg(pick(at_lo).alias("_l0"), pick(at_lo + 1).alias("_l1"), pick(at_hi).alias("_h0"), pick(at_hi + 1).alias("_h1"), F.first("_n").alias("_n"))
    hosts = per.select(mode, host).distinct()
    every = hosts.join(mids, mode)                       # hosts x bins, bins are few
    every = every.join(ranked.select(mode, "b", host, "_r"), [mode, "b", host], "left")
    low = F.when(F.col("_r") <= at_lo, F.col("_l1")).otherwise(F.col("_l0"))
    high = F.when(F.col("_r") <= at_hi, F.col("_h1")).otherwise(F.col("_h0"))
    # a host without data in a bin leaves that bin's plain median
    whole = F.when(F.col("_n") % 2 == 1, F.col("_h0")).otherwise((F.col("_l0") + F.col("_l1")) / 2)
    v = F.when(F.col("_r").isNotNull(), F.when(F.col("_n") > 1, (low + high) / 2)).otherwise(whole)
    curve = _filled_curve(every.select(mode, host, "b", v.alias("v")), [mode, host], n, lo, hi)
    fits = fits_in_task(points, [mode, host])
    scored = salted_join(points.filter((F.col(x) >= lo) & (F.col(x) < hi)), curve, [mode, host], fits=fits)
    scored = scored.withColumn("_lr", 0.5 * (F.col(value) - interp_array(F.col(x), F.col("xs"), F.col("ys"))))
    return medians(medians(scored, [mode, host, spectrum], fits or None, lr="_lr"), [mode, host], fits or None, log_ratio="lr")


# ---- weighted quantiles, best rows, evidence -------------------------------------------------------

def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles by cumulative weight with linear interpolation, clamped at both ends."""
    keys = list(keys)
    c = df.groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.sum(weight).alias("_w"))
    fits = fits_in_task(c, keys)
    c = cumulative(c, "_x", {"_cum": F.col("_w")}, keys, fits=fits)
    total = c.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    j = salted_join(c, total, keys, fits=fits) if keys else attach_row(c, total)
    q = F.col("_cum") / F.col("_total")
    picks = []
    for n, p in probs.items():
        below, above = F.when(q <= p, F.struct(q.alias("q"), F.col("_x").alias("x"))), F.when(q > p, F.struct(q.alias("q"), F.col("_x").alias("x")))
        picks += [F.max(below).alias(f"_a_{n}"), F.min(above).alias(f"_b_{n}")]
    g = j.groupBy(*keys).agg(*picks)
    out = []
    for n, p in probs.items():
        a, b = F.col(f"_a_{n}"), F.col(f"_b_{n}")
        mid = a["x"] + (p - a["q"]) * (b["x"] - a["x"]) / (b["q"] - a["q"])
        out.append(F.when(a.isNull(), b["x"]).when(b.isNull(), a["x"]).otherwise(mid).alias(n))
    return g.select(*keys, *out)


def best_per_regime(df: DataFrame, keys: Sequence[str], regimes: dict[str, str], descriptor: str) -> DataFrame:
    """Per key and regime: the smallest value and the descriptor of its row; NULL values never win."""
    aggs = []
    for name, c in regimes.items():
        s = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(descriptor).alias("d")))
        aggs.append(F.min(s).alias(f"_{name}"))
    g = df.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[c for n in regimes for c in (F.col(f"_{n}.v").alias(f"best_{n}"), F.col(f"_{n}.d").alias(f"{descriptor}_{n}"))])


def evidence_table(runs: DataFrame, keys: Sequence[str], model: str, logz: str, err: str, full: str, reduced: dict[str, str]) -> DataFrame:
    """keys, term, ln_b, error: log evidence of the full model against each reduced one, errors in quadrature."""
    f = runs.filter(F.col(model) == full).select(*keys, F.col(logz).alias("_z"), F.col(err).alias("_e"))
    names = {v: k for k, v in reduced.items()}
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    r = runs.filter(F.col(model).isin(list(names))).withColumn("term", F.element_at(F.create_map(*pairs), F.col(model)))
    return r.join(f, list(keys)).select(*keys, "term", (F.col("_z") - F.col(logz)).alias("ln_b"), F.hypot("_e", err).alias("error"))


def credited(ln_b: Column, improved: Column, inputs: Column) -> Column:
    """Difference of at least 3 and at least two thirds of the inputs improved."""
    return (ln_b >= 3) & (improved >= F.ceil(2 * inputs / 3))
