"""Fixed-length arrays (views, spectra) as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyframe.functions.basics import col


def doubles(a: str | Column) -> Column:
    return col(a).cast("array<double>")


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, even where body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def sd(a: Column) -> Column:
    """Population standard deviation, two passes."""
    return let(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m)))))


def median(a: Column) -> Column:
    at = lambda s, i: F.get(s, i.cast("int"))
    return let(F.array_sort(a), lambda s: (at(s, (F.size(s) - 1) / 2) + at(s, F.size(s) / 2)) / 2)


def part(a: Column, start: int, stop: int) -> Column:
    """Elements start..stop-1, 0-based."""
    return F.slice(a, start + 1, max(stop - start, 0))


ERR_LOG_MIN, ERR_LOG_MAX = -4.0, 2.0  # fixed values: clipping of log10 errors


def error_channel(err: str | Column) -> Column:
    """Half of the clipped log10 error; a non-finite error is the largest."""
    def one(x):
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        v = F.log10(F.greatest(x, F.lit(10.0 ** ERR_LOG_MIN)))
        return F.when(bad, ERR_LOG_MAX).otherwise(F.least(F.greatest(v, F.lit(ERR_LOG_MIN)), F.lit(ERR_LOG_MAX))) / 2.0
    return F.transform(doubles(err), one)


def usable(label: str | Column, *arrays: str | Column) -> Column:
    ok = col(label) >= 0
    for a in arrays:
        ok = ok & F.forall(col(a), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce(ok, F.lit(False))


def in_units(depth: Column, mask: Column, amplitude: Column) -> Column:
    """Depth minus its covered median over an amplitude; NULL outside coverage."""
    covered = F.filter(F.zip_with(depth, mask, lambda d, m: F.when(m > 0, d)), lambda x: x.isNotNull())
    return let(F.when(amplitude > 0, median(covered)), lambda level: F.zip_with(depth, mask, lambda d, m: F.when(m > 0, (d - level) / amplitude)))


def strength_blind(depth: Column, unc: Column, mask: Column) -> dict[str, Column]:
    """Whitened residual over its RMS, mask, and clipped log error over the median error: blind to feature size."""
    zipped = F.arrays_zip(depth.alias("d"), unc.alias("u"), mask.alias("m"))
    rows = F.filter(zipped, lambda r: r["m"] > 0)
    w = lambda r: 1 / (r["u"] * r["u"])
    sums = F.aggregate(rows, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("d")),
                       lambda s, r: F.struct((s["w"] + w(r)).alias("w"), (s["d"] + w(r) * r["d"]).alias("d")),
                       lambda s: s["d"] / s["w"])
    enough = F.size(rows) >= 2
    on = lambda r, v: F.when(r["m"] > 0, v).otherwise(0.0)
    blank = F.transform(mask, lambda m: F.lit(0.0))

    def residual(mu: Column) -> Column:
        rms = F.greatest(F.sqrt(mean(F.transform(rows, lambda r: F.pow((r["d"] - mu) / r["u"], 2)))), F.lit(1e-6))
        return let(rms, lambda k: F.transform(zipped, lambda r: on(r, (r["d"] - mu) / r["u"] / k)))

    errors = let(median(F.transform(rows, lambda r: r["u"])), lambda mid: F.transform(
        zipped, lambda r: on(r, F.least(F.greatest(F.log10(r["u"] / mid), F.lit(-2.0)), F.lit(2.0)))))
    return {"residual": F.when(enough, let(sums, residual)).otherwise(blank),
            "mask": F.transform(mask, lambda m: F.when(enough, m).otherwise(0)),
            "log_error": F.when(enough, errors).otherwise(blank)}


DEPTH_SCALE = 1000.0  # fixed value


def model_features(depth: Column, unc: Column, mask: Column) -> Column:
    """Scaled depth, scaled error, mask and signal-to-noise, concatenated."""
    snr = F.zip_with(F.arrays_zip(depth.alias("d"), unc.alias("u")), mask, lambda r, m: F.when(m > 0, r["d"] / F.greatest(r["u"], F.lit(1e-6))).otherwise(0.0))
    scaled = lambda a: F.transform(a, lambda x: x / DEPTH_SCALE)
    return F.concat(scaled(depth), scaled(unc), F.transform(mask, lambda m: m.cast("double")), snr)


def occlude(a: Column, start: Column, width: int) -> Column:
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < start + width), 0.0).otherwise(x))


def windows(length: int, width: int) -> Column:
    """Starts of consecutive non-overlapping windows."""
    return F.array(*[F.lit(s) for s in range(0, length - width + 1, width)])


def region_masks(length: int, fraction: Column, local_half: int = 15) -> dict[str, Column]:
    """Bins in the event, around half a period, and inside the local core, from duration / period."""
    c = length // 2
    hw = F.greatest(F.lit(3), F.ceil(0.6 * fraction * length).cast("int"))
    grid = F.sequence(F.lit(0), F.lit(length - 1))
    return {"event": F.transform(grid, lambda i: (i >= c - hw) & (i <= c + hw)),
            "opposite": F.transform(grid, lambda i: (i < 2 * hw) | (i >= length - 2 * hw)),
            "core": F.transform(grid, lambda i: (i >= c - local_half) & (i <= c + local_half))}


def signed_log(x: str | Column) -> Column:
    return F.signum(col(x)) * F.log10(1 + F.abs(col(x)))


def shape_features(g: Column, l: Column, ng: int, nl: int, core: int = 10, wing: int = 40, gap: int = 60, quarter_half: int = 30) -> dict[str, Column]:
    """Twelve shape numbers of a whole-orbit and a zoomed view, each something a human vetter looks at."""
    c = nl // 2
    body = part(l, max(0, c - core), c + core + 1)
    wings = F.concat(part(l, 0, max(0, c - wing)), part(l, min(nl, c + wing + 1), nl))
    depth, floor = -F.array_min(body), -mean(body)
    gc, quarter, edge = ng // 2, ng // 4, max(1, round(0.04 * ng))
    oot = F.concat(part(g, edge, gc - gap), part(g, gc + gap, ng - edge))
    level = lambda a, b: median(part(g, a, b)).alias("x")
    spread = lambda b: 1.4826 * median(F.transform(oot, lambda x: F.abs(x - b)))
    base_mad = let(median(oot), lambda b: F.struct(b.alias("base"), spread(b).alias("mad")))
    far = F.least(level(0, edge), level(ng - edge, ng))
    near = F.least(level(max(0, gc - quarter - quarter_half), max(1, gc - quarter + quarter_half)),
                   level(min(ng - 1, gc + quarter - quarter_half), min(ng, gc + quarter + quarter_half)))
    # the deeper of two regions is the more significant one, since both share baseline and scatter
    dip = lambda x: let(base_mad, lambda s: F.when(s["mad"] > 0, (s["base"] - x) / s["mad"]).otherwise(0.0))
    left, right = -F.array_min(part(g, 0, gc)), -F.array_min(part(g, gc, ng))
    return {
        "local_depth": depth, "local_floor": floor, "v_shape": F.when(depth > 0, floor / depth).otherwise(0.0),
        "local_snr": let(sd(wings), lambda s: F.when(s > 0, depth / s).otherwise(0.0)), "wing_level": mean(wings), "wing_scatter": sd(wings),
        "global_scatter": sd(g), "oot_mad": base_mad["mad"],
        "duration_frac": let(F.array_min(g) / 2, lambda h: F.size(F.filter(g, lambda x: x < h)) / ng),
        "secondary_sig": dip(far), "quadrature_sig": dip(near),
        "transit_asymmetry": F.when(left + right > 0, F.abs(left - right) / (left + right)).otherwise(0.0),
    }
