"""Expressions everything else is built from: hashed draws, clipping, day numbers, checks."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A rule that must hold for the data does not hold."""


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digest(parts: tuple) -> Column:
    text = [F.lit(p) if isinstance(p, int) else col(p) for p in parts]
    return F.md5(F.concat_ws("|", *[t.cast("string") for t in text]))


def _share(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def uniform(*parts: str | Column | int) -> Column:
    """A draw in [0, 1) with 52 bits, fixed by the text of its parts, the same on every engine and retry."""
    return _share(_digest(parts), 1)


def std_normal(*parts: str | Column | int) -> Column:
    """Box-Muller on two uniforms from one digest; the first is kept off zero."""
    digest = _digest(parts)
    u = F.greatest(_share(digest, 1), F.lit(1e-10))
    v = _share(digest, 14)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


def clip(x: str | Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(x)))


def no_nan(x: str | Column) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def finite(x: str | Column) -> Column:
    x = col(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def epoch_days(ts: str | Column) -> Column:
    """Days since 1970 as a double (session zone UTC)."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(86400e6)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0."""
    den = col(den)
    return F.when(den != 0, col(num) / den)


def bin_index(p: str | Column, n: int) -> Column:
    """Equal-width bin of a value in [0, 1]; 1.0 falls in the last bin."""
    return F.least(F.floor(col(p) * n), F.lit(n - 1)).cast("int")


def lookup(value: str | Column, mapping: dict, default=None) -> Column:
    """A small literal mapping as a CASE expression."""
    expr = F
    for k, v in mapping.items():
        expr = expr.when(col(value) == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise CheckFailed(f"missing columns {missing}")
    return df


def require_empty(df: DataFrame, what: str, show: int = 10) -> None:
    """Raise with a few examples when a violation query returns rows."""
    rows = df.limit(show).collect()
    if rows:
        raise CheckFailed(f"{what}: {[r.asDict() for r in rows]}")
