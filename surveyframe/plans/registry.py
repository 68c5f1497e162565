"""Registered queries: a Spark plan over the given tables and, where SQL can say it, its ANSI twin."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ["catalog", "cleaning", "matching", "splits", "metrics", "resampling", "timeseries", "spectra",
           "ranking", "screens", "fitting", "runlog", "lines"]


class Tables:
    """The given parquet tables as attributes; nothing is read until a column is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # day numbers are defined in UTC

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def positive_zero(sql: str) -> str:
    """Wrap every round(...) so that a tiny negative number rounds to 0.0, as in Spark, and not to -0.0."""
    out, i = [], 0
    for m in re.finditer(r"(?<![A-Za-z0-9_])round\(", sql):
        if m.start() < i:
            continue
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = positive_zero(sql[m.end():j - 1])
        out.append(sql[i:m.start()] + f"(round({inner}) + 0.0::double)")
        i = j
    return "".join(out) + sql[i:]


def query(name: str, ids: str, sql: str | None = None):
    """Register a plan under a name together with the inventory ids it covers."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, tuple(ids.split()), fn, positive_zero(sql) if sql else None)
        return fn

    return add


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"surveyframe.plans.{m}")
    return QUERIES


# ---- SQL fragments shared by the twins -------------------------------------------------------------

def sql_uniform(key: str) -> str:
    return f"(('0x'||substr(md5({key}),1,13))::BIGINT/4503599627370496.0::DOUBLE)"


def sql_normal(key: str) -> str:
    u, v = (f"(('0x'||substr(md5({key}),{i},13))::BIGINT/4503599627370496.0::DOUBLE)" for i in (1, 14))
    return f"(sqrt(-2.0*ln(greatest({u},1e-10)))*cos(2.0*pi()*{v}))"


def sql_mod(x: str, p: str) -> str:
    return f"(((({x}) % ({p})) + ({p})) % ({p}))"


SQL_DAY = "(epoch_us(ts)/86400e6::DOUBLE)"
