"""Run registered queries and their SQL twins side by side and compare them.

    python tests/oracle.py [--sf 0.01] [--module NAME] [query ...]
"""
import argparse
import importlib
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "tinyint": "TINYINT", "smallint": "SMALLINT", "date": "DATE", "timestamp": "TIMESTAMP",
                 "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql):
    """'' when equal, else what differs; a leading '~' means equal only up to 1e-6."""
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, [str(x) for x in rel.types]))
    got_types = {n: SPARK_TO_DUCK.get(t, t) for n, t in df.dtypes}
    want = rel.df()
    got = df.toPandas()
    if sorted(got_types) != sorted(want_types):
        return f"columns {sorted(got_types)} vs {sorted(want_types)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    notes = [f"type {c}: {got_types[c]} vs {want_types[c]}" for c in got_types if got_types[c] != want_types[c]]
    cols = sorted(got_types)
    missing = lambda v: v is None or v is pd.NaT or v is pd.NA or v != v

    def norm(f):
        out = pd.DataFrame()
        for c in cols:
            s = f[c]
            if want_types[c] in ("DOUBLE", "FLOAT") or got_types[c] in ("DOUBLE", "FLOAT"):
                out[c] = [None if missing(v) else float(v) for v in s]
            elif "INT" in want_types[c]:
                out[c] = [None if missing(v) else str(int(v)) for v in s]
            else:
                out[c] = [None if missing(v) else str(v) for v in s]
        return out

    a, b = norm(got), norm(want)

    def rows(f):
        r = [tuple(x) for x in f.astype(object).where(f.notna(), None).itertuples(index=False)]
        return sorted(r, key=lambda t: tuple((v is None, f"{round(v, 5) + 0.0:.5f}" if isinstance(v, float) else str(v)) for v in t))

    ra, rb = rows(a), rows(b)
    if ra == rb:
        return "; ".join(notes)
    worst, first = "~", None
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if u == v:
                continue
            if isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1.1e-6 * max(1, abs(u)):
                first = first or (x, y)
                continue
            return f"DIFF {dict(zip(cols, x))} vs {dict(zip(cols, y))} " + "; ".join(notes)
    return f"{worst} close only {first} " + "; ".join(notes)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module", default="")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("--rows-per-task", default="")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from pyspark.sql import SparkSession
    from surveyframe.plans import registry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if a.module:
        for m in a.module.split(","):
            importlib.import_module(f"surveyframe.plans.{m}")
    else:
        registry.load_all()
    if a.rows_per_task:
        spark.conf.set("spark.surveyframe.rowsPerTask", a.rows_per_task)
    sf_dir = f"/root/testdata/sf{a.sf}"
    con, bad = connect(sf_dir), 0
    for name, q in registry.QUERIES.items():
        if a.module and q.run.__module__.rsplit(".", 1)[-1] not in a.module.split(","):
            continue
        if a.names and name not in a.names:
            continue
        t0 = time.time()
        try:
            df = q.run(registry.Tables(spark, sf_dir))
            if q.sql is None:
                n = len(df.toPandas())
                res = "" if n else "no rows"
                tag = f"rows-only {n}"
            else:
                res, tag = compare(df, con, q.sql), "oracle"
            if a.show:
                df.show(8, False)
        except Exception as e:  # noqa: BLE001
            res, tag = f"ERROR {type(e).__name__} {str(e)[:900]}", "?"
        bad += bool(res)
        print(f"{'OK  ' if not res else 'BAD '} {name:38s} {time.time()-t0:6.2f}s {tag} {res}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
