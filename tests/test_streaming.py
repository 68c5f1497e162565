import json
import tempfile

import pytest
from pyspark.sql import functions as F

from surveyframe.streaming import runlog as L

SF = "/root/testdata/sf0.001"
SCHEMA = "object_id string, time timestamp, seq long, status string, category string"


@pytest.fixture(scope="module")
def log_dir(spark):
    """A run log in two files, with a truncated and a blank line, from the events table."""
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    d = tempfile.mkdtemp(prefix="runlog-")
    lines = [json.dumps({"object_id": str(r["user_id"]), "time": r["ts"].isoformat(), "seq": r["event_id"],
                         "status": "failed" if r["event_type"] == "error" else "ok", "category": r["event_type"]}) for r in e]
    for i, part in enumerate((lines[:600], lines[600:])):
        with open(f"{d}/part{i}.json", "w") as f:
            f.write("\n".join(part) + "\n" + ('{"object_id": "7", "ti' if i == 0 else "") + "\n")
    return d


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def batch(spark, log_dir):
    return spark.read.schema(SCHEMA).json(log_dir).filter("object_id is not null")


def test_current_state_equals_batch(spark, log_dir):
    out, chk = tempfile.mkdtemp(), tempfile.mkdtemp()
    s = L.log_stream(spark, log_dir, SCHEMA, 1)
    L.start_current_state(s, "object_id", ["time", "seq"], ["status", "category"], out, chk).awaitTermination(120)
    got = L.read_current_state(spark, out, "object_id", ["status", "category"])
    want = L.current_state(batch(spark, log_dir), "object_id", ["time", "seq"], ["status", "category"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_failure_runs_equal_batch(spark, log_dir):
    s = L.log_stream(spark, log_dir, SCHEMA, 1)
    got = run(L.stream_failure_runs(s, "object_id", "time", F.col("status") == "failed"), "runs", "update")
    last = {r["object_id"]: r["m"] for r in got.groupBy("object_id").agg(F.max("longest").alias("m")).collect()}
    want = L.failure_runs(batch(spark, log_dir), "time", "seq", F.col("status") == "failed", ["object_id"])
    assert last == {r["object_id"]: r["longest"] for r in want.collect()}


def test_sessions_equal_batch(spark, log_dir):
    got = run(L.stream_sessions(L.log_stream(spark, log_dir, SCHEMA), "time", ["category"], 7200, "0 seconds"), "sessions", "append").collect()
    want = L.work_sessions(batch(spark, log_dir), "time", "seq", ["category"], 7200).collect()
    # the newest session of each key stays open until the watermark passes it
    assert len(want) - 6 <= len(got) <= len(want)
    known = {(r["category"], round(r["started"], 3)): r["records"] for r in want}
    assert all(known[(r["category"], round(r["started"].timestamp(), 3))] == r["records"] for r in got)


def test_progress_and_dedup(spark, log_dir):
    s = L.log_stream(spark, log_dir, SCHEMA)
    hours = run(L.stream_progress(s, "time", delay="0 seconds"), "hours", "append").collect()
    want = {r["h"]: r["n"] for r in batch(spark, log_dir).groupBy(F.date_trunc("hour", "time").alias("h")).agg(F.count("*").alias("n")).collect()}
    assert hours and all(want[r["started"]] == r["records"] for r in hours)
    finished = spark.createDataFrame([("1",), ("2",)], "object_id string")
    left = [r["object_id"] for r in run(L.stream_work_left(L.log_stream(spark, log_dir, SCHEMA), finished, "object_id", "time", "40 days"), "left", "append").collect()]
    everyone = {r["object_id"] for r in batch(spark, log_dir).select("object_id").distinct().collect()}
    assert sorted(left) == sorted(everyone - {"1", "2"})
