"""Queries over an append-only run log, as batch plans and as Structured Streaming twins.

A log record has an object, a status, a category and an event time.  The streaming forms keep one small
state per object or session and write each micro-batch under its own epoch, so a replayed batch replaces
itself.  Watermarks are a choice of this library: records later than the delay are left out of windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from surveyframe.operators.cleaning import latest_record
from surveyframe.operators.scale import cumulative, neighbour, salted_join, scalar_of

IDLE_SECONDS = 600          # fixed value: a longer silence ends a work session
RECENT, LEAST_STAMPS = 300, 25  # fixed values: stamps the rate looks at, and how many it needs
WATERMARK = "1 hour"


# ---- batch -----------------------------------------------------------------------------------------

def current_state(log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return latest_record(log, key, order, columns)


def state_counts(log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """How many objects are currently in each status and category."""
    return current_state(log, key, order, columns).groupBy(*columns).agg(F.count("*").alias("objects"))


def seconds(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)


def work_sessions(log: DataFrame, time: str, tie: str, keys: Sequence[str] = (), idle: float = IDLE_SECONDS) -> DataFrame:
    """keys, session, started, ended, records: a silence longer than `idle` seconds ends a session."""
    x = log.withColumn("_s", seconds(time))
    near = neighbour(x, "_s", {"_before": "_s"}, keys, tie)
    near = near.withColumn("_new", F.coalesce((F.col("_s") - F.col("_before") > idle).cast("int"), F.lit(0)))
    numbered = cumulative(near, "_s", {"session": F.col("_new")}, keys, tie)
    return numbered.groupBy(*keys, "session").agg(F.min("_s").alias("started"), F.max("_s").alias("ended"), F.count("*").alias("records"))


def recent_rate(log: DataFrame, time: str, remaining: int) -> DataFrame:
    """per_hour and hours_left from the median working gap of the newest stamps; no row when too few stamps."""
    from pyspark.sql import Window as W

    last = log.select(seconds(time).alias("_s")).orderBy(F.col("_s").desc()).limit(RECENT)   # at most RECENT rows
    gap = last.withColumn("_g", F.col("_s") - F.lag("_s").over(W.partitionBy(F.lit(0)).orderBy("_s")))
    ok = F.col("_g").between(0, IDLE_SECONDS) & (F.col("_g") > 0)
    g = gap.agg(F.count("*").alias("stamps"), F.array_sort(F.collect_list(F.when(ok, F.col("_g")))).alias("_w"))
    middle = F.get("_w", F.floor(F.size("_w") / 2).cast("int"))
    return g.filter((F.col("stamps") >= LEAST_STAMPS) & (F.size("_w") > 0)).select(
        "stamps", (3600 / middle).alias("per_hour"), (remaining * middle / 3600).alias("hours_left"))


def started_sessions(log: DataFrame, time: str, tie: str, start: Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys, session, started, seconds, records of sessions opened by explicit start events; records before the first are session 0."""
    x = log.withColumn("_s", seconds(time)).withColumn("_new", start.cast("int"))
    n = cumulative(x, "_s", {"session": F.col("_new")}, keys, tie)
    return n.groupBy(*keys, "session").agg(F.min("_s").alias("started"), (F.max("_s") - F.min("_s")).alias("seconds"), F.count("*").alias("records"))


def failure_runs(log: DataFrame, time: str, tie: str, failed: Column, keys: Sequence[str] = (), limit: int = 3) -> DataFrame:
    """keys, longest, tripped: longest run of consecutive failures, and how many runs reached the limit."""
    x = log.withColumn("_s", seconds(time)).withColumn("_ok", (~failed).cast("int"))
    islands = cumulative(x, "_s", {"_island": F.col("_ok")}, keys, tie)
    runs = islands.groupBy(*keys, "_island").agg(F.sum(1 - F.col("_ok")).alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").alias("longest"), F.count_if(F.col("_run") >= limit).alias("tripped"))


def progress(log: DataFrame, time: str, key: str, done: Column, total: int) -> DataFrame:
    """hour, finished, running_total, hours_left: objects finishing per hour, each counted when it first finishes."""
    first = log.filter(done).groupBy(key).agg(F.min(seconds(time)).alias("_s"))
    per = first.groupBy(F.floor(F.col("_s") / 3600).cast("bigint").alias("hour")).agg(F.count("*").alias("finished"))
    run = cumulative(per, "hour", {"running_total": F.col("finished")})
    began = scalar_of(per, h=F.min("hour"))["h"]
    return run.withColumn("hours_left", (total - F.col("running_total")) * (F.col("hour") - began + 1) / F.col("running_total"))


def work_left(log: DataFrame, wanted: DataFrame, key: str, order: Sequence[str], status: str, finished: Sequence[str]) -> DataFrame:
    """Wanted objects whose latest record is not final: new ones and failures, each once."""
    done = current_state(log, key, order, [status]).filter(F.col(status).isin(list(finished)))
    return wanted.select(key).distinct().join(done, key, "left_anti")


def clean_finish(log: DataFrame, key: str, time: str, tie: str, start: Column, end: Column, early: Column, transient: Column) -> DataFrame:
    """One row: whether the newest session ended, was stopped early, how many objects are left on a transient failure, and the verdict."""
    x = log.withColumn("_o", F.struct(seconds(time), F.col(tie)))
    marks = x.agg(F.max(F.when(start, F.col("_o"))).alias("_start"), F.max(F.when(end, F.col("_o"))).alias("_end"), F.max(F.when(early, F.col("_o"))).alias("_early"))
    last = x.groupBy(key).agg(F.max_by(transient, F.col("_o")).alias("_t"))
    left = last.agg(F.count_if("_t")).scalar()
    after = lambda c: F.coalesce(F.col(c) > F.col("_start"), F.lit(False))
    m = marks.select(after("_end").alias("ended"), after("_early").alias("stopped_early"), left.alias("transient_failures"))
    return m.withColumn("complete", F.col("ended") & ~F.col("stopped_early") & (F.col("transient_failures") == 0))


# ---- streaming -------------------------------------------------------------------------------------

def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A growing directory of JSON lines; malformed lines give NULL objects and are left out."""
    return (spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files_per_trigger).json(path)
            .filter(F.col("object_id").isNotNull()))


def _epochs(path: str):
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def start_current_state(stream: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last record per object; changed objects are appended under the epoch that changed them."""
    state = stream.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r"), F.max(F.struct(*order)).alias("o"))
    return (state.select(key, "r.*", "o").writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(_epochs(path)).trigger(availableNow=True).start())


def read_current_state(spark: SparkSession, path: str, key: str, columns: Sequence[str]) -> DataFrame:
    """The table start_current_state keeps: the newest epoch's row per object."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("o")).alias("r")).select(key, "r.*")


def stream_sessions(stream: DataFrame, time: str, keys: Sequence[str], idle: int = IDLE_SECONDS, delay: str = WATERMARK) -> DataFrame:
    """Sessions per key (a log, mission or object) with a gap of `idle` seconds, emitted once the watermark has passed them."""
    s = F.session_window(time, f"{idle} seconds")
    return stream.withWatermark(time, delay).groupBy(*keys, s).agg(F.count("*").alias("records"), F.max(time).alias("ended")).select(
        *keys, F.col("session_window.start").alias("started"), "ended", "records")


def stream_progress(stream: DataFrame, time: str, width: str = "1 hour", delay: str = WATERMARK) -> DataFrame:
    w = F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w).agg(F.count("*").alias("records")).select(F.col("window.start").alias("started"), "records")


def stream_failure_runs(stream: DataFrame, key: str, time: str, failed: Column) -> DataFrame:
    """key, run, longest after every micro-batch: the current and the longest run of failures, two numbers of state per key.

    Rows of a micro-batch are taken in time order, so the log must not be out of order across micro-batches.
    """
    types = dict(stream.dtypes)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, longest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("_s", kind="stable")
        for f in rows["_f"]:
            run = run + 1 if f else 0
            longest = max(longest, run)
        state.update((run, longest))
        yield pd.DataFrame({key: [keys[0]], "run": [run], "longest": [longest]})

    x = stream.select(key, seconds(time).alias("_s"), failed.alias("_f"))
    return x.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, run long, longest long", "run long, longest long", "update", GroupStateTimeout.NoTimeout)


def stream_work_left(stream: DataFrame, finished: DataFrame, key: str, time: str, delay: str = WATERMARK) -> DataFrame:
    """Requests whose object is not finished yet, each object once within the watermark."""
    return stream.withWatermark(time, delay).join(finished.select(key), key, "left_anti").dropDuplicatesWithinWatermark([key])
