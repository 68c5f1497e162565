"""Small helpers shared by the training-data operators: stored tables, row keys, Arrow batches and hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: Fixed odd multipliers of the 64-bit mixers and of the polynomial byte hash.
MIX_A, MIX_B, BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


# ---- tables and keys --------------------------------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="surveyframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and outlives any executor.

    The files are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/surveyframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep the rows' partitions as they are; the files are deleted when the driver's JVM ends."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    where = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by `stored` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that any other column of the input, whatever its name, stays out of the way."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Hashes r1 (64 bits) and r2 (32 bits) of (doc_id, text): equal rows share them, NULLs are allowed."""
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("r1"), F.hash(F.col(text), F.col(doc_id)).alias("r2")]


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a NULL id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id and one 0/1 label `y` of at most about max_rows labelled rows that are not held out.

    Rows are picked by a hash of the id, the same ones on every run; NULL ids and labels are left out and of
    conflicting labels of an id the larger counts.  The result has a proven bound, so it may be broadcast.
    """
    rows = (labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
            .filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")))
    n = max(1, rows.count())
    share = min(1.0, max_rows / n)
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


# ---- Arrow ------------------------------------------------------------------------------------------

def arrow_map(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """mapInArrow where fn maps one record batch to an iterable of column dicts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for columns in fn(b):
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((columns[f.name], f) for f in fields)],
                    schema=fields)

    return df.mapInArrow(run, struct)


def text_buffer(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; NULL counts as empty."""
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, a longer row alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


# ---- words and hashes in numpy ----------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal values stay equal."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("p", BASE), ("q", pow(BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; span_hash reads the hash of any span from them."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, q = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with inside[byte], cut at row bounds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = on.copy(), on.copy()
    start[1:] &= ~on[:-1] | cut[1:-1]
    end[:-1] &= ~on[1:] | cut[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and, per row, the index of its first word (n + 1 values)."""
    starts, ends = word_spans(data, offsets, inside)
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):     # in blocks, so that a huge row needs no huge table of powers
        to = max(int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")), at + 1)
        lo, hi = starts[at], ends[to - 1]
        if hi - lo > SLICE_BYTES:      # one huge word
            out[at] = int.from_bytes(hashlib.blake2b(data[lo:hi].tobytes(), digest_size=8).digest(), "little")
        else:
            out[at:to] = span_hash(prefix_hash(data[lo:hi]), starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out, np.searchsorted(starts, offsets)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of the edge list with the smallest node of its component.

    Large-star and small-star steps alternate on star nodes until the edges no longer change; there is no limit
    on the rounds.  Each round's table is stored, so that a lost executor repeats one round at most.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            low.select("u", F.col("m").alias("v")).filter("u <> v"))
        last, e = e, stored(small.distinct())
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
