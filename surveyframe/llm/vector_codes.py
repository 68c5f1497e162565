"""Product codes of vectors, assigned through a lexicographic trie of their distinct parts.

Components become integers; vectors are cut into equal consecutive parts, each with a codebook of its own.  The
distinct parts of a position are sorted, so that parts with a common beginning stand together and form a trie over
the dimensions.  Going down depth first, a node's distances to all entries are its parent's plus one squared
difference, so a beginning shared by many parts is added up once.  A leaf is one distinct part: the least distance
names its entry, and its components go, times its number of copies, to that entry's sums.  Only those sums
(entries x dimensions) leave a task, whatever the number of rows.

The distinct parts are counted once, batch by batch before the one shuffle, and stored; every round reads them.
The last assignment meets the vectors where they are: each batch builds the trie of its own distinct parts.

Arithmetic is exact: 64-bit integers while no component passes 2 ** 26, Python integers beyond.  Components are
limited to +-2 ** 62; an error beyond the range of a long is given as the largest long.

Defined cases: rows whose vector is NULL or has NULL or non-finite components are left out, and so are those whose
length is not a positive multiple of the parts or not that of the vector with the least id.  NULL ids are kept but
start no codebook while others do; ids that occur again are rows of their own, in order of their vectors.  Fewer
vectors than entries give shorter codebooks.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SAFE, LARGEST = 1 << 26, (1 << 63) - 1
#: Neighbouring nodes of one depth that go down together; a task holds the distances of at most depth x depth blocks.
BLOCK = 4096


# ---- the trie ---------------------------------------------------------------------------------------

def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row of `parts`, which are distinct and in lexicographic order."""
    n, width = parts.shape
    entry, error = np.zeros(n, np.int64), np.zeros(n, parts.dtype)
    if not n:
        return entry, error
    todo = [(n, 0, np.array([0]), np.zeros((1, len(book)), parts.dtype))]       # neighbouring nodes: end, depth, starts, distances
    while todo:
        hi, depth, start, dist = todo.pop()
        if depth == width:
            best = dist.argmin(axis=1) if dist.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in dist])
            entry[start], error[start] = best, dist[np.arange(len(start)), best]
            continue
        lo = start[0]
        fresh = np.zeros(hi - lo, bool)
        fresh[start - lo] = True
        fresh[1:] |= parts[lo + 1:hi, depth] != parts[lo:hi - 1, depth]
        child = np.flatnonzero(fresh) + lo
        parent = np.searchsorted(start, child, "right") - 1
        for a in range((len(child) - 1) // BLOCK * BLOCK, -1, -BLOCK):      # the first block is taken up next, down to its leaves
            c = child[a:a + BLOCK]
            below = dist[parent[a:a + BLOCK]] + (parts[c, depth][:, None] - book[:, depth][None, :]) ** 2
            todo.append((int(child[a + BLOCK]) if a + BLOCK < len(child) else hi, depth + 1, c, below))
    return entry, error


def sums(parts: np.ndarray, n: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and componentwise sums of each entry over distinct sorted parts with n copies each."""
    entry, _ = assign(parts, book)
    count = np.zeros(len(book), np.int64)
    np.add.at(count, entry, n)
    total = np.zeros(book.shape, object)
    for e in np.unique(entry).tolist():
        mine = entry == e
        weighted = (parts[mine] * n[mine, None]).sum(axis=0)
        total[e] = [int(x) for x in weighted]
    return count, total


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, each row's place among them, and their counts."""
    order = np.lexsort(parts.T[::-1])
    s = parts[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]).any(axis=1)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(fresh) - 1
    at = np.flatnonzero(fresh)
    return s[at], place, np.diff(np.append(at, len(s)))


# ---- packing ----------------------------------------------------------------------------------------

def pack(parts: np.ndarray) -> pa.Array:
    """Big-endian integers with the sign bit turned, so that bytes sort as the numbers do: 4 bytes each if all fit, else 8."""
    n, width = parts.shape
    small = (np.abs(parts) < SAFE).all(axis=1)
    if small.all():
        data = (parts + (1 << 31)).astype(">u4").tobytes()
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 4 * width * n + 1, 4 * width, dtype=np.int32)), pa.py_buffer(data)])
    return pa.array([(r + (1 << 31)).astype(">u4").tobytes() if s else (r.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes()
                     for r, s in zip(parts, small)], pa.binary())


def unpack(values: pa.Array, width: int) -> np.ndarray:
    """The parts, as 64-bit integers, or as Python integers where one needs 8 bytes."""
    lengths = pc.binary_length(values).to_numpy()
    if (lengths == 4 * width).all():
        _, offsets, data = values.buffers()
        lo = np.frombuffer(offsets, np.int32)[values.offset] if len(values) else 0
        flat = np.frombuffer(data, ">u4", len(values) * width, lo) if len(values) else np.zeros(0)
        return flat.reshape(-1, width).astype(np.int64) - (1 << 31)
    rows = [np.frombuffer(v, ">u4").astype(np.int64) - (1 << 31) if len(v) == 4 * width
            else (np.frombuffer(v, ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) for v in values.to_pylist()]
    return np.array([[int(x) for x in r] for r in rows], object)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors of a batch, in Python integers where 64-bit squares could overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return flat.astype(object) if flat.size and np.abs(flat).max() >= SAFE else flat


# ---- Spark ------------------------------------------------------------------------------------------

def _map(df: DataFrame, run, schema: str) -> DataFrame:
    return df.mapInArrow(run, schema)


def integers(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """The kept rows with components floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    # Spark joins this test to the caller's own filters; one with a lambda would make it work out parts of those early, for rows they guard
    finite = ~F.array_contains(v, float("nan")) & (F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf"))      # array_contains is NULL where a component is
    good = (F.size(v) == 0) | finite
    far = float(1 << 62)
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(far)), F.lit(-far))).cast("long"))
    return rows.filter(F.coalesce(good, F.lit(False))).withColumn(vector, whole)


def count_parts(rows: DataFrame, vector: str, width: int, parts: int) -> DataFrame:
    """(pos, part, n): the distinct parts of every position, packed, with their numbers; sorted inside each task."""
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for p in range(parts):
                rows_, _, n = distinct(v[:, p * size:(p + 1) * size])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), p, np.int32)), pack(rows_), pa.array(n, pa.int64())], names=["pos", "part", "n"])

    counted = _map(rows.select(vector), run, "pos int, part binary, n long").groupBy("pos", "part").agg(F.sum("n").alias("n"))
    return counted.sortWithinPartitions("pos", "part")


def _step(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floor of the mean of its parts, an unused one stays."""
    size = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), object) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            pos, n = (batch.column(c).to_numpy() for c in (0, 2))
            v = unpack(batch.column(1), size)
            for p in np.unique(pos).tolist():
                at = np.flatnonzero(pos == p)
                at = at[np.lexsort(v[at].T[::-1])]        # a batch may hold the end of one sorted run and the start of the next
                c, t = sums(v[at], n[at], books[p].astype(v.dtype))
                count[p] += c
                total[p] += t
        rows = [(p, e, int(count[p][e]), d, Decimal(total[p][e][d])) for p in range(len(books)) for e in range(len(books[p])) if count[p][e] for d in range(size)]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0)))],
                                         names=["pos", "entry", "n", "dim", "total"])

    found = _map(table, run, "pos int, entry int, n long, dim int, total decimal(38,0)").groupBy("pos", "entry", "dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    new = [b.copy() for b in books]
    for r in found.collect():        # parts x entries x dimensions rows, whatever the input
        new[r["pos"]][r["entry"], r["dim"]] = int(r["total"]) // r["n"]
    return new


def _books(first: list[list[int]], parts: int) -> list[np.ndarray]:
    size = len(first[0]) // parts
    values = [np.array([v[p * size:(p + 1) * size] for v in first], object) for p in range(parts)]
    return values if max(abs(x) for v in first for x in v) >= SAFE else [v.astype(np.int64) for v in values]


def train(rows: DataFrame, vec_id: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], DataFrame]:
    """Codebooks, one array of entries per position, and the rows they apply to; none for an empty table."""
    first = rows.select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries)
    least = first.select(vector).collect()       # `entries` rows
    width = len(least[0][0]) if least else 0
    if not width or width % parts:
        return [], rows.filter(F.lit(False))
    if any(len(r[0]) != width for r in least):
        least = rows.filter(F.size(vector) == width).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    rows = rows.filter(F.size(vector) == width)
    books = _books([r[0] for r in least], parts)
    table = stored(count_parts(rows, vector, width, parts)) if rounds else None
    for _ in range(rounds):
        books = _step(table, books)
    return books, rows


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def encode(rows: DataFrame, vec_id: str, vector: str, books: list[np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, extra columns, code (two hex digits a part) and error of integer vectors."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = rows.select(vec_id, *extra, vector)
    struct = T.StructType([*kept.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    fields = to_arrow_schema(struct)
    parts = len(books)
    size = books[0].shape[1] if books else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _vectors(b.column(b.num_columns - 1), parts * size)
            codes, error = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), v.dtype)
            for p, book in enumerate(books):
                wide = v.dtype == object or book.dtype == object
                d, place, _ = distinct(v[:, p * size:(p + 1) * size])
                entry, e = assign(d.astype(object) if wide else d, book.astype(object) if wide else book)
                codes[:, p], error = entry[place], error + e[place]
            hexes = [r.tobytes().hex() for r in codes]
            capped = pa.array([min(int(x), LARGEST) for x in error], pa.int64()) if error.dtype == object else pa.array(error)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns[:-1], pa.array(hexes, pa.string()), capped], fields)], schema=fields)

    return _map(kept, run, struct) if books else kept.filter(F.lit(False)).select(vec_id, *extra, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector.

    label_error is the error summed over rows with the same label, NULL being a label; its joins are left to
    Spark, which sends the sums only where they are small.
    """
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    whole = integers(need(vectors, vec_id, vector, label).toDF("id", "vec", "label"), "id", "vec", scale)
    books, rows = train(whole, "id", "vec", parts, entries, rounds)
    coded = stored(encode(rows, "id", "vec", books, ("label",)))
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("t"))
    total = total.select(F.col("label").alias("_l"), F.least("t", F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("_l"))).select(
        F.col("id").alias(vec_id), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
