"""Benchmark decontamination by random-walk embedding and bit-sampling LSH, verified by exact edit distance.

Texts and benchmark items become sequences of words (letters and digits, lower-cased).  A document is contaminated by
an item of n words when some stretch of it is at most n * MAX_EDIT_PERCENT / 100 word edits from the item.

1. Windows.  A window starts at every word.  It can only match an item of a size class if enough of the word pairs in
   it are word pairs of items (an edit destroys two pairs at most, and a window may hold all edits that the largest
   item of the class allows), which running sums over a bit table of the items' pairs tell for all starts at once;
   this bound is exact and drops no match.  Items below MIN_WORDS words allow no edit: their whole hash is the sample.
2. Embedding.  A walk over the window emits its current word at every step and then moves on or stays, as a random
   function of step and word says.  Edits delay one walk against the other for a few steps only, so that a small edit
   distance becomes a small Hamming distance of the emitted words.
3. Bit sampling.  Each of several walks is read at SAMPLES random steps within the size class; equal samples of a
   window and an item make a candidate.  The number of walks of a class is the least that brings simulated items at the
   edit limit to TARGET_RECALL.  Signatures meet in a join, so the benchmark may have any size.
4. Neighbouring candidate windows form one stretch of the text, in which the item is aligned exactly with free ends.

Defined cases: NULL and wordless texts contain nothing; items that are NULL or have no word match nothing, those
of up to four words match where they stand unchanged; repeated items and rows count each; an empty table on either side
gives uncontaminated rows or none; other columns are ignored by `find_leaks` and kept by `clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTER, arrow_map, free_name, mix, need, row_keys, row_slices, stored, text_buffer, word_hashes

MAX_EDIT_PERCENT, MIN_WORDS = 20, 5
SAMPLES, SLACK = 3, 3
TARGET_RECALL, TRIALS, WALKS = 0.98, 800, (16, 24, 32, 40, 48, 56, 64, 80, 96, 128, 192, 256)
PAIR_BITS, KEY_BITS = 22, 24
_SEED = 0x2545F4914F6CDD1D


def size_class(n: int) -> int:
    """The smallest item size of the class of n; classes grow by about a third, below MIN_WORDS each size is its own."""
    if n < MIN_WORDS:
        return n
    low = MIN_WORDS
    while low * 4 // 3 + 1 <= n:
        low = low * 4 // 3 + 1
    return low


def most_edits(low: int) -> int:
    """Edits that the largest item of a class allows."""
    high = low if low < MIN_WORDS else low * 4 // 3
    return high * MAX_EDIT_PERCENT // 100


def walks_of(low: int, target: float = TARGET_RECALL) -> int:
    """The least number of walks that makes `target` of simulated items of the class, edited up to the limit, candidates."""
    if low < MIN_WORDS:
        return 1
    rng = np.random.default_rng(low)
    n, gap = low * 4 // 3, 2 * low + 2
    items = np.zeros((TRIALS, n + gap), np.uint64)
    items[:, :n] = rng.integers(1, 1 << 62, (TRIALS, n))
    copies = items.copy()
    for row in copies:
        row[rng.choice(n, most_edits(low), replace=False)] = rng.integers(1, 1 << 62, most_edits(low)).astype(np.uint64)
    starts = np.arange(TRIALS) * (n + gap)
    found = signatures(items.ravel(), starts, low, WALKS[-1]) == signatures(copies.ravel(), starts, low, WALKS[-1])
    halves = np.split(found, 2)             # both must reach it, so that luck in one does not decide
    return next((w for w in WALKS if min(h[:, :w].any(axis=1).mean() for h in halves) >= target), WALKS[-1])


def _words(column: pa.Array):
    """Word hashes of row slices: (first row, words, index of each row's first word)."""
    data, off = text_buffer(column, lower=True)
    for lo, hi in row_slices(off):
        words, first = word_hashes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], LETTER)
        yield lo, words, first


def _pairs(words: np.ndarray) -> np.ndarray:
    return (mix(words[:-1] * np.uint64(3) + words[1:]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _steps(low: int, repeat: int) -> np.ndarray:
    """Sorted sampled steps of one walk over a window of the class; a walk passes about half a word a step."""
    rng = np.random.default_rng([low, repeat])
    return np.sort(rng.choice(np.arange(2 * low - 2), SAMPLES, replace=False))


def signatures(words: np.ndarray, starts: np.ndarray, low: int, walks: int) -> np.ndarray:
    """len(starts) x walks hashes of the sampled steps of the walks from each start; words past the end are 0."""
    padded = np.concatenate((words, np.zeros(2 * low + 2, np.uint64)))
    out = np.empty((len(starts), walks), np.uint64)
    if low < MIN_WORDS:
        out[:, 0] = mix(np.array([low], np.uint64))[0]
        for i in range(low):
            out[:, 0] = mix(out[:, 0] * np.uint64(3) + padded[starts + i])
        return out
    for r in range(walks):
        at, steps = starts.copy(), _steps(low, r)
        key = np.full(len(starts), mix(np.array([low * 1000 + r + 1], np.uint64))[0], np.uint64)
        for step in range(int(steps[-1]) + 1):
            word = padded[at]
            if step in steps:
                key = mix(key * np.uint64(3) + word)
            coin = (word ^ np.uint64((_SEED * (step + 1 + 131 * r)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9FB21C651E98DF25)
            at = at + (coin >> np.uint64(63)).astype(np.int64)
        out[:, r] = key
    return out


# ---- benchmark --------------------------------------------------------------------------------------

def _classes(benchmark: DataFrame) -> dict[int, int]:
    """Walks of every size class that the benchmark has items of; the classes grow with the logarithm of the sizes."""

    def run(b: pa.RecordBatch):
        for _, _, first in _words(b.column("text")):
            yield {"low": np.array(sorted({size_class(int(n)) for n in np.diff(first) if n > 0}), np.int32)}

    lows = arrow_map(need(benchmark, "text"), run, "low int").distinct().collect()
    return {low: walks_of(low) for low in sorted(r[0] for r in lows)}


def _items(benchmark: DataFrame, walks: dict[int, int]) -> DataFrame:
    """item_id and words of every item, its size class and its signatures."""

    def run(b: pa.RecordBatch):
        text, ids = b.column("text"), b.column("item_id")
        for lo, words, first in _words(text):
            rows = [i for i in range(len(first) - 1) if first[i + 1] > first[i]]
            seqs = [words[first[i]:first[i + 1]] for i in rows]
            low = [size_class(len(s)) for s in seqs]
            sigs = [signatures(s, np.zeros(1, np.int64), c, walks[c])[0].view(np.int64).tolist() for s, c in zip(seqs, low)]
            yield {"item_id": ids.take(pa.array([lo + i for i in rows], pa.int64())), "low": low, "words": [s.view(np.int64).tolist() for s in seqs], "sigs": sigs}

    return arrow_map(need(benchmark, "item_id", "text"), run, T.StructType([
        T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("low", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.LongType())), T.StructField("sigs", T.ArrayType(T.LongType()))]))


def _bits(df: DataFrame, column: str, n: int) -> np.ndarray:
    """A table of 2 ** n flags, packed; what reaches the driver is bounded by the table, not by the data."""
    at = df.select(F.col(column)).distinct()
    packed = at.groupBy((F.col(column) / 8).cast("int").alias("byte")).agg(F.bit_or(F.pow(F.lit(2.0), F.col(column) % 8).cast("int")).alias("bits")).toPandas()
    out = np.zeros(1 << (n - 3), np.uint8)
    out[packed["byte"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64)
    return out


def _get(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1


# ---- documents --------------------------------------------------------------------------------------

def _windows(words: np.ndarray, first: np.ndarray, pair_table: np.ndarray, low: int) -> np.ndarray:
    """Starts whose window has enough item pairs for an item of the class of `low`, at any allowed edit distance."""
    n = len(words)
    most = most_edits(low)
    wanted = low - 1 - 2 * most
    hits = np.zeros(n + 1, np.int32)
    if n > 1:
        end = np.zeros(n - 1, bool)             # pairs across rows do not count
        end[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)] - 1] = True
        np.cumsum(_get(pair_table, _pairs(words)).astype(np.int32) * ~end, out=hits[1:n])
        hits[n] = hits[n - 1]
    start = np.arange(n)
    reach = np.minimum(start + low + most, np.repeat(first[1:], np.diff(first)))
    last = np.maximum(reach - 1, start)
    return start[(hits[last] - hits[start] >= max(wanted, int(low > 1))) & (reach - start >= low - most)]


def _clusters(starts: np.ndarray, keys: np.ndarray, first: np.ndarray, low: int):
    """Stretches of neighbouring hits: (row, start, end, distinct keys), each at most about four class sizes long."""
    at, which = np.unique(starts, return_inverse=True)
    row = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > low) | (row[1:] != row[:-1])
    head = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    new[1:] |= np.diff((at - head) // (2 * low)) != 0
    group = np.cumsum(new) - 1
    lo = at[new]
    hi = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])
    of = group[which]
    order = np.lexsort((keys, of))
    cut = np.searchsorted(of[order], np.arange(len(lo) + 1))
    for g in range(len(lo)):
        r = row[new][g]
        yield int(r), max(int(lo[g]) - SLACK, int(first[r])), min(int(hi[g]) + 2 * low + SLACK, int(first[r + 1])), np.unique(keys[order[cut[g]:cut[g + 1]]])


def _candidates(docs: DataFrame, walks: dict[int, int], pair_table: np.ndarray, key_table: np.ndarray) -> DataFrame:
    """Row keys, place and words of every stretch of windows whose signatures some item has, with those signatures."""

    def run(b: pa.RecordBatch):
        r1, r2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("r1", "r2"))
        for lo, words, first in _words(b.column("text")):
            out = {c: [] for c in ("r1", "r2", "at", "sigs", "around")}
            for low, n_walks in walks.items():
                starts = _windows(words, first, pair_table, low)
                hits = []
                for part in np.array_split(starts, max(1, len(starts) // 8192)):
                    sig = signatures(words, part, low, n_walks)
                    # The walk may run past its row's end there; such samples differ from every item's, as they should.
                    hit = _get(key_table, (sig >> np.uint64(64 - KEY_BITS)).astype(np.int64).ravel()).reshape(sig.shape).astype(bool)
                    i, j = np.nonzero(hit)
                    hits.append((part[i], sig[i, j]))
                at, keys = (np.concatenate(x) for x in zip(*hits))
                if not len(at):
                    continue
                for row, a, z, found in _clusters(at, keys, first, low):
                    for c, v in zip(out, (r1[lo + row], r2[lo + row], a - int(first[row]), found.view(np.int64).tolist(), words[a:z].view(np.int64).tolist())):
                        out[c].append(v)
            yield out

    return arrow_map(docs, run, "r1 long, r2 int, at long, sigs array<long>, around array<long>")


def free_end_distance(item: list, text: list) -> int:
    """Fewest word edits between the item and any stretch of the text; bit t of a vector stands for the item's word t."""
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    mask, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score, best = mask, 0, len(item), len(item)
    for w in text:
        eq = where.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (mask & ~(diag | up)), diag & up
        score += bool(right & top) - bool(left & top)
        best = min(best, score)
        right, left = right << 1, left << 1
        up, down = mask & (left | ~(diag | right)), mask & right & diag
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """r1, r2 (hashes of doc_id and text), item_id and edits, one row for each item found in a text."""
    walks = _classes(benchmark)
    items = stored(_items(benchmark, walks))
    pair_schema = "pair long"

    def item_pairs(b: pa.RecordBatch):
        for w in b.column("words"):
            yield {"pair": _pairs(np.array(w.as_py(), np.int64).view(np.uint64))}

    pair_table = _bits(arrow_map(items.select("words"), item_pairs, pair_schema), "pair", PAIR_BITS)
    sigs = items.select("item_id", F.explode("sigs").alias("sig"))
    key_table = _bits(sigs.select(F.shiftrightunsigned("sig", 64 - KEY_BITS).alias("key")), "key", KEY_BITS)
    keyed = need(docs, "doc_id", "text").select(*row_keys(), "text")
    found = _candidates(keyed, walks, pair_table, key_table)
    met = found.select("r1", "r2", "at", "around", F.explode("sigs").alias("sig")).join(sigs, "sig")
    met = met.groupBy("r1", "r2", "at", "item_id").agg(F.first("around").alias("around"))
    pairs = met.join(items.select(F.col("item_id").alias("_i"), "words"), F.col("item_id").eqNullSafe(F.col("_i"))).drop("_i", "at")
    item_type = benchmark.schema["item_id"].dataType

    def verify(b: pa.RecordBatch):
        edits, keep = [], []
        for words, around in zip(b.column("words"), b.column("around")):
            words = words.as_py()
            d = free_end_distance(words, around.as_py())
            keep.append(100 * d <= MAX_EDIT_PERCENT * len(words))
            edits.append(d)
        mask = pa.array(keep, pa.bool_())
        yield {c: b.column(c).filter(mask) for c in ("r1", "r2", "item_id")} | {"edits": pa.array(edits, pa.int32()).filter(mask)}

    good = arrow_map(pairs, verify, T.StructType([T.StructField("r1", T.LongType()), T.StructField("r2", T.IntegerType()),
                                                  T.StructField("item_id", item_type), T.StructField("edits", T.IntegerType())]))
    return good.groupBy("r1", "r2", "item_id").agg(F.min("edits").alias("edits"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits of every item found in a row."""
    rows = need(docs, "doc_id", "text").select("doc_id", *row_keys())
    return rows.join(find_leaks(docs, benchmark), ["r1", "r2"]).select("doc_id", "item_id", "edits")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and the fewest edits of every row."""
    leaks = find_leaks(docs, benchmark).groupBy("r1", "r2").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("edits").alias("edits"))
    rows = need(docs, "doc_id", "text").select("doc_id", *row_keys())
    none = F.array().cast(leaks.schema["item_ids"].dataType)
    return rows.join(leaks, ["r1", "r2"], "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("int").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), "edits")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any benchmark item, with all their columns."""
    leaks = find_leaks(docs, benchmark).select(F.xxhash64("r1", "r2").alias("leak")).distinct()
    key = free_name(docs, "leak")
    return docs.withColumn(key, F.xxhash64(*row_keys())).join(leaks.withColumnRenamed("leak", key), key, "left_anti").drop(key)
