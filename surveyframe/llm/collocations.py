"""Phrase collocations by mergeable Misra-Gries summaries and one exact count.

First pass: every n-gram of up to `longest` words gets a 64-bit hash, and a task counts the hashes of its texts.
Its counts, limited to the threshold (a count that reaches it is proof enough), are cut by hash partition into
summaries.  A partition's summaries have a mass, the sum of their counts; they are merged with a capacity above
mass / threshold, each overflow taking the least surplus count from all counters.  What is taken is less than the
threshold in all, so every n-gram that occurs `least` times survives, and equal hashes can only add survivors.  The
number of partitions follows the bytes of the texts, so a partition's mass does not grow with the input.

Second pass: n-grams are counted exactly, by their words, where a bit table of the survivors' hashes lets them pass.
The table has a fixed size; should it fill up, it lets more n-grams pass and the counts stay right.

Scores are floors of exact quotients.  A candidate's least cut counts, its parts are looked up in the same counts
(a part occurs at least as often as the phrase, so it is there).

Defined cases: a NULL or empty text has no words; a NULL lang is `und`; repeated rows count each; texts are cut
between words into slices that overlap by the longest phrase, so very long ones need no more memory; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix, need, prefix_hash, row_slices, span_hash, stored, text_buffer

LEAST, LONGEST, COVERED_PERCENT, TOP, MILLION = 10, 3, 50, 2000, 1_000_000
BYTES_PER_PARTITION = 16 << 20
SLICE, HELD, ROWS_READ = 2 << 20, 2_000_000, 2048
FILTER_BITS = 26
#: Rows one task ranks at a time while the best of a language are picked, in lists of TOP.
LISTS = 32

#: 1 between words, 2 between pieces, 0 in words.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


# ---- n-grams of a slice -----------------------------------------------------------------------------

def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Index of each word in the slice's dictionary, the dictionary, and the number of the piece it stands in."""
    kind = KIND[data]
    inside = kind == 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    at = np.flatnonzero(start)
    piece = np.cumsum((kind == 2) | cut[:-1], dtype=np.int32)[at]
    sizes = np.flatnonzero(end) + 1 - at
    edges = np.concatenate(([0], np.cumsum(sizes)))
    flat = pa.py_buffer(data[inside].tobytes())
    column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges.astype(np.int64)), flat])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, piece


def grams(ids: np.ndarray, piece: np.ndarray, n_words: int, longest: int, skip: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, one place of each distinct n-gram, its count) for sizes from 1 on; the first `skip` words start none that ends among them."""
    code, base = ids, n_words
    for size in range(1, longest + 1):
        if size > 1:
            if not len(code) or len(ids) < size:
                return
            if base > (1 << 62) // max(n_words, 1):          # names would not fit: number the distinct ones first
                _, code = np.unique(code, return_inverse=True)
                base = len(code)
            code = code[:-1] * n_words + ids[size - 1:]
            base *= n_words
        whole = np.ones(len(code), bool) if size == 1 else piece[:len(code)] == piece[size - 1:]
        whole[:max(skip - size + 1, 0)] = False          # counted with the slice before
        places = np.flatnonzero(whole)
        _, first, count = np.unique(code[places], return_index=True, return_counts=True)
        yield size, places[first], count


def gram_hash(word_hash: np.ndarray, ids: np.ndarray, places: np.ndarray, size: int, salt: np.uint64) -> np.ndarray:
    h = np.full(len(places), salt, np.uint64)
    for j in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hash[ids[places + j]])
    return h


def slices(b: pa.RecordBatch, longest: int, limit: int = SLICE) -> Iterator[tuple[str, np.ndarray, np.ndarray, int]]:
    """(lang, bytes, row offsets, words repeated from the slice before) with texts of one language each."""
    for at in range(0, b.num_rows, ROWS_READ):
        rows = b.slice(at, ROWS_READ)
        lang = pc.fill_null(rows.column("lang").cast(pa.string()), "und")
        for value in pc.unique(lang).to_pylist():
            data, off = text_buffer(rows.column("text").filter(pc.equal(lang, value)))
            for lo, hi in row_slices(off, limit):
                part = LOWER[data[off[lo]:off[hi]]]
                if len(part) <= 2 * limit:
                    yield value, part, off[lo:hi + 1] - off[lo], 0
                else:
                    yield from ((value, *x) for x in _cut(part, longest, limit))


def _cut(text: np.ndarray, longest: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """One huge text in slices that begin with the last longest - 1 words of the slice before."""
    kind = KIND[text] > 0
    begins = np.flatnonzero(~kind & np.concatenate(([True], kind[:-1])))
    lo = 0
    while lo < len(begins):
        hi = max(int(np.searchsorted(begins, begins[lo] + limit)), lo + 1)
        back = max(lo - longest + 1, 0)
        part = text[begins[back]:begins[hi] if hi < len(begins) else len(text)]
        yield part, np.array([0, len(part)]), lo - back
        lo = hi


def dictionary_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of dictionary words, the same in every task."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(words), np.uint64)
    lo = 0
    while lo < len(words):
        hi = max(int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1, lo + 1)
        if at[hi] - at[lo] > SLICE_BYTES:      # one huge word: the same polynomial over its pieces
            pieces = range(int(at[lo]), int(at[hi]), SLICE_BYTES)
            h = np.uint64(len(pieces))
            for p in pieces:
                block = raw[p:min(p + SLICE_BYTES, int(at[hi]))]
                h = mix(h + span_hash(prefix_hash(block), np.array([0]), np.array([len(block)])))[0]
            out[lo] = h
        else:
            block = raw[at[lo]:at[hi]]
            out[lo:hi] = span_hash(prefix_hash(block), at[lo:hi] - at[lo], at[lo + 1:hi + 1] - at[lo])
        lo = hi
    return out


def lang_salt(lang: str) -> np.uint64:
    return dictionary_hashes(pa.array([lang.encode()], pa.large_binary()))[0]


# ---- Misra-Gries ------------------------------------------------------------------------------------

def pack(h: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Hash and count in one integer: the hash loses its last bits to the count, which ends at `least`."""
    bits = np.uint64(least.bit_length())
    return (h >> bits << bits) | np.minimum(n, least).astype(np.uint64)


def unpack(v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(least.bit_length())
    return v >> bits, (v & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def fold(v: np.ndarray, least: int, block: int = 1 << 18) -> np.ndarray:
    """Packed hashes in order, equal ones added up; sorts its input in place and works through it in blocks, to spare memory."""
    v.sort()
    bits, out, lo = np.uint64(least.bit_length()), 0, 0
    while lo < len(v):
        hi = min(lo + block, len(v))
        if hi < len(v):         # up to the end of a key's entries
            hi = int(np.searchsorted(v, ((v[hi - 1] >> bits) + np.uint64(1)) << bits)) if v[hi - 1] >> bits < np.uint64((1 << 64 - int(bits)) - 1) else len(v)
        key, n = unpack(v[lo:hi], least)
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        v[out:out + len(at)] = (key[at] << bits) | np.minimum(np.add.reduceat(n, at), least).astype(np.uint64)
        out, lo = out + len(at), hi
    return v[:out].copy()


class Summary:
    """Misra-Gries counters of fixed capacity, merged with others of the same capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        k, c = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        self.keys, self.counts = k[at], np.add.reduceat(c, at) if len(at) else c
        if len(self.keys) > self.capacity:
            off = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            self.taken += int(off)
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off

    def frequent(self, least: int) -> np.ndarray:
        """All keys that can have occurred `least` times."""
        return self.keys[self.counts + self.taken >= least]


def summaries(docs: DataFrame, partitions: int, least: int, longest: int) -> DataFrame:
    """(p, mass, counters): each task's summaries by hash partition, packed; counts end at `least`."""

    # partition p holds the hashes from edges[p - 1] on; the hash's first 32 bits are dealt evenly
    edges = np.array([-(-(p << 32) // partitions) << 32 for p in range(1, partitions)], np.uint64)

    def cut(v: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.concatenate(([0], np.searchsorted(v, edges), [len(v)])).tolist()
        for p, (lo, hi) in enumerate(zip(at, at[1:])):
            if hi > lo:
                mass = int(unpack(v[lo:hi], least)[1].sum())
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([mass], pa.int64()), pa.array([v[lo:hi].tobytes()], pa.binary())],
                                                 names=["p", "mass", "counters"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for lang, data, off, skip in slices(b, longest):
                ids, words, piece = words_of(data, off)
                word_hash, salt = dictionary_hashes(words), lang_salt(lang)
                for size, places, n in grams(ids, piece, len(words), longest, skip):
                    parts.append(pack(gram_hash(word_hash, ids, places, size, salt), n, least))
                    held += len(n)
                if held > HELD:
                    v = np.concatenate(parts)
                    parts.clear()
                    v = fold(v, least)
                    if len(v) > HELD // 2:
                        yield from cut(v)
                        v = v[:0]
                    parts, held = [v], len(v)
        if held:
            yield from cut(fold(np.concatenate(parts), least))

    return need(docs, "lang", "text").mapInArrow(run, "p long, mass long, counters binary")


def survivors(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bytes_per_partition: int = BYTES_PER_PARTITION) -> DataFrame:
    """h: hashes (without the bits of the count) that hold every n-gram occurring `least` times, and some others."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = int(size // bytes_per_partition) + 1

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Summary(int(pdf["mass"].sum()) // least + 1)
        for x in pdf["counters"]:
            s.merge(*unpack(np.frombuffer(x, np.uint64), least))
        return pd.DataFrame({"h": s.frequent(least).view(np.int64)})

    return summaries(docs, partitions, least, longest).groupBy("p").applyInPandas(merge, "h long")


def bit_table(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """2 ** bits flags as bytes, set where a hash ends; the rows that travel are the flags' words, at most 2 ** (bits - 6)."""
    slot = F.col("h").bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return table


def count_phrases(docs: DataFrame, table: np.ndarray, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, size, f) of all n-grams whose hash is flagged, and one row a language with size 0: all its words."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = ["lang", "phrase", "size", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for b in batches:
            for lang, data, off, skip in slices(b, longest):
                ids, words, piece = words_of(data, off)
                word_hash, salt = dictionary_hashes(words), lang_salt(lang)
                text = words.cast(pa.large_string())
                out = [(pa.array([""]), [0], [len(ids) - skip])]
                for size, places, n in grams(ids, piece, len(words), longest, skip):
                    h = gram_hash(word_hash, ids, places, size, salt)
                    slot = (h >> np.uint64(least.bit_length())) & np.uint64((1 << bits) - 1)
                    on = (flags[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                    places, n = places[on], n[on]
                    parts = [text.take(pa.array(ids[places + j])) for j in range(size)]
                    phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                    out.append((phrase.cast(pa.string()), np.full(len(n), size, np.int32), n))
                for phrase, size, n in out:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), phrase, pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=names)

    return need(docs, "lang", "text").mapInArrow(run, "lang string, phrase string, size int, f long").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


# ---- candidates, scores and ranks -------------------------------------------------------------------

def scored(freq: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of every candidate by its least cut; freq has all n-grams of the least frequency."""
    cand = freq.filter("size >= 2")
    w = F.split("phrase", " ")
    cuts = cand.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice(w, F.col("k") + 1, F.col("size")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        part = freq.select(F.col("lang").alias("_g"), F.col("phrase").alias("_p"), F.col("f").alias(name))
        cuts = cuts.join(part, (F.col("lang") == F.col("_g")) & (F.col(side) == F.col("_p"))).drop("_g", "_p")
    exact = F.expr(f"(cast({MILLION} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = F.min(F.struct(exact.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best.alias("b")).select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def uncovered(cand: DataFrame, freq: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """Candidates that no longer candidate holds at least `percent` of."""
    w = F.split("phrase", " ")
    longer = freq.filter("size >= 3").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.select("lang", "f", "n", w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("i"))
    inner = longer.groupBy(F.col("lang").alias("_g"), F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("_p")).agg(F.max("f").alias("most"))
    joined = cand.join(inner, (F.col("lang") == F.col("_g")) & (F.col("phrase") == F.col("_p")), "left")
    return joined.filter(F.coalesce(100 * F.col("most") < percent * F.col("a"), F.lit(True))).drop("_g", "_p", "most")


def best_of(df: DataFrame, key: str, order: list, top: int, lists: int = LISTS) -> DataFrame:
    """The first `top` rows of every key with their rank: first of hashed pieces of it, then of `lists` such lists at a time."""
    n = df.count()
    pieces = max(1, -(-n // (lists * top)))
    df = df.withColumn("_piece", F.pmod(F.xxhash64("phrase"), F.lit(pieces)))
    while True:
        df = df.withColumn("rank", F.row_number().over(W.partitionBy(key, "_piece").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        if pieces == 1:
            return df.drop("_piece")
        pieces = -(-pieces // lists)
        df = df.drop("rank").withColumn("_piece", F.floor(F.col("_piece") / lists))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = COVERED_PERCENT, top: int = TOP,
                 bytes_per_partition: int = BYTES_PER_PARTITION, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words."""
    table = bit_table(survivors(docs, least, longest, bytes_per_partition), bits)
    counts = stored(count_phrases(docs, table, least, longest, bits).filter((F.col("size") == 0) | (F.col("f") >= least)))
    total = counts.filter("size = 0").select(F.col("lang").alias("_g"), F.col("f").alias("n"))
    freq = counts.filter("size > 0")
    kept = stored(uncovered(scored(freq), freq, percent))
    best = best_of(kept, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return best.join(total, F.col("lang") == F.col("_g")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
