"""Near-duplicates by order MinHash, verified by banded alignment.

Words are the runs of non-space characters, lower-cased.  Texts of up to TINY words meet by what is left of them without
any fifth of their words, which no pair within the limit escapes.  Texts of SHORT lengths meet by two-word shingles, each
labelled with its occurrence number: for each of SKETCHES random orders the two smallest are kept in text order and
hashed, so a sketch agrees with a probability that falls with the edit distance rather than with the overlap of sets
alone.  LONG texts meet by the smallest labelled five-word shingle of each order: of a pair at the limit a third of the
shingles survive, too few for two common minima.

Exact copies are collapsed first.  Texts with an equal sketch meet in a bucket and each is compared with the bucket's
first text in one random priority.  Then the buckets that still hold several classes are cut into pieces, and every
piece meets every piece.  Both rounds first hold all pairs of different classes against an exact lower bound of their
edit distance (counts of hashed words, `_bags`) and keep the texts with an allowed partner; only these texts are read.
The allowed pairs are aligned where they meet, the likeliest first, unless links of the same piece already hold them
together.  So any two texts of a bucket are compared or already in one class; nothing is capped.
A pair is linked when its words align with at most a fifth of edits (similarity 1 - d / longer
>= 0.8), found exactly by a bit-parallel alignment in a band.  Classes are the connected components of the links.

Defined cases: a NULL text is a class of its own; texts without words are copies only of the very same text; equal
texts, repeated rows among them, share a class; class_id is the smallest doc_id of the class, NULL where it has none;
an empty table gives no rows; other columns are ignored.  Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, arrow_map, components, discard, free_name, mix, need, row_slices, stored, text_buffer, word_hashes

K, SKETCHES, SIMILARITY_PERCENT = 5, 32, 80
#: Most words of texts met by deletions; fewest and most words of those met by pairs of SHORT_K-word and single K-word minima.
TINY, SHORT_K, SHORT, LONG = 14, 2, (12, 75), (60, 1 << 62)
#: Texts and words of a piece of a bucket, and the fewest and most bins of a text's word counts.
PIECE, PIECE_WORDS, BINS = 1024, 1_000_000, (64, 1024)
_BLOCK = 1024


# ---- sketches ---------------------------------------------------------------------------------------

def _order_minhash(words: np.ndarray, first: np.ndarray, n: np.ndarray, k: int, n_sketches: int, single: bool = False) -> np.ndarray:
    rows = np.zeros((len(n), n_sketches), np.uint64)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return rows
    size = np.maximum(n[full] - k + 1, 1)
    start = np.concatenate(([0], np.cumsum(size)))
    own = np.repeat(np.arange(len(full)), size)
    place = np.arange(start[-1]) - start[own]
    at = first[full][own] + place
    gram = np.zeros(start[-1], np.uint64)
    for i in range(k):          # a text shorter than k words has one shingle of all of them
        inside = i < n[full][own]
        gram = np.where(inside, mix(gram * np.uint64(3) + words[np.minimum(at + i, len(words) - 1)]), gram)
    key = mix(gram + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    i = np.arange(len(order))
    nth = np.empty(len(order), np.uint64)
    nth[order] = (i - np.maximum.accumulate(np.where(same, 0, i))).astype(np.uint64)
    label = mix(gram + nth * np.uint64(0xC2B2AE3D27D4EB4F))
    bits = max(20, int(len(label)).bit_length())
    low = np.uint64((1 << bits) - 1)
    here = i.astype(np.uint64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(n_sketches):
        seed = mix(np.array([t + 1], np.uint64))[0]
        v = (((label ^ seed) * np.uint64(0x9FB21C651E98DF25)) & ~low) | here
        a = (np.minimum.reduceat(v, start[:-1]) & low).astype(np.int64)
        if single:
            rows[full, t] = mix(label[a] ^ seed)
            continue
        v[a] = most
        b = np.minimum.reduceat(v, start[:-1])
        b = np.where(b == most, a, (b & low).astype(np.int64))
        rows[full, t] = mix(label[np.minimum(a, b)] * np.uint64(3) + label[np.maximum(a, b)])
    return rows


def _deletions(words: np.ndarray) -> list[int]:
    """Hashes of what is left of a text without any fifth of its words or fewer: texts within the limit share one."""
    most, w = len(words) // 5, words.tolist()
    left = {tuple(x for i, x in enumerate(w) if i not in out) for d in range(most + 1) for out in combinations(range(len(w)), d)}
    rows = np.zeros((len(left), len(w) + 1), np.uint64)
    for r, t in enumerate(left):
        rows[r, :len(t)] = t
        rows[r, -1] = len(t)
    h = np.zeros(len(left), np.uint64)
    for c in rows.T:
        h = mix(h * np.uint64(3) + c)
    return h.tolist()


def bucket_keys(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words and the keys of the buckets of each text, of one to three families by its length.

    Lengths of two families overlap by more than a fifth, so that any pair that can be linked has one in common.
    """
    data, off = text_buffer(column, lower=True)
    n_words, out = np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
    for lo, hi in row_slices(off):
        words, first = word_hashes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], ~SPACE)
        n = np.diff(first)
        n_words[lo:hi] = n
        for i in np.flatnonzero((n > 0) & (n <= TINY)):
            out[lo + i].append(np.array(_deletions(words[first[i]:first[i + 1]]), np.uint64))
        for k, sketches_, single, least, most in ((SHORT_K, SKETCHES, False, *SHORT), (K, SKETCHES, True, *LONG)):
            rows = np.flatnonzero((n >= least) & (n <= most))
            if len(rows):
                some = np.concatenate([words[first[i]:first[i + 1]] for i in rows])
                at = np.concatenate(([0], np.cumsum(n[rows])))
                mh = _order_minhash(some, at, n[rows], k, sketches_, single)
                mh = mix(mh + (np.arange(sketches_, dtype=np.uint64) + np.uint64(1000 * k)) * np.uint64(0x9E3779B97F4A7C15))
                for i, row in zip(rows, mh):
                    out[lo + i].append(row)
    return n_words, [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in out]


def _bags(column: pa.Array) -> list[bytes]:
    """Counts of each text's words, hashed to a power of two of bins, one byte each (255 stands for more).

    Half the sum of the differences of two bags, folded to the same size, never exceeds what the edits can change.
    """
    data, off = text_buffer(column, lower=True)
    out = []
    for lo, hi in row_slices(off):
        words, first = word_hashes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], ~SPACE)
        for a, b in zip(first[:-1], first[1:]):
            size = min(max(1 << int(b - a).bit_length() - 1 if b > a else 0, BINS[0]), BINS[1])
            out.append(np.minimum(np.bincount((words[a:b] & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes())
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """node (hash of the text), doc_id, n_words, bag, sketch of every text that is not NULL."""
    d = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("node"), "text")

    def run(b: pa.RecordBatch):
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            n, keys = bucket_keys(part.column("text"))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            flat = pa.array(np.concatenate(keys).view(np.int64))
            yield {"doc_id": part.column("doc_id"), "node": part.column("node"), "n_words": n, "bag": pa.array(_bags(part.column("text")), pa.binary()),
                   "sketch": pa.ListArray.from_arrays(pa.array(ends), flat)}

    return arrow_map(d, run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("node", T.LongType()),
                                           T.StructField("n_words", T.LongType()), T.StructField("bag", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))]))


# ---- verification -----------------------------------------------------------------------------------

def _band(where: dict, a_len: int, b: list, k: int) -> int:
    """Edit distance of a (given by `where`) and b if it is at most k, else a value above k.

    Bit t of a column j stands for row j - k + t; the vectors hold the vertical steps of one column inside the band.
    """
    width = 2 * k + 1
    mask = (1 << width) - 1
    up, down = mask & ~((1 << k) - 1), 0
    top = 1 << (2 * k)
    dist = min(k, a_len)
    for j in range(1, len(b) + 1):
        lo = j - k - 1
        word, pm = b[j - 1], 0
        for block in range(max(lo, 0) // _BLOCK, (lo + width - 1) // _BLOCK + 1):
            bits = where.get((word, block))
            if bits:
                shift = block * _BLOCK - lo
                pm |= bits << shift if shift >= 0 else bits >> -shift
        pm &= mask
        diag = ((((pm & up) + up) ^ up) | pm | down) & mask
        right = down | (mask & ~(diag | up))
        left = diag & up
        if j + k <= a_len:
            dist += not diag & top
        else:
            at = 1 << (a_len - j + k)
            dist += bool(right & at) - bool(left & at)
        diag >>= 1
        up, down = left | (mask & ~(diag | right)), diag & right
    return dist


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Word edit distance if it is at most `most`, else None; the band doubles until it holds the alignment."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    if not a or not b:
        d = len(a) + len(b)
        return d if d <= most else None
    if max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > most:
        return None
    where: dict = {}
    for i, w in enumerate(a):
        key = (w, i // _BLOCK)
        where[key] = where.get(key, 0) | 1 << (i % _BLOCK)
    k = max(8, abs(len(a) - len(b)))
    if abs(len(a) - len(b)) > most:
        return None
    while True:
        k = min(k, most)
        d = _band(where, len(a), b, k)
        if d <= k:
            return d
        if k >= most:
            return None
        k *= 2


def linked(a: str, b: str) -> bool:
    return linked_words(a.lower().encode().split(), b.lower().encode().split())


def linked_words(x: list, y: list) -> bool:
    most = max(len(x), len(y)) * (100 - SIMILARITY_PERCENT) // 100
    return bool(x) and bool(y) and abs(len(x) - len(y)) <= most and edit_distance(x, y, most) is not None


# ---- pairs of a bucket ------------------------------------------------------------------------------

def _near_pairs(cls: np.ndarray, n: np.ndarray, side: np.ndarray, lead: np.ndarray, bags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the pairs of different classes that may be linked, the likeliest first.

    `side` is the piece of each row: rows of two pieces pair across them, rows of one piece with each other.  `lead`
    marks a bucket's first text, whose pairs have been tried before.
    """
    across = side.min() != side.max()
    size = np.array([len(b) for b in bags])
    at, left, right, bound = np.argsort(n, kind="stable"), [], [], []
    for m in np.unique(size):
        own, twice = at[size[at] == m], at[size[at] == 2 * m]
        rows = np.concatenate((own, twice))
        flat = np.frombuffer(b"".join(bags[i] for i in own), np.uint8).reshape(-1, m).astype(np.int16)
        fold = np.frombuffer(b"".join(bags[i] for i in twice), np.uint8).reshape(-1, 2, m).sum(1, dtype=np.int16)
        counts = np.minimum(np.concatenate((flat, fold)), 255).astype(np.int16)
        total = counts.sum(1, dtype=np.int64)
        length = n[rows]
        for x in range(len(own)):       # own is in order of length, and so is twice
            if lead[rows[x]]:
                continue
            j = np.arange(x + 1, len(rows))
            most = np.maximum(length[j], length[x]) * (100 - SIMILARITY_PERCENT) // 100
            ok = (np.abs(length[j] - length[x]) <= most) & (cls[rows[j]] != cls[rows[x]]) & ~lead[rows[j]]
            if across:
                ok &= side[rows[j]] != side[rows[x]]
            j, most = j[ok], most[ok]
            if not len(j):
                continue
            more = np.maximum(counts[j] - counts[x], 0).sum(1, dtype=np.int64)
            d = np.maximum(more, more - total[j] + total[x])
            ok = d <= most
            left.append(np.full(int(ok.sum()), rows[x]))
            right.append(rows[j[ok]])
            bound.append(d[ok])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.concatenate(bound), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def _by_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """`work` maps the rows of a block (an Arrow table) to a record batch; a task holds one block at a time."""
    rows = rows.repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column("block").to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()
            if kept and kept[0].column("block")[0].as_py() != block[0]:
                yield from work(pa.Table.from_batches(kept))
                kept = []
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                kept.append(b.slice(lo, hi - lo))
                if hi < b.num_rows:       # the last block may go on in the next batch
                    yield from work(pa.Table.from_batches(kept))
                    kept = []
        if kept:
            yield from work(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, schema)


_ROW = "block long, key long, side long, lead boolean, class long, node long"


def _partners(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of every block (see _ROW) that have a partner the bags allow; never more rows than there are."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        side, lead, cls, n = (t.column(c).to_numpy() for c in ("side", "lead", "class", "n_words"))
        i, j = _near_pairs(cls, n, side, lead, t.column("bag").to_pylist())
        if len(i):
            keep = pa.array(np.unique(np.concatenate((i, j))))
            yield t.select([c.split()[0] for c in _ROW.split(", ")]).take(keep).combine_chunks().to_batches()[0]

    return _by_block(rows.join(nodes.select("node", "n_words", "bag"), "node").select(*[c.split()[0] for c in _ROW.split(", ")], "n_words", "bag"), work, _ROW)


def _links(partners: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, leader) of the pairs that align, without those that others of their block already hold together.

    A pair that shares several buckets is aligned in the one with the least key; at most rows - 1 links leave a block.
    """

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        side, lead, cls, node, key = (t.column(c).to_numpy() for c in ("side", "lead", "class", "node", "key"))
        column = t.column("text").combine_chunks()
        data, off = text_buffer(column, lower=True)
        words: list[np.ndarray] = []
        for lo, hi in row_slices(off):
            w, first = word_hashes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], ~SPACE)
            words += [w[a:b] for a, b in zip(first[:-1], first[1:])]
        keys = [np.asarray(x) for x in t.column("sketch").to_pylist()]
        lists: dict[int, list] = {}
        root = {c: c for c in set(cls.tolist())}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for i, j in zip(*_near_pairs(cls, np.array([len(w) for w in words]), side, lead, _bags(column))):
            a, b = find(int(cls[i])), find(int(cls[j]))
            if a == b or (key[i] != 0 and np.intersect1d(keys[i], keys[j], assume_unique=True)[0] != key[i]):
                continue
            x, y = (lists.setdefault(int(r), words[r].tolist()) for r in (i, j))
            if linked_words(x, y):
                root[max(a, b)] = min(a, b)
                found.append((int(node[i]), int(node[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in found]), pa.array([min(p) for p in found])], names=["node", "leader"])

    return _by_block(partners.join(texts, "node").select(*[c.split()[0] for c in _ROW.split(", ")], "text", "sketch"), work, "node long, leader long")


def _pieces(n: str = "n", words: str = "words") -> Column:
    """Pieces of a bucket by its texts and their words."""
    return F.greatest(F.ceil(F.col(n) / PIECE), F.ceil(F.col(words) / PIECE_WORDS), F.lit(1).cast("long"))


def _first_rows(members: DataFrame) -> DataFrame:
    """Blocks of every bucket's first text with the other texts of its buckets: they pair with it alone."""
    first = members.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit("first"), "node").alias("p"), "node")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    led = members.join(first.select("key", F.col("f.node").alias("leader")), "key").filter("node <> leader").select("node", "leader", "n_words").distinct()
    size = led.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).select("leader", _pieces().alias("pieces"))
    follow = led.join(size, "leader").select(F.xxhash64("leader", F.pmod(F.xxhash64(F.lit("piece"), "node"), F.col("pieces"))).alias("block"), "node", F.lit(1).alias("side"))
    lead = size.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")).select(
        F.xxhash64("leader", "piece").alias("block"), F.col("leader").alias("node"), F.lit(0).alias("side"))
    return follow.unionByName(lead).select("block", F.lit(0).cast("long").alias("key"), F.col("side").cast("long").alias("side"), F.lit(False).alias("lead"), F.col("node").alias("class"), "node")


def _bucket_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """Blocks of the buckets that still hold several classes: every piece of a bucket with every piece."""
    roots = components(links, "node", "leader")
    m = members.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    first = F.min(F.struct(F.xxhash64(F.lit("first"), "node").alias("p"), "node"))["node"].alias("leader")
    mixed = m.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.bit_xor(F.xxhash64(F.lit("set"), "node")).alias("set"), F.min("class").alias("a"),
                                 F.max("class").alias("b"), first).filter("a <> b")
    once = mixed.groupBy("n", "set").agg(F.min(F.struct("key", "leader", "words")).alias("k"))      # buckets of the very same texts
    once = once.select("k.key", "k.leader", _pieces("n", "k.words").alias("pieces"))
    piece = F.pmod(F.xxhash64(F.lit("piece"), "node"), F.col("pieces"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("o")
    b = m.join(once, "key").select("node", "class", "key", (F.col("node") == F.col("leader")).alias("lead"), piece.alias("side"), other)
    block = F.xxhash64("key", F.least("side", "o"), F.greatest("side", "o")).alias("block")
    return b.select(block, "key", "side", "lead", "class", "node")


# ---- classes ----------------------------------------------------------------------------------------

def duplicate_classes(docs: DataFrame) -> DataFrame:
    """node, class_id, keeper, n_links for every text of docs (doc_id, text) that is not NULL."""
    nodes = stored(sketches(docs).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.max("n_words").alias("n_words"), F.first("bag").alias("bag")))
    members = nodes.filter("n_words > 0").select("node", "n_words", F.explode("sketch").alias("key"))
    members = stored(members.join(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key"))
    d = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("node"), "doc_id", "text")
    links, scrap = None, [members]
    for _ in ("first texts", "all pairs"):
        rows = _first_rows(members) if links is None else _bucket_rows(members, links)
        partners = stored(_partners(rows, nodes))
        wanted = partners.select("node").distinct()
        rep = nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("rep"), "sketch")
        # Joined on the document too, so that a large group of copies does not meet in one task.
        same = (F.col("d.node") == F.col("r.node")) & F.col("doc_id").eqNullSafe(F.col("rep"))
        texts = d.alias("d").join(rep.alias("r"), same).select("d.node", "text", "sketch").dropDuplicates(["node"])
        found = stored(_links(partners, texts))
        discard(partners)
        scrap.append(found)
        links = found if links is None else links.unionByName(found)
    roots = components(links, "node", "leader")
    degree = links.select("node").unionAll(links.select("leader")).groupBy("node").agg(F.count("*").alias("n_links"))
    rooted = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k")
    least = rooted.groupBy("root").agg(keeper).select("root", F.col("k.doc_id").alias("class_id"), F.col("k.node").alias("keeper"))
    out = rooted.join(least, "root").join(degree, "node", "left").select("node", "class_id", "keeper", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = stored(out)
    discard(nodes, *scrap)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, keeper (the document of its class that stays) and n_links of every row.

    n_links counts the verified links that the search kept for the row's text; they hold its class together.
    """
    d = need(docs, "doc_id", "text")
    classes = duplicate_classes(d)
    rows = d.select("doc_id", F.xxhash64("text").alias("node"), F.col("text").isNull().alias("none")).join(classes, "node", "left")
    class_id = F.when(F.col("none"), F.col("doc_id")).otherwise(F.col("class_id"))
    stays = F.col("none") | ((F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    return rows.select("doc_id", class_id.alias("class_id"), stays.alias("keeper"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one per class, with all columns, and every row whose text is NULL."""
    classes = duplicate_classes(need(docs, "doc_id", "text"))
    stays = classes.select(F.xxhash64("class_id", "keeper").alias("key")).distinct()
    row, key = free_name(docs, "row"), free_name(docs, "key")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.xxhash64("doc_id", F.xxhash64("text")).alias(key))
    texts = keyed.filter(F.col(row)["text"].isNotNull()).join(stays.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key])
    return texts.unionByName(keyed.filter(F.col(row)["text"].isNull())).select(f"{row}.*")
