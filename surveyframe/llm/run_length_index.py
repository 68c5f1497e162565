"""Long repeated passages through run-length compressed Burrows-Wheeler transforms.

A byte is repeated when a string of `window` bytes that covers it also starts anywhere else in the corpus.

1. Routing.  Every window picks an anchor, the GRAM-byte string in it with the smallest hash (leftmost on ties).
   Windows that pick the same anchor are neighbours and form one segment of at most 2 windows.  Equal windows pick
   equal anchors at the same place, so only segments with the same anchor can share a window; anchors that occur
   once are dropped.  Equal segments are collapsed to one with its number of occurrences, those in a row (periodic
   text) already where they are found.
2. Index.  Different segments with the same anchor meet in a block of bounded size.  The block's suffixes are
   sorted, its transform is cut into runs, and only the text positions at the ends of runs are kept, with the length
   of the match to the neighbouring suffix.
3. Matching statistics are streamed through the text from those samples: inside a run the match of the next
   position is one shorter, so each position takes the nearest sample before it.  A position whose match reaches
   the window length starts a repeated window.  A segment that was collapsed from several is repeated as a whole.
4. The repeated spans of a document are merged and cut out.

An anchor whose different segments exceed `hot_bytes` is not gathered: all windows of its segments are counted by a
95-bit hash, with partial sums before the shuffle.  Nothing is sampled or capped.

Defined cases: a NULL text counts as empty; repeated rows repeat each other, so long ones go; texts below the window
length stay whole; an empty table gives no rows; `doc_id` may be NULL or repeated; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, free_name, mix, prefix_hash, row_keys, row_slices, span_hash, stored, text_buffer

WINDOW, GRAM = 400, 24
BLOCK_BYTES, HOT_BYTES = 3 << 19, 2 << 20
_PLACE_BITS = 20


# ---- 1. routing -------------------------------------------------------------------------------------

def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys."""
    n = len(key)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """row, a (start in the slice), ln, kg (hash of the anchor), cx (hash of the segment and the anchor's place in it).

    c equal segments in a row are one entry; `span` is the length they cover together.
    """
    n = len(data)
    none = {c: np.zeros(0, np.int64) for c in ("row", "a", "ln", "kg", "cx", "c", "span")}
    if n < window:
        return none
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    full = span_hash(prefix, at, at + gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    best = _sliding_min((full & ~low) | at.astype(np.uint64), window - gram + 1)
    place = (best & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(row[:n - window + 1] == row[window - 1:])
    if not len(inside):
        return none
    p = place[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (p[1:] != p[:-1]) | (np.diff(inside) != 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(inside)) - 1
    a, end, p = inside[head], inside[tail] + window, p[head]
    cx = mix(span_hash(prefix, a, end) ^ ((p - a).astype(np.uint64) << np.uint64(40)))
    kg = full[p]
    new = np.ones(len(a), bool)
    new[1:] = (kg[1:] != kg[:-1]) | (cx[1:] != cx[:-1]) | (row[a[1:]] != row[a[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(a)) - 1
    return {"row": row[a[head]], "a": a[head], "ln": (end - a)[head], "kg": kg[head].view(np.int64), "cx": cx[head].view(np.int64),
            "c": tail - head + 1, "span": end[tail] - a[head]}


def _occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """r1, r2, kg, cx, a, ln, c, span of every segment of every text; texts are cut into overlapping slices where huge."""
    step = (1 << _PLACE_BITS) - 2 * window

    def run(b: pa.RecordBatch):
        data, off = text_buffer(b.column("text"))
        r1, r2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("r1", "r2"))
        for lo, hi in row_slices(off, step):
            start, stop = int(off[lo]), int(off[hi])
            for at in range(start, max(stop, start + 1), step):
                end = min(stop, at + step + window - 1)
                if at > start and end - at < window:
                    break
                s = segments(data[at:end], np.clip(off[lo:hi + 1], at, end) - at, window, gram)
                row = s.pop("row") + lo
                s["a"] = s["a"] + at - off[row]
                yield s | {"r1": r1[row], "r2": r2[row]}

    return arrow_map(docs.select("r1", "r2", "text"), run, "r1 long, r2 int, kg long, cx long, a long, ln int, c int, span long")


# ---- 2. and 3. index and matching statistics --------------------------------------------------------

def suffix_order(data: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Positions in suffix order, by prefix doubling over those still tied.

    rest: bytes from a position to the end of its segment; ends sort below all bytes, by position.  data is padded.
    """
    n, h = len(rest), 7
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = (key << np.uint64(8)) | np.where(rest > i, data[i:n + i], 0).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(rest, h).astype(np.uint64)
    act = np.argsort(key, kind="stable")
    k = key[act]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (rest[act[1:]] < h)
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[act] = group
    while True:
        alone = new & np.append(new[1:], True)
        act, old = act[~alone], group[~alone]
        if not len(act):
            break
        k = (old.astype(np.uint64) << np.uint64(32)) | rank[act + h].astype(np.uint64)
        o = np.argsort(k, kind="stable")
        act, k, old = act[o], k[o], old[o]
        i = np.arange(len(act))
        new = np.ones(len(act), bool)
        new[1:] = k[1:] != k[:-1]
        opened = np.ones(len(act), bool)
        opened[1:] = old[1:] != old[:-1]
        group = old + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(opened, i, 0))
        rank[act] = group
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _match(words: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at i and j, within their segments; eight bytes a step."""
    most = np.minimum(rest[i], rest[j])
    out = most.copy()
    live = np.flatnonzero(most > 0)
    at = 0
    while len(live):
        x = words[i[live] + at] ^ words[j[live] + at]
        differs = x != 0
        d = live[differs]
        x = x[differs]
        same = np.zeros(len(x), np.int64)
        for byte in range(7, 0, -1):        # leading zero bytes
            same = np.where(x < np.uint64(1 << (8 * byte)), 8 - byte, same)
        out[d] = np.minimum(most[d], at + same)
        live = live[~differs]
        at += 8
        live = live[most[live] > at]
    return out


class RunLengthIndex:
    """The run ends of the transform of a few segments, and the match lengths sampled there."""

    def __init__(self, parts: list[bytes]):
        self.length = np.array([len(p) for p in parts], np.int64)
        self.data = np.frombuffer(b"\x00".join(parts) + b"\x00" * 9, np.uint8)
        n = int(self.length.sum()) + len(parts)
        self.start = np.concatenate(([0], np.cumsum(self.length + 1)))[:-1]
        rest = np.repeat(self.start + self.length, self.length + 1) - np.arange(n)
        data = self.data[:n]
        order = suffix_order(self.data, rest)
        last = data[order - 1].astype(np.int64)
        at_start = np.zeros(n, bool)
        at_start[self.start] = True
        last[at_start[order]] = -1 - np.flatnonzero(at_start[order])        # segment starts end runs
        change = last[1:] != last[:-1]
        head, tail = np.flatnonzero(change) + 1, np.flatnonzero(change)
        words = np.zeros(n + 1, np.uint64)
        for i in range(8):
            words[:n] = (words[:n] << np.uint64(8)) | self.data[i:n + i].astype(np.uint64)
        self.n, self.n_runs = n, len(head) + 1
        self.samples = [(order[head], _match(words, rest, order[head], order[head - 1])), (order[tail], _match(words, rest, order[tail], order[tail + 1]))]

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest match that starts there and at another position, streamed from the samples."""
        out = np.zeros(self.n, np.int64)
        i = np.arange(self.n)
        for where, length in self.samples:
            reach = np.zeros(self.n, np.int64)
            at = np.zeros(self.n, np.int64)
            at[where], reach[where] = where, where + length
            out = np.maximum(out, reach[np.maximum.accumulate(at)] - i)
        return out

    def repeated(self, window: int) -> list[list[tuple[int, int]]]:
        """Per segment the [start, end) spans covered by a window that also starts elsewhere."""
        starts = np.flatnonzero(self.matching_statistics() >= window)
        out: list[list[tuple[int, int]]] = [[] for _ in self.start]
        if len(starts):
            cut = np.flatnonzero(np.diff(starts) > 1) + 1
            for run in np.split(starts, cut):
                p = int(np.searchsorted(self.start, run[0], "right")) - 1
                out[p].append((int(run[0] - self.start[p]), int(run[-1] - self.start[p] + window)))
        return out


def _index_blocks(window: int):
    """One block: index its different segments, report the spans of those that occur once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = RunLengthIndex(pdf["bytes"].tolist()).repeated(window)
        once = (pdf["m"] == 1).to_numpy()
        r1, r2, a = (pdf[c].to_numpy() for c in ("r1", "r2", "a"))
        rows = [(r1[i], r2[i], a[i] + s, e - s) for i, spans in enumerate(found) if once[i] for s, e in spans]
        return pd.DataFrame(rows, columns=["r1", "r2", "a", "ln"])

    return run


def _count_windows(segs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The way for hot anchors: r1, r2, a, ln of the windows of single segments that occur more than once.

    A window travels as two longs: x, its hash, and y, 32 more bits of it with its place and whether its segment was
    collapsed (2) or not (1).  Windows are counted with partial sums, runs of repeated ones become one span.
    segs: kg, cx, m, bytes, rest; places: r1, r2, a, kg, cx.
    """

    def run(b: pa.RecordBatch):
        for kg, sid, m, raw in zip(b.column("kg").to_pylist(), b.column("sid").to_pylist(), b.column("m").to_pylist(), b.column("bytes")):
            data = np.frombuffer(raw.as_py(), np.uint8)
            at = np.arange(len(data) - window + 1)
            prefix = prefix_hash(data)
            x = mix(span_hash(prefix, at, at + window) ^ np.uint64(kg & 0xFFFFFFFFFFFFFFFF))
            y = span_hash(prefix, at, at + window // 2) >> np.uint64(33)
            yield {"x": x.view(np.int64), "sid": np.full(len(at), sid), "y": (y.astype(np.int64) << 32) | (at << 2) | min(m, 2)}

    id_of = F.xxhash64("kg", "cx").alias("sid")
    w = arrow_map(segs.select("kg", id_of, "m", "bytes", "rest"), run, "x long, sid long, y long")     # rest: see repeated_spans
    half = F.shiftright("y", 32).alias("half")
    twice = w.groupBy("x", half).agg(F.sum(F.col("y").bitwiseAND(3)).alias("n")).filter("n > 1").select("x", "half")
    single = w.filter(F.col("y").bitwiseAND(3) == 1).select("x", half, "sid", F.shiftright(F.col("y").bitwiseAND(0xFFFFFFFF), 2).alias("o"))
    at = single.join(twice, ["x", "half"], "left_semi").groupBy("sid").agg(F.collect_set("o").alias("o"))        # bounded by the segment
    first = F.sort_array(F.filter("o", lambda i: ~F.array_contains("o", i - 1)))
    last = F.sort_array(F.filter("o", lambda i: ~F.array_contains("o", i + 1)))
    runs = at.select("sid", F.explode(F.arrays_zip(first.alias("f"), last.alias("l"))).alias("r"))
    return places.select("r1", "r2", "a", id_of).join(runs, "sid").select("r1", "r2", (F.col("a") + F.col("r.f")).alias("a"), (F.col("r.l") - F.col("r.f") + window).alias("ln"))


# ---- 4. whole corpus --------------------------------------------------------------------------------

def repeated_spans(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """r1, r2 and the set of spans (a, ln) that are repeated, from a table of r1, r2, text and the other columns, rest.

    `rest` goes along so that all joins with the texts read the same columns and Spark shuffles the texts once.
    """
    occ = stored(_occurrences(keyed, window, gram))
    several = occ.groupBy("kg").agg(F.sum("c").alias("n"), F.min("cx").alias("lo"), F.max("cx").alias("hi")).filter("n > 1")
    occ = stored(occ.join(several, "kg"))
    # Inside copies all segments of an anchor are equal, which the two extremes tell; only the others are grouped.
    mixed, span = occ.filter("lo <> hi"), ["r1", "r2", "a", F.col("span").alias("ln")]
    seg = mixed.groupBy("kg", "cx").agg(F.sum("c").alias("m"), F.max("n").alias("n"), F.min(F.struct("r1", "r2", "a", "ln")).alias("o"))
    seg = stored(seg.select("kg", "cx", "m", "n", "o.*"))
    whole = occ.filter("lo = hi").select(*span).unionByName(
        mixed.join(seg.filter("m > 1").select("kg", "cx"), ["kg", "cx"], "left_semi").select(*span))

    met = seg
    volume = met.groupBy("kg").agg(F.sum("ln").alias("bytes"))
    hot = stored(volume.filter(F.col("bytes") > hot_bytes).select("kg"))
    blocks = max(1, -(-(met.agg(F.sum("ln")).first()[0] or 0) // block_bytes))
    cuts = met.groupBy("r1", "r2").agg(F.collect_list(F.struct("kg", "cx", "m", "a", "ln")).alias("cuts"))      # bounded by the text
    joined = keyed.join(cuts, ["r1", "r2"]).dropDuplicates(["r1", "r2"])
    raw = F.encode(F.col("text"), "UTF-8")
    pieces = joined.select("r1", "r2", "rest", F.explode(F.transform("cuts", lambda c: F.struct(
        c["kg"].alias("kg"), c["cx"].alias("cx"), c["m"].alias("m"), c["a"].alias("a"), F.substring(raw, (c["a"] + 1).cast("int"), c["ln"]).alias("bytes")))).alias("c"))
    pieces = pieces.select("r1", "r2", "rest", "c.*")
    is_hot = not hot.isEmpty()
    cold = pieces.join(hot, "kg", "left_anti") if is_hot else pieces
    cold = cold.withColumn("block", F.pmod(F.xxhash64("kg"), F.lit(blocks)))
    marks = cold.groupBy("block").applyInPandas(_index_blocks(window), "r1 long, r2 int, a long, ln long")
    if is_hot:
        marks = marks.unionByName(_count_windows(pieces.join(hot, "kg", "left_semi"), met.join(hot, "kg", "left_semi"), window))
    return whole.unionByName(marks).groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "ln")).alias("spans"))


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of overlapping or adjoining spans (start, length)."""
    out: list[tuple[int, int]] = []
    for a, ln in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], a + ln)
        else:
            out.append((a, a + ln))
    return out


def _whole_words(text: bytes, a: int, b: int) -> tuple[int, int, int]:
    """(number, start, end) of the words of text that lie inside [a, b) from end to end."""
    while a < b and a > 0 and not text[a:a + 1].isspace() and not text[a - 1:a].isspace():
        a += 1
    while a < b < len(text) and not text[b - 1:b].isspace() and not text[b:b + 1].isspace():
        b -= 1
    inside = text[a:b]
    words = inside.split()
    lead = len(inside) - len(inside.lstrip())
    return len(words), a + lead, b - (len(inside) - len(inside.rstrip()) if words else 0)


def _cut(text: bytes, spans: list[tuple[int, int]], min_words: int = 0) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go and in how many maximal runs.

    With min_words a run goes only if it holds as many whole words, and then from its first to its last whole word.
    """
    runs = _runs(spans)
    if min_words:
        runs = [(a, b) for n, a, b in (_whole_words(text, *r) for r in runs) if n >= min_words]
    ends = [0, *(b for _, b in runs)]
    keep = [text[e:a] for e, a in zip(ends, [*(a for a, _ in runs), len(text)])]
    return b"".join(keep), sum(b - a for a, b in runs), len(runs)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES,
                   min_words: int = 0) -> DataFrame:
    """The columns of docs, then n_bytes, n_removed, n_spans, kept_sha256 and kept_text in one struct `repeats`.

    With min_words only maximal runs of as many whole words are cut, at word bounds; the others stay.
    kept_text is the kept bytes as text, without characters that a cut has split.  Where docs has a column of that
    name already, the struct's name gets a leading underscore.
    """
    name = free_name(docs, "repeats")
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(*row_keys(), "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    spans = repeated_spans(keyed, window, gram, block_bytes, hot_bytes)
    joined = keyed.join(spans, ["r1", "r2"], "left").select("text", "rest", "spans")

    def run(b: pa.RecordBatch):
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
            for text, found in zip(part.column("text"), part.column("spans")):
                raw = (text.as_py() or "").encode()
                kept, gone, runs = _cut(raw, [(s["a"], s["ln"]) for s in found.as_py() or ()], min_words)
                for c, v in zip(out, (len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"))):
                    out[c].append(v)
            yield out | {"text": part.column("text"), "rest": part.column("rest")}

    counts = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string").fields
    done = arrow_map(joined, run, T.StructType([joined.schema["text"], joined.schema["rest"], *counts]))
    columns = [F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]
    return done.select(*columns, F.struct(*[f.name for f in counts]).alias(name))
