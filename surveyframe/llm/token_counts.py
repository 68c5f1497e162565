"""Token counts with overlap resynchronisation.

A document up to `chunk` code points is encoded whole.  A longer one is encoded in overlapping chunks with
offsets; two neighbours are spliced at a boundary in their overlap that both encodings have, that lies before a
single space between two non-space characters (where the pre-tokenisers of these libraries always break), and
around which both give the same tokens.  Where no such boundary exists the overlap is doubled, up to the whole
of the chunk, after which the two chunks are encoded as one.  Memory is bounded by the chunk.

For byte-level BPE with the usual word pattern the same break is proven for every document, so the library
encodes each distinct word of a task once and counts are sums over words; other tokenisers get whole texts.

Defined cases: NULL and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, need

CHUNK, OVERLAP, AGREE, REMEMBERED = 1 << 16, 512, 4, 400_000


class Encoder:
    """One tokeniser file: counts of texts and (id, start, end) of every token of a chunk."""

    def __init__(self, path: str):
        self.by_word, self.first, self.later = False, {}, {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.lib = Tokenizer.from_file(path)
            self.lib.no_truncation()
            self.lib.no_padding()
            with open(path) as f:
                d = json.load(f)
            pre = d.get("pre_tokenizer") or {}
            self.by_word = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d.get("normalizer")
                            and all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in d["added_tokens"]))
            self.tokens = self._json_tokens
            self.count_all = lambda texts: [len(e) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            self.lib = SentencePieceProcessor(model_file=path)
            self.tokens = self._piece_tokens
            self.count_all = lambda texts: [len(x) for x in self.lib.encode(texts, num_threads=1)]

    def _json_tokens(self, text: str) -> list[tuple[int, int, int]]:
        e = self.lib.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]

    def _piece_tokens(self, text: str) -> list[tuple[int, int, int]]:
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80))).tolist()       # bytes to code points
        return [(p.id, at[p.begin], at[p.end]) for p in self.lib.encode(text, return_type="proto").pieces]

    def counts(self, texts: list[str]) -> list[int]:
        return self._by_word(texts) if self.by_word else self.count_all(texts)

    def _by_word(self, texts: list[str]) -> list[int]:
        """Sums over the words of each text; a word keeps the single space before it."""
        cut, new_first, new_later = [], {}, {}
        for t in texts:
            words = t.split(" ")
            if "" in words or any(w[0].isspace() or w[-1].isspace() for w in words):
                words = _joined(words)
            cut.append(words)
            if words[0] not in self.first:
                new_first[words[0]] = 0
            new_later.update((w, 0) for w in words[1:] if w not in self.later)
        for known, new, lead in ((self.first, new_first, ""), (self.later, new_later, " ")):
            if len(known) > REMEMBERED:
                known.clear()
                new = dict.fromkeys(w for ws in cut for w in (ws[1:] if lead else ws[:1]))
            if new:
                known.update(zip(new, self.count_all([lead + w for w in new])))
        return [self.first[w[0]] + sum(map(self.later.__getitem__, w[1:])) for w in cut]


def _joined(parts: list[str]) -> list[str]:
    """Undo the cuts at spaces that do not stand alone between two non-space characters."""
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and p and not out[-1][-1].isspace() and not p[0].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


def _alone(text: str, p: int) -> bool:
    return 0 < p < len(text) - 1 and text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()


def _common(text: str, left: list, lo: int, right: list, start: int, stop: int) -> tuple[int, int, int] | None:
    """(position, tokens of left before it, tokens of right before it) of a proven common boundary, or None.

    left and right hold tokens with offsets from lo and from start; positions lie between start and stop.
    """
    at_right = {}
    for j, (_, a, _) in enumerate(right):
        if a + start >= stop:
            break
        at_right.setdefault(_true_start(text, a + start), j)
    for i in range(len(left) - 1, -1, -1):
        p = _true_start(text, left[i][1] + lo)
        if p <= start:
            break
        j = at_right.get(p)
        if j is None or not _alone(text, p) or i < AGREE or j < AGREE:
            continue
        a = [(t, x + lo, y + lo) for t, x, y in left[i - AGREE:i + AGREE]]
        b = [(t, x + start, y + start) for t, x, y in right[j - AGREE:j + AGREE]]
        if len(a) == len(b) and a == b:
            return p, i, j
    return None


def _true_start(text: str, p: int) -> int:
    """A token's own space belongs to it, whether or not the library counts it in."""
    return p - 1 if p > 0 and text[p - 1:p] == " " and text[p:p + 1] != " " else p


def count_huge(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one long text from overlapping chunks."""
    lo, hi = 0, min(chunk, len(text))
    tokens, first, total = encoder.tokens(text[lo:hi]), 0, 0
    while hi < len(text):
        wide, found = overlap, None
        while True:
            start = max(lo, hi - wide)
            end = min(len(text), max(start + chunk, hi + 1))
            if start <= lo:     # nothing agreed in the whole chunk: one larger chunk instead
                tokens, hi, first = encoder.tokens(text[lo:end + chunk]), min(len(text), end + chunk), first
                break
            nxt = encoder.tokens(text[start:end])
            found = _common(text, tokens, lo, nxt, start, hi)
            if found and found[1] >= first:
                total += found[1] - first
                tokens, lo, hi, first = nxt, start, end, found[2]
                break
            wide *= 2
    return total + len(tokens) - first


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""
    d = need(docs, "doc_id", "text")

    def run(b: pa.RecordBatch):
        enc = encoder_of(tokenizer_path)
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            column = pc.fill_null(part.column("text"), "")
            texts = column.to_pylist()
            n = np.zeros(len(texts), np.int64)
            short = [i for i, t in enumerate(texts) if 0 < len(t) <= chunk]
            n[short] = enc.counts([texts[i] for i in short]) if short else 0
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = count_huge(enc, t, chunk, overlap)
            yield {"doc_id": part.column("doc_id"), "n_bytes": pc.binary_length(column), "n_tokens": n, "over_limit": n > limit}

    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return arrow_map(d, run, schema)
