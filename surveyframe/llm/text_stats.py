"""Counts of a text from its bytes, for quality rules and quality scores; whole record batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACE, mix, row_slices, text_buffer, word_hashes, word_spans

STATS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_bangs",
         "n_bars", "n_stops", "n_commas", "n_wide", "n_long_words", "n_short_words"]

SPACE_NOT = ~SPACE
_TABLES = {}
for _name, _bytes in (("n_symbols", b"#*$%&|<>"), ("n_upper", bytes(range(65, 91))), ("n_digits", bytes(range(48, 58))), ("n_bangs", b"!"), ("n_bars", b"|"),
                      ("n_stops", b".?"), ("n_commas", b",;:"), ("n_wide", bytes(range(0xC0, 0x100)))):
    _TABLES[_name] = np.zeros(256, np.uint8)
    _TABLES[_name][list(_bytes)] = 1
_TABLES["n_chars"] = (np.arange(256) & 0xC0 != 0x80).astype(np.uint8)
_TABLES["word_chars"] = (_TABLES["n_chars"].astype(bool) & ~SPACE).astype(np.uint8)


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def repeats(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per row: words inside k-word windows found twice or more in the row, and distinct words."""
    n_rows, n = len(first) - 1, len(words)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    own = mix(words + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(row[np.unique(own, return_index=True)[1]], minlength=n_rows)
    marked = np.zeros(n + 1, np.int64)
    if n >= k:
        gram = own[:n - k + 1].copy()
        for i in range(1, k):
            gram = mix(gram * np.uint64(3) + words[i:n - k + 1 + i])
        gram_at = np.flatnonzero(row[:n - k + 1] == row[k - 1:])
        gram = gram[gram_at]
        order = np.argsort(gram, kind="stable")
        s = gram[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(s), bool)
        hit[1:] |= same
        hit[:-1] |= same
        at = gram_at[order[hit]]
        np.add.at(marked, at, 1)
        np.add.at(marked, at + k, -1)
    covered = (np.cumsum(marked[:n]) > 0).astype(np.uint8)
    return _per_row(covered, first), distinct


def batch_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """Every count of STATS for each text of the column; a NULL counts as empty."""
    data, off = text_buffer(column)
    out = {c: np.zeros(len(column), np.int64) for c in STATS}
    for lo, hi in row_slices(off):
        part, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        for c, table in _TABLES.items():
            out[c][lo:hi] = _per_row(table[part], o)
        starts, ends = word_spans(part, o, SPACE_NOT)
        words, first = word_hashes(part, o, SPACE_NOT)
        out["n_words"][lo:hi] = np.diff(first)
        length = ends - starts
        out["n_long_words"][lo:hi] = _per_row((length > 15).astype(np.uint8), first)
        out["n_short_words"][lo:hi] = _per_row((length < 4).astype(np.uint8), first)
        out["n_repeat_words"][lo:hi], out["n_distinct_words"][lo:hi] = repeats(words, first)
    for i, t in enumerate(pc.fill_null(column, "").to_pylist()):
        out["n_lines"][i], out["n_dup_lines"][i] = dup_lines(t)
    return out
