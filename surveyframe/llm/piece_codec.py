"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the model's compiled character map (a double-array trie of UTF-8 keys): at every place the
longest key that fits is replaced, a code point without a key stays.  Each code point written remembers the byte
its source starts at, through removed white space, the dummy prefix and the escape of spaces.  The normalised text
is segmented, and the running lengths of the pieces, looked up in that record, give every piece's byte span in the
original text.  The bytes of an unknown code point share its span: the last one has it, the others are empty.

Segmentation is the library's, with a model whose own normaliser is switched off.  In a BPE model no merge crosses
a place that no piece spells, so where no piece has a space mark after another character the text is cut before
each run of marks and a task segments each distinct cut once; unigram models get whole texts.

Defined cases: NULL and empty texts have the begin and end ids only and decode to an empty text; repeated rows are
encoded each; an empty table gives no rows; other columns are ignored.  Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, need, row_slices

MARK = "▁"
REMEMBERED, LONG_CUT = 400_000, 256


class CharMap:
    """Longest-prefix replacement by a compiled character map, with the user's own symbols left as they are."""

    def __init__(self, blob: bytes, symbols: list[str] = ()):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.out = blob[4 + n:]
        heads = self._first_code_points()
        wanted = [re.escape(s) for s in sorted(symbols, key=len, reverse=True)]
        if heads:
            wanted.append("[" + "".join(re.escape(c) for c in heads) + "]")
        self.symbols = set(symbols)
        self.find = re.compile("|".join(wanted)).search if wanted else None

    def _child(self, node: int, byte: int) -> int | None:
        """The node one byte further, or None; a node is the position its children's labels are xor-ed to."""
        at = node ^ byte
        if at >= len(self.units):
            return None
        u = self.units[at]
        return at ^ self._offset(u) if u & 0x800000FF == byte else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _first_code_points(self) -> list[str]:
        """Every code point that begins a key (keys are whole code points)."""
        if not self.units:
            return []
        root, found = self._offset(self.units[0]), []
        todo = [(root, bytes())]
        while todo:
            node, path = todo.pop()
            if path:
                size = 1 if path[0] < 0x80 else 2 if path[0] < 0xE0 else 3 if path[0] < 0xF0 else 4
                if len(path) == size:
                    found.append(path.decode())
                    continue
            for b in range(0x80, 0xC0) if path else (*range(1, 0x80), *range(0xC2, 0xF5)):
                child = self._child(node, b)
                if child is not None:
                    todo.append((child, path + bytes([b])))
        return found

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """(bytes taken, replacement) of the longest key at a place."""
        node, best = self._offset(self.units[0]), None
        for i in range(at, len(raw)):
            here = node ^ raw[i]
            if here >= len(self.units) or self.units[here] & 0x800000FF != raw[i]:
                break
            node = here ^ self._offset(self.units[here])
            if self.units[here] >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        taken, text = best
        return taken, self.out[text:self.out.index(b"\0", text)].decode()

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        """The mapped text, and for each of its code points and its end the byte its source starts at."""
        raw = text.encode()
        b = np.frombuffer(raw, np.uint8)
        source = np.append(np.flatnonzero(b & 0xC0 != 0x80), len(raw))      # code points to bytes
        if self.find is None:
            return text, source
        parts, places, at = [], [], 0           # `at` is the next code point to write
        hit = self.find(text)
        while hit:
            lo = hit.start()
            found = None if hit.group() in self.symbols else self.longest(raw, int(source[lo]))
            if found is None:
                hi, new = hit.end(), hit.group()
                where = source[lo:hi]
            else:
                new = found[1]
                hi = int(np.searchsorted(source, source[lo] + found[0]))
                where = np.full(len(new), source[lo])
            parts += [text[at:lo], new]
            places += [source[at:lo], where]
            at = hi
            hit = self.find(text, at)
        return "".join(parts) + text[at:], np.concatenate([*places, source[at:]])


class Codec:
    """One SentencePiece model: ids, source spans and decoded text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        self.spec = pb.NormalizerSpec()
        self.spec.CopyFrom(model.normalizer_spec)
        self.lib = SentencePieceProcessor(model_file=path)
        kinds = pb.ModelProto.SentencePiece
        spelled = [p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        whole = model.denormalizer_spec.precompiled_charsmap or self.suffix or not self.spec.escape_whitespaces
        self.cuts = (model.trainer_spec.model_type == pb.TrainerSpec.BPE and not whole and MARK in spelled
                     and not any(re.search(f"[^{MARK}]{MARK}", p) for p in spelled))
        self.map = CharMap(self.spec.precompiled_charsmap, [p.piece for p in model.pieces if p.type == kinds.USER_DEFINED])
        model.normalizer_spec.CopyFrom(pb.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        self.plain = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.byte = np.array([int(p.piece[3:5], 16) if p.type == kinds.BYTE else -1 for p in model.pieces])
        self.length = np.array([len(p.piece) for p in model.pieces])
        self.unknown = self.lib.unk_id()
        self.first: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.later: dict[str, tuple[bytes, bytes, bytes]] = {}

    # ---- normalisation -----------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text that is segmented, and the source byte of each of its code points and of its end."""
        out, source = self.map.apply(text)
        if not text:
            return "", source
        if self.spec.remove_extra_whitespaces:
            c = np.frombuffer(out.encode("utf-32-le"), "<u4")
            blank = c == 0x20
            keep = ~blank
            keep[1:] |= blank[1:] & ~blank[:-1]
            keep[:1] = ~blank[:1]
            if blank.all():
                return "", source[:1]
            out, source = c[keep].tobytes().decode("utf-32-le"), np.append(source[:-1][keep], source[-1])
        if self.spec.escape_whitespaces:
            out = out.replace(" ", MARK)
        if self.spec.add_dummy_prefix:
            mark = MARK if self.spec.escape_whitespaces else " "
            if self.suffix:
                out, source = out + mark, np.append(source, source[-1:])
            else:
                out, source = mark + out, np.concatenate((source[:1], source))
        if self.spec.remove_extra_whitespaces:      # marks written in the text count as white space at the end
            n = len(out.rstrip(MARK if self.spec.escape_whitespaces else " ")) + (1 if self.suffix and self.spec.add_dummy_prefix else 0)
            out, source = out[:n], source[:n + 1]
        return out, source

    # ---- segmentation ------------------------------------------------------------------------------

    def _lengths(self, cuts: list[str], ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Code points of each piece; the bytes of a code point count 0, ..., 0, 1.  first: each cut's place in ids, and the end."""
        byte = self.byte[ids]
        more = np.append((byte[1:] & 0xC0) == 0x80, False) if len(ids) else np.zeros(0, bool)      # -1 marks no byte
        more &= np.append(byte[1:] >= 0, False)[:len(ids)]
        more[first[1:][first[1:] > 0] - 1] = False
        out = np.where(byte >= 0, ~more, self.length[ids]).astype("<u4")
        for i in np.unique(np.searchsorted(first, np.flatnonzero(ids == self.unknown), "right") - 1).tolist():
            at = np.cumsum([0, *(len(c.encode()) for c in cuts[i])])
            pieces = self.plain.encode(cuts[i], return_type="proto").pieces
            out[first[i]:first[i + 1]] = [np.searchsorted(at, p.end) - np.searchsorted(at, p.begin) for p in pieces]
        return out

    def _learn(self, known: dict, cuts: list[str], first: bool) -> None:
        """(ids, lengths, decoded) of cuts: packed integers and UTF-8."""
        all_ids = self.plain.encode(cuts, num_threads=1)
        begin = [self.lib.bos_id()] if self.lib.bos_id() >= 0 else []
        decoded = self.lib.decode([begin + x for x in all_ids]) if first else self.plain.decode(all_ids)
        at = np.concatenate(([0], np.cumsum([len(x) for x in all_ids])))
        ids = np.fromiter((t for x in all_ids for t in x), "<u4", at[-1])
        lengths, ids = self._lengths(cuts, ids, at).tobytes(), ids.tobytes()
        at = (4 * at).tolist()
        known.update((c, (ids[lo:hi], lengths[lo:hi], t.encode())) for c, lo, hi, t in zip(cuts, at, at[1:], decoded))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes, bytes]]:
        """(ids, starts, ends, decoded) of each text: little-endian 32-bit integers and UTF-8, begin and end ids included."""
        normal = [self.normalise(t) for t in texts]
        cuts = [re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", n) if self.cuts else [n] if n else [] for n, _ in normal]
        for known, new in ((self.first, {c[0] for c in cuts if c}), (self.later, {w for c in cuts for w in c[1:]})):
            if len(known) + len(new) > REMEMBERED:
                known.clear()
            fresh = [w for w in new if w not in known]
            if fresh:
                self._learn(known, fresh, known is self.first)
        begin, end = (np.array([i] if i >= 0 else [], "<u4").tobytes() for i in (self.lib.bos_id(), self.lib.eos_id()))
        out = []
        for (_, source), cut in zip(normal, cuts):
            found = ([self.first[cut[0]]] if cut else []) + [self.later[w] for w in cut[1:]]
            at = np.cumsum(np.frombuffer(b"".join([b"\0\0\0\0", *[f[1] for f in found]]), "<u4"), dtype=np.int64)
            spans = source[at].astype("<u4")
            lead, tail = spans[:len(begin) // 4].tobytes(), spans[-1:].tobytes() * (len(end) // 4)
            out.append((begin + b"".join([f[0] for f in found]) + end, lead + spans[:-1].tobytes() + tail,
                        lead + spans[1:].tobytes() + tail, b"".join([f[2] for f in found])))
        for known in (self.first, self.later):
            for w in [w for w in known if len(w) > LONG_CUT]:
                del known[w]
        return out


_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, packed: bool = False) -> DataFrame:
    """doc_id, ids, starts, ends, decoded of every text: ids with begin and end id, and each id's bytes [start, end).

    ids, starts and ends are integer arrays, or with `packed` little-endian unsigned 32-bit integers in a binary.
    """
    d = need(docs, "doc_id", "text")

    def run(b: pa.RecordBatch):
        codec = codec_of(model_path)
        column = pc.fill_null(b.column("text"), "")
        size = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))))
        for lo, hi in row_slices(size):
            found = codec.encode(column.slice(lo, hi - lo).to_pylist())
            columns = {"doc_id": b.column("doc_id").slice(lo, hi - lo), "decoded": pa.array([f[3] for f in found], pa.binary()).cast(pa.string())}
            for i, name in enumerate(("ids", "starts", "ends")):
                values = [f[i] for f in found]
                if packed:
                    columns[name] = pa.array(values, pa.binary())
                else:
                    ends = np.concatenate(([0], np.cumsum([len(v) // 4 for v in values]))).astype(np.int32)
                    columns[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), "<i4")))
            yield columns

    kind = "binary" if packed else "array<int>"
    return arrow_map(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids {kind}, starts {kind}, ends {kind}, decoded string")
