"""Collocations, vector codes and SentencePiece spans against brute force, the library and every odd case."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyframe.llm import collocations, piece_codec, queries, vector_codes


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=repr)


# ---- collocations -----------------------------------------------------------------------------------

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + s])) for s in range(1, longest + 1) for i in range(len(w) - s + 1))
    return f, n


def plain_collocations(rows, least=10, top=2000, percent=50, longest=3):
    f, n = plain_counts(rows, longest)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (g, p), a in cand.items():
        for s in range(2, len(p)):
            for i in range(len(p) - s + 1):
                held[g, p[i:i + s]] = max(held[g, p[i:i + s]], a)
    found = {}
    for (g, p), a in cand.items():
        if 100 * held[g, p] < percent * a:
            score, k = min((1000000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(g, []).append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return sorted(((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, v in found.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top])), key=repr)


def phrase_rows(seed=1):
    rng = random.Random(seed)
    parts = ["a", "B", "é", "x", " ", " ", " ", "\t", ".", "\n", "\x00", "the end", "\r", "  "]
    rows = [(rng.choice(["en", "EN", None, ""]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 30, 3000])))) for _ in range(120)]
    return rows + [(None, None), ("en", None), ("en", "w" * 3_000_000 + " a"), ("de", "hot pair " * 5000), ("de", "hot pair " * 5000)]


@pytest.mark.parametrize("setting", [{}, {"least": 3, "longest": 4, "top": 7}])
def test_collocations_equal_brute_force(spark, setting):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "c", "c") for r in rows], "lang string, text string, size int, f string, phrase string").repartition(3)
    small = {"bytes_per_partition": 1 << 18, "bits": 9}        # many partitions, and a bit table that fills up
    assert got(collocations.collocations(df, **setting, **small)) == plain_collocations(rows, **setting)
    assert got(collocations.collocations(df, **setting)) == plain_collocations(rows, **setting)
    assert collocations.collocations(df.filter("1 = 0")).count() == 0
    assert collocations.collocations(df.filter("text is null")).count() == 0


def test_the_best_come_from_any_number_of_lists(spark):
    rows = [("en", f"p{i:04d}", i % 97, i % 5) for i in range(2000)] + [("de", "q", 1, 1)]
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    out = collocations.best_of(spark.createDataFrame(rows, "lang string, phrase string, score int, a int"), "lang", order, 6, lists=4)
    want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[2], -r[3], r[1]))[:6]
    assert [r[1] for r in sorted(got(out.filter("lang = 'en'"), "rank", "phrase"))] == [r[1] for r in want]
    assert got(out.filter("lang = 'de'"), "rank", "phrase") == [(1, "q")]


@pytest.mark.parametrize("limit", [5, 40, 1 << 20])
def test_slices_of_huge_texts_count_every_phrase_once(limit):
    rows = [r for r in phrase_rows(3) if len(r[1] or "") < 10_000]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    for longest in (1, 3, 4):
        f, n = Counter(), Counter()
        for lang, data, off, skip in collocations.slices(batch, longest, limit):
            ids, words, piece = collocations.words_of(data, off)
            n[lang] += len(ids) - skip
            text = [w.decode() for w in words.to_pylist()]
            for size, places, count in collocations.grams(ids, piece, len(words), longest, skip):
                for p, c in zip(places.tolist(), count.tolist()):
                    f[lang, tuple(text[ids[p + j]] for j in range(size))] += c
        want = plain_counts(rows, longest)
        assert f == want[0] and +n == +want[1]


def test_names_of_phrases_that_do_not_fit_are_numbered_first():
    rng = np.random.default_rng(2)
    ids, piece = rng.integers(0, 3, 500), np.repeat(np.arange(50), 10)
    small = [(s, dict(zip(map(tuple, (tuple(ids[p:p + s]) for p in at)), n.tolist()))) for s, at, n in collocations.grams(ids, piece, 3, 5)]
    large = [(s, dict(zip(map(tuple, (tuple(ids[p:p + s]) for p in at)), n.tolist()))) for s, at, n in collocations.grams(ids, piece, 1 << 30, 5)]
    assert small == large


def test_summaries_keep_every_frequent_key_in_bounded_space():
    rng = np.random.default_rng(4)
    keys = np.concatenate([np.repeat(np.arange(50, dtype=np.uint64), 10), rng.integers(1000, 1 << 40, 3000).astype(np.uint64)])
    rng.shuffle(keys)
    s = collocations.Summary(len(keys) // 10 + 1)
    for part in np.array_split(keys, 60):
        k, c = np.unique(part, return_counts=True)
        s.merge(k, c)
        assert len(s.keys) <= s.capacity
    assert s.taken < 10 and set(range(50)) <= set(s.frequent(10).tolist())
    tight = collocations.Summary(80)          # merged summaries of any order give the same guarantee
    for part in np.array_split(np.concatenate([keys, np.full(2000, 7, np.uint64)]), 9):
        tight.merge(*np.unique(part, return_counts=True))
    assert 7 in tight.frequent(2000) and tight.taken <= (len(keys) + 2000) / 81


# ---- vector codes -----------------------------------------------------------------------------------

def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(x)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    books = [[k[1][p * w:(p + 1) * w] for k in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((s - t) ** 2 for s, t in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, b in enumerate(books):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(v[p * w:(p + 1) * w], b)[1], []).append(v[p * w:(p + 1) * w])
            new.append([[sum(c) // len(mine[j]) for c in zip(*mine[j])] if j in mine else e for j, e in enumerate(b)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, lab = [], Counter()
    for i, v, label in kept:
        c = [near(v[p * w:(p + 1) * w], b) for p, b in enumerate(books)]
        out.append((i, "".join("%02x" % j for _, j in c), sum(d for d, _ in c), label))
        lab[label] += out[-1][2]
    return sorted(((i, c, e, lab[label], sha) for i, c, e, label in out), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, code string, vec string, n int"


def vector_rows():
    rng = random.Random(1)
    rows = [(i if i % 7 else None, [rng.choice([0.0, -0.3, 1.5, 2.25, 1e-9, -7.0]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(3, [1.0] * 16, 1)] * 40 + [(4, None, 1), (5, [None] * 16, 1), (6, [math.nan] * 16, None), (7, [math.inf] * 16, None)]
    return rows


@pytest.mark.parametrize("rows", [vector_rows(), vector_rows()[:9], vector_rows() + [(50, [3e8] * 16, 2), (51, [-3e8, 2e9] * 8, 2)]], ids=["ties", "few", "large"])
def test_codes_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS).repartition(3)
    assert got(vector_codes.compress(df)) == plain_codes(rows)


def test_vectors_without_a_code(spark):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in [*vector_rows(), (60, [1.0] * 8, 1), (61, [], 1)]], VECTORS)
    assert got(vector_codes.compress(df)) == plain_codes(vector_rows())              # other lengths are left out
    assert vector_codes.compress(df.filter("1 = 0")).collect() == []
    odd = df.filter("embedding is null or size(embedding) = 0 or embedding[0] is null or isnan(embedding[0])")
    assert odd.count() == 4 and vector_codes.compress(odd).collect() == []


def test_the_trie_shares_beginnings_and_keeps_ties(monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 3)
    rng = np.random.default_rng(0)
    for high in (2, 5, 1000):
        parts, place, n = vector_codes.distinct(rng.integers(-high, high, (400, 4)))
        book = np.vstack([parts[:3], rng.integers(-high, high, (5, 4))])
        entry, error = vector_codes.assign(parts, book)
        dist = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry == dist.argmin(axis=1)).all() and (error == dist.min(axis=1)).all() and n.sum() == 400 and len(place) == 400


def test_packed_parts_keep_order_and_values():
    values = np.array([[-5, 3], [-5, 4], [0, -1], [7, 1 << 25], [1 << 40, -(1 << 61)]])
    for v in (values[:4], values):
        back = vector_codes.unpack(vector_codes.pack(v), 2)
        assert back.tolist() == v.tolist()
    packed = vector_codes.pack(values[:4]).to_pylist()
    assert packed == sorted(packed)
    assert vector_codes.unpack(vector_codes.pack(values[:4]).slice(2), 2).tolist() == values[2:4].tolist()


# ---- SentencePiece ----------------------------------------------------------------------------------

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def piece_texts():
    rng = random.Random(3)
    parts = [" ", "▁", "a", "é", "漢", "😀", "\n", "b", "the", "\x00", "﻿", "ﬁ", "<s>", "</s>", "<0x41>", "<unk>"]
    odd = ["", None, "  ", " a", "a  b\n c ", "▁x ▁▁ y", "漢字😀 é́", "x" * 5000, " " * 50, "\t\t a", "▁", "　全角　ﬁ", "株㌔ ①②ﬀ  Ａ　Ｂ ​ źé", "é́ Å ẛ̣ ﷺ x"]
    return odd + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["word " * 60_000]


def test_ids_spans_and_decoded_text_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = piece_texts()
    df = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string, starts string, decoded string").repartition(4)
    want = {}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        spans = [(p.begin, p.end) for p in lib.encode(t or "", return_type="proto").pieces]
        size = len((t or "").encode())
        spans = [(0, 0), *spans, (size, size)] if spans else [(0, 0), (0, 0)]
        want[i] = (ids, [s for s, _ in spans], [e for _, e in spans], lib.decode(ids))
    out = {r["doc_id"]: (r["ids"], r["starts"], r["ends"], r["decoded"]) for r in piece_codec.encode(df, MODEL).collect()}
    bad = [(texts[i], out[i], want[i]) for i in want if out[i] != want[i]]
    assert not bad[:1]
    packed = piece_codec.encode(df, MODEL, packed=True).filter("doc_id = 5").first()
    assert np.frombuffer(packed["ids"], "<u4").tolist() == want[5][0] and np.frombuffer(packed["ends"], "<u4").tolist() == want[5][2]
    assert piece_codec.encode(df.filter("1 = 0"), MODEL).collect() == []


def test_span_query_gives_the_digests(spark, tmp_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = piece_texts()[:60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got(queries.op13_piece_spans(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_maps_and_alignment_equal_the_library(rule, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze)
    codec = piece_codec.Codec.__new__(piece_codec.Codec)
    codec.spec = pb.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
    codec.suffix, codec.map = False, piece_codec.CharMap(codec.spec.precompiled_charsmap)
    for t in piece_texts()[:300]:
        text, source = codec.normalise(t or "")
        points = np.concatenate(([0], np.cumsum(np.frombuffer((t or "").encode(), np.uint8) & 0xC0 != 0x80)))      # the library counts code points
        starts = [int(points[s]) for s in source]
        assert (text, starts) == (lambda x: (x[0], list(x[1])))(lib.normalize(t or "", with_offsets=True)), repr(t)


def test_users_own_symbols_are_not_normalised():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    blob = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).normalizer_spec.precompiled_charsmap
    text, source = piece_codec.CharMap(blob, ["ﬁ", "ﬁx"]).apply("ﬁxﬁﬀ")
    assert text == "ﬁxﬁff" and source.tolist() == [0, 3, 4, 7, 7, 10]


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_folded_counters_add_up_equal_hashes(block):
    rng = np.random.default_rng(6)
    h = rng.choice(np.append(rng.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2), np.uint64((1 << 64) - 1)), 500)
    n = rng.integers(1, 14, 500)
    key, count = collocations.unpack(collocations.fold(collocations.pack(h, n, 10), 10, block), 10)
    want = Counter()
    for k, c in zip((h >> np.uint64(4)).tolist(), n.tolist()):
        want[k] += min(c, 10)
    assert dict(zip(key.tolist(), count.tolist())) == {k: min(c, 10) for k, c in want.items()} and (np.diff(key.astype(object)) > 0).all()
