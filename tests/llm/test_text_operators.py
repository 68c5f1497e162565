"""Operators over documents against brute force, on prose, copies and every odd case."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveyframe.llm import boosted_quality, common, decontamination, order_minhash, pivotal_mixing, quality_rules, run_length_index, token_counts, toxicity


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# ---- shared helpers ---------------------------------------------------------------------------------

def test_words_are_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    texts = ["b a  a", "", None, "a\x00 é\ta", "x" * (common.SLICE_BYTES + 5) + " a"]
    data, off = common.text_buffer(pa.array(texts))
    words, first = common.word_hashes(data, off, ~common.SPACE)
    split = [(t or "").encode().split() for t in texts]
    assert np.diff(first).tolist() == [len(s) for s in split]
    seen = {}
    for w, h in zip([w for s in split for w in s], words.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (5, 5)]
    roots = dict(got(common.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert roots == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 103)}


# ---- quality rules ----------------------------------------------------------------------------------

def plain_stats(text):
    text = text or ""
    w = text.encode().split()
    grams = list(zip(*[w[i:] for i in range(5)]))
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_and_base_rules(docs, rows, labels):
    out = quality_rules.quality_verdicts(docs, labels)
    want = []
    for r in rows:
        s = plain_stats(r[1])
        want.append((r[0], *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert out.filter("base_failed and kept").count() == 0


def test_cutoffs_reject_junk_within_the_certified_risk(spark):
    rng = random.Random(1)
    data, lab = [], []
    for i in range(3000):
        junk = i % 5 == 0
        w = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(40)]
        data.append((i, " ".join(x + "$$$" for x in w) if junk else " ".join(w), "en" if i % 4 else None, "s"))
        lab.append((i, int(not junk), 0))
    docs, labels = spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    cut = {r["stratum"]: r for r in quality_rules.fit_cutoffs(common.stored(quality_rules.document_stats(docs)), labels).collect()}
    assert set(cut) == {"en", None} and all(r["bound"] <= quality_rules.RISK for r in cut.values())
    kept = {r[0] for r in quality_rules.accept(docs, labels).select("doc_id").collect()}
    assert not any(i % 5 == 0 for i in kept) and len(kept) >= 0.95 * 2400
    few = quality_rules.fit_cutoffs(common.stored(quality_rules.document_stats(docs.filter("doc_id < 50"))), labels)
    assert all(r["step"] == -1 for r in few.collect())          # too few labels: nothing is certified


@pytest.mark.parametrize("k, n, delta", [(0, 100, 0.05), (3, 50, 0.01), (10, 10, 0.05), (0, 0, 0.05)])
def test_exact_bound(k, n, delta):
    from math import comb

    u = quality_rules.upper_bound(k, n, delta)
    if k >= n:
        assert u == 1.0
    else:
        assert abs(sum(comb(n, i) * u ** i * (1 - u) ** (n - i) for i in range(k + 1)) - delta) < 1e-6


def test_accept_keeps_all_columns(docs, labels):
    kept = quality_rules.accept(docs, labels)
    assert kept.columns == docs.columns
    want = quality_rules.quality_verdicts(docs, labels).filter("kept").select("doc_id")
    assert got(kept, "doc_id") == got(want, "doc_id")


# ---- near-duplicates --------------------------------------------------------------------------------

def plain_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.integers(0, 14))
def test_banded_distance(a, b, most):
    d = plain_distance(a, b)
    assert order_minhash.edit_distance(a, b, most) == (d if d <= most else None)


def test_classes_equal_brute_force(docs, rows):
    out = order_minhash.near_duplicates(docs)
    cls = {}
    for i, (d, t, *_) in enumerate(rows):
        cls[i] = i
    find = lambda i: i if cls[i] == i else find(cls[i])
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a is not None and b is not None and (a == b or (max(len(a), len(b)) < 20_000 and order_minhash.linked(a, b))):
                cls[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    want = [(r[0], min((x for x in ids[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]
    assert got(out, "doc_id", "class_id") == sorted(want, key=repr)


def test_one_document_of_each_class_stays(docs, rows):
    kept = order_minhash.one_per_class(docs)
    assert kept.columns == docs.columns
    classes = {c for _, c in got(order_minhash.near_duplicates(docs.filter("text is not null")), "doc_id", "class_id")}
    assert kept.filter("text is not null").count() == len(classes)
    assert kept.filter("text is null").count() == sum(r[1] is None for r in rows)


def test_recall_of_edited_copies(spark):
    rng = random.Random(2)
    data = []
    for i in range(150):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(40, 150))]
        data.append((2 * i, " ".join(w)))
        data.append((2 * i + 1, " ".join(x if rng.random() > 0.09 else "edit" for x in w)))
    out = dict(got(order_minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "class_id"))
    assert sum(out[2 * i + 1] == 2 * i for i in range(150)) >= 0.95 * 150
    assert len(set(out.values())) <= 158 and all(c in (d, d - 1) for d, c in out.items())


def test_order_matters_to_the_sketch():
    import pyarrow as pa

    w = [f"w{i}" for i in range(50)]
    _, s = order_minhash.bucket_keys(pa.array([" ".join(w), " ".join(w), " ".join(w[25:] + w[:25])]))
    assert s[0].tolist() == s[1].tolist() and len(np.intersect1d(s[0], s[2])) < 0.8 * len(s[0])


# ---- repeated passages ------------------------------------------------------------------------------

def plain_repeats(texts, window):
    raw = [(t or "").encode() for t in texts]
    n = Counter(x[i:i + window] for x in raw for i in range(len(x) - window + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if n[x[i:i + window]] > 1:
                gone[i:i + window] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window, gram, hot", [(400, 24, 2 << 20), (60, 8, 2 << 20), (60, 8, 100)])
def test_repeats_equal_brute_force(docs, rows, window, gram, hot):
    out = run_length_index.remove_repeats(docs.filter("length(text) < 20000 or text is null"), window, gram, block_bytes=20_000, hot_bytes=hot)
    some = [r for r in rows if r[1] is None or len(r[1]) < 20_000]
    want = [(r[0], *x) for r, x in zip(some, plain_repeats([r[1] for r in some], window))]
    name = out.columns[-1]
    assert name == "_repeats" and out.columns[:-1] == docs.columns
    assert got(out.select("doc_id", f"{name}.*"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5))
def test_matching_statistics(parts):
    index = run_length_index.RunLengthIndex(parts)
    ms = index.matching_statistics()
    for p, start in zip(parts, index.start):
        for i in range(len(p)):
            best = 0
            for q, other in zip(parts, index.start):
                for j in range(len(q)):
                    if start + i != other + j:
                        k = 0
                        while i + k < len(p) and j + k < len(q) and p[i + k] == q[j + k]:
                            k += 1
                        best = max(best, k)
            assert ms[start + i] == best


# ---- decontamination --------------------------------------------------------------------------------

def test_leaks_are_found_under_edits_and_clean_documents_are_not(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(40)] + [(90, None), (91, "a b"), (92, "")]
    data, true = [], {}
    for i in range(400):
        w = [word() for _ in range(rng.randint(0, 200))]
        if i % 2:
            k = rng.randrange(40)
            leak = items[k][1].split()
            edits = rng.randint(0, len(leak) // 10)
            for _ in range(edits):
                j = rng.randrange(len(leak))
                kind = rng.random()
                if kind < 0.5:
                    leak[j] = "edit"
                elif kind < 0.75:
                    leak.insert(j, "more")
                elif len(leak) > 5:
                    del leak[j]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," if rng.random() < 0.3 else x for x in leak]
            true[i] = k
        data.append((i, " ".join(w), "x"))
    data += [(1000, None, "x"), (1001, "", "x"), (None, items[0][1], "x"), (1002, items[1][1], "x"), (1002, items[1][1], "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, leak string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contamination(docs, bench).collect()
    found = {r["doc_id"]: r for r in out if r["contaminated"]}
    assert len(out) == len(data)
    hits = sum(i in found and k in found[i]["item_ids"] for i, k in true.items())
    assert hits >= 0.97 * len(true), hits
    assert set(found) - {None, 1002} <= set(true) and None in found and 1002 in found
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in out)
    assert decontamination.contamination(docs, bench.filter("1 = 0")).filter("contaminated").count() == 0
    assert decontamination.contamination(docs.filter("1 = 0"), bench).count() == 0


# ---- token counts -----------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(docs, rows, name):
    import public_tokenizers

    path = str(public_tokenizers.path(name))
    texts = [r[1] or "" for r in rows]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        from sentencepiece import SentencePieceProcessor

        want = [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    for chunk, overlap in ((1 << 16, 512), (3000, 64)):
        out = token_counts.count_tokens(docs, path, chunk=chunk, overlap=overlap)
        assert got(out, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted([(r[0], len(t.encode()), n, n > 512) for r, t, n in zip(rows, texts, want)], key=repr)


# ---- mixing -----------------------------------------------------------------------------------------

def plain_targets(size_of, weights=(3, 1, 2), budget=1.5, most=2):
    names = sorted((s for s in size_of if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size_of)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    words, full = budget * sum(size_of.values()), set()
    while True:
        rate = (words - sum(most * size_of[s] for s in full)) / max(1e-9, sum(w[s] for s in names if s not in full))
        new = {s for s in names if s not in full and most * size_of[s] < rate * w[s]}
        if not new:
            return {s: most * size_of[s] if s in full else rate * w[s] for s in names}
        full |= new


def test_mix_meets_targets(docs, rows):
    out = pivotal_mixing.mix(docs, rows_per_group=8, fan_in=2)
    again = pivotal_mixing.mix(docs.repartition(3), rows_per_group=8, fan_in=2)
    size = [len((r[1] or "").encode().split()) for r in rows]
    size_of = Counter()
    for r, n in zip(rows, size):
        size_of[r[3]] += n
    want = plain_targets(size_of)
    assert got(out, "doc_id", "size") == sorted([(r[0], n) for r, n in zip(rows, size)], key=repr)
    assert got(out, *out.columns) == got(again, *out.columns)
    taken, largest = Counter(), Counter()
    for r in out.collect():
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size_of[r["source"]]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in want)


def test_pivot_keeps_sums_and_expectations():
    size = np.array([5.0, 9.0, 2.0, 7.0, 4.0, 6.0])
    total = np.zeros(6)
    for seed in range(4000):
        p = np.full(6, 0.4)
        held = pivotal_mixing.pivot(p, size, np.random.default_rng(seed))
        assert abs((p * size).sum() - 0.4 * size.sum()) < 1e-9
        assert sum(0 < x < 1 for x in p) == (held >= 0)
        total += p
    assert np.abs(total / 4000 - 0.4).max() < 0.03


# ---- scores -----------------------------------------------------------------------------------------

def labelled(spark, n=1500):
    rng = random.Random(7)
    data, lab = [], []
    for i in range(n):
        toxic, junk = i % 6 == 0, i % 5 == 0
        w = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(30)]
        if toxic:
            w[rng.randrange(30)] = rng.choice(["vile", "nasty"])
        data.append((i, (" | " if junk else " ").join(w)))
        lab.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [("toxicity", "toxic"), ("quality", "quality")])
def test_scores_generalise_to_held_out_rows(spark, module, label):
    docs, labels = labelled(spark)
    out = (toxicity.toxicity if module == "toxicity" else boosted_quality.quality)(docs, labels)
    m = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert 0.1 < len(m) / 1500 < 0.3 and m["score"].between(0, 1).all()
    assert (m["predicted"] == m[label]).mean() > 0.97
    import zlib

    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in m["doc_id"])


def test_held_out_labels_are_never_learnt_from(spark):
    docs, labels = labelled(spark, 400)
    other = labels.withColumn("toxic", F.when(common.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert got(toxicity.toxicity(docs, labels), "doc_id", "score") == got(toxicity.toxicity(docs, other), "doc_id", "score")


@pytest.mark.parametrize("score", [toxicity.toxicity, boosted_quality.quality])
def test_scores_of_odd_rows(docs, rows, labels, empty, score):
    out = score(docs, labels)
    assert got(out, "doc_id") == sorted([(r[0],) for r in rows], key=repr)
    assert out.filter("score is null or score < 0 or score > 1").count() == 0
    none = score(docs, labels.filter("1 = 0"))
    assert {r[0] for r in none.select("score").distinct().collect()} == {0.5}
    assert score(empty, labels).count() == 0


def test_flat_trees_equal_walked_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = boosted_quality.fit_trees(x, y, trees=15, depth=3)
    want = np.full(500, t.start)
    for f, c, leaf in zip(t.feature, t.cutoff, t.leaf):
        for i in range(500):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[i, f[node]] > c[node])
            want[i] += leaf[node - len(f)]
    assert np.allclose(t.scores(x), 1 / (1 + np.exp(-want))) and ((t.scores(x) > 0.5) == y).mean() > 0.9


# ---- empty tables -----------------------------------------------------------------------------------

def test_empty_tables(empty, labels, docs):
    import public_tokenizers

    assert quality_rules.quality_verdicts(empty, labels).count() == 0
    assert quality_rules.quality_verdicts(docs, labels.filter("1 = 0")).filter("not base_failed and not kept").count() == 0
    assert order_minhash.near_duplicates(empty).count() == 0 and order_minhash.one_per_class(empty).count() == 0
    assert run_length_index.remove_repeats(empty).count() == 0
    assert token_counts.count_tokens(empty, str(public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert pivotal_mixing.mix(empty).count() == 0


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=8), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_cuts_of_few_words_stay(spans, least):
    text = b"ab c  def g\thi jk l mnop qr s tu"
    spans = [(a, min(n, len(text) - a)) for a, n in spans if a < len(text)]
    gone = {i for a, n in spans for i in range(a, a + n)}
    runs, at = [], 0
    while at < len(text):
        end = at
        while end in gone:
            end += 1
        if end > at:
            words = [m for m in __import__("re").finditer(rb"\S+", text) if m.start() >= at and m.end() <= end]
            runs += ([(at, end)] if not least else [(words[0].start(), words[-1].end())]) if len(words) >= least else []
        at = max(end, at + 1)
    kept, n, k = run_length_index._cut(text, spans, least)
    assert (kept, n, k) == (bytes(c for i, c in enumerate(text) if not any(a <= i < b for a, b in runs)), sum(b - a for a, b in runs), len(runs))


def test_toxicity_examples_are_dealt_once(spark, monkeypatch):
    for buckets in ([], [0], [65535, 65536, 262143], list(range(0, 1 << 18, 7))):
        assert toxicity._unpacked(toxicity._packed(np.array(buckets, np.int64))).tolist() == buckets
    docs, labels = labelled(spark, 300)
    kept, plain = [], toxicity.checkpointed
    monkeypatch.setattr(toxicity, "checkpointed", lambda df: kept.append(plain(df)) or kept[0])
    toxicity.fit(docs, labels, rounds=1)
    places = kept[0].select("shard", F.spark_partition_id().alias("at")).distinct()      # so that no round shuffles them
    assert places.count() == kept[0].select("shard").distinct().count() == toxicity.SHARDS
