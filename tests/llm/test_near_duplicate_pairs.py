"""The pair search of the near-duplicates against brute force: groups in which the first text of a bucket hides links."""

import random

from surveyframe.llm import order_minhash


def classes(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame).collect()}


def edited(rng, words, share):
    """A copy with exactly this share of its words replaced, at random places."""
    out = list(words)
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = f"e{rng.getrandbits(40):x}"
    return out


def fresh(rng, n):
    return [f"w{rng.getrandbits(40):x}" for _ in range(n)]


def test_one_original_with_many_independent_copies(spark):
    rng = random.Random(7)
    original = fresh(rng, 100)
    texts = [" ".join(original)] + [" ".join(edited(rng, original, 0.15)) for _ in range(500)]
    out = classes(spark, texts)
    want = [j for j in range(1, len(texts)) if order_minhash.linked(texts[0], texts[j])]
    assert len(want) == 500 and sum(out[j] == out[0] for j in want) >= 0.99 * len(want)


def test_copies_among_foreign_pages_of_one_template(spark):
    """Pages share 60 of 100 words and are foreign to each other; pairs of near copies hide among them."""
    rng = random.Random(11)
    shared, texts = fresh(rng, 60), []
    for _ in range(400):
        own = fresh(rng, 40)
        texts += [" ".join(shared[:30] + own + shared[30:]), " ".join(edited(rng, shared[:30] + own + shared[30:], 0.16))]
    texts += [" ".join(shared[:30] + fresh(rng, 40) + shared[30:]) for _ in range(1200)]
    want = [i for i in range(0, 800, 2) if order_minhash.linked(texts[i], texts[i + 1])]
    out = classes(spark, texts)
    found = sum(out[i] == out[i + 1] for i in want)
    assert len(want) == 400 and found >= 0.98 * len(want), found
    assert not any(order_minhash.linked(texts[i], texts[j]) for i, j in (rng.sample(range(2000), 2) for _ in range(2000)) if i // 2 != j // 2 or i >= 800)
    assert all(out[i] == i for i in range(800, 2000))


def test_pairs_at_the_limit_are_found_at_every_length(spark):
    rng = random.Random(3)
    lengths, texts = [5, 8, 10, 12, 15, 20, 40, 60, 75, 76, 100, 200], []
    for n in lengths * 40:
        w = fresh(rng, n)
        texts += [" ".join(w), " ".join(edited(rng, w, 0.2))]
    w = fresh(rng, 14)                                   # deletions and insertions
    texts += [" ".join(w), " ".join(w[:4] + w[5:9] + w[10:])]
    w = fresh(rng, 10)                                   # one edit in the middle of ten words
    texts += [" ".join(w), " ".join(w[:5] + ["edit"] + w[6:])]
    out = classes(spark, texts)
    found = [out[i] == out[i + 1] for i in range(0, len(texts), 2)]
    assert all(order_minhash.linked(texts[i], texts[i + 1]) for i in range(0, len(texts), 2))
    assert found[-1] and found[-2] and sum(found) >= 0.985 * len(found)
    assert all(x for x, n in zip(found, lengths * 40) if n < 15)


def test_links_hold_classes_together(spark):
    """Every row of a class of several texts has a link, a class of k texts at least k - 1 of them; exact copies share their text's."""
    rng = random.Random(4)
    base = [fresh(rng, 60) for _ in range(5)]
    texts = [" ".join(edited(rng, w, 0.1)) for w in base for _ in range(6)] + [" ".join(fresh(rng, 30)), "", None]
    texts.append(texts[0])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in order_minhash.near_duplicates(frame).collect()}
    for i in range(5):
        group = [rows[6 * i + j] for j in range(6)]
        assert len({r.class_id for r in group}) == 1 and sum(r.n_links for r in group) >= 10 and min(r.n_links for r in group) >= 1
    assert [rows[i].n_links for i in (30, 31, 32)] == [0, 0, 0] and rows[33].n_links == rows[0].n_links and rows[33].class_id == rows[0].class_id
