"""Decontamination at its limits: 15 and 20 % of edits up to 200 words, the window bound, short items, the alignment."""
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surveyframe.llm import decontamination as D


def plain_free_end(item, text):
    """Least edits of the item against any stretch of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=25))
@settings(max_examples=300, deadline=None)
def test_alignment_with_free_ends(item, text):
    assert D.free_end_distance(item, text) == plain_free_end(item, text)


@pytest.mark.parametrize("n", [5, 6, 18, 19, 25, 34, 60, 113])
def test_the_window_bound_drops_no_item_within_the_limit(n):
    """All edits in the first words of the class, single words replaced, dropped or added."""
    rng, low = np.random.default_rng(n), D.size_class(n)
    for _ in range(300):
        item = rng.integers(1, 1 << 62, n).astype(np.uint64)
        pairs = np.zeros(1 << (D.PAIR_BITS - 3), np.uint8)
        for p in D._pairs(item):
            pairs[p >> 3] |= 1 << (p & 7)
        copy = item.tolist()
        for at in sorted(rng.choice(range(1, min(low, n)), min(n * D.MAX_EDIT_PERCENT // 100, min(low, n) - 1), replace=False), reverse=True):
            new = int(rng.integers(1, 1 << 62))
            copy[at:at + 1] = [[new], [], [new, copy[at]]][rng.integers(3)]
        around = [int(x) for x in rng.integers(1, 1 << 62, 30)]
        words = np.array(around + copy + around, np.uint64)
        assert 30 in D._windows(words, np.array([0, len(words)]), pairs, low)


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_edited_items_of_all_sizes_are_found(spark, share):
    rng = random.Random(int(share * 100))
    word = lambda: f"w{rng.getrandbits(48):x}"
    sizes = [5, 12, 25, 40, 60, 100, 150, 200] * 12
    items = [[word() for _ in range(n)] for n in sizes]
    docs = []
    for i, item in enumerate(items):
        leak = list(item)
        for j in rng.sample(range(len(leak)), int(share * len(leak))):
            leak[j] = word()
        docs.append((i, " ".join([word() for _ in range(50)] + leak + [word() for _ in range(50)])))
    docs += [(1000 + i, " ".join(word() for _ in range(300))) for i in range(50)] + [(2000, " ".join(items[7] + [word() for _ in range(60_000)]))]
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= {(i, i) for i in range(len(items))} | {(2000, 7)} and (2000, 7) in got
    assert len(got) - 1 >= 0.97 * len(items), len(got)


def test_short_items_match_unchanged_only(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one two three four"), (4, ""), (5, None), (6, "--")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ALPHA y"), (2, "beta, Gamma"), (3, "beta delta gamma"), (4, "zero one two three four five"), (5, "one two four"), (6, "alphabet"), (7, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in D.leaks(docs, bench).collect()) == [(1, 1, 0), (2, 2, 0), (4, 3, 0)]
