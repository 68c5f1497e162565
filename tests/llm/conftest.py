import random

import pytest

LONG_WORDS = 30_000


def words(rng, n, alphabet="abcdefghijklmnop"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus():
    """Rows (doc_id, text, lang, source): prose, copies, near copies, shared passages and every odd case."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 200)) for _ in range(40)]
    texts = [" ".join(w) for w in base]
    passage = " ".join(words(rng, 90))
    texts += [texts[0], texts[0], texts[1]]                                                      # exact copies
    for i in (2, 3, 4):                                                                         # near copies
        w = list(base[i])
        for j in range(7, len(w), 25):
            w[j] = "changed"
        texts.append(" ".join(w))
    texts += [f"{' '.join(base[i][:25])} {passage} {' '.join(base[i][25:50])}" for i in (5, 6, 7)]     # a shared passage
    texts += ["abcd " * 300, "ab\x00é " * 200, "", " \t\n ", None, "\n".join(["the same line here"] * 9), "é" * 500, "# * $ %% && ||" * 40,
              "one two", " ".join(words(rng, LONG_WORDS)), "x" * 3000, "a  b c \r\n d<|endoftext|> e", "I'm  we'll\n\n  they've 123 456!"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s0", None, "s2")[i % 4] if i % 5 else "s1") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[10], "en", "s1"), (None, None, None, None)]            # repeated rows and NULL ids
    return rows


CLASH = ["size", "score", "held_out", "row", "key", "h", "n_words", "kept", "stratum", "r1", "bytes", "repeats", "node", "k", "c", "spans", "leak"]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *CLASH) for r in rows], schema).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("1 = 0")


@pytest.fixture(scope="session")
def labels(spark, rows):
    data = [(r[0], int(i % 7 != 0), int(i % 9 == 0)) for i, r in enumerate(rows)] + [(1, None, None), (None, 1, 1), (2, 0, 1), (2, 1, 0)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
