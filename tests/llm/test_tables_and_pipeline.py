"""URL templates, dialogues, the registered queries and the pipeline."""
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from oracle import compare, connect  # noqa: E402
from surveyframe.llm import perspectives, url_templates  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op") and n[2].isdigit()))
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == ""


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n == "pipeline" or (n.startswith("op") and n[2].isdigit())]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


# ---- URLs -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("url, host, path, rule", [
    ("https://WWW.Example.com/en/1?x=/fr/", "www.example.com", "/en/1", "www.example.com/en/"), ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/"),
    ("http://b.com/x", "b.com", "/x", "com/"), ("x://net/es/", "net", "/es/", "net/es/"), ("x://a.net/fr", "a.net", "/fr", None), ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("://", "", "", None), ("a://b://c.net/es/", "b:", "//c.net/es/", None), ("http://É.com#a/b", "É.com", "", None)])
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    h, p = url_templates.host_and_path(F.col("url"))
    got = df.select(h.alias("h"), p.alias("p")).withColumn("r", url_templates.rule_of(F.col("h"), F.col("p"))).first()
    assert tuple(got) == (host, path, rule)


def test_templates_generalise_and_reject_by_purity(spark):
    pages, labels = [], []
    for i in range(400):
        pages.append((i, f"http://h.org/{'spam' if i % 4 == 0 else 'news'}/{i}"))
        labels.append((i, int(i % 4 != 0), 0))
        pages.append((1000 + i, f"http://g.org/user/{chr(97 + i % 26)}{'xyz'[i % 3]}{chr(97 + i // 26)}/page"))
        pages.append((2000 + i, f"http://k.org/{'ab'[i % 2]}/{i}"))
        labels.append((2000 + i, int(i % 5 != 0), 0))
    pages += [(None, "http://h.org/spam/7"), (5000, None), (5001, ""), (3, "http://h.org/news/3"), (3, "http://h.org/news/3")]
    labels += [(None, 0, 0), (9000, None, None)]
    p = spark.createDataFrame([(*x, "clash", "clash") for x in pages], "page_id long, url string, template string, salt string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = url_templates.judge(p, lab)
    assert out.count() == len(pages)
    got = {(r["host"], r["template"]): r["verdict"] for r in out.collect()}
    assert got[("h.org", "spam/{num}")] == "block" and got[("h.org", "news/{num}")] == "allow"       # branches that differ stay apart
    assert ("g.org", "user/{any}/page") in got or ("g.org", "{any}/{any}/page") in got               # many thin children
    assert got[("k.org", "{any}/{num}")] == "allow"                                                 # alike branches are merged
    assert url_templates.judge(p.filter("1 = 0"), lab).count() == 0
    assert url_templates.judge(p, lab.filter("1 = 0")).filter("verdict is null or (rule is null and verdict = 'block')").count() == 0


# ---- dialogues --------------------------------------------------------------------------------------

def plain_rotation(turns, conv):
    mine = sorted({t for t in turns if t[0] == conv}, key=lambda t: (t[1] is None, t[1] or 0, t[2] or "unknown", t[3] or ""))
    people = {t[2] or "unknown" for t in mine} - {"system"}
    out = {}
    for who in people:
        text, masks = "", []
        for _, _, role, body in mine:
            role, body = role or "unknown", body or ""
            text += f"<|im_start|>{'system' if role == 'system' else 'assistant' if role == who else 'user name=' + role}\n"
            if role == who:
                masks.append((len(text), len(text) + len(body) + len("<|im_end|>")))
            text += body + "<|im_end|>\n"
        out[who] = (text, masks)
    return out


def test_rotation_equals_plain_rendering(spark):
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["ann", "bob", "eve", "system", None]), rng.choice(["hi é", "", None, "a\nb", "x" * 50])) for c in (1, 2, None) for t in [*range(40), None, 3, 3, 3]]
    turns += turns[:5] + [(9, 0, "system", "alone")] + [(8, 5, f"p{i % 3}", f"tie {i}") for i in range(30)]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, part string").repartition(5)
    for size, rows in ((256, 1024), (8, 1024), (8, 4)):
        out = perspectives.rotate(df, size, rows).collect()
        for conv in (1, 2, None, 8, 9):
            want = plain_rotation(turns, conv)
            mine = [r for r in out if r["conv_id"] == conv]
            assert {r["perspective"] for r in mine} == set(want)
            for who, (text, masks) in want.items():
                parts = sorted((r for r in mine if r["perspective"] == who), key=lambda r: r["char_start"])
                got = "".join(r["rendered"] for r in parts)
                spans = [(r["char_start"] + s["start"], r["char_start"] + s["end"]) for r in parts for s in r["spans"]]
                assert got == text and spans == masks
                assert max(r["n_turns"] for r in parts) <= rows
                assert all(got[a:b].endswith("<|im_end|>") for a, b in spans)
    assert perspectives.rotate(df.filter("1 = 0")).count() == 0


def test_branches_that_differ_in_the_ninth_segment_stay_apart(spark):
    deep = "a/b/c/d/e/f/g/h"
    pages = [(i, f"http://h.org/{deep}/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)] + [(1000 + i, f"http://k.org/{'/'.join('xyz'[i % 3] + str(j) for j in range(40))}") for i in range(3)]
    labels = [(i, 1 - i % 2, 0) for i in range(200)]
    out = url_templates.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r["host"], r["template"]): r["verdict"] for r in out}
    assert len(out) == 203 and got[("h.org", f"{deep}/spam/{{num}}")] == "block" and got[("h.org", f"{deep}/news/{{num}}")] == "allow"
    assert sum(h == "k.org" for h, _ in got) in (1, 3)


def test_a_dense_part_of_long_turns_keeps_its_order(spark):
    """One dialogue without turn numbers, longer than any task may hold, and very long turns."""
    rng = random.Random(6)
    turns = [(1, None, f"p{rng.randrange(3)}", f"{rng.random()} {'long ' * rng.choice([0, 1, 2000])}") for _ in range(400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(6)
    out = perspectives.rotate(df, 256, 16).collect()
    want = plain_rotation(turns, 1)
    for who, (text, masks) in want.items():
        parts = sorted((r for r in out if r["perspective"] == who), key=lambda r: r["cell"])
        assert "".join(r["rendered"] for r in parts) == text and [r["char_start"] for r in parts] == sorted(r["char_start"] for r in parts)
        assert [(r["char_start"] + s["start"], r["char_start"] + s["end"]) for r in parts for s in r["spans"]] == masks and max(r["n_turns"] for r in parts) <= 16


# ---- pipeline ---------------------------------------------------------------------------------------

def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, prose(120)) for i in range(60)]
    passage, item = prose(100), prose(25)
    data = clean + [(100, clean[0][1]), (101, clean[1][1].replace(clean[1][1].split()[50], "swap", 1)), (102, "too short"), (103, "same words again " * 40), (104, None), (105, "")]
    data += [(110 + i, f"{prose(60)} {passage} {prose(60)}") for i in range(3)] + [(120, f"{prose(50)} {item} {prose(50)}")]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or ""), "x", "y") for d, t in data],
                                 "doc_id long, text string, lang string, source string, n_chars long, row string, leak string")
    d = str(tmp_path)
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, ids, texts = spark.read.parquet(f"{d}/documents.parquet"), [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        ids.append(sorted(r[0] for r in now.select("doc_id").collect()))
        if k < 4:
            texts.append({r[0]: (r[1], r[2]) for r in now.select("doc_id", "text", "n_chars").collect()})
    good = [i for i, _ in clean]
    assert ids[0] == good + [100, 101, 110, 111, 112, 120]
    assert ids[1] == good + [110, 111, 112, 120]
    assert ids[2] == ids[1] and all(passage not in texts[2][i][0] and len(texts[2][i][0]) == texts[2][i][1] for i in (110, 111, 112))
    assert all(texts[2][i][0] == t for i, t in clean)
    assert ids[3] == good + [110, 111, 112]
    assert set(ids[4]) <= set(ids[3]) and now.filter("taken > 2 * size or copies < 1").count() == 0
    spark.read.parquet(f"{d}/documents.parquet").filter("1 = 0").write.parquet(f"{d}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{d}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{d}/none").count() == 0


def test_pipeline_runs_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and out.filter("taken > 2 * size").count() == 0


def test_repeated_passages_of_over_50_words_leave_the_pipeline(spark, tmp_path):
    """Passages of 54 short words, about 300 bytes: cut wherever they stand; 50 words, or a phrase of the prose, stay."""
    from surveyframe.llm import stages

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.choice([3, 4, 5, 6])))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short, few = text(54), text(50), text(51)
    assert len(long) < 330
    rows = [(i, f"{text(80)} {long} {text(70)}") for i in range(3)] + [(10 + i, f"{text(90)}\n{short}\n{text(60)}") for i in range(3)]
    rows += [(20 + i, f"{text(90)} {few} {text(60)}") for i in range(2)] + [(50 + i, text(150)) for i in range(20)] + [(40, long), (41, None), (42, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in stages.repeated_passage_stage(spark, docs, str(tmp_path)).collect()}
    before = dict(rows)
    for i in (0, 1, 2, 20, 21):
        gone = long if i < 10 else few
        assert gone not in out[i]["text"] and out[i]["text"].split() == before[i].replace(gone, "").split() and out[i]["n_chars"] == len(out[i]["text"])
    assert 40 not in out                                                       # nothing but the passage
    assert all(out[i]["text"] == before[i] for i in before if i in (10, 11, 12, 41, 42) or i >= 50)
