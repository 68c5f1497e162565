import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from surveyframe.functions.basics import CheckFailed
from surveyframe.operators import cleaning as C
from surveyframe.sources import registry as R
from surveyframe.sources import text as X


def folder(**files):
    d = tempfile.mkdtemp(prefix="sources-")
    for name, body in files.items():
        mode = "wb" if isinstance(body, bytes) else "w"
        with open(os.path.join(d, name.replace("__", ".")), mode) as f:
            f.write(body)
    return d


def test_catalog_comments_only_when_the_file_opens_with_one(spark):
    schema = "koi string, quarters string, period double"
    a = folder(a__csv="# made by us\n# twice\nkoi,quarters,period\nK1,0111,5.0\n")
    assert X.read_catalog(spark, a, schema).collect()[0].quarters == "0111"
    b = folder(b__csv="koi,quarters,period\n#K2,0101,3.0\n")
    assert X.read_catalog(spark, b, schema).collect()[0].koi == "#K2"


def ipac(columns, rows):
    width = 16
    line = lambda cells: "|" + "|".join(str(c).ljust(width) for c in cells) + "|\n"
    head = "\\KEY = 'value'\n" + line([c[0] for c in columns]) + line(["double"] * len(columns)) + line([c[1] for c in columns]) + line(["null"] * len(columns))
    return head + "".join(" " + " ".join(str(c).ljust(width) for c in r) + "\n" for r in rows)


def test_archive_spectra(spark):
    depth = ipac([("CENTRALWAVELNG", "microns"), ("PL_TRANDEP", "%"), ("PL_TRANDEPERR1", "%"), ("PL_TRANDEPERR2", "%")],
                 [[2.0, 0.5, 0.01, -0.03], [2.1, 0.6, 0.02, ""], ["", "", 0.1, 0.1], [0, 0, 0, 0], [2.3, "", 0.1, 0.1]])
    ratio = ipac([("CENTRALWAVELNG", "microns"), ("PL_RATROR", ""), ("PL_RATRORERR1", ""), ("PL_RATRORERR2", "")], [[3.0, 0.1, 0.001, -0.001]])
    points, report = X.read_archive_spectra(spark, folder(a__tbl=depth, b__tbl=ratio))
    got = {(r.file, r.wl): (round(r.depth_ppm, 6), round(r.err_ppm, 6)) for r in points.collect()}
    assert got == {("a.tbl", 2.0): (5000.0, 200.0), ("a.tbl", 2.1): (6000.0, 200.0), ("b.tbl", 3.0): (10000.0, 200.0)}
    r = {x.file: x for x in report.collect()}
    assert (r["a.tbl"].rows_raw, r["a.tbl"].all_null, r["a.tbl"].all_zero, r["a.tbl"].partial, r["a.tbl"].rows_kept) == (5, 1, 1, 1, 2)
    assert not r["b.tbl"].own_depth
    with pytest.raises(CheckFailed):
        X.read_archive_spectra(spark, folder(c__tbl=depth.replace("microns", "nm     ")))


def test_fixed_width(spark):
    body = "title\n-----\nnote\n---------\n 10001    1   12.5  0.91\n 10002    2    bad  0.12\n"
    d = X.read_fixed_width(spark, folder(t__txt=body), [(0, 7, "target", "bigint"), (7, 12, "planet", "int"), (12, 19, "period", "double"), (19, 25, "score", "double")])
    assert [(r.target, r.planet, r.period, r.score) for r in d.orderBy("target").collect()] == [(10001, 1, 12.5, 0.91), (10002, 2, None, 0.12)]


def test_numeric_spectra_layouts(spark):
    centre = "# depth in ppm\n1.0 0.05 5000 30\n1.1 0 5010 30\n1.3 0.05 5020 -1\n0.9 0.05 4990 30\n"
    edges = "1.0 1.2 0.5 0.003\n1.2 1.4 0.6 0.003\n"
    catalogue = spark.createDataFrame([("a.txt", 0.5), ("b.txt", 0.5)], "file string, depth_percent double")
    points, report = X.read_numeric_spectra(spark, folder(a__txt=centre, b__txt=edges), catalogue)
    p = {(r.file, round(r.wl, 3)): (round(r.half_width_um, 4), r.half_width_derived) for r in points.collect()}
    assert p[("b.txt", 1.1)] == (0.1, False) and p[("b.txt", 1.3)] == (0.1, False)
    assert p[("a.txt", 1.1)] == (0.075, True) and ("a.txt", 1.3) not in p
    r = {x.file: x for x in report.collect()}
    assert (r["a.txt"].edges, r["a.txt"].half_width_zero_rows, r["a.txt"].dropped, r["a.txt"].restarts, r["a.txt"].numeric_units) == (False, 1, 1, 1, "ppm")
    assert r["a.txt"].declared_units == "ppm" and r["b.txt"].edges and r["b.txt"].numeric_units == "%"
    with pytest.raises(CheckFailed):
        X.read_numeric_spectra(spark, folder(c__txt="1 2 3\n"))


def test_point_table_units_and_parts(spark):
    d = X.read_point_table(spark, folder(a__csv="# wl,d,e\n1.0,0.5,0.01\n", b__csv="0.5,0.4,0.01 # late part\n"), unit="percent", delimiter=",")
    assert [(r.wl, r.depth_ppm) for r in d.orderBy("wl").collect()] == [(0.5, 4000.0), (1.0, 5000.0)]


def test_run_log_ignores_broken_lines(spark):
    d = folder(log__json='{"object_id": "a", "status": "ok"}\n\n{"object_id": "b", "sta\n{"event": "start"}\n[1, 2]\n')
    assert [r.object_id for r in X.read_run_log(spark, d, "object_id string, status string").collect()] == ["a"]


def test_registry_rules(spark):
    reg = spark.createDataFrame([("data/raw", "source", "archive"), ("data/raw/x.csv", "derived", "ours"), ("data/y.csv", "source", ""),
                                 ("data/z.csv", "source", "a"), ("data/z.csv", "derived", "a"), ("old/w.csv", "source", "a")], "path string, role string, provenance string")
    bad = {(r.path, r.problem) for r in R.registry_problems(reg, spark.createDataFrame([("old",)], "path string")).collect()}
    assert bad == {("data/z.csv", "in two roles"), ("data/raw/x.csv", "inside another role's folder"), ("data/y.csv", "no provenance"), ("old/w.csv", "under an excluded folder")}
    ok = spark.createDataFrame([("/root/testdata/sf0.001/nation.parquet", "ref", "given")], "path string, role string, provenance string")
    assert set(R.load_role(spark, ok, ok.select("path"), "ref")) == {"nation"}
    R.assert_role(ok, "/root/testdata/sf0.001/nation.parquet", "ref")
    with pytest.raises(CheckFailed):
        R.load_role(spark, ok, ok.select("path").limit(0), "ref")
    with pytest.raises(CheckFailed):
        R.assert_role(ok, "/root/testdata/sf0.001/nation.parquet", "other")


def test_registry_rules_meet_a_folder_once(spark):
    """Rows that repeat a folder must not multiply: 400 owners of one folder, three roles, and 400 paths below it."""
    rows = [("d/a", ("x", "y", None)[i % 3], "p") for i in range(400)] + [(f"d/a/{i}", ("x", "y", "z", None)[i % 4], "p") for i in range(400)] + [("d/b", None, "p"), ("d/b/c", "x", "p")]
    got = R.registry_problems(spark.createDataFrame(rows, "path string, role string, provenance string"))
    assert {(r.path, r.problem) for r in got.collect()} == {("d/a", "in two roles")} | {(f"d/a/{i}", "inside another role's folder") for i in range(400) if i % 4 != 3}
    joined, todo = [], [got._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            joined.append(node.metrics().apply("numOutputRows").value())
        below = [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        todo += below
    assert joined and max(joined) <= 400


def test_file_screens(spark):
    d = folder(a__fits=b"SIMPLE  =" + b" " * (2880 - 9), b__fits=b"", c__fits=b"SIMPLE  =" + b" " * 10, d__fits=b"x" * 2880)
    names = spark.createDataFrame([(n,) for n in os.listdir(d)], "name string")
    got = {r.name: r.reason for r in R.binary_screen(spark, d, "SIMPLE  =", names).collect()}
    assert got == {"b.fits": "empty", "c.fits": "size not a multiple of the block", "d.fits": "missing magic prefix"}
    f = R.fingerprint(spark, d).first()
    assert (f.files, f.bytes) == (3, 2880 + 19 + 2880)   # the empty file is not handed out
    h = R.content_hashes(spark, d)
    good = spark.createDataFrame([("d.fits", hashlib.sha256(b"x" * 2880).hexdigest())], "name string, sha256 string")
    R.check_frozen(h, good)
    with pytest.raises(CheckFailed):
        R.check_frozen(h, good.withColumn("sha256", F.lit("0")))
    with pytest.raises(CheckFailed):
        R.check_frozen(h, good.withColumn("name", F.lit("gone")))


def test_file_index(spark):
    m = spark.createDataFrame([("K2", 7, None), ("K2", 8, "own.csv")], "mission string, id long, file string")
    listing = spark.createDataFrame([("lc_00007.csv", "/a/lc_00007.csv"), ("own.csv", "/a/own.csv")], "file string, path string")
    assert {r.path for r in R.file_index(m, listing, "lc_%05d.csv").collect()} == {"/a/lc_00007.csv", "/a/own.csv"}
    with pytest.raises(CheckFailed):
        R.file_index(m, listing.limit(1), "lc_%05d.csv").count()


def test_split_sink_and_column_scan(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    C.write_split(df, d + "/out")
    assert sorted(x for x in os.listdir(d + "/out") if x.startswith("split=")) == ["split=test", "split=train"]
    with pytest.raises(CheckFailed):
        C.write_split(df.withColumn("split", F.when(F.col("id") == 1, "train")), d + "/bad")
    assert C.scan_columns({"t": spark.createDataFrame([(1, 2)], "flux_12 int, name int")}, r"^flux_\d+$") == [("t", "flux_12")]


def test_strict_labels_and_exclusions(spark):
    df = spark.createDataFrame([("F",), (None,), ("X",)], "code string")
    with pytest.raises(CheckFailed):
        C.harmonize_labels(df, "code", {"F": "CONFIRMED"})
    got = C.harmonize_labels(df, "code", {"F": "CONFIRMED", "X": "CANDIDATE"}).collect()
    assert [r.label_harmonized for r in got] == ["CONFIRMED", None, "CANDIDATE"]
    two = spark.createDataFrame([("a", "r", "n")], "id string, reason string, note string")
    with pytest.raises(CheckFailed):
        C.exclusions_lookup(two.select("id"), "id", {"x": two, "y": two})
    with pytest.raises(CheckFailed):
        C.add_group_key(df, "code")
