import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyframe.operators import scale

SF = "/root/testdata/sf0.001"


def frame(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    # a hot type with a third of the rows and a frequent value
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type")).alias("k"),
                    F.when(F.col("event_id") % 2 == 0, F.lit(7.0)).otherwise(F.col("value")).alias("v"))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_cumulative_matches_pandas(spark, tiny_tasks, keys):
    df = frame(spark)
    got = scale.cumulative(df, "v", {"rn": F.lit(1), "s": F.col("event_id")}, keys, tie="event_id").toPandas()
    assert scale.split_ranges(df, "v", keys, "event_id") is not None
    p = df.toPandas().sort_values(["v", "event_id"])
    p["one"] = 1
    g = p.groupby(keys) if keys else p.assign(z=0).groupby("z")
    p["rn"], p["s"] = g["one"].cumsum(), g["event_id"].cumsum()
    m = got.merge(p, on="event_id")
    assert len(m) == len(p) and (m.rn_x == m.rn_y).all() and (m.s_x == m.s_y).all()


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("forward", [False, True])
def test_neighbour_matches_pandas(spark, tiny_tasks, keys, forward):
    df = frame(spark)
    got = scale.neighbour(df, "v", {"p": "event_id"}, keys, tie="event_id", forward=forward).toPandas()
    p = df.toPandas().sort_values(["v", "event_id"])
    g = p.groupby(keys) if keys else p.assign(z=0).groupby("z")
    p["p"] = g["event_id"].shift(-1 if forward else 1)
    m = got.merge(p, on="event_id")
    assert ((m.p_x == m.p_y) | (m.p_x.isna() & m.p_y.isna())).all()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_match_pandas(spark, tiny_tasks, keys):
    df = frame(spark)
    specs = {"q1": ("v", 0.25), "q2": ("v", 0.5), "q9": ("event_id", 0.9)}
    got = scale.quantiles(df, keys, specs).toPandas()
    p = df.toPandas()
    for row in got.to_dict("records"):
        sub = p[p.k == row["k"]] if keys else p
        for n, (c, q) in specs.items():
            assert row[n] == pytest.approx(sub[c].quantile(q))


def test_parts_of_a_hot_group_are_small(spark, tiny_tasks):
    parts = scale.split_ranges(frame(spark), "v", ["k"], "event_id")
    biggest = parts.groupBy("k", "_part").count().agg(F.max("count")).first()[0]
    assert biggest <= 80


def test_salted_join_equals_join(spark, tiny_tasks):
    df = frame(spark)
    dim = df.groupBy("k").agg(F.count("*").alias("n"))
    a = scale.salted_join(df, dim, ["k"], "left").toPandas().sort_values("event_id").reset_index(drop=True)
    b = df.join(dim, "k", "left").toPandas().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a[b.columns], b)


def test_string_values_and_ties_are_split(spark, tiny_tasks):
    df = frame(spark).select("event_id", "k", "v", F.format_string("K%06d", "event_id").alias("name"))
    got = scale.cumulative(df, "v", {"rn": F.lit(1)}, ["k"], tie="name").toPandas()
    p = df.toPandas().sort_values(["v", "name"])
    p["rn"] = 1
    p["rn"] = p.groupby("k")["rn"].cumsum()
    m = got.merge(p, on="event_id")
    assert len(m) == len(p) and (m.rn_x == m.rn_y).all()
    by_name = scale.cumulative(df, "name", {"rn": F.lit(1)}).toPandas().sort_values("name")
    assert (by_name.rn.to_numpy() == range(1, len(by_name) + 1)).all()


@pytest.mark.parametrize("split", [False, True])
def test_ranks_keep_null_keys_and_values(spark, split):
    from surveyframe.operators.metrics import with_mean_rank
    from surveyframe.operators.ranking import shared_rank

    rows = [(i, None if i % 3 == 0 else "a", None if i % 10 == 0 else float("nan") if i % 47 == 0 else float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    if split:
        spark.conf.set("spark.surveyframe.rowsPerTask", "40")
    try:
        got = {r["id"]: (r["rank"]) for r in shared_rank(df, "v", ["k"]).collect()}
        mean = {r["id"]: r["m"] for r in with_mean_rank(df, "v", "m", ["k"]).collect()}
    finally:
        spark.conf.unset("spark.surveyframe.rowsPerTask")
    key = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    for i, k, v in rows:
        same = [key(x) for _, g, x in rows if g == k]
        assert got[i] == 1 + sum(x > key(v) for x in same)
        if v is not None:
            known = [x for x in same if x != (0, 0.0)]
            assert mean[i] == sum(x < key(v) for x in known) + (1 + sum(x == key(v) for x in known)) / 2
    assert set(mean) == {i for i, _, v in rows if v is not None}


def test_components_of_a_long_chain(spark):
    from surveyframe.operators.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    nodes = spark.range(402).withColumnRenamed("id", "node")
    assert {r["node"]: r["root"] for r in components(edges, nodes).collect()} == {i: 0 for i in range(401)} | {401: 401}


def test_zero_durations_keep_their_twins(spark):
    from surveyframe.operators.graph import signal_families, signal_twins

    rows = [(1, "s1", 10.0, 5.0, 0.2), (2, "s2", 10.0, 5.0, 0.0), (3, "s3", 10.0, 5.0, 0.0), (4, "s4", 77.0, 1.0, 0.0), (5, "s5", 77.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, star string, p double, t double, d double")
    args = ("id", "star", "p", "t", "d")
    assert {(r["a_id"], r["b_id"]) for r in signal_twins(df, *args).collect()} == {(1, 2), (1, 3)}
    assert {r["id"]: r["family_root"] for r in signal_families(df, *args).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


@pytest.mark.parametrize("n", [3, 5000])
def test_lookup_of_nan_is_null(spark, n):
    from surveyframe.operators.matching import interpolate

    knots = spark.range(n).select(F.col("id").cast("double").alias("x"), (2.0 * F.col("id")).alias("y"))
    q = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, None), (4, -3.0), (5, 1e9)], "i long, q double")
    got = {r["i"]: r["out"] for r in interpolate(q, "q", knots, "x", "y", "out").collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: 0.0, 5: 2.0 * (n - 1)}
