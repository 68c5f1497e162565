"""Steps whose work must not outgrow their input: held against the plain form on small tables."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyframe.operators import draws as DR
from surveyframe.operators import graph as G
from surveyframe.operators import metrics as M
from surveyframe.operators import ranking as RK
from surveyframe.operators import splits as SP
from surveyframe.operators import timeseries as TS
from surveyframe.operators import vectors as V
from surveyframe.sources import text as X

INPUTS = {"u": (-1.0, 1.0), "v": (0.0, 1.0)}


@pytest.mark.parametrize("limit", ["2000000", "5"])       # in tasks; as rows
def test_designs_meet_rows_in_tasks(spark, monkeypatch, limit):
    rows = [(i, float(i % 5), float(i % 3), float(i % 4)) for i in range(30)] + [(30, None, 1.0, 2.0), (31, 2.0, 1.0, None), (32, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, ref double")
    design_score = lambda r, d: 2.0 ** d["u"] * r["a"] + d["v"] * r["b"]
    designs = RK.sobol_table(spark, 40, INPUTS)
    met = RK.sobol_designs(df, 40, INPUTS).withColumn("s", F.round(design_score({c: F.col(c) for c in "ab"}, {c: F.col(c) for c in "uv"}), 9))
    want = {(r.sample, r.design): r.spearman for r in M.spearman(met, "s", "ref", ["sample", "design"]).collect()}
    ranked = RK.shared_rank(met, "s", ["sample", "design"]).groupBy("id").agg(F.avg((F.col("rank") <= 4).cast("int")).alias("p")).collect()
    dealt, plain = [], RK.spread
    monkeypatch.setattr(RK, "spread", lambda x, *rest: dealt.append(x.count()) or plain(x, *rest))
    spark.conf.set("spark.surveyframe.rowsPerTask", limit)
    try:
        got = {(r.sample, r.design): r.spearman for r in RK.design_spearman(df, designs, ["a", "b"], ["u", "v"], design_score, "ref").collect()}
        top = {r.id: r.p_top for r in RK.design_top_share(df, designs, "id", ["a", "b"], ["u", "v"], design_score, 4).collect()}
    finally:
        spark.conf.unset("spark.surveyframe.rowsPerTask")
    assert got == pytest.approx(want) and len(got) == 160
    assert top == pytest.approx({r.id: r.p for r in ranked})
    assert (limit == "5") == (not dealt) and all(n <= 4 * spark.sparkContext.defaultParallelism * len(rows) for n in dealt)


@pytest.mark.parametrize("limit", ["2000000", "5"])       # multiplied out; at the roots of unity
def test_success_distribution_in_tasks(spark, limit):
    rng = np.random.default_rng(4)
    p = {"a": rng.random(1), "b": rng.random(64), "c": rng.random(65) * 0.01, "d": np.concatenate([rng.random(300), [0, 1, 1]])}
    df = spark.createDataFrame([(g, float(x)) for g, v in p.items() for x in v] + [("a", None)], "g string, p double")
    spark.conf.set("spark.surveyframe.rowsPerTask", limit)
    try:
        plan = RK.success_distribution(df, ["g"], "p")
        got = {(r.g, r.k): r.probability for r in plan.collect()}
    finally:
        spark.conf.unset("spark.surveyframe.rowsPerTask")
    want = {}
    for g, v in p.items():
        f = np.ones(1)
        for x in [*v, *([0.0] if g == "a" else [])]:
            f = np.convolve(f, [1 - x, x])
        want |= {(g, k): x for k, x in enumerate(f)}
    assert got == pytest.approx(want, abs=1e-12)
    assert ("explode" in plan._jdf.queryExecution().toString()) == (limit == "5")       # rows x points, only for groups beyond a task


@pytest.mark.parametrize("block", [None, 7, 40])
def test_nearest_rows_of_blocks(spark, monkeypatch, block):
    """Ties, equal vectors, excluded folds, slabs of a few rows: the same as a full sort."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (90, 3)).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), i % 4, i % 5) for i in range(90)], "id int, v array<double>, label int, fold int")
    monkeypatch.setattr(V, "CELLS", 100)
    monkeypatch.setattr(V, "FOUND", 60, raising=False)
    near = V.nearest(df, "id", "v", 4, "label", "fold", block).collect()
    want = set()
    for i in range(90):
        d = [(round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 9), j) for j in range(90) if i % 5 != j % 5]
        want |= {(i, j, d, j % 4) for d, j in sorted(d)[:4]}
    assert {(r.id, r.other, round(r.distance, 9), r.label_other) for r in near} == want and len(near) == 360


def test_blocks_of_nearest_rows_grow_with_the_table(spark, monkeypatch):
    """What travels follows the rows: a row goes to as many meetings as there are blocks."""
    seen, plain = [], V._meetings
    monkeypatch.setattr(V, "_meetings", lambda df, row, within, block: seen.append(block) or plain(df, row, within, block))
    for n in (1000, 200_000, 400_000):
        V.nearest(spark.range(n).select("id", F.array(F.lit(1.0)).alias("v"), F.lit(1).alias("label")), "id", "v", 1, "label")
    assert seen[0] == V.BLOCK_ROWS and seen[2] == 2 * seen[1] and -(-200_000 // seen[1]) <= 32


def test_log_likelihoods_of_equal_objects_share_their_logarithms(monkeypatch):
    rng = np.random.default_rng(8)
    p, y = np.clip(rng.random((500, 6)) ** 40, 1e-9, 1 - 1e-9), np.array([0.0, 0.25, 0.6, 1.0])[np.arange(500) % 4]
    want = (y[:, None] * np.log(p) + (1 - y[:, None]) * np.log(1 - p)).sum(axis=0)
    assert RK._log_likelihood(p, y) == pytest.approx(want, rel=1e-12)
    assert RK._log_likelihood(p, rng.random(500)).shape == (6,)
    made, plain = [], RK.hashlib.md5
    monkeypatch.setattr(RK.hashlib, "md5", lambda x: made.append(x) or plain(x))
    RK._normal_block.cache_clear()
    first, again = (RK.prior_block(97, 200_000, prior, 1) for prior in (RK.PRIOR, RK.NEUTRAL))
    assert len(made) == 3 * len(first["alpha"]) == 3 * (200_000 - 97 * RK.DRAWS_PER_BLOCK)       # made once for both
    h = plain(f"{97 * RK.DRAWS_PER_BLOCK + 5}|beta|1".encode()).hexdigest()
    u, v = int(h[:13], 16) / 2 ** 52, int(h[13:26], 16) / 2 ** 52
    z = np.sqrt(-2 * np.log(max(u, 1e-10))) * np.cos(2 * np.pi * v)
    assert first["beta"][5] == pytest.approx(-2 + z, abs=1e-12) and again["beta"][5] == pytest.approx(2 * z, abs=1e-12)


def test_cells_of_a_line_are_cut_out_once(spark):
    """Files meet their header without a shuffle, and a cell is cut out of its line at one place of the plan."""
    row = lambda cells: "|" + "|".join(c.ljust(16) for c in cells) + "|"
    head = [row(["CENTRALWAVELNG", "PL_TRANDEP", "PL_TRANDEPERR1", "PL_TRANDEPERR2"]), row(["double"] * 4), row(["microns", "%", "%", "%"])]
    body = ["".join(" " + c.ljust(16) for c in cells) for cells in (["2.0", "0.5", "nan", "0.1"], ["2.1", "text", "0.1", "0.1"], ["", "", "0.1", "0.1"])]
    lines = spark.createDataFrame([("a", 0, i, x) for i, x in enumerate(head + body)], "file string, block long, seq long, line string")
    points, report = X.archive_spectra(lines)
    assert [(r.wl, r.depth_ppm, r.err_ppm) for r in points.collect()] == [(2.0, 5000.0, 1000.0)]
    r = report.first()
    assert (r.rows_raw, r.all_null, r.partial, r.rows_kept) == (3, 1, 1, 1)
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substr(line#") == len(X.IPAC_COLUMNS) and plan.count("strategy=broadcast") == 2


def test_chords_are_averaged_as_arrays(spark):
    """No loop over impact parameters inside an expression; the same average, also for NaN and NULL."""
    rows = [(0, 0.02, None), (1, 0.5, 0.3), (2, float("nan"), None), (3, None, None), (4, -1.0, None)]
    df = spark.createDataFrame(rows, "id int, k double, b double").select("id", TS.mean_chord(F.col("k"), F.col("b")).alias("c"))
    got = {r.id: r.c for r in df.collect()}
    want = sum(np.sqrt(1.02 ** 2 - (i / 200) ** 2) for i in range(201)) / 201
    assert got == pytest.approx({0: want, 1: np.sqrt(1.5 ** 2 - 0.09), 2: float("nan"), 3: 0.0, 4: 0.0}, nan_ok=True)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rank_correlation_sums_up_per_value(spark, tiny_tasks, monkeypatch):
    """Groups beyond a task: NULL keys, ties, a single value; only one rank is joined to the rows."""
    rng = np.random.default_rng(9)
    rows = [(g, float(x), float(x + e)) for g in ("u", None) for x, e in zip(rng.integers(0, 9, 120), rng.integers(0, 30, 120))]
    rows += [("flat", 1.0, float(i)) for i in range(50)] + [("u", None, 1.0), ("u", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    monkeypatch.setattr(M, "with_mean_rank", None)
    for few in (M.FEW, 1):                        # ranks sent to the tasks; ranks that travel
        monkeypatch.setattr(M, "FEW", few)
        got = {r.g: (r.spearman, r.rows) for r in M.spearman(df, "a", "b", ["g"]).collect()}
        for g in ("u", None):
            x = pd.DataFrame([r[1:] for r in rows if r[0] == g], columns=["a", "b"]).dropna().rank()
            assert got[g] == (pytest.approx(x["a"].corr(x["b"]), abs=1e-12), 120)
        assert got["flat"] == (None, 50) and len(got) == 3
    one = M.spearman(df.filter("g = 'u'"), "b", "a").first()
    assert (one.spearman, one.rows) == (pytest.approx(got["u"][0], abs=1e-12), 120)


# ---- model comparison ----------------------------------------------------------------------------------

def test_series_of_exponentials_are_the_exponentials():
    """Draws next to each other take few terms, spread ones are taken one by one; objects of unequal magma share nothing."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"key": [0, 0, 1, 2, 2, 2, 3], "y": [0, 0, 1, 0.25, 0.25, 0.25, 1], "margin": rng.normal(size=7), "magma": [0, 0, 1, 1, 0, 2, 0.0], "n": [1, 2, 1, 1, 1, 1, 3.0], "c": 1.0})
    one, tiles = RK._tiles(rows)
    use = {"intercept": (0, 0), "slope": (1, 0), "magma": (0, 1), "both": (1, 1)}
    for spread, few in ((1e-3, True), (5.0, False)):
        theta = {"alpha": rng.normal(size=20), "beta": -2 + spread * rng.normal(size=20), "gamma": 3 * rng.normal(size=20)}
        assert (0 < RK._Exponentials(tiles, theta, 1).terms < 10) == few
        for tile, made in RK._probabilities(tiles, theta, use):
            for model, p in ((m, p) for names, p in made for m in names):
                for at, got in zip(tile.at, p):
                    r = rows[rows["key"] == one["key"][at]]
                    z = theta["alpha"] + use[model][0] * np.outer(r["margin"], theta["beta"]) + use[model][1] * np.outer(r["magma"], theta["gamma"])
                    assert got == pytest.approx(np.average(1 / (1 + np.exp(-z)), axis=0, weights=r["n"]), rel=1e-13)


def test_models_without_margins_meet_objects_alike_once_and_far_draws_add_nothing(spark):
    rng, n, objects = np.random.default_rng(5), 3000, 400
    rows = [(k, float(m), float(k % 2), (0.0, 0.25, 1.0)[k % 3]) for k in range(objects) for m in rng.normal(size=1 + k % 2)]
    df = spark.createDataFrame(rows, "k long, m double, g double, y double").repartition(3)
    seen = {tuple(use): kinds.count() for use, kinds, _ in RK._seen_apart(RK._margin_rows(df, "k", "m", "g", "y"), RK.MODELS)}
    assert seen == {("slope", "both"): len(rows), ("intercept",): 3, ("magma",): 6}
    z = RK._normal_block(0, n, 1), RK._normal_block(1, n, 1)
    th = {c: RK.NEUTRAL[c][0] + RK.NEUTRAL[c][1] * np.concatenate([b[c] for b in z]) for c in RK.NEUTRAL}
    got = {r.model: r for r in RK.model_comparison(df, "k", "m", "g", "y", n).collect()}
    for model, use in RK.MODELS.items():
        p, y = [], []
        for k in range(objects):
            s = [1 / (1 + np.exp(-(th["alpha"] + use[0] * th["beta"] * m + use[1] * th["gamma"] * g))) for i, m, g, _ in rows if i == k]
            p.append(np.clip(np.mean(s, axis=0), 1e-9, 1 - 1e-9))
            y.append((0.0, 0.25, 1.0)[k % 3])
        p, y = np.array(p), np.array(y)[:, None]
        ll = y * np.log(p) + (1 - y) * np.log(1 - p)
        total = ll.sum(axis=0)
        if use[0]:
            assert (total < total.max() - 800).any()                      # draws without weight
        e = np.exp(total - ll - (total - ll).max(axis=1)[:, None])
        q = ((e * p).sum(axis=1) / e.sum(axis=1))[:, None]
        assert got[model].log_marginal == pytest.approx(total.max() + np.log(np.mean(np.exp(total - total.max()))), abs=1e-8)
        assert got[model].loo_score == pytest.approx((y * np.log(q) + (1 - y) * np.log(1 - q)).mean(), abs=1e-10)


# ---- families ------------------------------------------------------------------------------------------

def plain_families(rows, pairs):
    """id -> smallest id of its component of {same star} and {pair}."""
    root = {r[0]: r[0] for r in rows if r[1] is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, star in ((r[0], r[1]) for r in rows if r[1] is not None):
        pairs = [*pairs, (first.setdefault(star, i), i)]
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in root}


@pytest.mark.parametrize("name", [lambda k: k, lambda k: f"s{k}"])
def test_families_are_linked_where_their_periods_meet(spark, monkeypatch, name):
    """Against all pairs; copies, no durations, missing values and missing stars occur, and cells are one bucket wide."""
    rng, rows = np.random.default_rng(31), []
    for i in range(400):
        p = 3 * (1 + 0.6e-4) ** int(rng.integers(0, 300))
        rows.append((1000 - i, None if i % 97 == 5 else name(int(rng.integers(0, 330))), p if i % 50 else float("nan"), float(rng.integers(0, 8)), float(rng.choice([0, 0.3, 0.9])) if i % 31 else None))
    rows += [(2000 + i, name(500 + i), 3.0, 1.0, d) for i, d in enumerate([0.5, 0.5, 0.5, 0.0, 0.0])] + [(2100 + i, name(600 + i), 70.0, 1.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, f"id long, star {'long' if name(1) == 1 else 'string'}, p double, t double, d double").repartition(5)
    twins = [(r.a_id, r.b_id) for r in G.signal_twins(df, "id", "star", "p", "t", "d").collect()]
    want = plain_families(rows, twins)
    assert 40 < len(set(want.values())) < len(want) - 60
    joined = []
    monkeypatch.setattr(G, "_near_pairs", lambda *a: joined.append(1))        # twins are not made as rows
    monkeypatch.setattr(G, "BUCKETS_PER_CELL", 1)
    assert {r.id: r.family_root for r in G.signal_families(df, "id", "star", "p", "t", "d").collect()} == want and not joined
    monkeypatch.setattr(G, "fits_packed", lambda df, rows: False)             # more stars than a task holds
    carried = G.signal_families(df, "id", "star", "p", "t", "d", ("star", "t")).collect()
    assert {r.id: r.family_root for r in carried} == want and {(r.id, r.star, r.t) for r in carried} == {(i, s, t) for i, s, _, t, _ in rows if s is not None}


def test_a_forest_folds_edges_as_they_come(monkeypatch):
    monkeypatch.setattr(G, "EDGES_AT_ONCE", 8)
    rng, forest, every = np.random.default_rng(2), G._Forest(), []
    for _ in range(40):
        a, b = rng.integers(0, 300, (2, 5))
        forest.add(a, b)
        every.append((a, b))
        assert forest.size <= max(8, len(forest.a))
    packed = [e for batch in forest.packed() for e in G._numbers(batch)]
    node, root = G.smallest_of_component(*(np.concatenate(x) for x in zip(*every)))
    assert dict(zip(*(np.concatenate(x).tolist() for x in zip(*packed)))) == {n: r for n, r in zip(node.tolist(), root.tolist()) if n != r}


def test_splits_of_a_family_are_made_distinct_before_they_are_counted(spark):
    rows = [(1, 7, True, "a"), (2, 7, True, "b"), (3, 7, False, None), (4, 8, True, "a"), (5, 8, False, None), (6, 9, False, None), (7, 10, True, None), (8, 10, False, None)]
    df = spark.createDataFrame(rows, "id long, family long, labelled boolean, split string")
    got = SP.drop_bridging(df, "family", F.col("labelled"), "split", 9, {"x": 1.0})
    assert {r.id: r.split for r in got.collect()} == {1: "a", 2: "b", 4: "a", 5: "a", 6: "x", 7: None, 8: "x"}
    assert "count(distinct" not in got._jdf.queryExecution().analyzed().toString()


def test_bridging_rows_meet_their_family_by_star(spark):
    from surveyframe.plans.registry import Tables, load_all

    got = load_all()["bridging_families"].run(Tables(spark, "/root/testdata/sf0.001"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3 and got.count() > 0


# ---- ranks of draws ------------------------------------------------------------------------------------

@pytest.mark.parametrize("s", [[0.3, 1.0, 0.3, 0.0, 0.999999999, 1.0], [], [0.5], [-0.25, 0.5, -0.25], [3e8, 0.1, 3e8, 2e12]])
def test_ranks_down_share_the_better_rank(s):
    s = np.array(s, float)
    assert DR.ranks_down(s).tolist() == [1 + int((s > x).sum()) for x in s]


def test_planets_that_are_never_small_draw_no_margin(monkeypatch):
    rng, n = np.random.default_rng(8), 6
    f = pd.DataFrame({c: rng.uniform(0.01, 0.02, n) if "_err" in c else rng.uniform(1, 2, n) for c in DR.QUANTITIES} | {"mass_measured": True, "transiting": True, "_h": np.arange(n)})
    f["rade"] = [1.0, 3.0, 1.49, 4.0, 2.0, 0.8]
    drawn, plain = {}, DR.normals
    monkeypatch.setattr(DR, "normals", lambda key, draws, tag, seed: drawn.update({tag: len(key)}) or plain(key, draws, tag, seed))
    every = DR.physics(f, np.arange(50))
    assert drawn["x"] == drawn["L"] == n
    some = DR.physics(f, np.arange(50), only=DR.SCORED)
    assert drawn["x"] == drawn["L"] == 3 and drawn["R"] == n
    old = (every["R"] < 1.5) & (every["margin_primary"] < 0)
    assert np.array_equal(DR.components(some)["terrestrial_atm"], old) and np.array_equal(DR.components(every)["terrestrial_atm"], old)
