"""Permutations, prior draws and EM at their full sizes against enumeration, numpy and closed forms on small tables."""
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyframe.functions import physics as PH
from surveyframe.operators import draws as DR
from surveyframe.operators import ranking as RK
from surveyframe.operators import resample as RS
from surveyframe.operators import screens as SC


def plain_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_permutation_p_against_all_relabellings(spark, fan):
    """Ties, a tree of one level and of several."""
    s = np.array([1, 2, 2, 3, 3, 3, 4, 5, 6, 6.0])
    y = np.array([0, 0, 1, 0, 1, 0, 1, 1, 0, 1])
    obs, every = plain_auc(y, s), []
    for pick in combinations(range(10), int(y.sum())):
        z = np.zeros(10, int)
        z[list(pick)] = 1
        every.append(plain_auc(z, s))
    exact = np.mean(np.array(every) >= obs - 1e-12)
    rows = [(int(a), float(b)) for a, b in zip(y, s)] + [(None, 1.0), (1, None)]
    got = RS.permutation_p(spark.createDataFrame(rows, "y int, s double"), "y", "s", fan=fan).first()
    assert got.permutations == 100_000 and got.auc == pytest.approx(obs) and got.p == pytest.approx(exact, abs=0.006)
    again = RS.permutation_p(spark.createDataFrame(rows, "y int, s double").repartition(4), "y", "s", fan=fan).first()
    assert again == got


def test_dealt_positives_are_draws_without_replacement():
    rng, counts = np.random.default_rng(3), np.array([3, 1, 4, 2])
    got = RS.dealt(rng, counts, np.full(40_000, 5))
    assert (got.sum(0) == 5).all() and (got <= counts[:, None]).all()
    assert got.mean(1) == pytest.approx(counts / 2, abs=0.02)
    want = 5 * 0.3 * 0.7 * (10 - 5) / (10 - 1)
    assert got[0].var() == pytest.approx(want, rel=0.05)
    assert (RS._taken(rng, 6 * 10 ** 8, 6 * 10 ** 8, np.array([0, 5, 12 * 10 ** 8])) == [0, 0, 6 * 10 ** 8])[[0, 2]].all()


def test_one_class_has_no_p(spark):
    assert tuple(RS.permutation_p(spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double"), "y", "s").first()) == (None, 0, None)


# ---- derived columns ---------------------------------------------------------------------------------

def plain_loo_r2(x, y):
    """The reference definition, refitted without each row."""
    e = []
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        a = np.column_stack([np.ones(len(y)), x])
        e.append(y[i] - a[i] @ np.linalg.lstsq(a[rest], y[rest], rcond=None)[0])
    return 1 - np.sum(np.square(e)) / np.sum((y - y.mean()) ** 2)


def derived_rows(n=60):
    rng = np.random.default_rng(5)
    a, b, c = rng.uniform(1, 4, n), rng.uniform(0.5, 2, n), rng.normal(size=n)
    return a, b, c, a ** 2 / b


def test_subsets_of_predictors_and_their_null_against_refits(spark):
    a, b, c, y = derived_rows()
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(a, b, c, y))], "row long, a double, b double, c double, y double").repartition(3)
    x = np.column_stack([a, b, c])
    got = {tuple(r.subset): r.loo_r2 for r in SC.subset_scores(df, "y", ["a", "b", "c"], "row", 3, 0).collect()}
    assert len(got) == 7 and all(v == pytest.approx(plain_loo_r2(x[:, list(s)], y), abs=1e-9) for s, v in got.items())
    shuffled = SC.shuffles(df, "y", "row", 6, 4, "s").collect()
    assert all(sorted(r.s for r in shuffled if r.permutation == p) == sorted(y) for p in range(6))
    assert len({tuple(r.s for r in sorted((r for r in shuffled if r.permutation == p), key=lambda r: r.row)) for p in range(6)}) == 6
    null = {r.permutation: r.best for r in SC.derived_null(df, "y", ["a", "b", "c"], "row", 2, 6, 4).collect()}
    for p in range(6):
        rows = sorted((r for r in shuffled if r.permutation == p), key=lambda r: r.row)
        z = np.array([r.s for r in rows])
        want = max(plain_loo_r2(x[:, list(s)], z) for s in SC._subsets(3, 2))
        assert null[p] == pytest.approx(want, abs=1e-9)


def test_a_power_law_is_found_in_logarithms_only(spark):
    a, b, c, y = derived_rows()
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(a, b, c, y))], "row long, a double, b double, c double, y double")
    got = {r.form: r for r in SC.derived_search(df, "y", ["c", "a", "b"], "row", 3).collect()}
    assert got["log"].subset == "a, b" and got["log"].k == 2 and got["log"].loo_r2 == pytest.approx(1) and got["log"].flagged and 0 < got["log"].null_p999 < 0.6
    assert not got["linear"].flagged and got["linear"].loo_r2 < 0.98
    assert set(r.form for r in SC.derived_search(df.withColumn("y", -F.col("y")), "y", ["c", "a"], "row", 2, 20).collect()) == {"linear"}


def test_shuffled_levels_are_rarely_separable(spark):
    rows = [(i, i // 4, float(i)) for i in range(8)]
    got = SC.separable_p(spark.createDataFrame(rows, "row long, level long, v double"), "level", "v", "row").first()
    assert got.permutations == 500 and got.p == pytest.approx((1 + 500 * 2 / 70) / 501, abs=0.03)      # 2 of 70 ways to deal the levels


def test_packed_shuffles_are_those_of_the_rows_and_nothing_is_broadcast(spark):
    a, b, c, y = derived_rows()
    df = spark.createDataFrame([(i * 7 - 100, *map(float, v), i % 5 if i % 9 else None) for i, v in enumerate(zip(a, b, c, y))], "row long, a double, b double, c double, y double, level long").repartition(3)
    want = {(r.row, r.permutation): r.s for r in SC.shuffles(df, "y", "row", 4, 3, "s").collect()}

    def work(table, numbers, taken):
        import pyarrow as pa
        row, v = table.column("id").to_numpy(), table.column("y").to_numpy()
        return pa.table({"row": np.tile(row, len(numbers)), "permutation": np.repeat(np.array(numbers, np.int32), len(row)), "s": np.concatenate([v[taken(p)] for p in numbers])})

    got = SC.packed_shuffles(df.select("row", F.col("row").alias("id"), "y"), "row", -1, 4, 3, work, "row long, permutation int, s double").collect()
    as_is = {r.row: r.y for r in df.collect()}
    assert len(got) == 5 * 60 and all(r.s == (as_is[r.row] if r.permutation < 0 else want[r.row, r.permutation]) for r in got)
    plan = SC.shuffles(df, "y", "row", 4, 3, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    levels = df.select("row", F.when(F.col("row") < -90, 1).otherwise(F.col("level") * 0).alias("level"), F.when(F.col("row") < 250, F.col("row") % 60).alias("v"))

    def both():
        scores = SC.subset_scores(df, "y", ["a", "b", "c"], "row", 2, 6, 4).collect()
        return {(r.permutation, *r.subset): r.loo_r2 for r in scores}, SC.separable_p(levels.filter("row < -60"), "level", "v", "row", 40).first().p

    packed, p = both()
    spark.conf.set("spark.surveyframe.rowsPerTask", "1")
    try:
        rows, q = both()
    finally:
        spark.conf.unset("spark.surveyframe.rowsPerTask")
    assert packed.keys() == rows.keys() and all(v == pytest.approx(rows[i], abs=1e-12) for i, v in packed.items()) and p == q


def test_replicates_in_tasks_are_those_of_the_rows(spark):
    """Intervals of AUCs and median gaps with ties, NULL labels and scores, repeated units, against replicates as rows."""
    rng = np.random.default_rng(6)
    data = [(i if i % 11 else 3, i % 7 if i % 13 else None, None if i % 17 == 0 else int(rng.uniform() < 0.6), None if i % 8 == 0 else round(float(rng.uniform()), 1), float(rng.normal())) for i in range(80)]
    df = spark.createDataFrame(data, "id long, star long, y int, s double, s2 double").repartition(3)

    def every():
        return [tuple(f.first()) for f in (RS.auc_interval(df, "star", "y", "s", 30), RS.paired_auc_difference(df, "id", "y", "s", "s2", 30), RS.median_gap_change(df, "id", "y", "s", "s2", 30))]

    packed = every()
    assert RS.in_tasks(df, "id", 4, 1, lambda t: lambda w: (w.sum(),), ["n"]).count() == 4
    spark.conf.set("spark.surveyframe.rowsPerTask", "1")
    try:
        assert RS.in_tasks(df, "id", 4, 1, lambda t: lambda w: (w.sum(),), ["n"]) is None
        rows = every()
    finally:
        spark.conf.unset("spark.surveyframe.rowsPerTask")
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in zip(packed, rows))


# ---- posterior over prior draws ----------------------------------------------------------------------

def plain_draws(n, prior=RK.PRIOR, seed=1):
    b = [RK.prior_block(i, n, prior, seed) for i in range(-(-n // RK.DRAWS_PER_BLOCK))]
    return {k: np.concatenate([x[k] for x in b]) for k in ("alpha", "beta", "gamma")}


def observed():
    rng, rows = np.random.default_rng(12), []
    for k in range(40):
        y, g = float(rng.choice([0, 0.25, 1])), float(k % 2)
        rows += [(k, float(m), g, y) for m in rng.choice(rng.normal(size=6), rng.integers(1, 5))]           # equal margins occur
    return rows


def plain_p(rows, th, use):
    by = {}
    for k, m, g, y in rows:
        by.setdefault((k, y), []).append(1 / (1 + np.exp(-(th["alpha"] + use[0] * th["beta"] * m + use[1] * th["gamma"] * g))))
    return [(k, y, np.clip(np.mean(v, axis=0), 1e-9, 1 - 1e-9)) for (k, y), v in by.items()]


def test_blocked_posterior_equals_numpy(spark):
    n, rows = 5000, observed()
    df = spark.createDataFrame(rows, "k long, m double, g double, y double").repartition(3)
    th = plain_draws(n)
    columns = {r.draw: r for r in spark.range(n).select(F.col("id").cast("int").alias("draw")).select("draw", *[RK.parameter(k, RK.PRIOR, "draw", 1).alias(k) for k in th]).collect()}
    assert all(np.allclose(th[k], [columns[i][k] for i in range(n)], rtol=1e-12) for k in th)
    lw = RK.draw_likelihoods(df, "k", "m", "g", "y", n)
    p = plain_p(rows, th, (1, 1))
    ll = {k: y * np.log(x) + (1 - y) * np.log(1 - x) for k, y, x in p}
    total = np.sum(list(ll.values()), axis=0)
    got = {r.draw: r.logw for r in lw.collect()}
    assert np.allclose([got[i] for i in range(n)], total, atol=1e-9)
    post = {r.draw: r.w for r in RK.posterior(lw).collect()}
    w = np.exp(total - total.max())
    w /= w.sum()
    assert np.allclose([post[i] for i in range(n)], w, atol=1e-12)
    loo = {r.k: r.p_loo for r in RK.leave_one_out(df, lw, "k", "m", "g", "y", n).collect()}
    for k, _, x in p:
        e = np.exp(total - ll[k] - (total - ll[k]).max())
        assert loo[k] == pytest.approx((e * x).sum() / e.sum(), abs=1e-10)
    new = RK.predict(RK.posterior(lw), df, "k", "m", "g").collect()
    want = {k: x @ w for k, _, x in p}
    assert len(new) == len(want) and all(r.p == pytest.approx(want[r.k], abs=1e-9) for r in new)


def test_models_are_compared_as_in_numpy(spark):
    n, rows = 3000, observed()
    df = spark.createDataFrame(rows, "k long, m double, g double, y double").repartition(3)
    got = {r.model: r for r in RK.model_comparison(df, "k", "m", "g", "y", n).collect()}
    th, want = plain_draws(n, RK.NEUTRAL), {}
    for model, use in RK.MODELS.items():
        p = plain_p(rows, th, use)
        ll = [y * np.log(x) + (1 - y) * np.log(1 - x) for _, y, x in p]
        total = np.sum(ll, axis=0)
        loo = []
        for (_, y, x), own in zip(p, ll):
            e = np.exp(total - own - (total - own).max())
            q = np.clip((e * x).sum() / e.sum(), 1e-6, 1 - 1e-6)
            loo.append(y * np.log(q) + (1 - y) * np.log(1 - q))
        want[model] = total.max() + np.log(np.mean(np.exp(total - total.max()))), np.mean(loo)
    for model, (marginal, score) in want.items():
        assert (got[model].log_marginal, got[model].loo_score) == pytest.approx((marginal, score), abs=1e-9)
        assert got[model].ln_bayes_factor == pytest.approx(marginal - want["intercept"][0], abs=1e-9)


# ---- draws of planets --------------------------------------------------------------------------------

def planet_rows(n=30):
    rng, rows = np.random.default_rng(21), []
    for i in range(n):
        r = {"key": i, "mass_measured": bool(i % 3 == 0), "transiting": bool(i % 7 != 6)}
        for c, lo, hi in (("insol", 0.2, 2), ("teff", 2500, 7500), ("rade", 0.6, 4.5), ("mass", 0.5, 9), ("rs", 0.1, 1.1), ("axis", 0.02, 0.2), ("lum", -3, 0)):
            v = float(rng.uniform(lo, hi))
            r |= {c: v, f"{c}_err1": abs(v) * 0.1, f"{c}_err2": -abs(v) * 0.05}
        if i % 4 == 0:
            r["insol_err1"] = None
        if i % 5 == 0:
            r |= {"lum": None, "lum_err1": None, "lum_err2": None}
        if i % 6 == 0:
            r["rade_err2"] = None
        rows.append(r | {"jmag": float(rng.uniform(7, 12))})
    return pd.DataFrame(rows)


def planet_frame(spark, rows):
    columns = [*DR.QUANTITIES]
    data = [(r["key"], *[None if pd.isna(r[c]) else float(r[c]) for c in columns], bool(r["mass_measured"]), bool(r["transiting"])) for _, r in rows.iterrows()]
    return spark.createDataFrame(data, "key long, " + ", ".join(f"{c} double" for c in columns) + ", mass_measured boolean, transiting boolean").repartition(3)


def hashed(spark, rows):
    h = {r.key: r.h for r in planet_frame(spark, rows).select("key", F.xxhash64("key").alias("h")).collect()}
    return rows.assign(_h=[h[k] for k in rows["key"]])


def test_drawn_physics_follows_the_column_formulas(spark):
    rows = hashed(spark, planet_rows())
    d = DR.physics(rows, np.arange(5))
    flat = [(int(k), j, *[float(d[c][i, j]) for c in ("S", "T", "R", "M", "Rs", "A", "L")], float(rows["jmag"].iloc[i])) for i, k in enumerate(rows["key"]) for j in range(5)]
    df = spark.createDataFrame(flat, "key long, draw int, S double, T double, R double, M double, Rs double, A double, L double, jmag double")
    df = df.withColumn("teq", PH.equilibrium_temperature("T", "Rs", "A"))
    cons, opt = PH.in_zone("S", "T")
    metric, cut = PH.spectroscopy_metric("R", "M", "Rs", "teq", "jmag")
    got = df.select("key", "draw", "teq", cons.alias("cons"), opt.alias("opt"), metric.alias("metric"), cut.alias("cut"), PH.escape_velocity("M", "R").alias("v_esc"),
                    PH.cumulative_flux("S", "L").alias("flux"), PH.shoreline_margins(PH.escape_velocity("M", "R"), F.col("S"), F.col("L"), F.lit(0.0), F.lit(0.0))["bolometric"].alias("margin_bolometric")).collect()
    at = {k: i for i, k in enumerate(rows["key"])}
    for r in got:
        i, j = at[r.key], r.draw
        for c in ("teq", "cut", "v_esc", "flux", "margin_bolometric"):
            assert d[c][i, j] == pytest.approx(r[c], rel=1e-9)
        assert (d["cons"][i, j], d["opt"][i, j]) == (r.cons, r.opt)
        assert d["metric"][i, j] == pytest.approx(r.metric, rel=1e-9) if rows["transiting"].iloc[i] else np.isnan(d["metric"][i, j])
    free = ~rows["mass_measured"].to_numpy()
    mass = df.select("key", "draw", PH.mass_from_radius("R").alias("m"), PH.mass_scatter_dex("R").alias("s")).collect()
    z = DR.normals(rows["_h"].to_numpy(), np.arange(5), "m", 1)
    assert all(d["M"][at[r.key], r.draw] == pytest.approx(r.m * 10 ** (z[at[r.key], r.draw] * r.s), rel=1e-9) for r in mass if free[at[r.key]])


def test_draws_have_the_quoted_spread_and_depend_on_the_planet_alone(spark):
    rows = hashed(spark, planet_rows())
    d = DR.physics(rows, np.arange(20_000))
    above = (d["T"] > rows["teff"].to_numpy()[:, None])
    assert above.mean() == pytest.approx(0.5, abs=0.01)
    step = (d["T"] / rows["teff"].to_numpy()[:, None] - 1)
    assert np.sqrt((step[above] ** 2).mean()) == pytest.approx(0.1, rel=0.02) and np.sqrt((step[~above] ** 2).mean()) == pytest.approx(0.05, rel=0.02)
    no_low = rows["rade_err2"].isna().to_numpy()
    assert (d["R"][no_low] >= rows["rade"].to_numpy()[no_low, None] - 1e-12).all()
    alone = DR.physics(rows.iloc[7:8], np.arange(100, 120))
    assert np.array_equal(alone["R"][0], d["R"][7, 100:120])
    u = DR.uniforms(np.arange(50), np.arange(4000), "i", 1)
    assert abs(np.corrcoef(u)[np.triu_indices(50, 1)]).max() < 0.08 and u.mean() == pytest.approx(0.5, abs=0.005)


def test_summaries_and_ranks_equal_numpy(spark, monkeypatch):
    rows = hashed(spark, planet_rows())
    df, n = planet_frame(spark, rows), 700
    d = DR.physics(rows, np.arange(n))
    got = {r.key: r for r in DR.planet_summary(df, "key", n).collect()}
    for i, k in enumerate(rows["key"]):
        assert got[k].teq == pytest.approx(np.median(d["teq"][i])) and got[k].p_retain_primary == pytest.approx((d["margin_primary"][i] < 0).mean())
        if rows["transiting"].iloc[i]:
            assert got[k].metric_p84 == pytest.approx(np.quantile(d["metric"][i], 0.84)) and got[k].p_above_cut == pytest.approx((d["metric"][i] > d["cut"][i]).mean())
        else:
            assert got[k].metric is None and got[k].p_above_cut is None
    seen = rows["transiting"].to_numpy()
    s = DR.score(DR.components(d), RK.WEIGHTS)[seen].round(9)
    ranks = np.array([[1 + (s[:, j] > s[i, j]).sum() for j in range(n)] for i in range(len(s))])
    assert (ranks[:, 0] >= 1).all() and len(np.unique(ranks[:, 0])) < len(s)            # some planets share a rank
    want = {k: (np.median(r), np.quantile(r, 0.05), np.quantile(r, 0.95), (r <= 10).mean()) for k, r in zip(rows["key"][seen], ranks)}
    monkeypatch.setattr(DR, "CELLS", 26 * 100)                                          # several blocks of draws
    for limit in ("2000000", "20"):                                                     # and ranked as rows
        spark.conf.set("spark.surveyframe.rowsPerTask", limit)
        out = {r.key: (r.rank_median, r.rank_p5, r.rank_p95, r.p_top) for r in DR.rank_distribution(df, "key", RK.WEIGHTS, n).collect()}
        spark.conf.unset("spark.surveyframe.rowsPerTask")
        assert out.keys() == want.keys() and all(out[k] == pytest.approx(want[k]) for k in want)
    q = {r.key: (r.low, r.score, r.high) for r in DR.score_quantiles(df, "key", RK.WEIGHTS, n).collect()}
    full = DR.score(DR.components(d), RK.WEIGHTS)[seen]
    assert all(q[k] == pytest.approx(tuple(np.quantile(x, (0.05, 0.5, 0.95)))) for k, x in zip(rows["key"][seen], full))
    assert {r.dropped for r in DR.ablation(df, "key", RK.WEIGHTS, 50).collect()} == set(RK.WEIGHTS)


def test_few_label_draws_in_tasks_equal_draws_as_rows(spark):
    rng = np.random.default_rng(8)
    data = [(i, "abc"[i % 3] if i > 3 else "d", int(rng.random() < 0.4), round(float(rng.random()), 2)) for i in range(160)]
    df = spark.createDataFrame(data, "row long, band string, y int, p double")
    found = lambda: {r.kind: tuple(r) for r in RS.few_label(df.filter("row < 110"), df.filter("row >= 90"), "band", "y", "p", "row", 5, 3).collect()}
    tasks, plain = [], RS.spread
    try:
        RS.spread = lambda *a: tasks.append(1) or plain(*a)
        few = found()
        assert len(tasks) == 1
        spark.conf.set("spark.surveyframe.rowsPerTask", "20")
        many = found()
        assert len(tasks) == 1                                                          # the rows did not fit
    finally:
        RS.spread = plain
        spark.conf.unset("spark.surveyframe.rowsPerTask")
    assert few.keys() == many.keys() == {"few", "oracle", "frozen"} and all(few[k] == pytest.approx(many[k]) for k in few)


def test_drawn_rows_are_dealt_and_ranked_from_one_copy(spark):
    """A single file of planets is drawn in many tasks, and ranks of large draws read scores that are made once."""
    planets = planet_frame(spark, planet_rows()).coalesce(1)
    d = RK.planet_draws(planets, "key", 4)
    assert d.rdd.getNumPartitions() > 1
    score = RK.score_components(d, "key").select("key", "draw", F.round(RK.weighted_score(RK.WEIGHTS), 9).alias("score"))
    want = {(r.key, r.draw): r["rank"] for r in RK.shared_rank(score, "score", ["draw"]).collect()}
    spark.conf.set("spark.surveyframe.rowsPerTask", "20")
    got = RK.shared_rank(score, "score", ["draw"])
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.key, r.draw): r["rank"] for r in got.collect()} == want
    spark.conf.unset("spark.surveyframe.rowsPerTask")


def test_median_scores_are_drawn_once(spark, monkeypatch):
    """Ranks read the table of median scores several times; it must hold values by then, not draws to be made again."""
    from surveyframe.operators import metrics as MT

    seen, plain = [], MT.spearman
    monkeypatch.setattr(MT, "spearman", lambda df, *a: seen.append(df) or plain(df, *a))
    got = {r.dropped: r.rows for r in DR.ablation(planet_frame(spark, planet_rows()), "key", RK.WEIGHTS, 20).collect()}
    assert len(seen) == 1 and "MapInPandas" not in seen[0]._jdf.queryExecution().toString()
    assert set(got.values()) == {int(planet_rows()["transiting"].sum())}


def test_a_score_draws_only_what_it_is_made_of(spark):
    rows = hashed(spark, planet_rows())
    every, some = DR.physics(rows, np.arange(300)), DR.physics(rows, np.arange(300), only=DR.SCORED)
    assert "margin_empirical" not in some and "flux" not in some
    assert all(np.array_equal(some[c], every[c], equal_nan=True) for c in DR.SCORED)
    u = np.linspace(0, 1, 10_001)
    assert abs(DR._cos_turns(u.copy()) - np.cos(2 * np.pi * u)).max() < 1e-15
    x = np.random.default_rng(3).normal(size=(40, 101))
    x[3, 5], x[7] = np.nan, np.nan
    low, mid = DR._quantiles(x, (0.16, 0.5))
    assert low[3] == np.nanquantile(x[3], 0.16) and np.isnan(mid[7]) and np.array_equal(mid[8:], np.quantile(x[8:], 0.5, axis=1))


def test_planets_travel_once_per_share_of_the_draws(spark, monkeypatch):
    """A table of many blocks of draws is copied per task, not per block, and gives the same ranks."""
    df = planet_frame(spark, planet_rows())
    run = lambda: {r.key: tuple(r) for r in DR.rank_distribution(df, "key", RK.WEIGHTS, 400).collect()}
    want, dealt, plain = run(), [], DR.spread
    monkeypatch.setattr(DR, "CELLS", 26)                      # a draw at a time
    monkeypatch.setattr(DR, "RANKED", 3, raising=False)
    monkeypatch.setattr(DR, "spread", lambda rows, *rest: dealt.append(rows.count()) or plain(rows, *rest))
    assert run() == want and dealt[0] <= 2 * spark.sparkContext.defaultParallelism * len(want)


# ---- sensitivity, label shift ------------------------------------------------------------------------

def test_indices_of_the_ishigami_function(spark):
    pi = float(np.pi)
    one = spark.createDataFrame([(1,)], "id int")
    d = RK.sobol_designs(one, RK.BASE_SAMPLES, {"x1": (-pi, pi), "x2": (-pi, pi), "x3": (-pi, pi)})
    assert d.count() == 5 * 4096
    f = d.withColumn("f", F.sin("x1") + 7 * F.pow(F.sin("x2"), 2) + 0.1 * F.pow("x3", 4) * F.sin("x1"))
    got = {r.input: (r.first_order, r.total) for r in RK.sobol_indices(f, "f", ["x1", "x2", "x3"]).collect()}
    for name, want in {"x1": (0.3139, 0.5576), "x2": (0.4424, 0.4424), "x3": (0.0, 0.2437)}.items():
        assert got[name] == pytest.approx(want, abs=0.06)


@pytest.mark.parametrize("limit, tolerance", [("2000000", 1e-6), ("5", 0.01)])       # in a task; by rounds over the counts
def test_label_shift_runs_to_its_fixed_point(spark, limit, tolerance):
    rng = np.random.default_rng(9)
    rows = []
    for band, rate in ((0, 0.2), (1, 0.6), (None, 0.4)):
        y = rng.random(400) < rate
        rows += [(band, int(v), float(round(np.clip(rng.normal(0.65 if v else 0.35, 0.15), 0.02, 0.98), 2))) for v in y]
    source = [(0, int(i % 2), 0.5) for i in range(50)] + [(1, int(i % 4 == 0), 0.5) for i in range(40)]
    schema = "band int, y int, p double"
    spark.conf.set("spark.surveyframe.rowsPerTask", limit)
    got = {r.band: r for r in RK.label_shift_em(spark.createDataFrame(rows, schema), spark.createDataFrame(source, schema), "band", "y", "p", tolerance=tolerance).collect()}
    spark.conf.unset("spark.surveyframe.rowsPerTask")
    overall = (25 + 10) / 90
    for band, start in ((0, 0.5), (1, 0.25), (None, overall)):
        p = np.array([r[2] for r in rows if r[0] == band])
        pi, steps = start, 0
        while True:
            a, b = pi / start * p, (1 - pi) / (1 - start) * (1 - p)
            new, steps = (a / (a + b)).mean(), steps + 1
            if abs(new - pi) < tolerance:
                break
            pi = new
        assert steps > 2 and got[band].pi_target == pytest.approx(pi, abs=1e-9) and got[band].pi_source == pytest.approx(start) and got[band].rows == 400
        assert abs(new - got[band].pi_target) < tolerance                                    # one more step changes nothing
