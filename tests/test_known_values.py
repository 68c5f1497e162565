"""Published and hand-calculated values, planted cases and properties, on small fixtures."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyframe.functions import arrays as A
from surveyframe.functions import physics as P
from surveyframe.functions import stats as ST
from surveyframe.functions import text as X
from surveyframe.operators import graph as G
from surveyframe.operators import metrics as M
from surveyframe.operators import models as ML
from surveyframe.operators import ranking as R
from surveyframe.operators import spectra as S
from surveyframe.operators import splits as SP
from surveyframe.operators import timeseries as T


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_planted_twins_and_families(spark):
    rows = [(0, 1, 5.0, 100.0), (1, 2, 5.0 * (1 + 5e-5), 100.02), (2, 3, 7.3, 100.0), (3, 3, 9.0, 50.0), (4, 4, 9.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, star long, p double, t double").withColumn("d", F.lit(3.0 / 24))
    assert [(r.a_id, r.b_id) for r in G.signal_twins(df, "id", "star", "p", "t", "d").orderBy("a_id").collect()] == [(0, 1), (3, 4)]
    fam = {r.id: r.family_root for r in G.signal_families(df, "id", "star", "p", "t", "d").collect()}
    assert fam == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)]
    e = spark.createDataFrame(chain, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(61)] + [(i,) for i in range(100, 300)] + [(999,)], "node long")
    got = {r.node: r.root for r in G.components(e, nodes).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 300)) and got[999] == 999


def test_split_guarantees(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("star"), "o_orderstatus")
    rows = SP.apply_split(o, SP.grouped_split(o, "star", "o_orderstatus"), "star").cache()
    SP.check_leakage(rows, "star", o.count())
    bal = {(r.split, r["class"]): r.pct for r in SP.class_balance(rows, "split", "o_orderstatus", ["F", "O", "P"]).collect()}
    assert all(abs(bal[(s, c)] - bal[("all", c)]) < 2.5 for s in ("train", "val", "test") for c in "FOP")
    share = {r.split: r["count"] / o.count() for r in rows.groupBy("split").count().collect()}
    assert abs(share["test"] - 0.15) < 0.02 and abs(share["val"] - 0.15) < 0.02


def test_proportions_and_tests(spark):
    p, lo, hi = ST.wilson(F.lit(90), F.lit(100))
    b = one(spark, p=p, lo=lo, hi=hi, m=ST.binomial_two_sided(F.lit(0), F.lit(10)), f=ST.fisher_two_sided(F.lit(8), F.lit(2), F.lit(1), F.lit(5)),
            big=ST.binomial_two_sided(F.lit(499000), F.lit(1000000)), t=ST.normal_tail(F.lit(1.959964)))
    assert (round(b.p, 4), round(b.lo, 4), round(b.hi, 4)) == (0.9, 0.8256, 0.9448)
    assert b.m == pytest.approx(2 * 0.5 ** 10) and b.f == pytest.approx(0.03496503, rel=1e-5)
    assert b.big == pytest.approx(0.04563, rel=1e-2) and b.t == pytest.approx(0.025, rel=1e-5)


def test_auc_interval_brackets_and_survives_a_perfect_ranking(spark):
    lo, hi = ST.auc_interval(F.lit(0.97), F.lit(15), F.lit(14))
    plo, phi = ST.auc_interval(F.lit(1.0), F.lit(6), F.lit(7))
    r = one(spark, lo=lo, hi=hi, plo=plo, phi=phi)
    assert 0.8 < r.lo < 0.97 < r.hi < 1 and 0.5 < r.plo < 1 and r.phi == 1.0


def test_holm_by_hand(spark):
    d = spark.createDataFrame([("a", .01), ("b", .04), ("c", .03)], "name string, p double")
    got = {r.name: round(r.p_holm, 10) for r in M.holm(d, "p", "name").collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_calibration_errors(spark):
    d = spark.createDataFrame([(i, y, 0.5) for i, y in enumerate([0, 0, 0, 0, 1, 1, 1, 1, 1, 0])], "id int, y int, p double")
    assert M.ece_equal_count(d, "y", "p", "id", 1).first().ece == pytest.approx(0)
    bad = spark.createDataFrame([(i, 0, 0.9) for i in range(10)], "id int, y int, p double")
    assert M.ece_equal_count(bad, "y", "p", "id", 10).first().ece == pytest.approx(0.9)
    assert M.ece_equal_width(bad, "y", "p").first().ece == pytest.approx(0.9)


def test_zone_and_planets(spark):
    r = one(spark, e=F.struct(*P.in_zone(F.lit(1.0), F.lit(5780.0))), v=F.struct(*P.in_zone(F.lit(1.91), F.lit(5780.0))), m=F.struct(*P.in_zone(F.lit(0.43), F.lit(5780.0))),
            lim=P.flux_limit("runaway_greenhouse", F.lit(5780.0)), teq=P.equilibrium_temperature(F.lit(5772.0), F.lit(1.0), F.lit(1.0)), mass=P.mass_from_radius(F.lit(1.0)),
            esc=P.escape_velocity(F.lit(1.0), F.lit(1.0)))
    assert tuple(r.e) == (True, True) and tuple(r.v) == (False, False) and tuple(r.m) == (True, True)
    assert r.lim == pytest.approx(1.107) and 278 < r.teq < 280 and r.mass == pytest.approx(0.9718) and r.esc == pytest.approx(11.186)
    cut = one(spark, **{f"c{i}": P.spectroscopy_metric(F.lit(x), F.lit(1.0), F.lit(1.0), F.lit(300.0), F.lit(8.0))[1] for i, x in enumerate([1.49, 1.5, 4.0])})
    assert (cut.c0, cut.c1, cut.c2) == (12.0, 92.0, 92.0)


def test_duration_of_an_earth(spark):
    null = F.lit(None).cast("double")
    h = T.duration_hours(F.lit(365.25), F.lit(1.0), F.lit(1.0), null, null, F.lit(0.00917), null, F.lit(0.0))
    assert one(spark, h=h).h == pytest.approx(13.0, rel=0.02)


def test_names_years_links_evidence(spark):
    k = lambda s: X.name_key(F.lit(s))
    r = one(spark, a=k("HAT-P-18 Ab") == k("HAT-P-18 b"), b=k("TRAPPIST-1 e") == k("TRAPPIST-1e"), c=k("WASP-39 b") == k("WASP-39 c"),
            y=X.reference_year(F.lit("<a refstr=SMITH_ET_AL__2019 href=/1812> Smith et al. 2021 </a>")), n=X.reference_year(F.lit("none 3021")),
            l=X.paper_link(F.lit("see arXiv:2301.01234v2")), h=X.host_of(F.lit("K2-18 b")))
    assert r.a and r.b and not r.c and r.y == 2021 and r.n is None and r.l.endswith("/2301.01234") and r.h == "K2-18"
    text = ("<p>We report a 5 sigma detection of methane in this planet. Methane is detected in both visits of the target. "
            "The presence of methane explains the observed spectrum. We find a tentative hint of methane in the third visit.</p>")
    e = one(spark, e=X.evidence(X.strip_html(F.lit(text)), X.GAS_NAMES["CH4"].replace("methane", "[Mm]ethane"))).e
    assert (e.n_sentences, e.n_pos, e.n_tentative) == (4, 3, 1)
    assert one(spark, l=X.evidence_label(F.lit(e.n_pos), F.lit(e.n_neg))).l == "1"


def light_curve(spark):
    t = np.arange(0, 200, 30 / 1440)
    ph = (t - 1 + 1.5) % 3 - 1.5
    flux = 1 + 1e-4 * np.random.default_rng(1).standard_normal(len(t)) - np.where(np.abs(ph) < 0.06, 1e-3, 0)
    rows = [(1, i, float(a), float(b), 1e-4) for i, (a, b) in enumerate(zip(t, flux))]
    return spark.createDataFrame(rows, "star long, id long, t double, flux double, err double").withColumn("period", F.lit(3.0)).withColumn("duration", F.lit(0.12))


def test_fold_view_and_diagnostics(spark):
    lc = light_curve(spark).withColumn("phase", T.phase("t", "period", F.lit(1.0))).cache()
    v = T.as_arrays(T.local_view(lc, ["star"]), ["star"]).first()
    vals = np.array(v["values"])
    assert len(vals) == 201 and np.median(vals) == pytest.approx(0, abs=1e-6) and vals.min() == pytest.approx(-1) and abs(int(vals.argmin()) - 100) <= 13
    louder = T.as_arrays(T.local_view(lc.withColumn("err", F.col("err") * 3), ["star"]), ["star"]).first()
    assert np.allclose(np.array(louder["errors"]), 3 * np.array(v["errors"]), rtol=1e-4) and np.allclose(louder["values"], v["values"])
    d = T.transit_diagnostics(lc, ["star"]).first()
    assert d.depth == pytest.approx(1e-3, rel=0.05) and d.depth_snr > 50
    w = T.transit_diagnostics(lc.withColumn("phase", T.phase("t", "period", F.lit(2.5))), ["star"]).first()
    assert abs(w.depth_snr) < 10


def test_local_quadratic_is_a_least_squares_filter(spark):
    rng, n, h = np.random.default_rng(2), 60, 4
    y = rng.standard_normal(n)
    df = spark.createDataFrame([(1, i, float(i), float(v)) for i, v in enumerate(y)], "k long, id long, t double, y double")
    got = [r.s for r in T.local_quadratic(df, ["k"], "t", "y", h, "s", "id").orderBy("id").collect()]
    for i in range(n):
        c = min(max(i, h), n - 1 - h)
        x = np.arange(c - h, c + h + 1)
        assert got[i] == pytest.approx(np.polyval(np.polyfit(x - c, y[x], 2), i - c), abs=1e-9)


def test_detrend_blocks_do_not_change_the_result(spark, monkeypatch):
    lc = light_curve(spark).limit(400).select("star", "id", "t", "flux")
    a = [r.s for r in T.local_quadratic(lc, ["star"], "t", "flux", 6, "s", "id").orderBy("id").collect()]
    monkeypatch.setattr(T, "LEAST_BLOCK", 1)
    monkeypatch.setattr(T, "WINDOWS_PER_BLOCK", 1)
    b = [r.s for r in T.local_quadratic(lc, ["star"], "t", "flux", 6, "s", "id").orderBy("id").collect()]
    assert np.allclose(a, b, atol=1e-10)


def plain_savgol(y, h):
    if len(y) <= 2 * h:
        return np.full(len(y), np.median(y))
    centre = np.clip(np.arange(len(y)), h, len(y) - 1 - h)
    return np.array([np.polyval(np.polyfit(np.arange(-h, h + 1), y[c - h:c + h + 1], 2), i - c) for i, c in enumerate(centre)])


def plain_detrend(t, y, protected, h):
    live = ~protected
    for _ in range(3):
        trend = plain_savgol(y[live], h)
        res = y[live] - trend
        keep = np.abs(res) < 3 * res.std() + 1e-14
        knots, trend = t[live][keep], trend[keep]
        live[np.flatnonzero(live)[~keep]] = False
    full = np.interp(t, knots, trend)
    flat = y / full
    return full, flat, flat <= np.median(flat) + 3 * flat.std()


def test_every_star_is_detrended_over_its_own_window(spark):
    """Stars of different cadence and longest event, with gaps, against numpy; one star is shorter than its window."""
    rng, rows, want = np.random.default_rng(8), [], {}
    for star, (n, step, longest) in enumerate([(400, 0.02, None), (300, 0.05, 0.9), (260, 0.1, 0.5), (12, 0.05, 2.0), (700, 0.01, 0.6)]):
        t = np.arange(n) * step
        t[n // 2:] += 50 * step                                        # one gap
        y = 1 + 0.01 * np.sin(t / 3) + 0.001 * rng.standard_normal(n)
        y[5::37] += 0.03
        protected = rng.random(n) < 0.1
        y[protected] -= 0.005
        window = max(int(round(max(1.0, 3 * (longest or 0)) / np.median(np.diff(t)))) | 1, 5)
        for part in (slice(0, n // 2), slice(n // 2, n)):
            full, flat, stay = plain_detrend(t[part], y[part], protected[part].copy(), window // 2)
            want.update({star * 1000 + part.start + i: (window, full[i], flat[i]) for i in np.flatnonzero(stay)})
        rows += [(star, star * 1000 + i, float(t[i]), float(y[i]), bool(protected[i]), longest) for i in range(n)]
    assert len({w for w, _, _ in want.values()}) == 5
    df = spark.createDataFrame(rows, "star long, id long, t double, flux double, protected boolean, longest double").repartition(3)
    got = {r.id: (r.window, r.trend, r.flat) for r in T.detrend_events(df, ["star"], "t", "flux", "protected", "longest", "id").collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1:] == pytest.approx(want[i][1:], abs=1e-9) for i in want)


def test_drift_flag(spark):
    p = spark.createDataFrame([(1, 0.0), (1, 1000.0)], "star long, t double")
    e = spark.createDataFrame([("a", 1, 10.0, 0.0, 0.1, 1e-5, 1e-3), ("b", 1, 10.0, 0.0, 0.1, 1e-2, 1e-3), ("c", 1, 10.0, 0.0, 0.1, None, 1e-3)],
                              "object_id string, star long, period double, epoch double, duration double, period_err double, epoch_err double")
    r = {x.object_id: x for x in T.ephemeris_drift(p, e, "star", "t").collect()}
    assert r["a"].reliable and r["a"].drift_h == pytest.approx(24 * math.hypot(1e-3, 100 * 1e-5)) and not r["b"].reliable and r["c"].reliable is None


def test_strength_blind_channels_ignore_scale(spark):
    d = np.random.default_rng(0).normal(size=60)
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    m = F.array(*[F.lit(int(i % 7 != 0)) for i in range(60)])
    a = A.strength_blind(arr(d), arr(np.full(60, 0.5)), m)
    b = A.strength_blind(arr(300 + 7.5 * d), arr(np.full(60, 1.5)), m)
    r = one(spark, a=a["residual"], b=b["residual"], c=a["log_error"], e=b["log_error"])
    assert np.allclose(r.a, r.b, atol=1e-9) and np.allclose(r.c, r.e, atol=1e-9)


def test_band_recovery(spark):
    wl = np.linspace(2, 4, 400)
    rows = [("p", float(w), float(5000 + 10 * math.sin(7 * w)), 30.0) for w in wl]
    df = spark.createDataFrame(rows, "planet string, wl double, d double, e double")
    got = S.injection_recovery(df, ["planet"], "wl", "d", "e", "CH4").first()
    assert got.recovered == pytest.approx(5.0, abs=1e-6)
    b = S.resample(df, ["planet"], "wl", "d", "e")
    obs = {r.molecule: r.observable for r in S.band_observable(b, ["planet"]).collect()}
    assert obs["CH4"] and obs["H2O"] and not obs["CO"]


def test_retention_follows_margin(spark):
    t = spark.createDataFrame([(i, m, 0.0) for i, m in enumerate([-1.0, 0.0, 1.0])], "k int, m double, g double")
    post = spark.createDataFrame([(0.0, -1.3, 2.6, 1.0)], "alpha double, beta double, gamma double, w double")
    p = [r.p for r in R.predict(post, t, "k", "m", "g").orderBy("k").collect()]
    assert p[0] > p[1] > p[2] and p[1] == pytest.approx(0.5)


def test_repeats(spark):
    d = spark.createDataFrame([("a", 30.0, 50.0, 0.0), ("a", 40.0, 50.0, 0.0), ("a", 0.0, 50.0, 0.0), ("b", 10.0, 50.0, 30.0), ("c", 30.0, 50.0, 2.0)], "k string, s double, v double, f double")
    got = {r.k: r.n for r in R.repeats_needed(d, ["k"], "s", "v", "f", 5.0).collect()}
    assert got["a"] == pytest.approx(25 / (0.36 + 0.64)) and got["b"] == math.inf
    assert 900 / (2500 / got["c"] + 4) == pytest.approx(25, rel=1e-9)


def test_success_distribution_against_convolution(spark):
    q = [0.1, 0.5, 0.5, 0.9, 1.0, 0.0]
    d = spark.createDataFrame([("a", x) for x in q], "k string, p double")
    got = [r.probability for r in R.success_distribution(d.withColumnRenamed("k", "g"), ["g"], "p").orderBy("k").collect()]
    want = np.array([1.0])
    for x in q:
        want = np.convolve(want, [1 - x, x])
    assert np.allclose(got, want, atol=1e-12)


def test_leave_one_out_platt_against_brute_force(spark):
    rng = np.random.default_rng(3)
    s, y = rng.uniform(0.05, 0.95, 25), rng.integers(0, 2, 25)
    s[10:14], s[14:17] = s[3], s[4]                       # rows with the same score, and some with the same label too
    fit_rows = lambda lab: [(i, int(b), float(a)) for i, (a, b) in enumerate(zip(s, lab))]
    run = lambda lab, block: [r.p_loo for r in ML.leave_one_out_platt(spark.createDataFrame(fit_rows(lab), "id long, y int, s double"), "id", "y", "s", block=block).orderBy("id").collect()]
    got = run(y, 4000)
    x = np.log(s / (1 - s))
    for i in range(25):
        m = np.arange(25) != i
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(w[0] * x[m] + w[1])))
            g = np.array([((p - y[m]) * x[m]).sum() + w[0], (p - y[m]).sum()])
            k = p * (1 - p)
            w -= np.linalg.solve(np.array([[(k * x[m] ** 2).sum() + 1, (k * x[m]).sum()], [(k * x[m]).sum(), k.sum()]]), g)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(w[0] * x[i] + w[1]))), abs=1e-6)
    flipped = y.copy()
    flipped[0] = 1 - flipped[0]
    assert run(flipped, 10)[0] == pytest.approx(got[0], abs=1e-9)


def test_leave_one_out_platt_meets_no_pairs_near_the_full_fit(spark, monkeypatch):
    """The expansion round the full fit against the fits of every pair; two rows of great leverage are too far for it."""
    rng = np.random.default_rng(4)
    s = np.append(rng.uniform(0.05, 0.95, 1500).round(3), [1e-9, 1 - 1e-9])
    y = np.append((rng.uniform(size=1500) < 0.3 + 0.5 * s[:1500]).astype(int), [1, 0])
    df = spark.createDataFrame([(i, int(b), float(a)) for i, (a, b) in enumerate(zip(s, y))], "id long, y int, s double")
    run = lambda block: {r.id: r.p_loo for r in ML.leave_one_out_platt(df, "id", "y", "s", steps=12, block=block).collect()}
    want, met, plain = run(4000), [], ML._held_fits
    monkeypatch.setattr(ML, "_held_fits", lambda base, pairs, n, m, *rest: met.append((n, m)) or plain(base, pairs, n, m, *rest))
    got = run(200)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(p, abs=1e-10) for i, p in want.items())
    assert all(m < n / 10 for n, m in met)


def test_every_held_object_has_a_fit_without_it(spark):
    """Against a plain Newton fit per object; objects come from the data, NULL among them, features may be missing."""
    rng, rows = np.random.default_rng(5), []
    for i in range(240):
        o = ("a", "b", "c", None)[i % 4]
        d = ("a", "b", "c", None)[rng.integers(4)] if rng.random() < 0.2 else o
        x1, x2 = rng.normal(), rng.normal(3, 2)
        rows.append((i, o, d, int(rng.random() < 1 / (1 + np.exp(-(1.5 * x1 - 0.4 * (x2 - 3))))), float(x1), None if i % 11 == 0 else float(x2)))
    schema = "id long, obj string, donor string, y int, x1 double, x2 double"
    got = ML.held_out_scores(spark.createDataFrame(rows, schema).repartition(3), "obj", "obj", "donor", ["x1", "x2"], "y").collect()
    assert len(got) == 240
    for o in ("a", "b", "c", None):
        train = [r for r in rows if r[1] != o and r[2] != o]
        fill = np.mean([r[5] for r in train if r[5] is not None])
        z = lambda rs: np.array([[1, r[4], fill if r[5] is None else r[5]] for r in rs])  # noqa: B023,E731
        w, t = np.zeros(3), np.array([r[3] for r in train])
        for _ in range(40):
            p = 1 / (1 + np.exp(-z(train) @ w))
            w -= np.linalg.solve((z(train) * (p * (1 - p))[:, None]).T @ z(train), z(train).T @ (p - t))
        want = sorted(1 / (1 + np.exp(-z([r for r in rows if r[1] == o]) @ w)))
        assert np.allclose(sorted(r.score for r in got if r.held == o), want, atol=1e-5)
    one = spark.createDataFrame([(1, "a", "a", 1, 0.1, 0.2), (2, "b", "b", 0, 0.3, 0.1)], schema)
    assert {r.held: r.score for r in ML.held_out_scores(one, "obj", "obj", "donor", ["x1", "x2"], "y").collect()} == {"a": 0.0, "b": 1.0}
    assert ML.held_out_scores(one.filter("id > 5"), "obj", "obj", "donor", ["x1"], "y").collect() == []


def dense_log_likelihood(r, c):
    low = np.linalg.cholesky(c)
    z = np.linalg.solve(low, r)
    return -0.5 * z @ z - np.log(np.diag(low)).sum() - 0.5 * len(r) * np.log(2 * np.pi)


def test_folded_rows_are_not_shuffled_again_for_views_and_diagnostics(spark):
    """Rows that lie with their series are summed up there: one deal of the rows, no join that carries them."""
    rows = spark.range(400).select((F.col("id") % 5).alias("star"), (F.col("id") / 40 - 5).alias("phase"), (1 + F.col("id") % 7 / 10).alias("flux"),
                                   F.lit(0.1).alias("err"), F.lit(10.0).alias("period"), F.lit(0.5).alias("duration")).repartition(4, "star")
    few = T.transit_diagnostics(rows, ["star"], True)
    plan = few._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    spark.conf.set("spark.surveyframe.rowsPerTask", "20")
    many = {r.star: r for r in T.transit_diagnostics(rows, ["star"]).collect()}
    slow = sorted((r.star, r.bin, r.value, r.err) for r in T.local_view(rows, ["star"], 21).collect())
    spark.conf.unset("spark.surveyframe.rowsPerTask")
    for r in few.collect():
        assert tuple(r) == pytest.approx(tuple(many[r.star]))
    view = T.local_view(rows, ["star"], 21, True)
    assert view._jdf.queryExecution().sparkPlan().toString().count("Join") == 1         # one row a series meets its bins
    fast = sorted((r.star, r.bin, r.value, r.err) for r in view.collect())
    assert len(fast) == 5 * 21 and all(a == pytest.approx(b) for a, b in zip(fast, slow))


def test_amplitude_profiles_against_dense_likelihoods(spark):
    rng, rows = np.random.default_rng(4), []
    n, length = 40, 0.2
    x = np.sort(rng.uniform(0, 1, n))
    spot, kernel = 1 + 0.3 * np.sin(3 * x), np.exp(-0.5 * ((x[:, None] - x[None]) / length) ** 2)
    want = {}
    for visit, amplitude in enumerate((0.0, 0.02, 0.1)):
        level, sigma = 10.0, rng.uniform(0.05, 0.15, n)
        shape = np.outer(level * spot, level * spot) * kernel
        y = level + rng.multivariate_normal(np.zeros(n), np.diag(sigma ** 2) + amplitude ** 2 * shape)
        b = np.column_stack([level * spot, np.ones(n)])
        base = np.diag(sigma ** 2) + (b * np.array([0.01, 0.5]) ** 2) @ b.T
        grid = np.linspace(-4.5, 0.0, 361)
        profile = np.array([dense_log_likelihood(y - level, base + 10 ** (2 * a) * shape + 1e-9 * np.eye(n)) for a in grid])
        fast = ML.NoiseProfile(y - level, base, shape)
        assert np.allclose(fast.log_likelihood(grid), profile, atol=1e-5)
        want[visit] = grid, profile, dense_log_likelihood(y - level, base + 1e-9 * np.eye(n))
        rows += [(visit, float(a), float(v), float(e), level, float(w)) for a, v, e, w in zip(x, y, sigma, spot)]
    df = spark.createDataFrame(rows, "visit long, x double, y double, s double, d double, spot double").repartition(3)
    got = {r.visit: r for r in ML.amplitude_profile(df, "visit", "x", "y", "s", "d", {"spot": 0.01}, 0.5, length, "spot").collect()}
    for visit, (grid, profile, none) in want.items():
        r = got[visit]
        assert r.points == n and r.lnl_none == pytest.approx(none, abs=1e-5) and r.lnl >= max(profile.max(), none) - 1e-5
        if r.lnl > none + 1e-9:
            assert abs(r.log10_amplitude - grid[profile.argmax()]) <= grid[1] - grid[0] and r.lnl - profile.max() < 0.01
        else:
            assert r.log10_amplitude == -math.inf
        inside = grid[profile >= r.lnl - 0.5]
        assert r.high == pytest.approx(inside[-1]) and (r.low == -math.inf if inside[0] <= -4.5 else r.low == pytest.approx(inside[0]))
    assert got[2].low > -2 and abs(got[2].log10_amplitude + 1) < 0.4


def test_components_are_finished_in_a_task_that_holds_their_edges(spark, monkeypatch):
    rng = np.random.default_rng(12)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 620)] + [(900, i) for i in range(700, 800)]
    df, nodes = spark.createDataFrame(edges, "a long, b long"), spark.range(1000).withColumnRenamed("id", "node")
    steps, plain = [], G._star_step
    monkeypatch.setattr(G, "_star_step", lambda e, large: steps.append(1) or plain(e, large))
    found = lambda: {r.node: r.root for r in G.components(df, nodes).collect()}
    few = found()
    assert not steps
    monkeypatch.setattr(G, "fits_packed", lambda df, rows: False)
    assert found() == few and steps and len(few) == 1000 and few[620] == 500 and few[900] == 700


def test_rows_to_detrend_are_cut_into_segments_once(spark, monkeypatch):
    """Every pass reads the segments from one copy, instead of finding gaps and windows again."""
    rows = spark.range(300).select(F.col("id").alias("point"), (F.col("id") % 2).alias("star"), (F.col("id") / 10).cast("double").alias("t"),
                                   (1 + F.col("id") % 5 / 10).alias("flux"), F.lit(False).alias("protected"), F.lit(0.2).alias("longest"))
    plans, plain = [], T.local_quadratic
    monkeypatch.setattr(T, "local_quadratic", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, *a, **k))
    out = T.detrend_events(rows, ["star"], "t", "flux", "protected", "longest", "point", gap=20)
    assert len(plans) == 3 and not any("Window" in p or "Join" in p for p in plans[:1])
    assert 0 < out.count() <= 300


def test_stacked_visits_equal_visits_alone(spark, monkeypatch):
    """Visits of a batch are solved together by their length, in steps, and a visit does not depend on the others."""
    rng = np.random.default_rng(9)
    rows = [(v, float(i), float(rng.normal(10, 1)), 0.2, 10.0, 1 + 0.1 * i) for v in range(9) for i in range(5 + v % 3)]
    df = spark.createDataFrame(rows, "visit int, x double, y double, s double, d double, spot double")
    monkeypatch.setattr(ML, "VISITS", 2)
    fit = lambda p: {r.visit: tuple(r) for r in ML.amplitude_profile(p, "visit", "x", "y", "s", "d", {"spot": 0.01}, 0.5, 2.0, "spot").collect()}
    together, seen = fit(df), 0
    for v in (0, 4, 8):
        assert fit(df.filter(F.col("visit") == v))[v] == pytest.approx(together[v])
    profile = ML.NoiseProfile(np.ones((3, 4)), np.stack([np.eye(4) * k for k in (1.0, 2.0, 3.0)]), np.stack([np.full((4, 4), 0.5)] * 3))
    for k, best in enumerate(zip(*profile.best())):
        alone = ML.NoiseProfile(np.ones(4), np.eye(4) * (k + 1.0), np.full((4, 4), 0.5)).best()
        assert [float(b) for b in best] == pytest.approx([float(b) for b in alone], abs=1e-9)
        seen += 1
    assert len(together) == 9 and seen == 3


def test_information_and_projection():
    rng = np.random.default_rng(1)
    t = np.linspace(0, 1, 60)
    s, b, sg = np.exp(-((t - 0.5) / 0.1) ** 2), np.column_stack([np.ones(60), t, t ** 2]), rng.uniform(0.5, 1.5, 60)
    r = s - b @ np.linalg.lstsq(b / sg[:, None], s / sg, rcond=None)[0]
    cov = np.diag(sg ** 2) + 0.3 * np.exp(-0.5 * ((t[:, None] - t[None]) / 0.05) ** 2)
    full = np.column_stack([s, b])
    want = 1 / np.linalg.inv(full.T @ np.linalg.inv(cov) @ full)[0, 0]
    assert ML.marginal_information(s, b, cov) == pytest.approx(want)
    assert ML.marginal_information(s, b, np.diag(sg ** 2)) == pytest.approx((r ** 2 / sg ** 2).sum())


def test_reconstruction_error_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = {r.vec_id: r.error for r in ML.leave_group_out_reconstruction(e, "vec_id", "label", "embedding").collect()}
    p = e.toPandas()
    x = np.stack(p.embedding.to_numpy()).astype(float)
    for lab in p.label.unique()[:3]:
        tr, te = x[(p.label != lab).to_numpy()], (p.label == lab).to_numpy()
        mu = tr.mean(0)
        v = np.linalg.svd(tr - mu, full_matrices=False)[2][:3]
        d = x[te] - mu
        err = np.sqrt(np.mean((d - d @ v.T @ v) ** 2, axis=1))
        assert np.allclose([got[i] for i in p.vec_id[te]], err, atol=1e-8)


def test_subset_fit_against_brute_force(spark):
    from surveyframe.operators import screens as SC

    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.standard_normal(40)
    df = spark.createDataFrame([tuple(map(float, (*a, b))) for a, b in zip(x, y)], "a double, b double, c double, y double")
    got = {r.subset: r.loo_r2 for r in SC.loo_r2_subsets(df, "y", ["a", "b", "c"], 2).collect()}
    X1 = np.column_stack([np.ones(40), x[:, :2]])
    hat = X1 @ np.linalg.pinv(X1)
    want = 1 - (((y - hat @ y) / (1 - np.diag(hat))) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert got["a, b"] == pytest.approx(want) and len(got) == 6
