"""Spectra and arrays: a user's events over the hour of the day are a spectrum, embeddings are views."""

from pyspark.sql import functions as F

from surveyframe.functions import arrays as A
from surveyframe.functions import physics as P
from surveyframe.functions.basics import epoch_days
from surveyframe.operators import matching as M
from surveyframe.operators import spectra as S
from surveyframe.operators import vectors as V
from surveyframe.plans.metrics import r6
from surveyframe.plans.registry import query, sql_uniform

HOUR = "((epoch_us(ts)/86400e6::double - floor(epoch_us(ts)/86400e6::double)) * 24)"
SP = f"sp as (select event_id, user_id, event_type, {HOUR} as wl, value as d, case when event_type <> 'view' then 0.1::double + 0.01::double * value end as e from events)"
BANDS = {"A": [(2.0, 5.0)], "B": [(8.0, 10.5), (13.0, 15.0)], "C": [(18.0, 21.0)]}


def points(t):
    x = epoch_days("ts")
    return t.events.select("event_id", "user_id", "event_type", ((x - F.floor(x)) * 24).alias("wl"), F.col("value").alias("d"),
                           F.when(F.col("event_type") != "view", 0.1 + 0.01 * F.col("value")).alias("e"))


def binned(t, keys=("user_id",)):
    return S.resample(points(t), list(keys), "wl", "d", "e", 0.0, 24.0, 24)


BIN = """bn as (select user_id, floor(wl)::int as bin, bool_and(coalesce(e > 0, false)) as a, sum(d / (e * e)) filter (where e > 0) as wd, sum(1 / (e * e)) filter (where e > 0) as w, avg(d) as m,
avg(e) filter (where e > 0) as em, count(*) filter (where e > 0) as ng, count(*) as n, stddev_pop(d) as sd from sp group by 1, 2),
rs as (select user_id, bin, case when a then wd / w else m end as depth, case when a then 1 / sqrt(w) when ng > 0 then em / sqrt(ng) when n > 1 then sd / sqrt(n) end as unc, n as points from bn)"""
PREP = "md as (select user_id, median(depth) as md, median(unc) as mu from rs group by 1), pr as (select user_id, bin, depth - md as depth, coalesce(unc, mu) as unc, points from rs join md using (user_id))"


@query("binned_spectrum", "A35", f"with {SP}, {BIN} select user_id, bin, round(depth, 6) as depth, round(unc, 6) as unc, points from rs")
def _(t):
    return r6(binned(t), "depth", "unc")


@query("prepared_spectrum", "A35", f"with {SP}, {BIN}, {PREP} select user_id, bin, round(depth, 6) as depth, round(unc, 6) as unc, points from pr")
def _(t):
    return r6(S.prepare(binned(t), ["user_id"]), "depth", "unc")


@query("spectrum_channels", "A35")
def _(t):
    return S.as_channels(S.prepare(binned(t), ["user_id"]), ["user_id"], 24)


_WIN = ", ".join(f"('{m}', {i}, {a}::double, {b}::double)" for m, ws in BANDS.items() for i, (a, b) in enumerate(ws))


@query("band_observable", "A36", f"""with {SP}, {BIN}, c as (select user_id, m, i, count(*) filter (where bin + 0.5 between a and b) as n from rs, (values {_WIN}) v(m, i, a, b) group by 1, 2, 3)
select user_id, m as molecule, max(n) >= 3 as observable from c group by 1, 2""")
def _(t):
    return S.band_observable(binned(t), ["user_id"], BANDS, 0.0, 24.0, 24)


@query("band_index", "A37", f"""with {SP}, {BIN}, {PREP}, f as (select *, bin + 0.5 between 8 and 10.5 as b, (bin + 0.5 between 5 and 7.5 or bin + 0.5 between 11 and 13) as k from pr),
g as (select user_id, count(*) filter (where b) as nb, count(*) filter (where k) as nk, avg(depth) filter (where b) as mb, avg(depth) filter (where k) as mk, sqrt(sum(unc * unc) filter (where b)) / count(*) filter (where b) as eb, sqrt(sum(unc * unc) filter (where k)) / count(*) filter (where k) as ek from f group by 1)
select user_id, case when nb >= 2 and nk >= 2 then round(mb - mk, 6) end as index, case when nb >= 2 and nk >= 2 then round(sqrt(eb * eb + ek * ek), 6) end as error, nb as n_band from g""")
def _(t):
    return r6(S.band_index(S.prepare(binned(t), ["user_id"]), ["user_id"], (8.0, 10.5), [(5.0, 7.5), (11.0, 13.0)], 0.0, 24.0, 24), "index", "error")


def _in(x, ws):
    return "(" + " or ".join(f"{x} between {a}::double and {b}::double" for a, b in ws) + ")"


_ANY = _in("wl", [w for ws in BANDS.values() for w in ws])


def band_sql(name, src, depth="d"):
    parts = " union all ".join(f"select user_id, '{m}' as molecule, {depth} as d, 1 / (e * e) as w, {_in('wl', ws)} as b, {_in('wl', [(a - 3, b + 3) for a, b in ws])} and not {_ANY} as k from {src} where e > 0" for m, ws in BANDS.items())
    return f"""{name}_p as ({parts}), {name}_g as (select user_id, molecule, count(*) filter (where b) as n_band, count(*) filter (where k) as n_cont, sum(w) filter (where b) as wb, sum(w) filter (where k) as wc,
sum(w * d) filter (where b) as db, sum(w * d) filter (where k) as dc, sum(w * d * d) as q from {name}_p where b or k group by 1, 2),
{name}_v as (select *, n_band >= 3 and n_cont >= 3 as evaluable from {name}_g),
{name}_s as (select *, case when evaluable then db / wb - dc / wc end as delta, case when evaluable then sqrt(1 / wb + 1 / wc) end as sigma, case when evaluable then (q - db * db / wb - dc * dc / wc) / greatest(n_band + n_cont - 2, 1) end as chi2_red from {name}_v),
{name} as (select *, sigma * sqrt(greatest(chi2_red, 1)) as wide from {name}_s)"""


def tests(t):
    return S.band_test(points(t), ["user_id"], "wl", "d", "e", BANDS, 3.0)


@query("band_statistic", "A38", f"""with {SP}, {band_sql('bt', 'sp')} select user_id, molecule, n_band, n_cont, evaluable, round(delta, 6) as delta, round(sigma, 6) as sigma, round(delta / sigma, 5) as z, round(chi2_red, 5) as chi2_red,
round(wide, 5) as sigma_inflated, round(delta / wide, 6) as z_inflated, round(greatest(delta, 0) + 3 * wide, 5) as limit3 from bt""")
def _(t):
    return tests(t).select("user_id", "molecule", "n_band", "n_cont", "evaluable", *[F.round(c, d).alias(c) for c, d in
                           [("delta", 6), ("sigma", 6), ("z", 5), ("chi2_red", 5), ("sigma_inflated", 5), ("z_inflated", 6), ("limit3", 5)]])


@query("injection_check", "A39", f"""with {SP}, {band_sql('b0', 'sp')}, s1 as (select sp.*, d + case when {_in('wl', BANDS['B'])} then 5 * sigma else 0 end as d2 from sp join b0 using (user_id) where molecule = 'B' and evaluable),
{band_sql('b1', 's1', 'd2')} select b1.user_id, round(b1.delta / b1.sigma - b0.delta / b0.sigma, 5) as recovered from b1 join b0 using (user_id, molecule) where molecule = 'B' and b0.evaluable""")
def _(t):
    got = S.injection_recovery(points(t), ["user_id"], "wl", "d", "e", "B", BANDS, window=3.0)
    return got.withColumn("recovered", F.round("recovered", 5))


@query("continuum_excess", "A40", f"""with {SP}, f as (select user_id, wl as x, d as y, 1 / (e * e) as w, not {_ANY} as o, wl between 8 and 10.5 as h from sp where e > 0),
g as (select user_id, count(*) filter (where o) as n, count(*) filter (where h) as nb, sum(w) filter (where o) as s, sum(w*x) filter (where o) as sx, sum(w*x*x) filter (where o) as sxx, sum(w*y) filter (where o) as sy, sum(w*x*y) filter (where o) as sxy,
sum(w) filter (where h) as b, sum(w*x) filter (where h) / sum(w) filter (where h) as xb, sum(w*y) filter (where h) / sum(w) filter (where h) as yb from f group by 1), k as (select *, s * sxx - sx * sx as det from g where n >= 4 and nb >= 3)
select user_id, round((s * sxy - sx * sy) / det, 5) as slope, round(yb - (sxx * sy - sx * sxy) / det - (s * sxy - sx * sy) / det * xb, 5) as excess, round(sqrt(1 / b + (sxx - 2 * xb * sx + xb * xb * s) / det), 5) as sigma from k""")
def _(t):
    got = S.continuum_excess(points(t), ["user_id"], "wl", "d", "e", BANDS, (8.0, 10.5))
    return got.select("user_id", *[F.round(c, 5).alias(c) for c in ("slope", "excess", "sigma")])


@query("band_profile", "A40", f"with {SP} select event_type, floor(wl / 0.5)::bigint as step, round(sum(d / (e * e)) / sum(1 / (e * e)), 6) as mean, round(1 / sqrt(sum(1 / (e * e))), 6) as error, count(*) as points from sp where e > 0 group by 1, 2")
def _(t):
    return r6(S.band_profile(points(t), ["event_type"], "wl", "d", "e", 0.5), "mean", "error")


AMP = "am as (select user_id, 0.05::double + avg(value) / 100 as amplitude from events group by 1)"


def amplitudes(t):
    return t.events.groupBy("user_id").agg((0.05 + F.avg("value") / 100).alias("amplitude"))


@query("sensitivity_needs", "A41", f"""with {SP}, {AMP}, {band_sql('bt', 'sp')} select user_id, molecule, size, round(wide / amplitude, 5) as sigma_in_h, round(wide * 5 / (size * amplitude), 4) as improve, round(power(wide * 5 / (size * amplitude), 2), 3) as repeats from bt join am using (user_id), (values (2.0::double), (5.0::double)) v(size) where evaluable""")
def _(t):
    need = S.sensitivity(tests(t), amplitudes(t), ["user_id"])[0]
    return need.select("user_id", "molecule", "size", F.round("sigma_in_h", 5).alias("sigma_in_h"), F.round("improve", 4).alias("improve"), F.round("repeats", 3).alias("repeats"))


@query("best_band_per_spectrum", "A41", f"""with {SP}, {AMP}, {band_sql('bt', 'sp')} select user_id, arg_min(molecule, (wide / amplitude, molecule)) as best_band, round(min(wide / amplitude), 5) as sigma_in_h from bt join am using (user_id) where evaluable group by 1""")
def _(t):
    best = S.sensitivity(tests(t), amplitudes(t), ["user_id"])[1]
    return best.withColumn("sigma_in_h", F.round("sigma_in_h", 5))


@query("reduction_spread", "A42", f"""with {SP}, {band_sql('bt', 'sp')}, n as (select c_nationkey, molecule, delta / sigma as z from bt join customer on c_custkey = user_id where evaluable)
select c_nationkey, molecule, count(*) as inputs, round(min(z), 5) as low, round(median(z), 5) as median, round(max(z), 5) as high, round(stddev_samp(z), 5) as sd from n group by 1, 2""")
def _(t):
    j = tests(t).filter("evaluable").join(t.customer.select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id")
    got = S.spread_over_inputs(j, ["c_nationkey", "molecule"], "z")
    return got.select("c_nationkey", "molecule", "inputs", *[F.round(c, 5).alias(c) for c in ("low", "median", "high", "sd")])


@query("feature_strength", "A43", f"""with {SP}, g as (select user_id, sum(1 / (e * e)) as w, sum(d / (e * e)) as s, sum(d * d / (e * e)) as q, count(*) as n from sp where e > 0 group by 1) select user_id, round((q - s * s / w) / n, 5) as strength, n as points from g""")
def _(t):
    return S.feature_strength(points(t), ["user_id"], "d", "e").select("user_id", F.round("strength", 5).alias("strength"), "points")


@query("template_snr", "A67", f"""with {SP}, {BIN}, t as (select i::int as bin, sin(i / 3.0::double) as s from range(24) r(i)), j as (select user_id, 1 / (unc * unc) as w, s from rs join t using (bin) where unc > 0),
g as (select user_id, sum(w) as w, sum(w * s) as ws, sum(w * s * s) as q from j group by 1) select user_id, round(sqrt(greatest(q - ws * ws / w, 0)), 5) as snr from g""")
def _(t):
    template = t.spark.range(24).select(F.col("id").cast("int").alias("bin"), F.sin(F.col("id") / 3.0).alias("s"))
    return S.matched_filter(binned(t), template, ["user_id"], "bin", "s", "unc").withColumn("snr", F.round("snr", 5))


CAL = f"cal as (select event_type, user_id, user_id||'/'||floor(epoch_us(ts)/86400e6::double / 10)::bigint as spec, {HOUR} as wl, ln(value) as v from events)"
HM = "m1 as (select event_type, user_id, spec, floor(wl)::int as b, median(v) as v from cal group by all), m2 as (select event_type, user_id, b, median(v) as v from m1 group by 1, 2, 3)"


def calibration(t):
    x = epoch_days("ts")
    spec = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.floor(x / 10).cast("string"))
    return t.events.select("event_type", "user_id", spec.alias("spec"), ((x - F.floor(x)) * 24).alias("wl"), F.ln("value").alias("v"))


@query("hierarchical_median", "A44", f"with {CAL}, {HM} select event_type, b, round(median(v), 6) as v from m2 group by 1, 2")
def _(t):
    curve = S.fit_curve(calibration(t), "event_type", "user_id", "spec", "wl", "v", 0.0, 24.0, 24)
    return curve.select("event_type", F.posexplode("ys").alias("b", "v")).withColumn("v", F.round("v", 6))


@query("leave_one_host_out", "A45", f"""with {CAL}, {HM}, hs as (select distinct event_type, user_id from m2), cv as (select h.event_type, h.user_id, b, median(v) as v from hs h join m2 m on m.event_type = h.event_type and m.user_id <> h.user_id group by 1, 2, 3),
q as (select cal.*, greatest(least(floor(wl - 0.5), 22), 0)::int as i, greatest(least(wl, 23.5), 0.5) as x from cal), s as (select q.event_type, q.user_id, spec, 0.5 * (q.v - (a.v + (x - (i + 0.5)) * (b.v - a.v))) as lr
from q join cv a on a.event_type = q.event_type and a.user_id = q.user_id and a.b = i join cv b on b.event_type = q.event_type and b.user_id = q.user_id and b.b = i + 1),
p as (select event_type, user_id, spec, median(lr) as lr from s group by 1, 2, 3) select event_type, user_id, round(median(lr), 6) as log_ratio from p group by 1, 2""")
def _(t):
    return r6(S.leave_one_host_out(calibration(t), "event_type", "user_id", "spec", "wl", "v", 0.0, 24.0, 24), "log_ratio")


@query("weighted_quantiles", "W16", """with c as (select l_returnflag, l_extendedprice as x, sum(l_quantity) as w from lineitem group by 1, 2), k as (select *, sum(w) over (partition by l_returnflag order by x) / sum(w) over (partition by l_returnflag) as q from c),
p as (select unnest([0.025::double, 0.16::double, 0.5::double, 0.84::double]) as p), b as (select l_returnflag, p, max(case when q <= p then q end) as qa, max(case when q <= p then x end) as xa, min(case when q > p then q end) as qb, min(case when q > p then x end) as xb from k, p group by 1, 2),
v as (select l_returnflag, p, case when qa is null then xb when qb is null then xa else xa + (p - qa) * (xb - xa) / (qb - qa) end as v from b)
select l_returnflag, round(max(v) filter (where p = 0.025), 4) as q02, round(max(v) filter (where p = 0.16), 4) as q16, round(max(v) filter (where p = 0.5), 4) as q50, round(max(v) filter (where p = 0.84), 4) as q84 from v group by 1""")
def _(t):
    got = S.weighted_quantile(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", {"q02": 0.025, "q16": 0.16, "q50": 0.5, "q84": 0.84})
    return got.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q02", "q16", "q50", "q84")])


@query("best_row_per_regime", "W19", """select o_custkey, min(o_totalprice) as best_white, arg_min(o_orderpriority, (o_totalprice, o_orderpriority)) as o_orderpriority_white, min(case when o_orderstatus = 'F' then o_totalprice end) as best_tls,
arg_min(o_orderpriority, (o_totalprice, o_orderpriority)) filter (where o_orderstatus = 'F') as o_orderpriority_tls from orders group by 1""")
def _(t):
    o = t.orders.withColumn("tls", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return S.best_per_regime(o, ["o_custkey"], {"white": "o_totalprice", "tls": "tls"}, "o_orderpriority")


@query("evidence_differences", "F26", """with r as (select o_custkey, o_orderstatus as m, avg(o_totalprice) / 1234.567::double as z, stddev_pop(o_totalprice) / 12345.67::double as e from orders group by 1, 2)
select r.o_custkey, case r.m when 'O' then 'CH4' else 'CO2' end as term, round(f.z - r.z, 6) as ln_b, round(sqrt(f.e * f.e + r.e * r.e), 6) as error from r join r f on f.o_custkey = r.o_custkey and f.m = 'F' where r.m in ('O', 'P')""")
def _(t):
    r = t.orders.groupBy("o_custkey", F.col("o_orderstatus").alias("m")).agg((F.avg("o_totalprice") / 1234.567).alias("z"), (F.stddev_pop("o_totalprice") / 12345.67).alias("e"))
    return r6(S.evidence_table(r, ["o_custkey"], "m", "z", "e", "F", {"CH4": "O", "CO2": "P"}), "ln_b", "error")


@query("evidence_credit", "F26", """select o_custkey, count(*) as inputs, count(*) filter (where o_totalprice > 250000) as improved, round(avg(o_totalprice) / 61234.567::double, 6) as ln_b,
avg(o_totalprice) / 61234.567::double >= 3 and count(*) filter (where o_totalprice > 250000) >= ceil(2 * count(*) / 3.0) as credited from orders group by 1""")
def _(t):
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("inputs"), F.count_if(F.col("o_totalprice") > 250000).alias("improved"), (F.avg("o_totalprice") / 61234.567).alias("ln_b"))
    return r6(g.withColumn("credited", S.credited(F.col("ln_b"), F.col("improved"), F.col("inputs"))), "ln_b")


# ---- arrays ----------------------------------------------------------------------------------------

EMB = "em as (select vec_id, label, embedding::double[] as g from embeddings)"


def unrolled(df, **arrays):
    z = F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])
    return df.select("vec_id", F.posexplode(z).alias("i", "z")).select("vec_id", "i", *[F.col(f"z.{n}").alias(n) for n in arrays])


@query("error_channel", "F17", f"with {EMB}, u as (select vec_id, unnest(g) as x, generate_subscripts(g, 1) - 1 as i from em) select vec_id, i::int as i, round(least(greatest(log10(greatest(x, 1e-4::double)), -4), 2) / 2, 6) as value from u")
def _(t):
    return r6(unrolled(t.embeddings, value=A.error_channel("embedding")), "value")


def _med(x):
    return f"list_aggregate({x}, 'median')"


_G = {"body": "list_slice(g, 29, 37)", "wings": "list_concat(list_slice(g, 1, 20), list_slice(g, 46, 64))", "oot": "list_concat(list_slice(g, 4, 26), list_slice(g, 39, 61))"}
_SHAPE = f"""with {EMB}, a as (select *, {_G['body']} as body, {_G['wings']} as wings, {_G['oot']} as oot from em), b as (select *, -list_min(body) as local_depth, -list_avg(body) as local_floor, list_stddev_pop(wings) as ws, {_med('oot')} as base, list_min(g) / 2 as half,
-list_min(list_slice(g, 1, 32)) as l, -list_min(list_slice(g, 33, 64)) as r from a), c as (select *, 1.4826::double * list_aggregate(list_transform(oot, lambda x: abs(x - base)), 'median') as mad from b)
select vec_id, round(local_depth, 6) as local_depth, round(local_floor, 6) as local_floor, round(case when local_depth > 0 then local_floor / local_depth else 0 end, 5) as v_shape, round(case when ws > 0 then local_depth / ws else 0 end, 5) as local_snr,
round(list_avg(wings), 6) as wing_level, round(ws, 6) as wing_scatter, round(list_stddev_pop(g), 6) as global_scatter, round(mad, 6) as oot_mad, round(len(list_filter(g, lambda x: x < half)) / 64.0::double, 6) as duration_frac,
round(greatest(case when mad > 0 then (base - {_med('list_slice(g, 1, 3)')}) / mad else 0 end, case when mad > 0 then (base - {_med('list_slice(g, 62, 64)')}) / mad else 0 end), 5) as secondary_sig,
round(greatest(case when mad > 0 then (base - {_med('list_slice(g, 15, 18)')}) / mad else 0 end, case when mad > 0 then (base - {_med('list_slice(g, 47, 50)')}) / mad else 0 end), 5) as quadrature_sig,
round(case when l + r > 0 then abs(l - r) / (l + r) else 0 end, 6) as transit_asymmetry from c"""


@query("shape_features", "F18", _SHAPE)
def _(t):
    g = A.doubles("embedding")
    f = A.shape_features(g, g, 64, 64, core=4, wing=12, gap=6, quarter_half=2)
    digits = {"v_shape": 5, "local_snr": 5, "secondary_sig": 5, "quadrature_sig": 5}
    return t.embeddings.select("vec_id", *[F.round(c, digits.get(n, 6)).alias(n) for n, c in f.items()])


def channels(t):
    g = A.doubles("embedding")
    return t.embeddings.withColumn("d", g).withColumn("u", F.transform(g, lambda x: F.abs(x) + 0.1)).withColumn("m", F.transform(g, lambda x: (x > -0.1).cast("int")))


CH = f"{EMB}, ch as (select vec_id, unnest(g) as d, generate_subscripts(g, 1) - 1 as i from em), cu as (select *, abs(d) + 0.1::double as u, (d > -0.1)::int as m from ch)"


@query("scale_height_units", "F19", f"with {CH}, md as (select vec_id, median(d) filter (where m > 0) as md from cu group by 1) select vec_id, i::int as i, case when m > 0 then round((d - md) / 0.02::double, 6) end as value from cu join md using (vec_id)")
def _(t):
    c = channels(t)
    return r6(unrolled(c, value=A.in_units(F.col("d"), F.col("m"), F.lit(0.02))), "value")


@query("strength_blind_channels", "F20", f"""with {CH}, a as (select vec_id, sum(d / (u * u)) / sum(1 / (u * u)) as mu, median(u) as mid from cu where m > 0 group by 1), r as (select vec_id, sqrt(avg(power((d - mu) / u, 2))) as rms from cu join a using (vec_id) where m > 0 group by 1)
select vec_id, i::int as i, round(case when m > 0 then (d - mu) / u / greatest(rms, 1e-6) else 0 end, 6) as residual, m as mask, round(case when m > 0 then least(greatest(log10(u / mid), -2), 2) else 0 end, 6) as log_error from cu join a using (vec_id) join r using (vec_id)""")
def _(t):
    c = channels(t)
    return r6(unrolled(c, **A.strength_blind(F.col("d"), F.col("u"), F.col("m"))), "residual", "log_error")


@query("model_features", "F21", f"""with {CH} select vec_id, (i + 64 * k)::int as i, round(case k when 0 then d / 1000 when 1 then u / 1000 when 2 then m else case when m > 0 then d / greatest(u, 1e-6) else 0 end end, 6) as value from cu, range(4) r(k)""")
def _(t):
    return r6(unrolled(channels(t), value=A.model_features(F.col("d"), F.col("u"), F.col("m"))), "value")


@query("window_occlusion", "F22", f"""with {EMB}, u as (select vec_id, unnest(g) as x, generate_subscripts(g, 1) - 1 as i from em) select vec_id, (8 * w)::int as start, round(sum(x) - sum(case when i between 8 * w and 8 * w + 7 then 0 else x end), 6) as change from u, range(8) r(w) group by 1, 2""")
def _(t):
    g = A.doubles("embedding")
    w = t.embeddings.select("vec_id", g.alias("g"), F.explode(A.windows(64, 8)).alias("start"))
    return r6(w.select("vec_id", "start", (A.total(F.col("g")) - A.total(A.occlude(F.col("g"), F.col("start"), 8))).alias("change")), "change")


@query("region_masks", "F23", """with e as (select vec_id, greatest(3, ceil(0.6::double * (0.02::double + label / 100.0::double) * 64)::int) as hw from embeddings) select vec_id, i::int as i, i between 32 - hw and 32 + hw as event, (i < 2 * hw or i >= 64 - 2 * hw) as opposite, i between 17 and 47 as core from e, range(64) r(i)""")
def _(t):
    m = A.region_masks(64, 0.02 + F.col("label") / 100.0)
    return unrolled(t.embeddings, **m)


@query("diagnostic_scaling", "F24", """with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, sign(l_extendedprice - 40000) * log10(1 + abs(l_extendedprice - 40000)) as x from lineitem), q as (select median(x) as m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr from s where l_linestatus = 'F')
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest((x - m) / case when iqr > 0 then iqr else 1 end, -5), 5), 6) as z, 0::int as missing from s, q""")
def _(t):
    from surveyframe.operators.screens import scaled_diagnostics
    li = t.lineitem.withColumn("gap", F.col("l_extendedprice") - 40000)
    got = scaled_diagnostics(li, ["gap"], F.col("l_linestatus") == "F")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("gap_z", 6).alias("z"), "missing")


@query("planet_like_score", "F25", f"with {EMB} select vec_id, round(g[2] + g[3], 6) as score from em")
def _(t):
    from surveyframe.operators.screens import planet_like
    return t.embeddings.select("vec_id", F.round(planet_like(A.doubles("embedding"), [1, 2]), 6).alias("score"))


@query("knn_separability", "A59", f"""with {EMB}, f as (select vec_id, label, (vec_id % 5)::int as fold, g from em), p as (select a.vec_id, a.fold, a.label, b.label as bl, row_number() over (partition by a.vec_id order by round(sqrt(list_sum(list_transform(list_zip(a.g, b.g), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9), b.vec_id) as rn from f a join f b on a.fold <> b.fold),
v as (select vec_id, fold, label, bl, count(*) as n from p where rn <= 7 group by all), w as (select vec_id, fold, label, arg_min(bl, (-n, bl)) as pred from v group by 1, 2, 3) select fold, round(avg((pred = label)::int), 6) as accuracy, count(*) as rows from w group by 1""")
def _(t):
    e = t.embeddings.withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    return r6(V.knn_accuracy(e, "vec_id", "embedding", "label", "fold", 7), "accuracy")


@query("label_silhouette", "A59", f"""with {EMB}, d as (select a.vec_id, a.label, b.label as bl, sum(sqrt(list_sum(list_transform(list_zip(a.g, b.g), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) as s, count(*) filter (where a.vec_id <> b.vec_id) as n from em a, em b group by 1, 2, 3),
m as (select vec_id, label, max(case when label = bl and n > 0 then s / n end) as a, min(case when label <> bl then s / n end) as b from d group by 1, 2) select label, round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette, count(*) as rows from m group by 1""")
def _(t):
    return r6(V.silhouette(t.embeddings, "vec_id", "embedding", "label"), "silhouette")


@query("sibling_view_correlation", "W20", f"""with {EMB}, u as (select vec_id, label, unnest(g) as x, generate_subscripts(g, 1) as i from em), p as (select a.label, a.vec_id, abs(corr(a.x, b.x)) as c from u a join u b on a.label = b.label and a.i = b.i and a.vec_id <> b.vec_id group by a.label, a.vec_id, b.vec_id)
select label, vec_id, round(max(c), 6) as max_corr, max(c) < 0.99 as distinct from p group by 1, 2""")
def _(t):
    return r6(V.sibling_correlation(t.embeddings, "label", "vec_id", "embedding"), "max_corr")


# ---- physics on spectra ----------------------------------------------------------------------------

_PL = "(1 / (power({x} * 1e-6::double, 5) * (exp(6.62607015e-34::double * 2.99792458e8::double / ({x} * 1e-6::double * 1.380649e-23::double * t)) - 1)))"


@query("photon_noise", "F09", f"""with p as (select p_partkey, 1 + p_size / 5.0::double as wl, 3000 + p_retailprice as t, 7 + p_size / 10.0::double as j from part), k as (select p_partkey, x0 + (wl - x0) * 0 as w0, wl, t, j from (select *, 0.0 as x0 from p)),
r as (select *, 3.129e-10::double * power(10.0::double, -0.4::double * j) * {_PL.format(x='wl')} / {_PL.format(x='1.235::double')} * 25.4::double * wl * 1e-6::double / (6.62607015e-34::double * 2.99792458e8::double) as rate from k),
s as (select p_partkey, rate, sqrt(1.5::double / (rate * 0.02::double * 2 * 3600)) * 1e6 as ideal, case when wl <= 2 then -0.3::double when wl >= 9 then -0.9::double else -0.3::double + (wl - 2) * (-0.6::double) / 7 end as eta from r)
select p_partkey, round(log10(rate), 6) as log_rate, round(ideal, 5) as ideal, round(ideal / sqrt(power(10.0::double, eta)), 5) as predicted from s""")
def _(t):
    p = t.part.select("p_partkey", (1 + F.col("p_size") / 5.0).alias("wl"), (3000 + F.col("p_retailprice")).alias("t"), (7 + F.col("p_size") / 10.0).alias("j"))
    knots = t.part.agg(F.min("p_size").alias("x")).select(F.inline(F.array(F.struct(F.lit(2.0).alias("kx"), F.lit(-0.3).alias("ky")), F.struct(F.lit(9.0).alias("kx"), F.lit(-0.9).alias("ky")))))
    p = M.interpolate(p, "wl", knots, "kx", "ky", "eta")
    ideal = P.ideal_sigma_ppm("wl", F.lit(0.02), "j", "t", F.lit(2.0))
    return p.select("p_partkey", F.round(F.log10(P.photon_rate("wl", "j", "t")), 6).alias("log_rate"), F.round(ideal, 5).alias("ideal"),
                    F.round(P.predicted_sigma_ppm(ideal, F.col("eta")), 5).alias("predicted"))


@query("scale_heights", "F10", """with p as (select p_partkey, 0.5::double + p_size / 20.0::double as r, case when p_size % 4 > 0 then 0.2::double + p_size / 10.0::double end as m, p_size % 3 = 0 as lim, p_retailprice as teq, 0.2::double + p_size / 100.0::double as rs, p_type from part),
u as (select *, case when lim or m is null then power(r, 3.7::double) else m end as mass, case when lim or m is null then 'estimated from radius' when contains(p_type, 'M-R') then 'relation (catalogue)' else 'measured (catalogue)' end as note from p),
g as (select *, 6.674e-11::double * mass * 5.972e24::double / power(r * 6.371e6::double, 2) as g from u), h as (select *, 1.380649e-23::double * teq / (mu * 1.66053907e-27::double * g) / 1e3 as h from g, (values (18), (28), (44)) v(mu))
select p_partkey, note, mu::int as mu, round(h, 5) as height_km, round(2 * r * 6.371e6::double * h * 1e3 / power(rs * 6.957e8::double, 2) * 1e6, 4) as amplitude_ppm from h""")
def _(t):
    s = F.col("p_size")
    p = t.part.select("p_partkey", "p_type", (0.5 + s / 20.0).alias("r"), F.when(s % 4 > 0, 0.2 + s / 10.0).alias("m"), (s % 3 == 0).alias("lim"), F.col("p_retailprice").alias("teq"), (0.2 + s / 100.0).alias("rs"))
    mass, note = P.usable_mass("m", F.col("lim"), "r", F.col("p_type"))
    p = p.withColumn("mass", mass).withColumn("note", note)
    g = P.surface_gravity("mass", "r")
    cells = F.inline(F.array(*[F.struct(F.lit(k).alias("mu"), P.scale_height_km("teq", g, mu).alias("h")) for k, mu in P.MEAN_WEIGHTS.items()]))
    h = p.select("p_partkey", "note", "r", "rs", cells)
    return h.select("p_partkey", "note", "mu", F.round("h", 5).alias("height_km"), F.round(P.amplitude_ppm("r", "rs", F.col("h")), 4).alias("amplitude_ppm"))
