"""Formulas, Monte-Carlo ranking, posteriors and design: parts are planets, suppliers are observed objects."""

from pyspark.sql import functions as F

from surveyframe.functions import physics as P
from surveyframe.functions import stats as ST
from surveyframe.functions.basics import std_normal, uniform
from surveyframe.operators import draws as D
from surveyframe.operators import metrics as M
from surveyframe.operators import ranking as R
from surveyframe.operators.scale import materialise
from surveyframe.plans.metrics import SC, auc_sql, r6, scored
from surveyframe.plans.registry import query, sql_normal, sql_uniform

DRAWS = 20      # of the queries whose rows are the draws themselves; summaries take all 4,000 (operators/draws.py)


def planets(t):
    s, k = F.col("p_size"), F.col("p_partkey")
    price = F.col("p_retailprice")
    null = lambda cond, v: F.when(cond, v)
    return t.part.select(
        k, (0.2 + price / 1000 * (s % 5)).alias("insol"), null(s % 4 > 0, 0.05 + s / 1000.0).alias("insol_err1"), null(s % 4 > 0, -0.04 - s / 1000.0).alias("insol_err2"),
        (2400.0 + s * 100).alias("teff"), F.lit(80.0).alias("teff_err1"), F.lit(-60.0).alias("teff_err2"),
        (0.6 + s / 12.0).alias("rade"), (0.05 + s / 500.0).alias("rade_err1"), (-0.04 - s / 500.0).alias("rade_err2"),
        (0.5 + s / 5.0).alias("mass"), F.lit(0.3).alias("mass_err1"), F.lit(-0.2).alias("mass_err2"), (s % 3 == 0).alias("mass_measured"),
        (0.2 + s / 100.0).alias("rs"), F.lit(0.02).alias("rs_err1"), F.lit(-0.01).alias("rs_err2"),
        (0.02 + s / 400.0).alias("axis"), F.lit(0.001).alias("axis_err1"), F.lit(-0.001).alias("axis_err2"),
        null(s % 2 == 0, -2.0 + s / 50.0).alias("lum"), null(s % 2 == 0, F.lit(0.05)).alias("lum_err1"), null(s % 2 == 0, F.lit(-0.04)).alias("lum_err2"),
        (7.0 + s / 10.0).alias("jmag"), (s % 10 != 9).alias("transiting"))


PL = """pl as (select p_partkey, 0.2::double + p_retailprice / 1000 * (p_size % 5) as insol, case when p_size % 4 > 0 then 0.05::double + p_size / 1000.0::double end as i1, case when p_size % 4 > 0 then 0.04::double + p_size / 1000.0::double end as i2,
2400.0::double + p_size * 100 as teff, 0.6::double + p_size / 12.0::double as rade, 0.05::double + p_size / 500.0::double as r1, 0.04::double + p_size / 500.0::double as r2, 0.5::double + p_size / 5.0::double as mass, p_size % 3 = 0 as meas,
0.2::double + p_size / 100.0::double as rs, 0.02::double + p_size / 400.0::double as axis, case when p_size % 2 = 0 then -2.0::double + p_size / 50.0::double end as lum, 7.0::double + p_size / 10.0::double as jmag, p_size % 10 <> 9 as transiting from part)"""


def _limit(name, teff):
    s, a, b, c, d = P.HZ_LIMITS[name]
    x = f"(least(greatest({teff}, 2600.0::double), 7200.0::double) - 5780.0::double)"
    return f"({s}::double + {x} * ({a}::double + {x} * ({b}::double + {x} * ({c}::double + {x} * {d}::double))))"


def _zone(s, t):
    return (f"({s} between {_limit('maximum_greenhouse', t)} and {_limit('runaway_greenhouse', t)})", f"({s} between {_limit('early_mars', t)} and {_limit('recent_venus', t)})")


def _bins(r, i):
    vals = [(1.5, 0.190, 12.0), (2.75, 1.26, 92.0), (4.0, 1.28, 92.0)]
    return "case " + " ".join(f"when {r} < {b[0]} then {b[i]}::double" for b in vals) + f" else {(1.15, 92.0)[i - 1]}::double end"


def _mass(r):
    return f"case when {r} < 1.23 then 0.9718::double * power({r}, 3.58::double) else 1.436::double * power({r}, 1.70::double) end"


_TEQ = "({t} * sqrt({rs} * 0.00465047::double / {a}) * power(0.25::double, 0.25::double))"


@query("zone_membership", "F03", f"""with {PL} select p_partkey, round({_limit('runaway_greenhouse', 'teff')}, 6) as inner_limit, round({_limit('maximum_greenhouse', 'teff')}, 6) as outer_limit, {_zone('insol', 'teff')[0]} as conservative, {_zone('insol', 'teff')[1]} as optimistic from pl""")
def _(t):
    cons, opt = P.in_zone("insol", "teff")
    return planets(t).select("p_partkey", F.round(P.flux_limit("runaway_greenhouse", "teff"), 6).alias("inner_limit"), F.round(P.flux_limit("maximum_greenhouse", "teff"), 6).alias("outer_limit"),
                             cons.alias("conservative"), opt.alias("optimistic"))


@query("mass_from_radius", "F04", f"with {PL} select p_partkey, round({_mass('rade')}, 6) as mass from pl")
def _(t):
    return planets(t).select("p_partkey", F.round(P.mass_from_radius("rade"), 6).alias("mass"))


@query("spectroscopy_metric", "F05", f"""with {PL}, q as (select *, {_TEQ.format(t='teff', rs='rs', a='axis')} as teq from pl) select p_partkey, round(teq, 6) as teq, round({_bins('rade', 1)} * power(rade, 3) * teq / (mass * rs * rs) * power(10.0::double, -jmag / 5), 6) as metric, {_bins('rade', 2)} as cut from q""")
def _(t):
    p = planets(t).withColumn("teq", P.equilibrium_temperature("teff", "rs", "axis"))
    m, cut = P.spectroscopy_metric("rade", "mass", "rs", "teq", "jmag")
    return p.select("p_partkey", F.round("teq", 6).alias("teq"), F.round(m, 6).alias("metric"), cut.alias("cut"))


@query("shoreline_margins", "F06", f"""with {PL}, v as (select *, 11.186::double * sqrt(mass / rade) as v, insol * power(power(10.0::double, coalesce(lum, -1.0::double)), -0.6::double) as x from pl)
select p_partkey, round(v, 6) as v_esc, round(log10(x) - (log10(8e-4::double) + 4 * log10(v)), 6) as primary_margin, round(log10(x) - (-4.49::double + 5.89::double * log10(v)), 6) as empirical_margin, round(log10(insol) - (log10(1e-4::double) + 4 * log10(v)), 6) as bolometric_margin from v""")
def _(t):
    import math
    p = planets(t).withColumn("v", P.escape_velocity("mass", "rade"))
    m = P.shoreline_margins(F.col("v"), F.col("insol"), F.pow(F.lit(10.0), F.coalesce("lum", F.lit(-1.0))), F.lit(math.log10(8e-4)), F.lit(0.0))
    return p.select("p_partkey", F.round("v", 6).alias("v_esc"), *[F.round(c, 6).alias(f"{n}_margin") for n, c in m.items()])


@query("platt_map", "F07", f"""with {SC}, q as (select doc_id, greatest(1e-6::double, least(1 - 1e-6::double, s2)) as q from sc) select doc_id, round(ln(q / (1 - q)), 6) as logit, round(1 / (1 + exp(-(1.0945::double * ln(q / (1 - q)) - 0.9221::double))), 6) as calibrated from q""")
def _(t):
    return scored(t).select("doc_id", F.round(ST.logit("s2"), 6).alias("logit"), F.round(ST.platt("s2", 1.0945, -0.9221), 6).alias("calibrated"))


@query("prior_shifted", "F08", f"""with {SC}, r as (select *, greatest(0.01::double, least(0.99::double, avg(y) over (partition by star))) as pt, greatest(0.01::double, least(0.99::double, avg(y) over ())) as ps from sc)
select doc_id, round(pt / ps * s2 / (pt / ps * s2 + (1 - pt) / (1 - ps) * (1 - s2)), 6) as shifted from r""")
def _(t):
    s = scored(t)
    rate = s.groupBy("star").agg(F.avg("y").alias("pt"))
    overall = s.agg(F.avg("y")).scalar()
    return s.join(rate, "star").select("doc_id", F.round(ST.prior_shift("s2", overall, "pt"), 6).alias("shifted"))


_K15 = "(6.62607015e-34::double * 2.99792458e8::double / (15e-6::double * 1.380649e-23::double))"


@query("eclipse_depths", "F12", f"""with {PL}, x as (select p_partkey, teff as t, power(rade / (rs * 109.1::double), 2) as k2, teff * sqrt(rs / (axis * 215.03::double)) as irr from pl)
select p_partkey, round(k2 * (exp({_K15} / t) - 1) / (exp({_K15} / (irr * power(2/3.0::double, 0.25::double))) - 1) * 1e6, 5) as bare, round(k2 * (exp({_K15} / t) - 1) / (exp({_K15} / (irr * power(0.25::double, 0.25::double))) - 1) * 1e6, 5) as atmosphere,
round(-(p * log2(p) + (1 - p) * log2(1 - p)), 6) as bits from x join (select p_partkey, 0.01::double + 0.0195::double * p_size as p from part) using (p_partkey)""")
def _(t):
    bare, atm = P.eclipse_depths("rade", "rs", "teff", "axis")
    bits = t.part.select("p_partkey", F.round(P.entropy_bits(0.01 + 0.0195 * F.col("p_size")), 6).alias("bits"))
    return planets(t).select("p_partkey", F.round(bare, 5).alias("bare"), F.round(atm, 5).alias("atmosphere")).join(bits, "p_partkey")


def _z(tag):
    return sql_normal(f"p_partkey||'|'||draw||'|{tag}|1'")


def _sn(v, hi, lo, z):
    return f"greatest(1e-9::double, case when {z} >= 0 then {v} + {z} * {hi} else {v} + {z} * {lo} end)"


@query("asymmetric_draws", "M11", f"""with {PL}, z as (select p_partkey, rade, r1, r2, draw, {sql_normal("p_partkey||'|'||draw||'|R|1'")} as z from pl, range({DRAWS}) d(draw)) select p_partkey, draw::int as draw, round({_sn('rade', 'r1', 'r2', 'z')}, 6) as radius from z""")
def _(t):
    d = R.with_draws(planets(t), DRAWS)
    r = R.split_normal(F.col("rade"), F.col("rade_err1"), F.col("rade_err2"), std_normal("p_partkey", "draw", F.lit("R"), 1))
    return d.select("p_partkey", "draw", F.round(r, 6).alias("radius"))


_XUV = "(log10(3.0::double))"
MC = f"""{PL}, zz as (select pl.*, draw, {_z('S')} as zs, {_z('T')} as zt, {_z('R')} as zr, {_z('M')} as zm, {_z('m')} as zq, {_z('Rs')} as zrs, {_z('A')} as za, {_z('L')} as zl, {_z('x')} as zx, {sql_uniform("p_partkey||'|'||draw||'|i|1'")} as ui,
sqrt(power(coalesce(ln(10.0::double) * case when lum is not null then 0.05::double end, 0), 2) + power(2 * 0.001::double / axis, 2)) as frac from pl, range({DRAWS}) d(draw)),
d1 as (select p_partkey, draw, meas, transiting, jmag, lum is not null as hl, zq, zx, ui, {_sn('insol', 'coalesce(i1, insol * frac)', 'coalesce(i2, insol * frac)', 'zs')} as S, {_sn('teff', '80.0::double', '60.0::double', 'zt')} as T, {_sn('rade', 'r1', 'r2', 'zr')} as R,
{_sn('mass', '0.3::double', '0.2::double', 'zm')} as M0, {_sn('rs', '0.02::double', '0.01::double', 'zrs')} as Rs, {_sn('axis', '0.001::double', '0.001::double', 'za')} as A, case when zl >= 0 then lum + zl * 0.05::double else lum + zl * 0.04::double end as LL from zz),
d2 as (select *, case when meas then M0 else ({_mass('R')}) * power(10.0::double, zq * case when R < 1.23 then 0.144::double else 0.248::double end) end as M, {_TEQ.format(t='T', rs='Rs', a='A')} as teq, power(10.0::double, case when hl then LL else log10(Rs * Rs * power(T / 5772.0::double, 4)) end) as L from d1),
d3 as (select *, {_zone('S', 'T')[0]} as cons, {_zone('S', 'T')[1]} as opt, case when transiting then {_bins('R', 1)} * power(R, 3) * teq / (M * Rs * Rs) * power(10.0::double, -jmag / 5) end as metric, {_bins('R', 2)} as cut, 11.186::double * sqrt(M / R) as v, S * power(L, -0.6::double) as flux from d2),
mc as (select *, log10(flux) + zx * {_XUV} - (log10(7e-4::double) + ui * (log10(1e-3::double) - log10(7e-4::double)) + 4 * log10(v)) as m1, log10(flux) + zx * {_XUV} - (-4.49::double + 5.89::double * log10(v)) as m2, log10(S) - (-4 + 4 * log10(v)) as m3 from d3)"""


def planet_draws(t):
    return R.planet_draws(planets(t), "p_partkey", DRAWS)


@query("planet_probabilities", "M12")
def _(t):
    """4,000 draws a planet; the tests compare the draws' physics with the column formulas and the summary with numpy."""
    got = D.planet_summary(planets(t), "p_partkey")
    return got.select("p_partkey", *[F.round(c, 5 if c in ("teq", "metric", "metric_p16", "metric_p84", "flux") else 6).alias(c) for c in got.columns if c != "p_partkey"])


@query("planet_notes", "M12", f"""with {PL} select p_partkey, concat_ws('; ', case when i1 is null then 'insolation error derived from L and a' end, case when not teff between 2600 and 7200 then 'temperature outside the zone fit: evaluated at the edge' end,
case when not transiting then 'not transiting: metric not applicable' end, case when not meas then 'mass from the radius relation' end, case when lum is null then 'luminosity from radius and temperature' end) as notes from pl""")
def _(t):
    return planets(t).select("p_partkey", R.planet_notes().alias("notes"))


COMP = f"""{MC}, cp as (select p_partkey, draw, transiting, cons::int + 0.5::double * (opt and not cons)::int as zone, (R < 1.5 and m1 < 0)::int::double as ta, coalesce(greatest(0, least(1, metric / cut)), 0) as obs from mc),
sc as (select *, round((0.4::double * zone + 0.3::double * ta + 0.3::double * obs) / 1.0::double, 9) as score from cp where transiting), rk as (select *, rank() over (partition by draw order by score desc) as r from sc)"""


def components(t):
    return R.score_components(planet_draws(t), "p_partkey").filter("transiting")


def ranked(t):
    c = components(t).withColumn("score", F.round(R.weighted_score(R.WEIGHTS), 9))
    return R.shared_rank(c.select("p_partkey", "draw", "score"), "score", ["draw"])


@query("draw_ranks", "W14", f"with {COMP} select p_partkey, draw::int as draw, r as rank from rk")
def _(t):
    return ranked(t).select("p_partkey", "draw", "rank")


@query("rank_distribution", "W15 W14")
def _(t):
    return r6(D.rank_distribution(planets(t), "p_partkey", R.WEIGHTS), "rank_median", "rank_p5", "rank_p95", "p_top")


@query("weighted_scores", "M13")
def _(t):
    return r6(D.score_quantiles(planets(t), "p_partkey", R.WEIGHTS), "score", "low", "high")


@query("component_ablation", "M13 A62")
def _(t):
    got = D.ablation(planets(t), "p_partkey", R.WEIGHTS)
    return got.withColumn("spearman", F.round("spearman", 5))


# ---- posterior: suppliers are observed objects with three margin draws each ------------------------

N_PRIOR = R.PRIOR_DRAWS


def objects(t):
    y = F.element_at(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.6, 1.0)]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = R.with_draws(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal", y.alias("y")), 3, "k")
    return rows.select("s_suppkey", "s_nationkey", "y", ((5000 - F.col("s_acctbal")) / 4000 + 0.2 * std_normal("s_suppkey", "k", F.lit("o"), 1) - F.col("y")).alias("margin"),
                       (F.col("s_nationkey") % 2).cast("double").alias("magma"))


OBJECT = ("s_suppkey", "margin", "magma", "y")


def likelihoods(rows):
    return materialise(R.draw_likelihoods(rows, *OBJECT))


def _prior(name, mean, sd):
    return f"{mean}::double + {sd}::double * {sql_normal(chr(39) + chr(39) + '||draw||' + chr(39) + '|' + name + '|1' + chr(39))}"


def objects_sql(models="(values ('both', 1, 1)) v(model, ub, ug)", prior=R.PRIOR):
    th = ", ".join(f"{_prior(k, *prior[k])} as {k}" for k in ("alpha", "beta", "gamma"))
    return f"""ob as (select s_suppkey, s_nationkey, y, (5000 - s_acctbal) / 4000 + 0.2::double * {sql_normal("s_suppkey||'|'||k||'|o|1'")} - y as margin, (s_nationkey % 2)::double as magma from (select *, ([0.0::double, 0.25::double, 0.6::double, 1.0::double])[s_suppkey % 4 + 1] as y from supplier), range(3) r(k)),
th as (select draw, {th} from range({N_PRIOR}) d(draw)),
lk as (select model, draw, s_suppkey, s_nationkey, y, greatest(1e-9::double, least(1 - 1e-9::double, avg(1 / (1 + exp(-(alpha + beta * ub * margin + gamma * ug * magma)))))) as p from ob, th, {models} group by 1, 2, 3, 4, 5),
ll as (select *, y * ln(p) + (1 - y) * ln(1 - p) as ll from lk)"""


POST = "lw as (select model, draw, sum(ll) as logw from ll group by 1, 2), pw as (select *, exp(logw - max(logw) over (partition by model)) / sum(exp(logw - mx)) over (partition by model) as w from (select *, max(logw) over (partition by model) as mx from lw))"


@query("posterior_weights", "M14", f"with {objects_sql()}, {POST} select draw::int as draw, round(alpha, 6) as alpha, round(beta, 6) as beta, round(gamma, 6) as gamma, round(logw, 4) as logw, round(w, 6) as w from pw join th using (draw)")
def _(t):
    got = R.posterior(likelihoods(objects(t)))
    return got.select("draw", *[F.round(c, 4 if c == "logw" else 6).alias(c) for c in ("alpha", "beta", "gamma", "logw", "w")])


@query("posterior_summary", "M14 W16", f"""with {objects_sql()}, {POST}, lo as (select w, unnest(['alpha', 'beta', 'gamma']) as parameter, unnest([alpha, beta, gamma]) as v from pw join th using (draw)), c as (select *, sum(w) over (partition by parameter order by v) / sum(w) over (partition by parameter) as q from lo),
b as (select parameter, p, max(case when q <= p then q end) as qa, max(case when q <= p then v end) as xa, min(case when q > p then q end) as qb, min(case when q > p then v end) as xb from c, (values (0.16::double), (0.5::double), (0.84::double)) z(p) group by 1, 2),
x as (select parameter, p, case when qa is null then xb when qb is null then xa else xa + (p - qa) * (xb - xa) / (qb - qa) end as v from b)
select parameter, round(max(v) filter (where p = 0.16), 5) as q16, round(max(v) filter (where p = 0.5), 5) as q50, round(max(v) filter (where p = 0.84), 5) as q84, round(any_value(ess), 5) as effective_size, round(any_value(neg), 6) as p_negative
from x join (select parameter, 1 / sum(w * w) as ess, sum(case when v < 0 then w else 0 end) as neg from lo group by 1) using (parameter) group by 1""")
def _(t):
    got = R.posterior_summary(R.posterior(likelihoods(objects(t))), {"q16": 0.16, "q50": 0.5, "q84": 0.84})
    return got.select("parameter", *[F.round(c, 5).alias(c) for c in ("q16", "q50", "q84", "effective_size")], F.round("p_negative", 6).alias("p_negative"))


LOO = "lo as (select ll.*, logw - ll.ll as lwi from ll join lw using (model, draw)), lm as (select *, max(lwi) over (partition by model, s_suppkey) as mx from lo), lp as (select model, s_suppkey, y, sum(exp(lwi - mx) * p) / sum(exp(lwi - mx)) as p_loo from lm group by 1, 2, 3)"


@query("leave_one_out_prediction", "M15", f"with {objects_sql()}, {POST}, {LOO} select s_suppkey, y, round(p_loo, 6) as p_loo from lp")
def _(t):
    o = objects(t)
    return r6(R.leave_one_out(o, likelihoods(o), *OBJECT).select("s_suppkey", "y", "p_loo"), "p_loo")


_CLIPQ = "greatest(1e-6::double, least(1 - 1e-6::double, {0}))"


@query("model_comparison", "M15")
def _(t):
    got = R.model_comparison(objects(t), *OBJECT)
    return got.select("model", F.round("log_marginal", 5).alias("log_marginal"), F.round("loo_score", 6).alias("loo_score"), F.round("ln_bayes_factor", 5).alias("ln_bayes_factor"))


def _fit_sql(name, where):
    return f"""{name}_l as (select draw, sum(ll) as logw from ll where {where} group by 1), {name}_w as (select draw, exp(logw - mx) / sum(exp(logw - mx)) over () as w from (select *, max(logw) over () as mx from {name}_l)),
{name} as (select s_suppkey, y, sum(w * p) as p from lk join {name}_w using (draw) where s_nationkey >= 13 group by 1, 2)"""


@query("early_late_update", "M25", f"""with {objects_sql()}, {_fit_sql('ea', 's_nationkey < 13')}, {_fit_sql('fu', 'true')}
select s_suppkey, round(e.p, 6) as p_early, round(f.p, 6) as p_all, round(f.p - e.p, 6) as change, round(-(e.y * ln({_CLIPQ.format('e.p')}) + (1 - e.y) * ln(1 - {_CLIPQ.format('e.p')})), 6) as loss_early from ea e join fu f using (s_suppkey)""")
def _(t):
    o = objects(t)
    fit = lambda rows: R.posterior(likelihoods(rows))
    late = o.filter("s_nationkey >= 13")
    a = R.predict(fit(o.filter("s_nationkey < 13")), late, "s_suppkey", "margin", "magma").withColumnRenamed("p", "p_early")
    b = R.predict(fit(o), late, "s_suppkey", "margin", "magma").withColumnRenamed("p", "p_all")
    y = late.select("s_suppkey", "y").distinct()
    j = a.join(b, "s_suppkey").join(y, "s_suppkey")
    return r6(j.select("s_suppkey", "p_early", "p_all", (F.col("p_all") - F.col("p_early")).alias("change"), M.log_loss_of("y", "p_early").alias("loss_early")), "p_early", "p_all", "change", "loss_early")


# ---- sensitivity, design, counts -------------------------------------------------------------------

INPUTS = {"w1": (-1.0, 1.0), "w2": (-1.0, 1.0), "credit": (0.0, 1.0)}
N_BASE = R.BASE_SAMPLES


def _inp(name, lo, hi):
    u = lambda side: sql_uniform(f"j||'|{name}|{side}|1'")
    return f"{lo}::double + {hi - lo}::double * case when design = 'B' or design = '{name}' then {u('B')} else {u('A')} end as {name}"


SOBOL = f"""tg as (select s_suppkey as id, s_acctbal / 10000 as a, (s_suppkey * 7 % 11) / 11.0::double as b, (s_nationkey % 5) / 5.0::double as c from supplier), ds as (select j, design, {', '.join(_inp(n, *r) for n, r in INPUTS.items())} from range({N_BASE}) r(j), (values ('A'), ('B'), ('w1'), ('w2'), ('credit')) v(design)),
ss as (select j, design, id, a + b + 0.5 * c as reg, round((0.6::double * power(2.0::double, w1) * (a + credit * c) + 0.4::double * power(2.0::double, w2) * b) / (0.6::double * power(2.0::double, w1) + 0.4::double * power(2.0::double, w2)), 9) as score from tg, ds),
rr as (select j, design, rank() over (partition by j, design order by score) + (count(*) over (partition by j, design, score) - 1) / 2.0::double as r1, rank() over (partition by j, design order by round(reg, 9)) + (count(*) over (partition by j, design, round(reg, 9)) - 1) / 2.0::double as r2 from ss),
rho as (select j, design, corr(r1, r2) as rho from rr group by 1, 2)"""


ROW = ["a", "b", "c"]


def sobol_rows(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("a"), ((F.col("s_suppkey") * 7 % 11) / 11.0).alias("b"), ((F.col("s_nationkey") % 5) / 5.0).alias("c"))
    return s.withColumn("reg", F.round(F.col("a") + F.col("b") + 0.5 * F.col("c"), 9))


def sobol_score(r, d):
    wa, wb = 0.6 * 2.0 ** d["w1"], 0.4 * 2.0 ** d["w2"]
    return (wa * (r["a"] + d["credit"] * r["c"]) + wb * r["b"]) / (wa + wb)


@query("sensitivity_indices", "M16", f"""with {SOBOL}, v as (select var_pop(rho) as v from rho where design in ('A', 'B')), p as (select a.j, a.rho as fa, b.rho as fb, x.design as input, x.rho as fx from rho a join rho b on a.j = b.j and a.design = 'A' and b.design = 'B' join rho x on x.j = a.j and x.design not in ('A', 'B'))
select input, round(avg(fb * (fx - fa)) / any_value(v), 4) as first_order, round(0.5 * avg((fa - fx) * (fa - fx)) / any_value(v), 4) as total from p, v group by 1""")
def _(t):
    rows = sobol_rows(t)
    rho = R.design_spearman(rows, R.sobol_table(rows.sparkSession, N_BASE, INPUTS), ROW, list(INPUTS), sobol_score, "reg")
    got = R.sobol_indices(rho, "spearman", list(INPUTS))
    return got.select("input", F.round("first_order", 4).alias("first_order"), F.round("total", 4).alias("total"))


@query("top_membership", "M16", f"""with {SOBOL}, k as (select id, rank() over (partition by j, design order by score desc) as r from ss where design in ('A', 'B')) select id, round(avg((r <= 10)::int), 6) as p_top from k group by 1""")
def _(t):
    rows = sobol_rows(t)
    both = R.sobol_table(rows.sparkSession, N_BASE, INPUTS).filter("design in ('A', 'B')")
    return R.design_top_share(rows, both, "id", ROW, list(INPUTS), sobol_score).select("id", F.round("p_top", 6).alias("p_top"))


def _tail_sql(z):
    """Same rational fit as the Spark expression, for P(Z > z)."""
    poly = f"{ST.ERFC[-1]}::double"
    for c in reversed(ST.ERFC[:-1]):
        poly = f"(({poly}) * t + {c}::double)"
    return f"(select case when x >= 0 then h else 1 - h end from (select x, t * exp(-x * x + {poly}) / 2 as h from (select x, 1 / (1 + 0.5 * abs(x)) as t from (select {z} / sqrt(2.0::double) as x))))"


POOL_N = 40
_PB = sql_normal("''||draw||'|beta|1'")
_PA = sql_normal("''||draw||'|alpha|1'")


@query("information_gain", "M17", f"""with th as (select draw, 1.5::double * {_PA} as alpha, -2.0::double + {_PB} as beta from range({POOL_N}) r(draw)), o as (select s_suppkey, (5000 - s_acctbal) / 4000 as m, 0.5::double + s_acctbal / 8000 as snr, 3 + (s_suppkey % 5)::double as hours from supplier),
e as (select *, {_tail_sql('snr / 2')} as eps from o), q as (select s_suppkey, hours, beta, eps + (1 - 2 * eps) / (1 + exp(-(alpha + beta * m))) as q from e, th),
c as (select *, greatest(1e-12::double, least(1 - 1e-12::double, q)) as qc from q), g as (select s_suppkey, hours, avg(q) as m, avg(-(qc * log2(qc) + (1 - qc) * log2(1 - qc))) as h, var_pop(beta) as v, sum(q) as w1, sum(q * beta) as b1, sum(q * beta * beta) as c1, sum(1 - q) as w0, sum((1 - q) * beta) as b0, sum((1 - q) * beta * beta) as c0 from c group by 1, 2)
select s_suppkey, round(-(m * log2(m) + (1 - m) * log2(1 - m)) - h, 6) as bits, round(v - (m * (c1 / w1 - power(b1 / w1, 2)) + (1 - m) * (c0 / w0 - power(b0 / w0, 2))), 6) as beta_gain, round((-(m * log2(m) + (1 - m) * log2(1 - m)) - h) / hours, 6) as bits_per_hour from g""")
def _(t):
    o = t.supplier.select("s_suppkey", ((5000 - F.col("s_acctbal")) / 4000).alias("m"), (0.5 + F.col("s_acctbal") / 8000).alias("snr"), (3 + F.col("s_suppkey") % 5).cast("double").alias("hours"))
    d = R.with_draws(o.withColumn("eps", ST.normal_tail(F.col("snr") / 2)), POOL_N)
    d = d.withColumn("alpha", R.parameter("alpha", R.PRIOR, "draw", 1)).withColumn("beta", R.parameter("beta", R.PRIOR, "draw", 1))
    d = d.withColumn("p", ST.sigmoid(F.col("alpha") + F.col("beta") * F.col("m")))
    return r6(R.information_gain(d, "s_suppkey", "p", "beta", "eps", "hours"), "bits", "beta_gain", "bits_per_hour")


@query("repeats_closed_form", "M18", """select l_suppkey, round(25.0::double / sum(power(l_discount + 0.01, 2) / power(l_quantity, 2)), 5) as n from lineitem group by 1""")
def _(t):
    bins = t.lineitem.groupBy("l_suppkey", "l_quantity").agg(F.sqrt(F.sum(F.pow(F.col("l_discount") + 0.01, 2))).alias("s")).withColumn("f", F.lit(0.0))
    got = R.repeats_needed(bins, ["l_suppkey"], "s", "l_quantity", "f", 5.0)
    return got.select("l_suppkey", F.round("n", 5).alias("n"))


@query("repeats_with_floor", "M18")
def _(t):
    bins = t.lineitem.groupBy("l_suppkey", "l_quantity").agg(F.sqrt(F.sum(F.pow(F.col("l_discount") + 0.01, 2))).alias("s")).withColumn("f", F.lit(0.05))
    return R.repeats_needed(bins, ["l_suppkey"], "s", "l_quantity", "f", 2.0)


_Q = sql_uniform("s_suppkey||'|'||draw||'|q'")


@query("success_counts", "M23", f"""with q as (select s_nationkey, draw, {_Q} as q from supplier, range(5) r(draw)), d as (select s_nationkey, draw, sum(q) as mean, exp(sum(ln(1 - q))) as none from q group by 1, 2) select s_nationkey, round(avg(mean), 6) as expected, round(avg(none), 6) as p_none from d group by 1""")
def _(t):
    q = R.with_draws(t.supplier.select("s_suppkey", "s_nationkey"), 5).withColumn("q", uniform("s_suppkey", "draw", F.lit("q")))
    dist = R.success_distribution(q, ["s_nationkey", "draw"], "q")
    d = dist.groupBy("s_nationkey", "draw").agg(F.sum(F.col("k") * F.col("probability")).alias("mean"), F.max(F.when(F.col("k") == 0, F.col("probability"))).alias("none"))
    return d.groupBy("s_nationkey").agg(F.round(F.avg("mean"), 6).alias("expected"), F.round(F.avg("none"), 6).alias("p_none"))


# ---- label shift -----------------------------------------------------------------------------------

_BAND = "case when n_chars < 600 then 0 when n_chars < 2000 then 1 else 2 end"


EM = f"""recursive {SC}, x as (select sc.*, {_BAND} as band from sc), sr as (select * from x where toxic = 1), tg as (select * from x where toxic = 0),
st as (select t.band, greatest(0.01::double, least(0.99::double, coalesce(s.r, (select avg(y) from sr)))) as ps from (select distinct band from tg) t left join (select band, avg(y) as r from sr group by 1) s on s.band = t.band),
ct as (select band, s2 as p, count(*) as n from tg group by 1, 2),
em as (select band, ps, ps as pi, false as done, 0 as i from st
       union all
       select band, any_value(ps), case when abs(sum(n * post) / sum(n) - any_value(pi)) < 1e-6 then any_value(pi) else sum(n * post) / sum(n) end, abs(sum(n * post) / sum(n) - any_value(pi)) < 1e-6, any_value(i) + 1
       from (select e.*, n, pi / ps * p / (pi / ps * p + (1 - pi) / (1 - ps) * (1 - p)) as post from em e join ct using (band) where not done and i < 1000) group by band),
fe as (select band, any_value(ps) as ps, arg_max(pi, i) as pi from em group by band)"""


def shift_inputs(t):
    x = scored(t).withColumn("band", M.band_of("n_chars", [0, 600, 2000, float("inf")]))
    return x.filter("toxic = 0"), x.filter("toxic = 1")


@query("label_shift_rates", "M09", f"with {EM} select tg.band, count(*) as rows, round(any_value(ps), 6) as pi_source, round(any_value(pi), 6) as pi_target, round(avg(y), 6) as true_rate from tg join fe on fe.band = tg.band group by 1")
def _(t):
    target, source = shift_inputs(t)
    return r6(R.label_shift_em(target, source, "band", "y", "s2"), "pi_source", "pi_target", "true_rate")


@query("label_shift_correction", "M09", f"""with {EM}, c as (select doc_id, pi / ps * s2 / (pi / ps * s2 + (1 - pi) / (1 - ps) * (1 - s2)) as pc, greatest(0.01::double, least(0.99::double, avg(y) over (partition by tg.band))) as pt, ps, s2 from tg join fe on fe.band = tg.band)
select doc_id, round(pc, 6) as p_corrected, round(pt / ps * s2 / (pt / ps * s2 + (1 - pt) / (1 - ps) * (1 - s2)), 6) as p_oracle from c""")
def _(t):
    target, source = shift_inputs(t)
    rates = R.label_shift_em(target, source, "band", "y", "s2")
    return r6(R.shifted_scores(target, rates, "band", "s2").select("doc_id", "p_corrected", "p_oracle"), "p_corrected", "p_oracle")
