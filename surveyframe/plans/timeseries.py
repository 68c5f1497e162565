"""Time-series queries: events are cadences of a user (star), orders are the periodic events of a customer."""

from pyspark.sql import functions as F

from surveyframe.functions.basics import epoch_days
from surveyframe.operators import timeseries as T
from surveyframe.operators.scale import neighbour
from surveyframe.plans.metrics import r6
from surveyframe.plans.registry import query, sql_mod
from surveyframe.sources.text import with_half_widths

D = "(epoch_us(ts)/86400e6::double)"
PTS = f"pts as (select event_id, user_id, {D} as t, value as flux, 0.1::double + 0.01::double * value as err, 3.5::double + (user_id % 7) * 0.3::double as period, 19723.0::double + user_id * 0.01::double as epoch, 0.5::double as duration from events)"
EPH = "eph as (select o_orderkey as object_id, o_custkey as user_id, 1 + o_totalprice / 10000 as period, epoch_us(o_orderdate)/86400e6::double as epoch, (0.1::double + o_orderkey % 7) / 24 as duration from orders)"
_PH = sql_mod("t - epoch + 0.5 * period", "period")
FOLD = f"fold as (select *, {_PH} - 0.5 * period as phase from pts)"


def points(t):
    return t.events.select("event_id", "user_id", epoch_days("ts").alias("t"), F.col("value").alias("flux"), (0.1 + 0.01 * F.col("value")).alias("err"),
                           (F.lit(3.5) + (F.col("user_id") % 7) * 0.3).alias("period"), (F.lit(19723.0) + F.col("user_id") * 0.01).alias("epoch"), F.lit(0.5).alias("duration"))


def ephemerides(t):
    return t.orders.select(F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("user_id"), (1 + F.col("o_totalprice") / 10000).alias("period"),
                           epoch_days("o_orderdate").alias("epoch"), ((F.lit(0.1) + F.col("o_orderkey") % 7) / 24).alias("duration"),
                           ((F.col("o_orderkey") % 3 + 1) * 1e-5).alias("period_err"), F.when(F.col("o_orderpriority") != "5-LOW", F.lit(0.001)).alias("epoch_err"))


def folded(t):
    return points(t).withColumn("phase", T.phase("t", "period", "epoch"))


@query("phase_fold", "W07 F01", f"with {PTS}, {FOLD} select event_id, user_id, round(phase, 6) as phase from fold")
def _(t):
    return r6(folded(t).select("event_id", "user_id", "phase"), "phase")


def view_sql(n, width, half):
    return f"""src as (select user_id, phase as x, flux, err, {half} as h, {width} as w from fold), rng as (select *, (2 * h - w) / {n - 1} as step from src where x between -h and h), ok as (select * from rng where step > 0),
inb as (select user_id, i as bin, flux, err from ok, range({n}) r(i) where x >= -h + step * i and x < -h + step * i + w),
fl as (select user_id, bin, median(flux) as m, {1.2533141373155001}::double * sqrt(sum(err * err)) / count(*) as e from inb group by 1, 2),
gr as (select user_id, i::int as bin, f from (select user_id, median(flux) as f from ok group by 1), range({n}) r(i)),
vv as (select user_id, gr.bin, coalesce(m, f) as v, m is not null as filled, e from gr left join fl using (user_id, bin)),
cc as (select *, v - median(v) over (partition by user_id) as c, max(e) over (partition by user_id) as emax, avg(filled::int) over (partition by user_id) as coverage from vv),
ss as (select *, abs(min(c) over (partition by user_id)) as s from cc)
select user_id, bin, round(c / case when s > 0 then s else 1 end, 6) as value, round(coalesce(e, emax) / case when s > 0 then s else 1 end, 6) as err, round(coverage, 6) as coverage, round(s, 6) as scale from ss"""


@query("global_median_view", "W08", f"with {PTS}, {FOLD}, {view_sql(50, 'greatest(period / 50, 0.16::double * duration)', 'period / 2')}")
def _(t):
    return r6(T.global_view(folded(t), ["user_id"], 50), "value", "err", "coverage", "scale")


@query("local_median_view", "W08", f"with {PTS}, {FOLD}, {view_sql(21, '0.16::double * duration', 'least(period / 2, 4 * duration)')}")
def _(t):
    return r6(T.local_view(folded(t), ["user_id"], 21), "value", "err", "coverage", "scale")


@query("view_arrays", "W08")
def _(t):
    return T.as_arrays(T.global_view(folded(t), ["user_id"], 201), ["user_id"])


_STEP = "st as (select *, t - lag(t) over (partition by user_id order by t, event_id) as dt from pts), cd as (select user_id, median(dt) as step from st group by 1)"


@query("gap_segments", "W09", f"with {PTS}, {_STEP} select event_id, user_id, sum(coalesce((dt > 5 * step)::int, 0)) over (partition by user_id order by t, event_id)::bigint as segment from st join cd using (user_id)")
def _(t):
    return T.gap_segments(points(t), ["user_id"], "t", "event_id").select("event_id", "user_id", "segment")


def stars(t):
    """Every user's events as the light curve of a star with known events (or none) of its own length."""
    longest = F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4 * 0.3)
    return points(t).select("event_id", "user_id", "t", "flux").withColumn("longest", longest).withColumn("protected", F.col("flux") > 60)


@query("detrended_series", "W10")
def _(t):
    """Each star is smoothed over its own window: three of its longest events, a day at least."""
    out = T.detrend_events(stars(t), ["user_id"], "t", "flux", "protected", "longest", "event_id", gap=20)
    return out.select("event_id", "user_id", "segment", "window", "trend", "flat")


@query("smoothed_series", "W10", f"""with {PTS}, r as (select *, row_number() over (partition by user_id order by t, event_id) - 1 as i, count(*) over (partition by user_id) as len, median(flux) over (partition by user_id) as lev, (3 + user_id % 5)::bigint as h from pts),
c as (select *, case when len > 2 * h then least(greatest(i, h), len - h - 1) end as c from r),
s as (select a.event_id, any_value(a.user_id) as user_id, any_value(a.lev) as lev, any_value(a.h)::double as h, any_value(a.i - a.c)::double as d, sum(b.flux - b.lev) as t0, sum((b.i - a.c) * (b.flux - b.lev)) as t1, sum((b.i - a.c) * (b.i - a.c) * (b.flux - b.lev)) as t2
      from c a left join c b on a.user_id = b.user_id and b.i between a.c - a.h and a.c + a.h group by a.event_id),
q as (select *, 2 * h + 1 as n, h * (h + 1) * (2 * h + 1) / 3 as q2, h * (h + 1) * (2 * h + 1) / 3 * (3 * h * h + 3 * h - 1) / 5 as q4 from s)
select event_id, user_id, round(lev + coalesce((q4 * t0 - q2 * t2) / (n * q4 - q2 * q2) + t1 / q2 * d + (n * t2 - q2 * t0) / (n * q4 - q2 * q2) * d * d, 0), 5) as smooth from q""")
def _(t):
    p = points(t).select("event_id", "user_id", "t", "flux").withColumn("half", 3 + F.col("user_id") % 5)
    out = T.local_quadratic(p, ["user_id"], "t", "flux", "half", "smooth", "event_id")
    return out.select("event_id", "user_id", F.round("smooth", 5).alias("smooth"))


@query("smoothing_window", "W10", f"""with p as (select user_id, {D} as t, event_id, case when user_id % 4 > 0 then user_id % 4 * 0.3::double end as longest from events),
d as (select user_id, t - lag(t) over (partition by user_id order by t, event_id) as step, longest from p),
c as (select user_id, median(step) as cadence, greatest(1.0::double, 3.0::double * coalesce(max(longest), 0)) as window_days from d group by 1)
select user_id, round(cadence, 6) as cadence, round(window_days, 6) as window_days, greatest(round_even(window_days / cadence, 0)::bigint | 1, 5)::bigint as window from c where cadence > 0""")
def _(t):
    p = t.events.select("user_id", "event_id", epoch_days("ts").alias("t"), F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4 * 0.3).alias("longest"))
    return r6(T.smoothing_window(p, ["user_id"], "t", "event_id", "longest"), "cadence", "window_days")


@query("filled_errors", "W10", """with e as (select event_id, user_id, case when event_id % 7 = 0 then null when event_id % 11 = 0 then 'inf'::double else value / 10.0::double end as err from events),
m as (select user_id, median(err) filter (where err < 'inf'::double) as m from e group by 1)
select event_id, user_id, round(case when err < 'inf'::double then err else m end, 6) as err from e left join m using (user_id)""")
def _(t):
    err = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value") / 10)
    return r6(T.filled_errors(t.events.select("event_id", "user_id", err.cast("double").alias("err")), ["user_id"], "err"), "err")


_FAST = "fast as (select event_id, user_id, event_type, {d} / 4000 as t, value as flux, 0.1::double + 0.01::double * value as err from events)".format(d=D)


@query("sub_cadence_bins", "W11", f"""with {_FAST}, s as (select *, t - lag(t) over (partition by user_id order by t, event_id) as dt, min(t) over (partition by user_id) as t0 from fast), c as (select user_id, median(dt) * 1440 < 1 as short from s group by 1),
b as (select user_id, floor((t - t0) / (2.0::double / 1440)) as bin, t0, flux, err from s join c using (user_id) where short)
select user_id, round(any_value(1.0::double / 1440 + t0 + bin * (2.0::double / 1440)), 6) as t, round(avg(flux), 6) as flux, round(sqrt(sum(err * err)) / count(*), 6) as err from b group by user_id, bin
union all select user_id, round(t, 6), round(flux, 6), round(err, 6) from s join c using (user_id) where not short""")
def _(t):
    fast = t.events.select("event_id", "user_id", (epoch_days("ts") / 4000).alias("t"), F.col("value").alias("flux"), (0.1 + 0.01 * F.col("value")).alias("err"))
    return r6(T.bin_short_cadence(fast, ["user_id"], "t", "flux", "err", "event_id"), "t", "flux", "err")


@query("scatter_over_error", "W12", f"with {PTS}, s as (select *, abs(flux - lag(flux) over (partition by user_id order by t, event_id)) as d from pts) select user_id, round(median(d) * 1.4826::double / sqrt(2) / median(err), 6) as scatter_over_error from s group by 1")
def _(t):
    return r6(T.scatter_over_error(points(t), ["user_id"], "t", "flux", "err", "event_id"), "scatter_over_error")


@query("transit_diagnostics", "W13", f"""with {PTS}, {FOLD}, m as (select *, abs(phase) < duration / 2 as i, abs(phase) > duration and abs(phase) < greatest(3 * duration, 0.5) as ring from fold),
a as (select user_id, count(*) filter (where i) as n_in, bool_or(ring) as anyring from m group by 1), o as (select m.*, n_in, case when anyring then ring else not i end as o from m join a using (user_id)),
b as (select user_id, median(case when o then flux end) as base, median(case when i then flux end) as ins from o group by 1), d as (select user_id, median(case when o then abs(flux - base) end) as mad from o join b using (user_id) group by 1)
select user_id, n_in, round(case when n_in > 0 then base - ins end, 6) as depth, round(case when n_in > 0 and mad > 0 then (base - ins) / (1.4826::double * mad / sqrt(n_in)) end, 6) as depth_snr, n_in > 0 as observed from a join b using (user_id) join d using (user_id)""")
def _(t):
    return r6(T.transit_diagnostics(folded(t), ["user_id"]), "depth", "depth_snr")


@query("half_period_control", "W20", f"""with {PTS}, fold as (select *, {sql_mod("t - epoch", "period")} - 0.5 * period as phase from pts), m as (select *, abs(phase) < duration / 2 as i, abs(phase) > duration and abs(phase) < 1.5 as ring from fold),
b as (select user_id, count(*) filter (where i) as n_in, median(case when ring then flux end) as base, median(case when i then flux end) as ins from m group by 1)
select user_id, n_in, round(base - ins, 6) as depth from b where n_in > 0 and base is not null""")
def _(t):
    wrong = points(t).withColumn("phase", T.phase("t", "period", F.col("epoch") + F.col("period") / 2))
    got = T.transit_diagnostics(wrong, ["user_id"]).filter("observed and depth is not null")
    return r6(got.select("user_id", "n_in", "depth"), "depth")


@query("protected_cadences", "P08", f"""with {PTS}, {EPH} select distinct event_id from pts join eph using (user_id) where abs({sql_mod("t - eph.epoch + 0.5 * eph.period", "eph.period")} - 0.5 * eph.period) < 1.5 * eph.duration / 2""")
def _(t):
    return T.protected_points(points(t).select("event_id", "user_id", "t"), ephemerides(t), "user_id", "event_id", "t").select("event_id")


def _hit(name, factor):
    return f"{name} as (select user_id, event_id, object_id from pts join eph using (user_id) where abs({sql_mod('t - eph.epoch + 0.5 * eph.period', 'eph.period')} - 0.5 * eph.period) < {factor} * eph.duration / 2)"


@query("sibling_removal", "J05", f"""with {PTS}, {EPH}, {_hit('hits', 1.5)}, {_hit('own', 1.0)}, sh as (select o.object_id as target, h.object_id, count(*) as n from own o join hits h using (event_id) where o.object_id <> h.object_id group by 1, 2),
sz as (select object_id as target, count(*) as own from own group by 1), bl as (select target, object_id from sh join sz using (target) where n > 0.5 * own)
select e.object_id as target, event_id, h.object_id from hits h join eph e using (user_id) where e.object_id <> h.object_id and not exists (select 1 from bl where bl.target = e.object_id and bl.object_id = h.object_id)""")
def _(t):
    e = ephemerides(t)
    return T.sibling_removal(points(t).select("event_id", "user_id", "t"), e, e, "user_id", "event_id", "t").drop("user_id")


@query("neighbour_half_widths", "W17", """with o as (select o_custkey, o_orderkey, epoch_us(o_orderdate)/86400e6::double as x from orders), g as (select *, nullif(x - lag(x) over w, 0) as l, nullif(lead(x) over w - x, 0) as r from o window w as (partition by o_custkey order by x, o_orderkey))
select o_orderkey, o_custkey, case when l is not null and r is not null then (l + r) / 2 else coalesce(l, r) end / 2 as half_width, least(l, r) as smaller_gap from g""")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", epoch_days("o_orderdate").alias("x"))
    return with_half_widths(o, "x", ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey", F.col("spacing_hw").alias("half_width"), "smaller_gap")


@query("series_restarts", "W18", """with g as (select user_id, value < lag(value) over (partition by user_id order by event_id) as f from events) select user_id, count(*) filter (where f) as restarts from g group by 1""")
def _(t):
    return T.restarts(t.events, ["user_id"], "event_id", "value")


@query("ephemeris_drift", "F02", f"""with {PTS}, {EPH}, s as (select user_id, min(t) as a, max(t) as b from pts group by 1), x as (select object_id, period, duration, greatest(abs(a - epoch), abs(b - epoch)) as far, (o_orderkey % 3 + 1) * 1e-5::double as pe, case when o_orderpriority <> '5-LOW' then 0.001::double end as ee from eph join s using (user_id) join orders on o_orderkey = object_id),
d as (select object_id, duration, sqrt(ee * ee + (far / period * pe) * (far / period * pe)) * 24 as d from x) select object_id, round(d, 6) as drift_h, d <= 0.5 * duration * 24 as reliable from d""")
def _(t):
    return r6(T.ephemeris_drift(points(t), ephemerides(t), "user_id", "t"), "drift_h")


@query("geometric_durations", "F11", """with g as (select i / 200.0::double as b from range(201) r(i)), x as (select p_partkey, 1 + p_retailprice / 100 as p, 0.5::double + p_size / 50.0::double as rs, case when p_size % 3 > 0 then 0.5::double + p_size / 60.0::double end as m, 4.0::double + p_size / 100.0::double as lg, case when p_size % 5 = 0 then 0.3::double end as b from part),
a as (select *, power(6.674e-8::double * coalesce(m, power(10.0::double, lg - 4.438::double) * rs * rs) * 1.989e33::double * power(p * 86400.0::double, 2) / (4 * pi() * pi()), 1/3.0::double) / (rs * 6.957e10::double) as ax, 2.0::double / (rs * 109.1::double) as k from x),
u as (select distinct k from a), av as (select k, avg(sqrt(greatest((1 + k) * (1 + k) - g.b * g.b, 0))) as c from u, g group by 1)
select p_partkey, round(p / pi() * asin(least(greatest(case when b is not null then sqrt(greatest((1 + k) * (1 + k) - b * b, 0)) else c end / ax, 0), 1)) * 24, 6) as duration_h from a join av using (k)""")
def _(t):
    s = F.col("p_size")
    return r6(t.part.select("p_partkey", T.duration_hours(
        1 + F.col("p_retailprice") / 100, 0.5 + s / 50.0, F.when(s % 3 > 0, 0.5 + s / 60.0), 4.0 + s / 100.0, F.lit(None).cast("double"),
        F.lit(None).cast("double"), F.lit(2.0), F.when(s % 5 == 0, 0.3)).alias("duration_h")), "duration_h")


@query("paired_excess", "A61", """with m as (select user_id, event_type, avg(value) as v from events group by 1, 2), d as (select x.event_type, x.v - z.v as e from m x join m z using (user_id) where z.event_type = 'click'),
p as (select event_type, median(e) as median_excess, count(*) filter (where e > 0) as responders, count(*) as pairs from d group by 1)
select event_type, round(median_excess, 6) as median_excess, responders, pairs, coalesce(event_type = (select min(event_type) from p where median_excess > 0.01 and responders >= 0.45 * greatest(pairs, 1)), false) as first_level from p""")
def _(t):
    return r6(T.paired_excess(t.events, "user_id", "event_type", "click", "value", 0.01, 0.45), "median_excess")


@query("processed_signals", "W21")
def _(t):
    return T.process_signals(points(t).select("event_id", "user_id", "t", "flux", "err"), ephemerides(t), "user_id", "event_id", "t", "flux", "err", 21)
