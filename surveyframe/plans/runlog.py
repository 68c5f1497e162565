"""The build log as `events`: error = failed, signup = session start, purchase = finished, view = stopped early."""

from pyspark.sql import functions as F

from surveyframe.plans.metrics import r6
from surveyframe.plans.registry import query
from surveyframe.streaming import runlog as L

S = "(epoch_us(ts) / 1e6::double)"
_LAST = "last as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1)"


@query("log_state_counts", "R01", f"with {_LAST} select event_type, count(*) as objects from last group by 1")
def _(t):
    return L.state_counts(t.events, "user_id", ["ts", "event_id"], ["event_type"])


@query("work_sessions", "R02", f"""with g as (select {S} as s, event_id, coalesce(({S} - lag({S}) over (order by ts, event_id) > 600)::int, 0) as f from events), n as (select *, sum(f) over (order by s, event_id)::bigint as session from g)
select session, round(min(s), 3) as started, round(max(s), 3) as ended, count(*) as records from n group by 1""")
def _(t):
    got = L.work_sessions(t.events.select("ts", "event_id"), "ts", "event_id")
    return got.select("session", F.round("started", 3).alias("started"), F.round("ended", 3).alias("ended"), "records")


@query("recent_rate", "R02", f"""with r as (select {S} as s from events order by 1 desc limit 300), g as (select s - lag(s) over (order by s) as g from r), w as (select g, row_number() over (order by g) as i, count(*) over () as n from g where g > 0 and g <= 600),
m as (select g from w where i = floor(n / 2) + 1) select (select count(*) from r) as stamps, round(3600 / g, 5) as per_hour, round(1000 * g / 3600, 5) as hours_left from m""")
def _(t):
    return L.recent_rate(t.events, "ts", 1000).select("stamps", F.round("per_hour", 5).alias("per_hour"), F.round("hours_left", 5).alias("hours_left"))


@query("started_sessions", "R03", f"""with n as (select user_id, {S} as s, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id)::bigint as session from events)
select user_id, session, round(min(s), 3) as started, round(max(s) - min(s), 3) as seconds, count(*) as records from n group by 1, 2""")
def _(t):
    got = L.started_sessions(t.events, "ts", "event_id", F.col("event_type") == "signup", ["user_id"])
    return got.select("user_id", "session", F.round("started", 3).alias("started"), F.round("seconds", 3).alias("seconds"), "records")


@query("failure_runs", "R04", """with i as (select user_id, event_type, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as island from events), r as (select user_id, island, count(*) filter (where event_type = 'error') as run from i group by 1, 2)
select user_id, max(run) as longest, count(*) filter (where run >= 3) as tripped from r group by 1""")
def _(t):
    return L.failure_runs(t.events, "ts", "event_id", F.col("event_type") == "error", ["user_id"])


@query("hourly_progress", "R05", f"""with f as (select user_id, min({S}) as s from events where event_type = 'purchase' group by 1), p as (select floor(s / 3600)::bigint as hour, count(*) as finished from f group by 1), c as (select *, sum(finished) over (order by hour)::bigint as running_total, min(hour) over () as h0 from p)
select hour, finished, running_total, round((150 - running_total) * (hour - h0 + 1) / running_total::double, 6) as hours_left from c""")
def _(t):
    return r6(L.progress(t.events, "ts", "user_id", F.col("event_type") == "purchase", 150), "hours_left")


@query("work_left", "R06", f"with {_LAST} select c_custkey as user_id from customer where c_custkey not in (select user_id from last where event_type in ('purchase', 'click'))")
def _(t):
    wanted = t.customer.select(F.col("c_custkey").alias("user_id"))
    return L.work_left(t.events, wanted, "user_id", ["ts", "event_id"], "event_type", ["purchase", "click"])


@query("clean_finish", "R07", f"""with {_LAST}, m as (select max((ts, event_id)) filter (where event_type = 'signup') as s, max((ts, event_id)) filter (where event_type = 'purchase') as e, max((ts, event_id)) filter (where event_type = 'view') as v from events), t as (select count(*) filter (where event_type = 'error') as n from last)
select e > s as ended, v > s as stopped_early, n as transient_failures, e > s and not v > s and n = 0 as complete from m, t""")
def _(t):
    is_ = lambda n: F.col("event_type") == n
    return L.clean_finish(t.events, "user_id", "ts", "event_id", is_("signup"), is_("purchase"), is_("view"), is_("error"))
