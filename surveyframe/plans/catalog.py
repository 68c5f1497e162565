"""Scans, sources, sinks and set operations over the given tables."""

from functools import reduce

from pyspark.sql import functions as F

from surveyframe.operators import cleaning as C
from surveyframe.operators.scale import medians, salted_join
from surveyframe.plans.registry import query, sql_uniform
from surveyframe.sources import registry as R
from surveyframe.sources import text as X

ROLES = {"region": "reference", "nation": "reference", "customer": "catalogue", "supplier": "catalogue",
         "part": "catalogue", "orders": "catalogue", "lineitem": "series", "events": "series",
         "documents": "text", "embeddings": "arrays", "pages": "text", "benchmark": "text",
         "labels": "labels", "conversations": "text"}


def _counts(t):
    return R.table_counts({n: getattr(t, n) for n in ROLES})


_COUNT_SQL = " union all ".join(f"select '{n}' as name, '{r}' as role, count(*) as rows from {n}" for n, r in ROLES.items())


@query("registered_tables", "S02 S04", f"select name, role, true as present, rows from ({_COUNT_SQL})")
def _(t):
    reg = t.spark.createDataFrame(list(ROLES.items()), "name string, role string")
    return R.role_status(reg, _counts(t))


@query("role_totals", "S02 S04", f"""select role, count(*) as tables, sum(rows)::bigint as rows
from ({_COUNT_SQL}) group by role""")
def _(t):
    reg = t.spark.createDataFrame(list(ROLES.items()), "name string, role string")
    return R.role_status(reg, _counts(t)).groupBy("role").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"))


@query("json_record_read", "S09", """select event_id, user_id, json_extract_string(props, '$.k')::bigint as k
from events where json_valid(props) and json_extract_string(props, '$.k') is not null""")
def _(t):
    return X.parse_json_records(t.events.select("event_id", "user_id", "props"), "props", "k bigint", "k").drop("props")


@query("segment_stitch", "S10", """with m as (select user_id, event_type, median(value) as med from events group by 1, 2)
select event_id, e.user_id, round(value / med, 6) as flux from events e join m using (user_id, event_type) where med > 0""")
def _(t):
    e = t.events.select("event_id", "user_id", "event_type", "value")
    from surveyframe.operators.timeseries import stitch_segments
    return stitch_segments(e, ["user_id", "event_type"], "value").select("event_id", "user_id", F.round("flux", 6).alias("flux"))


@query("photometry_assembly", "S11", """with seg as (select distinct o_orderkey from orders where o_orderstatus <> 'P')
select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_size, 0) as quality from lineitem
join seg on l_orderkey = o_orderkey left join (select p_partkey, p_size from part where p_size > 5) on l_partkey = p_partkey
where l_quantity > 3""")
def _(t):
    from surveyframe.operators.timeseries import assemble_photometry
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey")
    segments = t.orders.filter(F.col("o_orderstatus") != "P").select("o_orderkey").distinct()
    ref = t.part.filter(F.col("p_size") > 5).select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("quality"))
    got = assemble_photometry(rows, segments, ref, ["o_orderkey"], ["l_partkey"], F.col("l_quantity") > 3)
    return got.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "quality")


@query("array_table_checks", "S12", """select label, count(*) as rows,
sum(case when len(embedding) = 64 then 1 else 0 end)::bigint as full_length,
count(distinct vec_id) = count(*) as one_row_per_id from embeddings group by label""")
def _(t):
    ok = F.size("embedding") == 64
    return t.embeddings.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(ok).alias("full_length"),
                                             (F.count_distinct("vec_id") == F.count("*")).alias("one_row_per_id"))


SOURCES = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
           "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "events": ["event_id", "user_id", "event_type"]}


@query("source_fingerprint", "S13", " union all ".join(f"""select source, count(*) as rows, sum(('0x'||substr(h,1,8))::bigint)::bigint as hash_a, sum(('0x'||substr(h,9,8))::bigint)::bigint as hash_b
from (select '{s}' as source, md5({"||'|'||".join(f"{c}::varchar" for c in cols)}) as h from {s}) group by 1""" for s, cols in SOURCES.items()))
def _(t):
    prints = [R.row_fingerprint(getattr(t, s).withColumn("source", F.lit(s)), ["source"], cols) for s, cols in SOURCES.items()]
    return reduce(lambda a, b: a.unionByName(b), prints)


@query("content_hash_gate", "S14", """with h as (select c_nationkey, md5(c_custkey::varchar||'|'||c_name||'|'||c_mktsegment) as h from customer)
select c_nationkey, count(*) as rows, sum(('0x'||substr(h,1,8))::bigint)::bigint as hash_a,
sum(('0x'||substr(h,9,8))::bigint)::bigint as hash_b from h group by 1""")
def _(t):
    return R.row_fingerprint(t.customer, ["c_nationkey"], ["c_custkey", "c_name", "c_mktsegment"])


@query("calibration_points", "S17", """with p as (select event_id, user_id, event_type, value, c_acctbal,
count(*) over (partition by user_id, event_type) as n from events join customer on user_id = c_custkey
where c_acctbal > 0 and value between 0.5 and 200)
select event_id, user_id, event_type, round(value, 6) as value, c_acctbal from p where n >= 5""")
def _(t):
    from surveyframe.operators.spectra import calibration_points
    e = t.events.select("event_id", "user_id", "event_type", "value")
    hosts = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    got = calibration_points(e, hosts, "user_id", ["user_id", "event_type"], F.col("value").between(0.5, 200))
    return got.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"), "c_acctbal")


@query("split_sink_counts", "K01 K05", f"""with s as (select o_orderkey, case when {sql_uniform("o_custkey::varchar||'|3'")} < 0.15
then 'test' when {sql_uniform("o_custkey::varchar||'|3'")} < 0.3 then 'val' else 'train' end as split from orders)
select split, count(*) as wanted, count(l_orderkey) as found from s left join (select distinct l_orderkey from lineitem)
on l_orderkey = o_orderkey group by split""")
def _(t):
    from surveyframe.functions.basics import uniform
    u = uniform("o_custkey", 3)
    split = t.orders.select(F.col("o_orderkey").alias("id"), F.when(u < 0.15, "test").when(u < 0.3, "val").otherwise("train").alias("split"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct()
    return C.relayout(rows, split, "id")[1]


@query("build_plan", "K02", """with done as (select distinct l_orderkey from lineitem where l_linestatus = 'F'),
bad as (select distinct l_orderkey from lineitem where l_linestatus = 'O')
select o_orderkey, case when o_orderpriority = '5-LOW' then 'excluded' when d.l_orderkey is not null then 'skip'
when b.l_orderkey is not null then 'retry' else 'process' end as action from orders
left join done d on d.l_orderkey = o_orderkey left join bad b on b.l_orderkey = o_orderkey""")
def _(t):
    key = F.col("l_orderkey").alias("o_orderkey")
    li = t.lineitem
    return C.build_plan(t.orders, li.filter("l_linestatus = 'F'").select(key), li.filter("l_linestatus = 'O'").select(key),
                        t.orders.filter("o_orderpriority = '5-LOW'"), "o_orderkey")


@query("index_rebuild", "K03", """with last as (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s from orders group by 1)
select c_custkey, coalesce(s, 'not processed') as status from customer left join last on o_custkey = c_custkey""")
def _(t):
    log = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return C.rebuild_index(t.customer, log, "c_custkey", ["o_orderdate", "o_orderkey"], "status")


@query("exclusion_merge", "K04", """with o as (select c_custkey, 'old '||c_mktsegment as r from customer where c_nationkey < 12),
p as (select c_custkey from customer where c_nationkey between 5 and 15),
a as (select c_custkey, 'auto '||c_nationkey as r from customer where c_nationkey between 8 and 20)
select c_custkey, case when o.r is not null and p.c_custkey is null then 'manual' else 'derived' end as kind,
coalesce(o.r, a.r) as reason from o full join p using (c_custkey) full join a using (c_custkey)
where (o.r is not null and p.c_custkey is null) or a.r is not null""")
def _(t):
    c = t.customer
    old = c.filter("c_nationkey < 12").select("c_custkey", F.concat(F.lit("old "), "c_mktsegment").alias("reason"))
    prev = c.filter("c_nationkey between 5 and 15").select("c_custkey")
    auto = c.filter("c_nationkey between 8 and 20").select("c_custkey", F.concat(F.lit("auto "), F.col("c_nationkey").cast("string")).alias("reason"))
    return C.merge_exclusions(old, prev, auto, "c_custkey")


@query("archive_refresh", "K06", """select o_orderkey, o_orderdate, regexp_replace(o_orderpriority, '[^A-Za-z0-9.]+', '_', 'g') as safe_name
from orders where o_orderdate >= timestamp '2000-01-01' """)
def _(t):
    snap = t.orders.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return C.refresh_selection(t.orders, snap, "o_orderkey", "o_orderpriority").select("o_orderkey", "o_orderdate", "safe_name")


@query("retirable_inputs", "K07", """select o_custkey, bool_and(o_orderstatus = 'F') as safe,
count(*) filter (where o_orderstatus <> 'F') as open_records from orders group by 1""")
def _(t):
    return C.retirable(t.orders, "o_custkey", F.col("o_orderstatus") == "F")


# ---- set operations --------------------------------------------------------------------------------

@query("shaped_union", "U01", """select kind, count(*) as rows, count(period) as with_period, round(sum(depth), 2) as depth from (
select 'order' as kind, o_orderkey as id, o_totalprice / 1e4 as period, null::double as depth from orders
union all select 'line', l_orderkey, null, l_quantity from lineitem
union all select 'event', event_id, value, value / 2 from events) group by kind""")
def _(t):
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e4).alias("period"))
    b = t.lineitem.select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("depth"))
    c = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("period"), (F.col("value") / 2).alias("depth"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c)
    return u.groupBy("kind").agg(F.count("*").alias("rows"), F.count("period").alias("with_period"), F.round(F.sum("depth"), 2).alias("depth"))


@query("shared_keys", "U02", """select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'""")
def _(t):
    pick = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey")
    return pick("F").intersect(pick("O"))


@query("set_differences", "U03", """with a as (select distinct o_custkey as k from orders), b as (select distinct c_custkey as k from customer)
select k, 'only left' as side from a where k not in (select k from b) union all
select k, 'only right' from b where k not in (select k from a)""")
def _(t):
    return C.both_differences(t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k")), "k")


@query("cross_source_duplicates", "U04", """select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1""")
def _(t):
    return C.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("deduplicated_union", "U05 W06", """select k, arg_max(v, s) as label, max(s) as source_no from (
select doc_id as k, quality as v, 0 as s from labels union all select doc_id, toxic, 1 from labels where quality = 0
union all select vec_id, label, 2 from embeddings) group by k""")
def _(t):
    a = t.labels.select(F.col("doc_id").alias("k"), F.col("quality").alias("label"))
    b = t.labels.filter("quality = 0").select(F.col("doc_id").alias("k"), F.col("toxic").alias("label"))
    c = t.embeddings.select(F.col("vec_id").alias("k"), "label")
    return C.later_overrides([a, b, c], "k")


@query("singles_and_combinations", "U06", """with m as (select distinct l_orderkey, l_returnflag, l_linenumber from lineitem),
g as (select l_orderkey, l_returnflag, count(*) as n from m group by 1, 2 having count(*) >= 2)
select *, 'single' as input, 1::bigint as members from m union all
select m.*, 'combined', n from m join g using (l_orderkey, l_returnflag)""")
def _(t):
    return C.singles_and_combinations(t.lineitem, "l_linenumber", ["l_orderkey", "l_returnflag"])
