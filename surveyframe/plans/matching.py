"""Joins on the given tables."""

from pyspark.sql import functions as F

from surveyframe.functions import text as X
from surveyframe.functions.basics import epoch_days, uniform
from surveyframe.operators import cleaning as C
from surveyframe.operators import matching as M
from surveyframe.operators.scale import salted_join, top_rows
from surveyframe.plans.registry import query, sql_uniform

E_DAY = "(epoch_us(ts)/86400e6::double)"


@query("many_to_one_lookup", "J06", """select count(*) as rows, count(*) filter (where o_orderkey is not null) as matched, count(*) filter (where o_orderkey is null) as unmatched
from lineitem left join (select o_orderkey from orders where o_orderstatus <> 'P') on l_orderkey = o_orderkey""")
def _(t):
    right = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return M.match_counts(M.many_to_one(t.lineitem.select("l_orderkey"), right, ["l_orderkey"]))


@query("two_key_lookup", "J07", """with r as (select l_orderkey, l_linenumber, max(l_extendedprice) as best from lineitem where l_returnflag = 'R' group by 1, 2)
select l.l_orderkey, l.l_linenumber, l_partkey, l_suppkey, best from lineitem l left join r using (l_orderkey, l_linenumber)""")
def _(t):
    r = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("best"))
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return salted_join(left, r, ["l_orderkey", "l_linenumber"], "left")


@query("value_fallback_chain", "J08", """with d as (select o_custkey, case when o_totalprice > 300000 then o_totalprice end as v from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders where o_orderstatus = 'F') where rn = 1),
o as (select o_custkey, case when o_totalprice > 300000 then o_totalprice end as v from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders where o_orderstatus = 'O') where rn = 1),
e as (select o_custkey, avg(o_totalprice) as v from orders group by 1)
select c_custkey, round(coalesce(d.v, o.v, e.v), 6) as price, case when d.v is not null then 'catalogue' when o.v is not null then 'other set' when e.v is not null then 'estimated' else 'missing' end as price_source
from customer left join d on d.o_custkey = c_custkey left join o on o.o_custkey = c_custkey left join e on e.o_custkey = c_custkey""")
def _(t):
    def newest(status):
        rows = t.orders.filter(F.col("o_orderstatus") == status)
        best = top_rows(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()])
        return best.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")).alias("price"))
    est = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"))
    got = M.fallback_chain(t.customer.select("c_custkey"), "c_custkey", "price", [("catalogue", newest("F")), ("other set", newest("O")), ("estimated", est)])
    return got.withColumn("price", F.round("price", 6))


@query("second_catalogue_completion", "J09", """with s as (select s_nationkey, round(avg(s_acctbal), 4) as bal, max(s_acctbal) as top from supplier group by 1),
c as (select c_custkey, c_nationkey as nk, case when c_acctbal > 1000 then c_acctbal end as bal, case when c_mktsegment <> 'BUILDING' then c_acctbal * 2 end as top from customer)
select c_custkey, coalesce(c.bal, s.bal) as bal, coalesce(c.top, s.top) as top, concat_ws('; ', case when c.bal is null and s.bal is not null then 'bal from supplier' end,
case when c.top is null and s.top is not null then 'top from supplier' end, case when c.bal / s.bal > 3 or c.bal / s.bal < 1/3.0::double then 'bal conflicts with supplier' end) as notes,
coalesce(c.bal / s.bal > 3 or c.bal / s.bal < 1/3.0::double, false) as conflict from c left join s on s_nationkey = nk""")
def _(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nk")).agg(F.round(F.avg("s_acctbal"), 4).alias("bal"), F.max("s_acctbal").alias("top"))
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("nk"), F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("bal"),
                          F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") * 2).alias("top"))
    return M.complete_from(c, s, "nk", ["bal", "top"], "supplier", check="bal").drop("nk")


@query("normalised_name_join", "J10", r"""with a as (select c_custkey, c_name as n, 0 as r, c_nationkey from customer union all select c_custkey, 'Supplier '||lpad(c_custkey::varchar, 9, '0'), 1, c_nationkey from customer
union all select c_custkey, 'nation_'||c_nationkey||' b', 1, c_nationkey from customer),
k as (select regexp_replace(lower(regexp_replace(regexp_replace(trim(n), '\s+A\s*([b-h])$', ' \1'), 'A([b-h])$', ' \1')), '[^a-z0-9]', '', 'g') as k, arg_min(c_nationkey, (r, c_custkey)) as nk from a group by 1)
select s_suppkey, nk as found from supplier left join k on k = regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g')""")
def _(t):
    alt = F.concat(F.lit("Supplier "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("|nation_"), F.col("c_nationkey").cast("string"), F.lit(" b"))
    names = t.customer.select("c_custkey", "c_name", "c_nationkey", alt.alias("alt"))
    index = M.first_by_key(names, "c_name", "alt", "\\|", X.name_key, "c_custkey", "c_nationkey").withColumnRenamed("c_nationkey", "found")
    left = t.supplier.select("s_suppkey", X.name_key("s_name").alias("name_key"))
    return salted_join(left, index, ["name_key"], "left").select("s_suppkey", "found")


@query("membership_both_ways", "J11", """select (select count(*) from customer where c_custkey in (select o_custkey from orders)) as with_orders,
(select count(*) from customer where c_custkey not in (select o_custkey from orders)) as without_orders""")
def _(t):
    return C.membership_counts(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k").select(
        F.col("in_both").alias("with_orders"), F.col("only_left").alias("without_orders"))


@query("held_out_stars", "J11", """select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') and c_custkey in (select o_custkey from orders)""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("k"))
    key = F.col("o_custkey").alias("k")
    return M.presence(M.presence(c, t.orders.select(key), "k")[0], t.orders.filter("o_orderstatus = 'F'").select(key), "k")[1].select(F.col("k").alias("c_custkey"))


_GRID = f"""f as (select user_id, {E_DAY} as x, value as y, 0.1 + 0.01 * value as e from events where event_type <> 'view'),
c0 as (select user_id, event_type, floor({E_DAY})::bigint as d, avg(value) as cy, avg(0.1 + 0.01 * value) as ce from events where event_type = 'view' group by all),
c as (select user_id, d, d + 0.5 as centre, 0.6::double as half, cy, ce from c0),
b as (select user_id, d, sum(y / (e * e)) / sum(1 / (e * e)) as fb, any_value(cy) as cy, any_value(ce) as ce from f join c using (user_id) where x >= centre - half and x < centre + half group by 1, 2),
n as (select user_id, count(*) as n_coarse from c group by 1), m as (select user_id, count(*) as n, median(cy - fb) as mo, median(abs(cy - fb) / ce) as nd, corr(cy, fb) as r from b group by 1),
a as (select user_id, median(abs(cy - fb - mo) / ce) as na from b join m using (user_id) group by 1)"""


@query("grid_comparison", "J12", f"""with {_GRID} select user_id, n_coarse, coalesce(m.n, 0) as n_compared, round(coalesce(m.n, 0) / n_coarse::double, 6) as coverage,
round(mo, 4) as median_offset, round(nd, 4) as norm_diff, round(na, 4) as norm_diff_after_offset, case when isfinite(r) then round(r, 4) end as corr from n left join m using (user_id) left join a using (user_id)""")
def _(t):
    return grid_comparison(t).select("user_id", "n_coarse", "n_compared", *[F.round(c, d).alias(c) for c, d in
                                     [("coverage", 6), ("median_offset", 4), ("norm_diff", 4), ("norm_diff_after_offset", 4), ("corr", 4)]])


def grid_comparison(t):
    from surveyframe.functions.basics import no_nan
    fine = t.events.filter("event_type <> 'view'").select("user_id", epoch_days("ts").alias("x"), F.col("value").alias("y"), (0.1 + 0.01 * F.col("value")).alias("e"))
    coarse = t.events.filter("event_type = 'view'").groupBy("user_id", F.floor(epoch_days("ts")).alias("d")).agg(
        F.avg("value").alias("cy"), F.avg(0.1 + 0.01 * F.col("value")).alias("ce"))
    coarse = coarse.withColumn("centre", F.col("d") + 0.5).withColumn("half", F.lit(0.6))
    got = M.compare_grids(fine, coarse, ["user_id"], "x", "y", "e", "d", "centre", "half", "cy", "ce", 1.2)
    return got.withColumn("corr", no_nan("corr"))


@query("match_verdicts", "P24", f"""with {_GRID} select v as verdict, count(*) as keys from (select case when coalesce(m.n, 0) = 0 then 'no overlap' when m.n / n_coarse::double >= 0.8 and nd <= 0.25 then 'same data (re-binned)'
when m.n / n_coarse::double >= 0.8 and na <= 0.25 then 'same data up to a constant depth offset' when m.n / n_coarse::double >= 0.5 and nd <= 1.0 then 'consistent within errors (different reduction or binning)'
else 'INCONSISTENT' end as v from n left join m using (user_id) left join a using (user_id)) group by 1""")
def _(t):
    v = M.match_verdict(F.col("n_compared"), F.col("coverage"), F.col("norm_diff"), F.col("norm_diff_after_offset"))
    return grid_comparison(t).groupBy(v.alias("verdict")).agg(F.count("*").alias("keys"))


@query("best_match_per_key", "J13", """select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey order by abs(l_extendedprice - 40000), l_quantity desc, l_partkey, l_linenumber, l_suppkey) as rn from lineitem) where rn = 1""")
def _(t):
    li = t.lineitem.withColumn("diff", F.abs(F.col("l_extendedprice") - 40000)).withColumn("tie", F.struct("l_partkey", "l_linenumber", "l_suppkey"))
    return M.best_match(li, "l_orderkey", "diff", "l_quantity", "tie").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("linear_lookup", "J14", """with k as (select p_size * 1.7::double as x, avg(p_retailprice) as y from part group by 1),
s as (select x as x0, y as y0, lead(x) over (order by x) as x1, lead(y) over (order by x) as y1 from k),
e as (select min(x) as lo, max(x) as hi, arg_min(y, x) as ylo, arg_max(y, x) as yhi from k)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when l_quantity < lo then ylo when l_quantity >= hi then yhi else y0 + (l_quantity - x0) * (y1 - y0) / (x1 - x0) end, 6) as looked_up
from lineitem cross join e left join s on l_quantity >= x0 and (l_quantity < x1)""")
def _(t):
    knots = t.part.select((F.col("p_size") * 1.7).alias("x"), F.col("p_retailprice").alias("y"))
    q = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return M.interpolate(q, "l_quantity", knots, "x", "y", "looked_up").withColumn("looked_up", F.round("looked_up", 6)).drop("l_quantity")


@query("mixed_merge", "J15", """with o as (select o_custkey, count(*) as orders, max(o_totalprice) as top from orders where o_totalprice > 400000 group by 1),
e as (select user_id, round(sum(value), 4) as value from events group by 1)
select c_custkey, user_id, n_name, orders, top, e.value from customer join nation on c_nationkey = n_nationkey left join o on o_custkey = c_custkey full join e on user_id = c_custkey""")
def _(t):
    o = t.orders.filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("top"))
    e = t.events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("value"))
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name").join(o, "c_custkey", "left")
    return base.join(e, F.col("c_custkey") == F.col("user_id"), "full_outer")


@query("scenario_grid", "J16", """with g as (select a / 4.0::double as w1, b / 4.0::double as w2, c / 4.0::double as w3 from range(5) x(a), range(5) y(b), range(5) z(c) where a + b + c = 4)
select p_brand, w1, w2, w3, round(avg(w1 * p_size / 50 + w2 * p_retailprice / 1000 + w3 * (p_partkey % 7) / 7), 6) as score from part cross join g group by 1, 2, 3, 4""")
def _(t):
    p = M.weight_grid(t.part.select("p_brand", "p_size", "p_retailprice", "p_partkey"), ["w1", "w2", "w3"], 4)
    s = F.col("w1") * F.col("p_size") / 50 + F.col("w2") * F.col("p_retailprice") / 1000 + F.col("w3") * (F.col("p_partkey") % 7) / 7
    return p.groupBy("p_brand", "w1", "w2", "w3").agg(F.round(F.avg(s), 6).alias("score"))


@query("train_test_matrix", "J16", """select tr as train, te as test, round(avg(abs(l_discount - m.d)), 6) as mean_error, count(*) as rows from lineitem,
(select l_returnflag as tr, avg(l_discount) as d from lineitem group by 1) m, (values ('A'), ('N'), ('R')) v(te) where l_returnflag = te group by 1, 2""")
def _(t):
    models = t.lineitem.groupBy(F.col("l_returnflag").alias("train")).agg(F.avg("l_discount").alias("d"))
    rows = M.scenario_rows(t.lineitem.select(F.col("l_returnflag").alias("test"), "l_discount"), train=["A", "N", "R"])
    return rows.join(F.broadcast(models), "train").groupBy("train", "test").agg(
        F.round(F.avg(F.abs(F.col("l_discount") - F.col("d"))), 6).alias("mean_error"), F.count("*").alias("rows"))


@query("paired_common_subset", "J17", """with a as (select o_orderkey as id, o_totalprice as s1 from orders where o_orderstatus <> 'P'),
b as (select l_orderkey as id, case when sum(l_quantity) > 60 then sum(l_quantity) end as s2 from lineitem group by 1)
select id, s1, s2 from a join b using (id) where s1 is not null and s2 is not null""")
def _(t):
    a = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("s1"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("q")).select("id", F.when(F.col("q") > 60, F.col("q")).alias("s2"))
    return M.paired_subset(a, b, "id", ["s1", "s2"])


@query("formatted_id_join", "J19", """with q as (select printf('%.2f', l_quantity) as k, count(*) as lines from lineitem group by 1)
select event_id, k, lines from (select event_id, printf('%.2f', value) as k from events) join q using (k)""")
def _(t):
    q = t.lineitem.groupBy(F.format_string("%.2f", "l_quantity").alias("k")).agg(F.count("*").alias("lines"))
    return salted_join(t.events.select("event_id", F.format_string("%.2f", "value").alias("k")), q, ["k"])


@query("stripped_id_join", "J19", """select s_suppkey, c_custkey, c_nationkey from supplier join customer on regexp_replace(s_name, '^[A-Za-z]+#', '') = regexp_replace(c_name, '^[A-Za-z]+#', '')""")
def _(t):
    strip = lambda c: F.regexp_replace(c, "^[A-Za-z]+#", "").alias("k")
    return t.supplier.select("s_suppkey", strip("s_name")).join(t.customer.select("c_custkey", "c_nationkey", strip("c_name")), "k").drop("k")
