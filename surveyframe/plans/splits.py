"""Twins, families, grouped splits and their checks on orders (candidate), customer (star)."""

from pyspark.sql import functions as F

from surveyframe.functions.basics import epoch_days, uniform
from surveyframe.operators import cleaning as C
from surveyframe.operators import graph as G
from surveyframe.operators import splits as S
from surveyframe.operators.scale import salted_join
from surveyframe.plans.cleaning import STATUS, STATUS_SQL
from surveyframe.plans.registry import query, sql_mod, sql_uniform

_CAND = """cand as (select o_orderkey as id, o_custkey as star, 1 + o_totalprice / 10000 as p, epoch_us(o_orderdate)/86400e6::double as t,
(0.1::double + o_orderkey % 7) / 24 as d from orders)"""
_TWINS = f"""twins as (select a.id as a_id, b.id as b_id, a.star as a_star, b.star as b_star from cand a join cand b
on b.p >= a.p and b.p <= a.p * (1 + 1e-4::double) and (b.p > a.p or b.id > a.id) and a.star <> b.star
where abs({sql_mod("b.t - a.t + 0.5 * a.p", "a.p")} - 0.5 * a.p) < 0.5 * greatest(a.d, b.d))"""
_REACH = """link as (select a_star as x, b_star as y from twins union select b_star, a_star from twins),
reach as (select distinct star, star as r from cand union select reach.star, link.y from reach join link on link.x = reach.r),
firsts as (select star, min(id) as f from cand group by 1),
root as (select reach.star, min(f) as root from reach join firsts on firsts.star = reach.r group by 1),
fam as (select id, cand.star, root from cand join root using (star))"""


def candidates(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("star"), (1 + F.col("o_totalprice") / 10000).alias("p"),
                           epoch_days("o_orderdate").alias("t"), ((F.lit(0.1) + F.col("o_orderkey") % 7) / 24).alias("d"),
                           "o_orderstatus", "o_orderpriority")


def twins(t):
    return G.signal_twins(candidates(t), "id", "star", "p", "t", "d")


def families(t, *carry):
    return G.signal_families(candidates(t), "id", "star", "p", "t", "d", carry)


@query("signal_twins", "J01", f"with {_CAND}, {_TWINS} select * from twins")
def _(t):
    return twins(t)


@query("signal_families", "J02", f"with recursive {_CAND}, {_TWINS}, {_REACH} select id, dense_rank() over (order by root) as family from fam")
def _(t):
    stars = G.numbered(G.star_families(candidates(t), "id", "star", "p", "t", "d"))
    return salted_join(candidates(t).select("id", "star"), stars, ["star"]).select("id", "family")


@query("family_sizes", "J02", f"with recursive {_CAND}, {_TWINS}, {_REACH}, n as (select root, count(*) as members from fam group by 1) select members, count(*) as families from n group by 1")
def _(t):
    return families(t).groupBy("family_root").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("families"))


_FOLD = "least(floor((sum(rows) over (partition by stratum order by {u}, star) - rows) * {n} / sum(rows) over (partition by stratum)), {n} - 1)"


def split_sql(group, label, source, seed):
    """CTEs g (groups) and sp (star, split) of the two-stage hold-out."""
    u1, u2 = sql_uniform(f"star::varchar||'|{seed}'"), sql_uniform(f"star::varchar||'|{seed + 1}'")
    return f"""gc as (select {group} as star, coalesce({label}, 'UNLABELED') as stratum, count(*) as n from {source} group by 1, 2),
g as (select star, sum(n)::bigint as rows, arg_min(stratum, (-n, stratum)) as stratum from gc group by 1),
g1 as (select *, {_FOLD.format(u=u1, n=20)} as fold from g),
g2 as (select *, {_FOLD.format(u=u2, n=17)} as fold2 from g1 where fold >= 3),
sp as (select star, 'test' as split from g1 where fold < 3 union all select star, case when fold2 < 3 then 'val' else 'train' end from g2)"""


_SPLIT = split_sql("o_custkey", STATUS_SQL, "orders", 42)
CLASSES = ["CONFIRMED", "CANDIDATE", "FALSE POSITIVE"]


def labelled_orders(t):
    df = C.harmonize_labels(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus", STATUS, check=False)
    return df.withColumn("star", F.col("o_custkey"))


@query("grouped_split", "M01", f"with {_SPLIT} select star, split from sp")
def _(t):
    return S.grouped_split(labelled_orders(t), "star", "label_harmonized")


@query("class_balance", "A03 M01 J03", f"""with {_SPLIT}, r as (select split, {STATUS_SQL} as class from orders join sp on star = o_custkey),
x as (select split, class from r union all select 'all', class from r)
select s.split, c.class, coalesce(n, 0) as rows, round(100 * coalesce(n, 0) / total::double, 6) as pct from (select split, count(*) as total from x group by 1) s
cross join (values ('CONFIRMED'), ('CANDIDATE'), ('FALSE POSITIVE')) c(class) left join (select split, class, count(*) as n from x group by 1, 2) k on k.split = s.split and k.class = c.class""")
def _(t):
    rows = labelled_orders(t)
    split = S.apply_split(rows, S.grouped_split(rows, "star", "label_harmonized"), "star")
    return S.class_balance(split, "split", "label_harmonized", CLASSES).withColumn("pct", F.round("pct", 6))


@query("flag_balance", "A03", """with x as (select l_linestatus as split, l_returnflag as class from lineitem union all select 'all', l_returnflag from lineitem)
select split, class, count(*) as rows, round(100 * count(*) / sum(count(*)) over (partition by split)::double, 6) as pct from x group by 1, 2""")
def _(t):
    return S.class_balance(t.lineitem, "l_linestatus", "l_returnflag", ["A", "N", "R"]).select(
        F.col("l_linestatus").alias("split"), "class", "rows", F.round("pct", 6).alias("pct"))


@query("star_leakage", "J03", f"""with s as (select o_custkey, case when {sql_uniform("o_orderkey::varchar||'|5'")} < 0.8 then 'train' else 'test' end as split from orders)
select o_custkey, count(distinct split) as splits, count(*) as rows from s group by 1 having count(distinct split) > 1""")
def _(t):
    rows = t.orders.select("o_custkey", F.when(uniform("o_orderkey", 5) < 0.8, "train").otherwise("test").alias("split"))
    return S.leakage(rows, "o_custkey")


@query("twins_across_splits", "J03", f"""with {_CAND}, {_TWINS}, s as (select o_orderkey as id, case when {sql_uniform("o_custkey::varchar||'|5'")} < 0.8 then 'train' else 'test' end as split from orders)
select a_id, b_id, a.split as a_split, b.split as b_split from twins join s a on a.id = a_id join s b on b.id = b_id where a.split <> b.split""")
def _(t):
    split = t.orders.select(F.col("o_orderkey").alias("id"), F.when(uniform("o_custkey", 5) < 0.8, "train").otherwise("test").alias("split"))
    return S.pairs_across(twins(t), split, "id").select("a_id", "b_id", "a_split", "b_split")


_BRIDGE_U = sql_uniform("root::varchar||'|9'")


@query("bridging_families", "J04", f"""with recursive {_CAND}, {_TWINS}, {_REACH},
r as (select fam.id, fam.root, o_orderstatus <> 'P' as labelled, case when o_orderstatus <> 'P' then case when {sql_uniform("fam.star::varchar||'|6'")} < 0.7 then 'train' else 'test' end end as split
from fam join orders on o_orderkey = fam.id),
k as (select root, count(distinct split) as n, min(split) as s from r where labelled group by 1)
select r.id, case when labelled then r.split else coalesce(s, case when {_BRIDGE_U.replace('root', 'r.root')} < 0.7::double then 'train' else 'test' end) end as split
from r left join k using (root) where labelled or n is null or n <= 1""")
def _(t):
    rows = families(t, "star", "o_orderstatus").withColumn("labelled", F.col("o_orderstatus") != "P")
    own = F.when(uniform("star", 6) < 0.7, "train").otherwise("test")
    rows = rows.withColumn("split", F.when(F.col("labelled"), own))
    got = S.drop_bridging(rows, "family_root", F.col("labelled"), "split", 9, {"train": 0.7, "test": 0.3})
    return got.select("id", "split")


@query("overlapping_sets", "J18", """with recursive m as (select distinct doc_id as s, md5(trim(p)) as p from (select doc_id, unnest(string_split(text, chr(10))) as p from documents) where length(trim(p)) >= 1),
link as (select distinct a.s as x, b.s as y from m a join m b on a.p = b.p and a.s <> b.s),
reach as (select distinct s, s as r from m union select reach.s, y from reach join link on x = reach.r)
select s as doc_id, min(r) as "group" from reach group by 1""")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length(F.trim("line")) >= 1)
    return G.overlapping_sets(lines.select("doc_id", F.md5(F.trim("line")).alias("line")), "doc_id", "line")


@query("sharing_summary", "A02", """with p as (select o_custkey, count(*) as n from orders group by 1)
select sum(n)::bigint as total_rows, count(*) as groups, count(*) filter (where n > 1) as multi_row_groups,
round(100 * sum(case when n > 1 then n else 0 end) / sum(n)::double, 6) as pct_rows_on_multi, max(n) as max_rows, arg_min(o_custkey, (-n, o_custkey)) as busiest from p""")
def _(t):
    return S.sharing_summary(t.orders, "o_custkey").withColumn("pct_rows_on_multi", F.round("pct_rows_on_multi", 6))


@query("class_weights", "A47", """with c as (select o_orderpriority, count(*) as n from orders group by 1)
select o_orderpriority, 'inverse' as scheme, round((select avg(n) from c) / n, 6) as weight from c union all
select o_orderpriority, 'sqrt', round(sqrt((select avg(n) from c) / n), 6) from c union all select o_orderpriority, 'none', 1.0::double from c""")
def _(t):
    one = lambda s: S.class_weights(t.orders, "o_orderpriority", s).select("o_orderpriority", F.lit(s).alias("scheme"), F.round("weight", 6).alias("weight"))
    return one("inverse").unionByName(one("sqrt")).unionByName(one("none"))


@query("equal_group_weights", "A47", """select conv_id, turn, round(1 / (count(*) over (partition by conv_id))::double, 6) as weight from conversations""")
def _(t):
    return S.equal_group_weights(t.conversations.select("conv_id", "turn"), "conv_id").select("conv_id", "turn", F.round("weight", 6).alias("weight"))


@query("strata_balance_weights", "A48", """with q as (select quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as e from lineitem),
b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_returnflag = 'R')::int as y, len(list_filter(e, lambda v: l_extendedprice > v)) as k from lineitem, q),
w as (select *, avg(y) over () as p, avg(y) over (partition by k) as pb from b),
r as (select *, greatest(0.2::double, least(10::double, case when y = 1 then p / pb else (1 - p) / (1 - pb) end)) as w from w)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, k::int as bin, round(w / avg(w) over (), 6) as weight from r""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    got = S.strata_balance_weights(li, "l_extendedprice", "y")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("_bin").alias("bin"), F.round("weight", 6).alias("weight"))


@query("component_folds", "M02", f"""with gc as (select o_custkey as star, o_orderstatus as stratum, count(*) as n from orders group by 1, 2),
g as (select star, sum(n)::bigint as rows, arg_min(stratum, (-n, stratum)) as stratum from gc group by 1),
o as (select *, {_FOLD.format(u=sql_uniform("star::varchar||'|7'"), n=5)}::int as fold from g)
select star, fold, {_FOLD.format(u=sql_uniform("star::varchar||'|8'"), n=4)}::int as inner_fold from o""")
def _(t):
    g = S.group_table(t.orders.withColumn("star", F.col("o_custkey")), "star", "o_orderstatus")
    outer = S.assign_folds(g, "star", 5, 7)
    return S.assign_folds(outer, "star", 4, 8, "inner_fold").select("star", "fold", "inner_fold")


@query("nested_fractions", "M03", f"""with g as (select distinct o_custkey as star, (o_custkey % 5)::int as fold from orders),
r as (select *, row_number() over (partition by fold order by {sql_uniform("star::varchar||'|4'")}, star) / count(*) over (partition by fold)::double as s from g)
select star, fold, f as fraction from r, (values (0.1::double), (0.3::double), (1.0::double)) v(f) where s <= f""")
def _(t):
    g = t.orders.select(F.col("o_custkey").alias("star"), (F.col("o_custkey") % 5).cast("int").alias("fold")).distinct()
    ranked = S.nested_fraction(g, "star", "fold", 4)
    f = F.explode(F.array(*[F.lit(v) for v in (0.1, 0.3, 1.0)]))
    return ranked.withColumn("fraction", f).filter("rank_share <= fraction").select("star", "fold", "fraction")


@query("out_of_fold_scores", "M04", f"""select doc_id, (doc_id % 5)::int as fold, round({sql_uniform("doc_id::varchar||'|'||(doc_id % 5)")}, 6) as score from labels""")
def _(t):
    rows = t.labels.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("fold"))
    scores = t.labels.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("model_fold"))
    scores = scores.withColumn("score", uniform("doc_id", "model_fold"))
    return S.out_of_fold(rows, scores, "doc_id", "fold", "model_fold").select("doc_id", "fold", F.round("score", 6).alias("score"))
