"""Profiles and column screens on the given tables."""

from pyspark.sql import functions as F

from surveyframe.functions.basics import uniform
from surveyframe.operators import metrics as M
from surveyframe.operators import models as ML
from surveyframe.operators import screens as S
from surveyframe.plans.metrics import SC, auc_sql, r6, scored
from surveyframe.plans.registry import query, sql_uniform

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_profile", "A04 P17", " union all ".join(f"""select '{c}' as "column", count({c}) as n, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct, round(avg({c}), 9) as mean, round(stddev_samp({c}), 6) as sd, min({c}) as min, max({c}) as max,
round(skewness({c}), 6) as skew, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75 from lineitem""" for c in _COLS))
def _(t):
    return r6(S.describe(t.lineitem, _COLS).withColumn("mean", F.round("mean", 9)), "sd", "skew", "q25", "q50", "q75")


@query("percentile_in_reference", "A05", """select o_orderkey, round((select count(*) from lineitem where l_extendedprice <= o_totalprice / 5) / (select count(*) from lineitem)::double, 6) as share from orders""")
def _(t):
    o = t.orders.select("o_orderkey", (F.col("o_totalprice") / 5).alias("v"))
    return r6(S.percentile_within(o, "v", t.lineitem, "l_extendedprice").select("o_orderkey", "share"), "share")


@query("range_share", "A05", """select o_orderstatus, round(avg((o_totalprice between lo and hi)::int), 6) as inside from orders, (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem) group by 1""")
def _(t):
    from surveyframe.operators.scale import scalar_of
    r = scalar_of(t.lineitem, lo=F.min("l_extendedprice"), hi=F.max("l_extendedprice"))
    return t.orders.withColumn("_in", F.col("o_totalprice").between(r["lo"], r["hi"])).groupBy("o_orderstatus").agg(F.round(F.avg(F.col("_in").cast("int")), 6).alias("inside"))


_CELLS = "select l_discount, l_tax, count(*) as rows, stddev_samp(l_extendedprice) as spread, median(l_extendedprice) as med from lineitem group by 1, 2"


@query("grid_cells", "A06", f"select l_discount, l_tax, rows, round(spread, 4) as spread, round(med, 4) as median from ({_CELLS})")
def _(t):
    g = S.grid_cells(t.lineitem, "l_discount", "l_tax", "l_extendedprice")
    return g.select("l_discount", "l_tax", "rows", F.round("spread", 4).alias("spread"), F.round("median", 4).alias("median"))


@query("cell_statistics", "A06", f"select count(*) as cells, min(rows) as fewest, max(rows) as most, round(median(med), 4) as middle, round(avg(spread), 4) as mean_spread from ({_CELLS})")
def _(t):
    g = S.grid_cells(t.lineitem, "l_discount", "l_tax", "l_extendedprice")
    return g.agg(F.count("*").alias("cells"), F.min("rows").alias("fewest"), F.max("rows").alias("most"), F.round(F.percentile("median", 0.5), 4).alias("middle"), F.round(F.avg("spread"), 4).alias("mean_spread"))


@query("rule_yields", "A07", """select rule, rows, round(100 * rows / (select count(*) from part)::double, 6) as pct from (select 'small' as rule, count(*) as rows from part where p_size < 10 union all select 'cheap', count(*) from part where p_retailprice < 950
union all select 'small and cheap', count(*) from part where p_size < 10 and p_retailprice < 950)""")
def _(t):
    small, cheap = F.col("p_size") < 10, F.col("p_retailprice") < 950
    return r6(S.rule_yields(t.part, {"small": small, "cheap": cheap, "small and cheap": small & cheap}), "pct")


def derived(t):
    return t.lineitem.withColumn("copy", F.col("l_quantity")).withColumn("sum2", F.col("l_discount") * 2 + F.col("l_tax") * 3).withColumn(
        "power", F.col("l_extendedprice") * F.col("l_extendedprice"))


_DER = "x as (select *, l_quantity as copy, l_discount * 2 + l_tax * 3 as sum2, l_extendedprice * l_extendedprice as power from lineitem)"


@query("identical_columns", "A56", f"""with {_DER}, p as (select 'l_quantity' as a, 'copy' as b, avg((abs(l_quantity - copy) <= 1e-9)::int) as s from x union all select 'l_quantity', 'l_linenumber', avg((abs(l_quantity - l_linenumber) <= 1e-9)::int) from x
union all select 'copy', 'l_linenumber', avg((abs(copy - l_linenumber) <= 1e-9)::int) from x) select a, b, round(s, 6) as equal_share, s > 0.9 as flagged from p""")
def _(t):
    return r6(S.near_identical(derived(t), ["l_quantity", "copy", "l_linenumber"]), "equal_share")


def _sp(c):
    return f"""(select '{c}' as "column", corr(ra, rb) as s from (select rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as ra, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0::double as rb from x))"""


@query("rank_correlated_columns", "A56 A26", f"""with {_DER} select "column", round(s, 6) as spearman, abs(s) >= 0.95 as flagged from (select * from {_sp('power')} union all select * from {_sp('l_quantity')})""")
def _(t):
    return r6(S.rank_correlated(derived(t), "l_extendedprice", ["power", "l_quantity"]), "spearman")


@query("weighted_sum_column", "A56", f"with {_DER} select round(max(abs(sum2 - (l_discount * 2 + l_tax * 3))), 6) as max_gap from x")
def _(t):
    return r6(S.weighted_sum_gap(derived(t), "sum2", {"l_discount": 2.0, "l_tax": 3.0}), "max_gap")


def _loo(c):
    return f"""(select '{c}' as "column", 1 - sum(power((y - my - k / v * (x - mx)) / (1 - (1 / n + (x - mx) * (x - mx) / (n * v))), 2)) / any_value(n * vy) as r2 from (select {c} as x, l_extendedprice as y, avg({c}) over () as mx, avg(l_extendedprice) over () as my, var_pop({c}) over () as v, var_pop(l_extendedprice) over () as vy,
covar_pop({c}, l_extendedprice) over () as k, (count(*) over ())::double as n from x))"""


@query("derived_column_fit", "A57", f"""with {_DER} select "column", round(r2, 6) as loo_r2 from (select * from {_loo('power')} union all select * from {_loo('l_quantity')} union all select * from {_loo('l_tax')})""")
def _(t):
    return r6(S.loo_r2(derived(t), "l_extendedprice", ["power", "l_quantity", "l_tax"]), "loo_r2")


@query("derived_subset_fit", "A57")
def _(t):
    return S.loo_r2_subsets(derived(t), "sum2", ["l_discount", "l_tax", "l_quantity"], 3)


@query("derived_null_distribution", "A57")
def _(t):
    """500 shuffles of the target, each searched as the target itself; the tests compare with numpy."""
    return S.derived_null(t.part.withColumn("sq", F.col("p_retailprice") * F.col("p_retailprice")), "p_retailprice", ["sq", "p_size"], "p_partkey")


@query("derived_search", "A57")
def _(t):
    """Subsets of up to three columns, in linear and in logarithmic form, against 500 shuffles."""
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 97 + 1).cast("double").alias("mod"))
    return S.derived_search(p.withColumn("flux", F.col("price") * F.col("size") * F.col("size") / F.sqrt("mod")), "flux", ["size", "price", "mod"], "p_partkey")


@query("binned_columns", "A58", """with b as (select least(floor((p_retailprice - 900) / 40), 4)::int as level, p_retailprice as price, p_size::double as size from part), r as (select 'price' as "column", level, min(price) as lo, max(price) as hi from b group by 2 union all select 'size', level, min(size), max(size) from b group by 2),
n as (select *, lag(hi) over (partition by "column" order by lo) as before from r) select "column", bool_and(before is null or lo > before) as separable from n group by 1""")
def _(t):
    b = t.part.select(F.least(F.floor((F.col("p_retailprice") - 900) / 40), F.lit(4)).alias("level"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return S.separable_levels(b, "level", ["price", "size"])


@query("binned_column_p", "A58")
def _(t):
    b = t.part.select("p_partkey", F.least(F.floor((F.col("p_retailprice") - 900) / 40), F.lit(4)).alias("level"), F.col("p_retailprice").alias("price"))
    return S.separable_p(b, "level", "price", "p_partkey")


_EV = """e as (select c_custkey, case when c_acctbal > 0 then 1 end as a, case when c_nationkey < 20 then c_mktsegment end as sa, case when c_nationkey > 3 then 0 end as b, c_name as sb from customer),
l as (select c_custkey, 'CH4' as term, a as value, sa as source from e union all select c_custkey, 'CO2', b, sb from e)"""


def evidence(t):
    e = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, 1).alias("a"), F.when(F.col("c_nationkey") < 20, F.col("c_mktsegment")).alias("sa"), F.when(F.col("c_nationkey") > 3, 0).alias("b"), F.col("c_name").alias("sb"))
    return S.evidence_rows(e, "c_custkey", {"CH4": ("a", "sa"), "CO2": ("b", "sb")})


@query("evidence_audit", "A64", f"with {_EV} select c_custkey, term, value, source from l where value is not null and coalesce(trim(source), '') = ''")
def _(t):
    return S.evidence_violations(evidence(t))


@query("evidence_counts", "A64", f"with {_EV} select term, count(*) filter (where value = 1) as present, count(*) filter (where value = 0) as absent, count(*) filter (where value is null) as unknown from l group by 1")
def _(t):
    return evidence(t).groupBy("term").agg(F.count_if(F.col("value") == 1).alias("present"), F.count_if(F.col("value") == 0).alias("absent"), F.count_if(F.col("value").isNull()).alias("unknown"))


@query("scorer_agreement", "M22", f"""with {SC}, r as (select rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as a, rank() over (order by s2) + (count(*) over (partition by s2) - 1) / 2.0::double as b from sc)
select round(corr(a, b), 6) as spearman, (select round(max(abs(s - s2)), 6) from sc) as max_difference from r""")
def _(t):
    x = scored(t)
    gap = x.agg(F.round(F.max(F.abs(F.col("s") - F.col("s2"))), 6)).scalar()
    return M.spearman(x, "s", "s2").select(F.round("spearman", 6).alias("spearman"), gap.alias("max_difference"))


@query("stress_rates", "M21", f"""with {SC}, x as (select *, case when toxic = 1 then 0.2::double when n_chars > 2000 then 0.05::double end as f from sc), c as (select * from x where f > 0)
select 'fpr_absent' as metric, round(avg((s2 >= 0.5)::int) filter (where y = 0), 6) as value from x union all select 'fpr_absent_strong', round(avg((s2 >= 0.5)::int) filter (where y = 0 and f >= 0.1), 6) from x
union all select 'fpr_absent_clean', round(avg((s2 >= 0.5)::int) filter (where y = 0 and coalesce(f, 0) = 0), 6) from x union all select 'auc_all', round(auc, 6) from {auc_sql('x', 's2')} union all select 'auc_contaminated', round(auc, 6) from {auc_sql('c', 's2')}""")
def _(t):
    x = scored(t).withColumn("f", F.when(F.col("toxic") == 1, 0.2).when(F.col("n_chars") > 2000, 0.05))
    return r6(S.stress_rates(x, "y", "s2", F.col("y") == 1, "f"), "value")


@query("majority_baseline", "M05", f"""with x as (select l_returnflag as y, {sql_uniform("l_orderkey||'|2'")} < 0.7 as train from lineitem), b as (select arg_min(y, (-n, y)) as y from (select y, count(*) as n from x where train group by 1))
select round(avg((x.y = b.y)::int), 6) as accuracy, count(*) as rows from x, b where not train""")
def _(t):
    return r6(ML.majority_baseline(t.lineitem, "l_returnflag", uniform("l_orderkey", 2) < 0.7), "accuracy")


@query("exclusion_folds", "M24", """with r as (select o_orderkey, o_custkey % 40 as anchor, (o_orderkey * 7) % 40 as donor, (o_orderstatus = 'F')::int as y from orders), h as (select distinct anchor as held from r)
select held, count(*) filter (where anchor = held) as n_test, count(*) filter (where anchor <> held and donor <> held) as n_train, sum(y) filter (where anchor <> held and donor <> held)::bigint as pos_train,
sum(y) filter (where anchor <> held and donor <> held) in (0, count(*) filter (where anchor <> held and donor <> held)) as one_class from h, r group by 1""")
def _(t):
    r = t.orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("anchor"), ((F.col("o_orderkey") * 7) % 40).alias("donor"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return ML.exclusion_folds(r, "anchor", "donor", "y", "o_orderkey")
