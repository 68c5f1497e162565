"""Scores against labels: `labels.quality` as truth, hashed scores that lean on it, documents' source as cluster."""

from pyspark.sql import functions as F

from surveyframe.functions import stats as ST
from surveyframe.functions.basics import clip, uniform
from surveyframe.operators import metrics as M
from surveyframe.operators.scale import medians, quantiles, salted_join, scalar_of
from surveyframe.plans.registry import query, sql_uniform

_U1, _U2 = sql_uniform("l.doc_id::varchar||'|1'"), sql_uniform("l.doc_id::varchar||'|2'")
SC = f"""sc as (select l.doc_id, d.source as star, d.n_chars, quality as y, toxic,
floor(({_U1} + 0.35::double * quality) / 1.35::double * 200) / 200 as s, ({_U2} + 0.2::double * quality) / 1.2::double as s2
from labels l join documents d on d.doc_id = l.doc_id)"""


def scored(t):
    d = t.documents.select("doc_id", F.col("source").alias("star"), "n_chars")
    rows = t.labels.select("doc_id", F.col("quality").alias("y"), "toxic").join(d, "doc_id")
    s = F.floor((uniform("doc_id", 1) + 0.35 * F.col("y")) / 1.35 * 200) / 200
    return rows.withColumn("s", s).withColumn("s2", (uniform("doc_id", 2) + 0.2 * F.col("y")) / 1.2)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def auc_sql(src, score, y="y", keys=""):
    """Subquery with the keys, auc, n_pos, n_neg of a source relation."""
    part, k, group = (f"partition by {keys}", f"{keys}, ", f"group by {keys}") if keys else ("", "", "")
    over = f"{part}, {score}" if keys else f"partition by {score}"
    return f"""(select {k}case when n1 * n0 > 0 then (rs - n1 * (n1 + 1) / 2) / (n1 * n0) end as auc, n1 as n_pos, n0 as n_neg from (
select {k}sum(r) filter (where y_ = 1) as rs, (count(*) filter (where y_ = 1))::double as n1, (count(*) filter (where y_ = 0))::double as n0 from (
select {k}{y} as y_, rank() over ({part} order by {score}) + (count(*) over ({over}) - 1) / 2.0::double as r from {src}) {group}))"""


CURVE = """ct as (select s, sum((y = 1)::int)::double as pos, sum((y = 0)::int)::double as neg from sc group by 1),
tot as (select sum(pos) as p, sum(neg) as n from ct),
cv as (select s as threshold, pos, sum(pos) over w as tp, sum(neg) over w as fp, p, n from ct, tot window w as (order by s desc rows unbounded preceding)),
c as (select threshold, pos, tp, fp, tp / (tp + fp) as precision, tp / p as recall, fp / n as fpr, p, n from cv)"""


@query("group_comparison", "A08", f"""with {SC}, g as (select toxic, avg((s >= 0.5)::int) * 100 as high_pct, avg((n_chars > 1000)::int) * 100 as long_pct, median(s) as med_s, median(n_chars) as med_chars from sc group by 1)
select signal, round(a, 6) as toxic, round(b, 6) as clean, round(a - b, 6) as difference from (select 'high_score' as signal, x.high_pct as a, z.high_pct as b from g x, g z where x.toxic = 1 and z.toxic = 0
union all select 'long_text', x.long_pct, z.long_pct from g x, g z where x.toxic = 1 and z.toxic = 0 union all select 'median_score', x.med_s, z.med_s from g x, g z where x.toxic = 1 and z.toxic = 0
union all select 'median_chars', x.med_chars, z.med_chars from g x, g z where x.toxic = 1 and z.toxic = 0)""")
def _(t):
    from surveyframe.operators.screens import compare_groups
    flags = {"high_score": F.col("s") >= 0.5, "long_text": F.col("n_chars") > 1000}
    got = compare_groups(scored(t), F.col("toxic") == 1, flags, {"median_score": "s", "median_chars": "n_chars"})
    return got.select("signal", F.round("inside", 6).alias("toxic"), F.round("outside", 6).alias("clean"), F.round("difference", 6).alias("difference"))


@query("bucket_composition", "A09", f"""with {SC}, b as (select case when n_chars < 500 then 'short' when n_chars < 2000 then 'middle' else 'long' end as bucket, (s < 0.5)::int as missed from sc where y = 1)
select bucket, count(*) as rows, round(count(*) / (sum(count(*)) over ())::double, 6) as share, round(avg(missed), 6) as miss_rate, round((sum(sum(missed)) over ()) / (sum(count(*)) over ())::double, 6) as base_rate from b group by 1""")
def _(t):
    from surveyframe.operators.screens import bucket_composition
    b = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long")
    return r6(bucket_composition(scored(t).filter("y = 1").withColumn("bucket", b), "bucket", F.col("s") < 0.5), "share", "miss_rate", "base_rate")


_P3 = ", ".join(f"{sql_uniform(f'doc_id::varchar||chr(124)||{i + 10}')} + case when quality * 2 + toxic - 1 = {i} then 0.3::double else 0 end as p{i}" for i in range(3))
PRED3 = f"""p3 as (select doc_id, (case when toxic = 1 then 2 else quality end)::int as y, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as pred from (select doc_id, quality, toxic, {_P3} from labels))"""


def predicted3(t):
    boost = F.col("quality") * 2 + F.col("toxic") - 1
    scores = F.array(*[uniform("doc_id", i + 10) + F.when(boost == i, 0.3).otherwise(0.0) for i in range(3)])
    return t.labels.select("doc_id", F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("y"), M.argmax_class(scores).alias("pred"))


@query("confusion_matrix", "A10", f"with {PRED3} select y, pred, count(*) as rows from p3 group by 1, 2")
def _(t):
    return M.confusion(predicted3(t), "y", "pred")


@query("class_report", "A10", f"""with {PRED3}, k as (select unnest([0, 1, 2]) as class), c as (select class, (select count(*) from p3 where y = class) as support, (select count(*) from p3 where pred = class) as called,
(select count(*) from p3 where y = class and pred = class) as hit from k), m as (select class, support, coalesce(hit / nullif(called, 0)::double, 0) as p, coalesce(hit / nullif(support, 0)::double, 0) as r from c)
select class, support, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, round((select avg((y = pred)::int) from p3), 6) as accuracy from m""")
def _(t):
    return r6(M.class_report(predicted3(t), "y", "pred"), "precision", "recall", "f1", "accuracy")


@query("threshold_sweep", "A11", f"""with {SC}, th as (select i / 200.0::double as t from range(201) r(i)),
k as (select t, count(*) filter (where s >= t and y = 1) as tp, count(*) filter (where s >= t and y = 0) as fp, count(*) filter (where s < t and y = 1) as fn, count(*) filter (where s < t and y = 0) as tn from th, sc group by 1),
m as (select *, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as r from k)
select round(t, 6) as threshold, tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(case when p is not null and r is not null then case when p + r > 0 then 2 * p * r / (p + r) else 0 end end, 6) as f1,
round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy from m""")
def _(t):
    return r6(M.threshold_sweep(scored(t), "y", "s"), "threshold", "precision", "recall", "f1", "accuracy")


@query("roc_auc", "A12", f"with {SC} select round(auc, 6) as auc, n_pos, n_neg from {auc_sql('sc', 's')}")
def _(t):
    return r6(M.roc_auc(scored(t), "y", "s"), "auc")


@query("roc_auc_by_flag", "A12", f"""with x as (select l_linestatus as k, (l_returnflag = 'R')::int as y, l_extendedprice + case when l_returnflag = 'R' then 5000 else 0 end as s from lineitem)
select k, round(auc, 6) as auc, n_pos, n_neg from {auc_sql('x', 's', keys='k')}""")
def _(t):
    x = t.lineitem.select(F.col("l_linestatus").alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
                          (F.col("l_extendedprice") + F.when(F.col("l_returnflag") == "R", 5000).otherwise(0)).alias("s"))
    return r6(M.roc_auc(x, "y", "s", ["k"]), "auc")


@query("average_precision", "A13", f"""with {SC}, {CURVE} select round(sum(precision * pos) / max(p), 6) as average_precision, round(max(p) / (max(p) + max(n)), 6) as base_rate,
round(sum(precision * pos) / max(p) - max(p) / (max(p) + max(n)), 6) as lift from c""")
def _(t):
    return r6(M.average_precision(scored(t), "y", "s"), "average_precision", "base_rate", "lift")


@query("precision_at_recall", "A14", f"""with {SC}, {CURVE}, g as (select unnest([0.5::double, 0.8::double, 0.9::double, 0.95::double]) as target_recall),
o as (select target_recall, precision, recall, threshold, row_number() over (partition by target_recall order by precision desc, threshold) as rn from g join c on recall >= target_recall)
select target_recall, true as achievable, round(precision, 6) as precision, round(recall, 6) as recall, round(threshold, 6) as threshold from o where rn = 1""")
def _(t):
    return r6(M.precision_at_recall(scored(t), "y", "s", [0.5, 0.8, 0.9, 0.95]), "precision", "recall", "threshold")


@query("threshold_at_recall", "A14", f"with {SC} select round(quantile_cont(s2, 0.1), 6) as threshold from sc where y = 1")
def _(t):
    return r6(M.threshold_at_recall(scored(t), "y", "s2", 0.9), "threshold")


@query("fixed_threshold_rates", "A15", f"""with {SC}, k as (select star, count(*) filter (where s >= 0.4 and y = 1) as tp, count(*) filter (where s >= 0.4 and y = 0) as fp, count(*) filter (where s < 0.4 and y = 1) as fn, count(*) filter (where y = 0) as n0 from sc group by 1)
select star, round(tp / greatest(tp + fp, 1)::double, 6) as precision, round(tp / greatest(tp + fn, 1)::double, 6) as recall, round(fp / greatest(n0, 1)::double, 6) as false_positive_rate from k""")
def _(t):
    return r6(M.at_threshold(scored(t), "y", "s", 0.4, ["star"]), "precision", "recall", "false_positive_rate")


@query("ece_equal_width", "A16", f"""with {SC}, b as (select least(floor(s2 * 10), 9) as b, abs(sum(y) - sum(s2)) as d, count(*) as n from sc group by 1) select round(sum(d) / sum(n), 6) as ece from b""")
def _(t):
    return r6(M.ece_equal_width(scored(t), "y", "s2"), "ece")


@query("ece_equal_count", "A17", f"""with {SC}, q as (select y, s, ntile(10) over (order by s, doc_id) as b from sc), b as (select b, abs(sum(y) - sum(s)) as d, count(*) as n from q group by 1) select round(sum(d) / sum(n), 6) as ece from b""")
def _(t):
    return r6(M.ece_equal_count(scored(t), "y", "s", "doc_id"), "ece")


@query("reliability_curve", "A18", f"""with {SC} select least(floor(s2 * 10), 9)::int as bin, round(avg(s2), 6) as predicted, round(avg(y), 6) as observed, count(*) as rows from sc group by 1 having count(*) >= 5""")
def _(t):
    return r6(M.reliability_curve(scored(t), "y", "s2"), "predicted", "observed")


@query("probability_scores", "A19", f"""with {SC}, q as (select *, greatest(1e-6::double, least(1 - 1e-6::double, s2)) as q from sc) select toxic, round(avg((s2 - y) * (s2 - y)), 6) as brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss, round(avg(y), 6) as base_rate, count(*) as rows from q group by 1""")
def _(t):
    return r6(M.probability_scores(scored(t), "y", "s2", ["toxic"]), "brier", "log_loss", "base_rate")


def wilson_sql(k, n):
    z, n = "1.96::double", f"({n})::double"
    p = f"(({k})/{n})"
    c, d = f"({p}+{z}*{z}/(2*{n}))", f"(1+{z}*{z}/{n})"
    h = f"({z}*sqrt({p}*(1-{p})/{n}+{z}*{z}/(4*{n}*{n}))/{d})"
    return f"round({p},6) as rate, round(greatest(0.0::double,{c}/{d}-{h}),6) as low, round(least(1.0::double,{c}/{d}+{h}),6) as high"


@query("wilson_intervals", "A20", f"""with g as (select l_suppkey, count(*) as rows, count(*) filter (where l_returnflag = 'R') as hits from lineitem group by 1) select l_suppkey, rows, hits, {wilson_sql('hits', 'rows')} from g""")
def _(t):
    return r6(M.group_rates(t.lineitem, "l_suppkey", F.col("l_returnflag") == "R"), "rate", "low", "high")


@query("mcnemar_counts", "A21", f"""with {SC} select toxic, count(*) filter (where (s >= 0.5) = (y = 1) and (s2 >= 0.5) <> (y = 1)) as only_first, count(*) filter (where (s >= 0.5) <> (y = 1) and (s2 >= 0.5) = (y = 1)) as only_second from sc group by 1""")
def _(t):
    return paired_test(t).drop("p_exact")


def paired_test(t):
    a, b = (F.col("s") >= 0.5) == (F.col("y") == 1), (F.col("s2") >= 0.5) == (F.col("y") == 1)
    g = scored(t).groupBy("toxic").agg(F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))
    return g.withColumn("p_exact", ST.binomial_two_sided("only_first", F.col("only_first") + F.col("only_second")))


@query("mcnemar_p", "A21", f"""with {SC}, k as (select toxic, count(*) filter (where (s >= 0.5) = (y = 1) and (s2 >= 0.5) <> (y = 1)) as a, count(*) filter (where (s >= 0.5) <> (y = 1) and (s2 >= 0.5) = (y = 1)) as b from sc group by 1),
p as (select toxic, a, b, (select sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2.0::double))) from range(1000000) r(i) where i <= least(a, b)) as tail from k)
select toxic, round(case when a + b = 0 or a = b then 1.0::double else least(1.0::double, 2 * tail) end, 6) as p_exact from p""")
def _(t):
    return r6(paired_test(t).select("toxic", "p_exact"), "p_exact")


@query("exclusive_flag_groups", "A22", """with f as (select (l_discount >= 0.09)::int as a, (l_tax = 0)::int as b, (l_quantity > 45)::int as c, (l_linestatus = 'F')::int as rejected from lineitem),
g as (select case when a + b + c >= 2 then 'two or more' when a + b + c = 0 then 'none' when a = 1 then 'discounted only' when b = 1 then 'untaxed only' else 'large only' end as grp, rejected from f)
select grp as "group", count(*) as rows, sum(rejected)::bigint as rejected, (select count(*) from g) - count(*) as rest, ((select sum(rejected) from g) - sum(rejected))::bigint as rest_rejected from g group by 1""")
def _(t):
    return flag_groups(t).drop("p")


def flag_groups(t):
    from surveyframe.operators.screens import against_rest
    f = t.lineitem.select((F.col("l_discount") >= 0.09).alias("discounted"), (F.col("l_tax") == 0).alias("untaxed"), (F.col("l_quantity") > 45).alias("large"), (F.col("l_linestatus") == "F").alias("rejected"))
    return against_rest(f.withColumn("group", M.exclusive_flags(["discounted", "untaxed", "large"])), "group", F.col("rejected"))


@query("fisher_p_values", "A22")
def _(t):
    return r6(flag_groups(t).select("group", "p"), "p")


_PB = f"select p_type as family, p_brand as name, {sql_uniform(chr(39) + 'p' + chr(39) + chr(124)*2 + 'p_type' + chr(124)*2 + 'p_brand')} * 0.2 as p from part group by 1, 2"


@query("holm_adjustment", "A23", f"""with t as ({_PB}), r as (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by p, name) as i from t)
select family, name, round(p, 6) as p, round(max(least(1.0::double, (m - i + 1) * p)) over (partition by family order by p, name rows unbounded preceding), 6) as p_holm from r""")
def _(t):
    key = F.concat(F.lit("p"), "p_type", "p_brand")
    tests = t.part.select(F.col("p_type").alias("family"), F.col("p_brand").alias("name"), (uniform(key) * 0.2).alias("p")).distinct()
    return r6(M.holm(tests, "p", "name", ["family"]), "p", "p_holm")


@query("auc_score_interval", "A24")
def _(t):
    a = M.roc_auc(scored(t), "y", "s2", ["toxic"])
    lo, hi = ST.auc_interval("auc", "n_pos", "n_neg")
    return a.select("toxic", "auc", lo.alias("low"), hi.alias("high"))


_KAPPA = "(((b + (n - p - q + b)) / n) - (p * q + (n - p) * (n - q)) / (n * n)) / nullif(1 - (p * q + (n - p) * (n - q)) / (n * n), 0)"


@query("label_agreement", "A25 A55", f"""with x as (select coalesce(lang, 'all') as part, sum(quality * toxic)::double as b, sum(quality)::double as p, sum(toxic)::double as q, count(*)::double as n, avg((quality = toxic)::int) as agree
from labels join documents using (doc_id) group by grouping sets ((lang), ())) select part, round(agree, 6) as agreement, round({_KAPPA}, 6) as kappa from x""")
def _(t):
    from surveyframe.operators.screens import agreement
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return r6(agreement(j, "quality", "toxic", "lang", "part"), "agreement", "kappa")


@query("spearman", "A26", """with r as (select l_linestatus, rank() over (partition by l_linestatus order by l_quantity) + (count(*) over (partition by l_linestatus, l_quantity) - 1) / 2.0::double as a,
rank() over (partition by l_linestatus order by l_extendedprice) + (count(*) over (partition by l_linestatus, l_extendedprice) - 1) / 2.0::double as b from lineitem)
select l_linestatus, round(corr(a, b), 6) as spearman, count(*) as rows from r group by 1""")
def _(t):
    return r6(M.spearman(t.lineitem, "l_quantity", "l_extendedprice", ["l_linestatus"]), "spearman")


@query("correlation_screen", "A27", """with c as (select unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) as "column", unnest([corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice), corr(l_tax, l_extendedprice), corr(l_linenumber, l_extendedprice)]) as r from lineitem)
select "column", round(r, 6) as r, abs(r) = (select max(abs(r)) from c) as best from c""")
def _(t):
    return r6(M.correlations_with(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), "r")


@query("mann_whitney_u", "A28", """with r as (select l_returnflag = 'A' as g, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0::double as r from lineitem)
select sum(r) filter (where g) - (count(*) filter (where g))::double * ((count(*) filter (where g)) + 1) / 2 as u, (count(*) filter (where g))::double as n1, (count(*) filter (where not g))::double as n2 from r""")
def _(t):
    return M.mann_whitney(t.lineitem, F.col("l_returnflag") == "A", "l_quantity").select("u", "n1", "n2")


@query("mann_whitney_p", "A28")
def _(t):
    return M.mann_whitney(t.lineitem, F.col("l_returnflag") == "A", "l_quantity")


@query("wilcoxon_sums", "A29", """with d as (select l_discount * 100 - l_tax * 100 - l_linenumber as d from lineitem), n as (select round(d) as d from d where round(d) <> 0), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as r from n)
select sum(r) filter (where d > 0) as w_plus, sum(r) filter (where d < 0) as w_minus, count(*) as pairs from r""")
def _(t):
    d = t.lineitem.select(F.round(F.col("l_discount") * 100 - F.col("l_tax") * 100 - F.col("l_linenumber")).alias("d"))
    return M.wilcoxon(d, "d")


@query("kolmogorov_smirnov", "A30", """with u as (select l_extendedprice as v, (l_returnflag = 'A')::int as a from lineitem), c as (select v, sum(a) as a, sum(1 - a) as b from u group by 1),
k as (select sum(a) over (order by v) / (select sum(a) from u)::double as fa, sum(b) over (order by v) / (select sum(1 - a) from u)::double as fb from c) select round(max(abs(fa - fb)), 6) as ks from k""")
def _(t):
    pick = lambda c: t.lineitem.filter(c).select("l_extendedprice")
    return r6(M.kolmogorov_smirnov(pick("l_returnflag = 'A'"), pick("l_returnflag <> 'A'"), "l_extendedprice"), "ks")


@query("label_rate_by_bin", "A49", f"""with g as (select case when l_extendedprice < 10000 then 0 when l_extendedprice < 30000 then 1 when l_extendedprice < 60000 then 2 else 3 end as bin, count(*) as rows, count(*) filter (where l_returnflag = 'R') as hits from lineitem group by 1) select bin, rows, hits, {wilson_sql('hits', 'rows')} from g""")
def _(t):
    b = M.band_of("l_extendedprice", [0, 10000, 30000, 60000, float("inf")])
    return r6(M.group_rates(t.lineitem.withColumn("bin", b), "bin", F.col("l_returnflag") == "R"), "rate", "low", "high")


@query("stage_yields", "A50", """with c as (select o_orderstatus as class, count(*) as a, count(*) filter (where o_totalprice > 50000) as b, count(*) filter (where o_totalprice > 50000 and o_orderpriority <> '5-LOW') as c from orders group by 1),
f as (select class, a as catalogue, b as complete, c as built, c / b::double as share from c)
select class, catalogue, complete, built, round(share, 6) as share, abs(share - (select sum(built) / sum(complete)::double from f)) > 0.02 as shifted from f""")
def _(t):
    from surveyframe.operators.screens import stage_yields
    stages = {"catalogue": F.lit(True), "complete": F.col("o_totalprice") > 50000, "built": (F.col("o_totalprice") > 50000) & (F.col("o_orderpriority") != "5-LOW")}
    return r6(stage_yields(t.orders.withColumn("class", F.col("o_orderstatus")), "class", stages, 0.02), "share")


@query("family_selection", "A51", """with r as (select s_nationkey as family, s_acctbal as v from supplier), f as (select family, avg(v) as mean, stddev_samp(v) as sd, count(*) as runs from r group by 1),
b as (select * from f order by mean desc, family limit 1) select family, round(mean, 4) as mean, round(sd, 4) as sd, runs, family = (select min(f.family) from f, b where f.mean >= b.mean - coalesce(b.sd, 0)) as chosen from f""")
def _(t):
    from surveyframe.operators.screens import family_selection
    got = family_selection(t.supplier.select(F.col("s_nationkey").alias("family"), F.col("s_acctbal").alias("v")), "family", "v", "family")
    return got.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("roc_auc_by_band", "A52", f"""with {SC}, b as (select case when n_chars < 300 then 0 when n_chars < 1000 then 1 when n_chars < 3000 then 2 else 3 end as band, y, s from sc) select band, round(auc, 6) as auc, n_pos, n_neg from {auc_sql('b', 's', keys='band')}""")
def _(t):
    b = scored(t).withColumn("band", M.band_of("n_chars", [0, 300, 1000, 3000, float("inf")]))
    return r6(M.roc_auc(b, "y", "s", ["band"]), "auc")


@query("object_roll_up", "A53", f"""with x as (select conv_id, turn, role, {sql_uniform("conv_id::varchar||'|'||turn")} as s from conversations)
select conv_id, round(avg(s), 6) as mean_score, arg_min(role, turn) as label, count(*) as items, round(min(s), 6) as low, round(max(s), 6) as high from x group by 1""")
def _(t):
    from surveyframe.operators.screens import roll_up
    x = t.conversations.select("conv_id", "turn", "role", uniform("conv_id", "turn").alias("s"))
    return r6(roll_up(x, "conv_id", "s", "role", "turn"), "mean_score", "low", "high")


@query("reliability_notes", "A54", """with c as (select source, sum(quality)::bigint as pos, sum(1 - quality)::bigint as neg from labels join documents using (doc_id) group by 1)
select source, pos, neg, case when pos = 0 or neg = 0 then 'not evaluable' when least(pos, neg) < 3 then 'unreliable' when least(pos, neg) < 5 then 'indicative' else 'usable' end as note from c""")
def _(t):
    from surveyframe.operators.screens import reliability_note
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    c = j.groupBy("source").agg(F.sum("quality").alias("pos"), F.sum(1 - F.col("quality")).alias("neg"))
    return c.withColumn("note", reliability_note("pos", "neg"))


@query("external_agreement", "A55", """select o_orderstatus, count(*) as rows, round(avg(((o_totalprice > 250000) = (o_orderpriority < '3'))::int), 6) as agreement from orders group by 1""")
def _(t):
    same = (F.col("o_totalprice") > 250000) == (F.col("o_orderpriority") < "3")
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.round(F.avg(same.cast("int")), 6).alias("agreement"))


SEEDS = f"""sd as (select l.doc_id, quality as y, k, ({sql_uniform("l.doc_id::varchar||'|'||(k + 20)")} + 0.35::double * quality) / 1.35::double as s from labels l, range(1, 6) r(k)),
en as (select doc_id, y, avg(s) as mean, stddev_pop(s) as sd from sd group by 1, 2)"""


def seeds(t):
    rows = t.labels.select("doc_id", F.col("quality").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    return rows.withColumn("s", (uniform("doc_id", F.col("k") + 20) + 0.35 * F.col("y")) / 1.35)


def ensemble(t):
    return seeds(t).groupBy("doc_id", "y").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"))


@query("ensemble_scores", "A63", f"with {SEEDS} select doc_id, y, round(mean, 6) as mean, round(sd, 6) as sd from en")
def _(t):
    return r6(ensemble(t), "mean", "sd")


@query("selective_prediction", "A60", f"""with {SEEDS}, o as (select ((mean >= 0.5)::int <> y)::int as wrong, row_number() over (order by round(sd, 9), doc_id) as rn, count(*) over () as n from en),
c as (select unnest([1.0::double, 0.95::double, 0.9::double, 0.8::double, 0.7::double, 0.6::double, 0.5::double]) as coverage)
select coverage, count(*) as kept, round(avg(wrong), 6) as error_rate from c join o on rn <= round_even(coverage * n, 0) group by 1""")
def _(t):
    e = ensemble(t).withColumn("sd", F.round("sd", 9)).withColumn("wrong", (F.col("mean") >= 0.5).cast("int") != F.col("y"))
    return r6(M.selective_prediction(e, F.col("wrong"), "sd", "doc_id", [1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5]), "error_rate")


@query("selective_auc", "A60", f"""with {SEEDS}, o as (select doc_id, y, mean, round(sd, 9) as sd, ((mean >= 0.5)::int <> y)::int as wrong, row_number() over (order by round(sd, 9), doc_id) as rn, count(*) over () as n from en),
c as (select unnest([1.0::double, 0.95::double, 0.9::double, 0.8::double, 0.7::double, 0.6::double, 0.5::double]) as coverage), k as (select coverage, y, mean from c join o on rn <= round_even(coverage * n, 0))
select coverage, round(auc, 6) as auc, (select round(auc, 6) from {auc_sql('o', 'sd', y='wrong')}) as error_auc from {auc_sql('k', 'mean', keys='coverage')}""")
def _(t):
    e = ensemble(t).withColumn("sd", F.round("sd", 9)).withColumn("wrong", (F.col("mean") >= 0.5).cast("int") != F.col("y"))
    return r6(M.selective_auc(e, "y", "mean", F.col("wrong"), "sd", "doc_id", [1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5]), "auc", "error_auc")


@query("ranking_consistency", "A62", """with x as (select p_partkey, p_retailprice as a, p_retailprice + p_size * 10 as b from part), ta as (select p_partkey from x order by a desc, p_partkey limit 50), tb as (select p_partkey from x order by b desc, p_partkey limit 50),
r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double as rb from x)
select (select count(*) from (select * from ta intersect select * from tb)) as shared, (select round(corr(ra, rb), 6) from r) as spearman""")
def _(t):
    x = t.part.select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_retailprice") + F.col("p_size") * 10).alias("b"))
    rho = M.spearman(x, "a", "b").select(F.round("spearman", 6)).scalar()
    return M.top_k_overlap(x, "a", "b", "p_partkey", 50).select("shared", rho.alias("spearman"))


@query("curve_points", "A65", f"with {SC}, {CURVE} select round(threshold, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(fpr, 6) as fpr from c")
def _(t):
    return r6(M.curve(scored(t), "y", "s").select("threshold", "precision", "recall", "fpr"), "threshold", "precision", "recall", "fpr")


@query("boundary_validation", "A66", f"""with {SC}, d as (select doc_id, y, toxic, s - 0.5 as m, 'first' as definition from sc union all select doc_id, y, toxic, s2 - 0.5, 'second' from sc),
a as {auc_sql('d', 'm', keys='definition')}, f as {auc_sql('(select * from d where toxic = 0)', 'm', keys='definition')}
select definition, count(*) as rows, count(*) filter (where (m > 0) = (y = 1)) as correct, round(any_value(a.auc), 6) as auc, round(any_value(f.auc), 6) as auc_firm from d join a using (definition) join f using (definition) group by 1""")
def _(t):
    from surveyframe.operators.screens import boundary_validation
    x = scored(t).withColumn("first", F.col("s") - 0.5).withColumn("second", F.col("s2") - 0.5)
    return r6(boundary_validation(x, "y", ["first", "second"], F.col("toxic") == 1), "auc", "auc_firm")


MASKED = f"""m as (select doc_id, y, s, s2 as after from sc), d as (select *, s - after as fall from m)"""


@query("masking_test", "A68", f"""with {SC}, {MASKED}, g as (select y, round(median(fall), 6) as median_drop from d group by 1)
select g.y, median_drop, round(a.auc, 6) as auc_before, round(b.auc, 6) as auc_after from g, {auc_sql('m', 's')} a, {auc_sql('m', 'after')} b""")
def _(t):
    from surveyframe.operators.screens import masking_test
    return r6(masking_test(scored(t), "y", "s", "s2"), "median_drop", "auc_before", "auc_after")


LEVELS = f"""lv as (select doc_id, star, lvl, y, s2 as base, least(1.0::double, s2 + 0.05::double * lvl * {sql_uniform("doc_id::varchar||'|'||lvl")}) as treated from sc, range(1, 4) r(lvl))"""


@query("recovery_by_level", "A69", f"""with {SC}, {LEVELS}, u as (select lvl, 1 as y, treated as v from lv union all select lvl, 0, base from lv), a as {auc_sql('u', 'v', keys='lvl')}
select lvl as level, round(any_value(auc), 6) as auc, round(avg((treated >= 0.5)::int), 6) as recovered, round(avg((base >= 0.5)::int), 6) as false_rate, round(avg((treated - base > 0.06)::int), 6) as visible from lv join a using (lvl) group by 1""")
def _(t):
    from surveyframe.operators.screens import recovery_by_level
    lv = scored(t).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")))
    lv = lv.withColumn("treated", F.least(F.lit(1.0), F.col("s2") + 0.05 * F.col("level") * uniform("doc_id", "level")))
    return r6(recovery_by_level(lv, ["level"], "s2", "treated", 0.5, F.lit(0.02)), "auc", "recovered", "false_rate", "visible")


@query("adoption_rule", "A70", f"""with {SC}, a as {auc_sql('sc', 's')}, b as {auc_sql('sc', 's2')}, e as (select avg((s - y) * (s - y)) as x, avg((s2 - y) * (s2 - y)) as z from sc)
select round(a.auc - b.auc, 6) as auc_gain, round(z - x, 6) as brier_gain, a.auc - b.auc > 0.01 and x <= z as adopt from a, b, e""")
def _(t):
    from surveyframe.operators.screens import adoption
    return r6(adoption(scored(t), "y", "s", "s2", 0.01), "auc_gain", "brier_gain")


@query("validation_to_test", "A71", f"""with {SC}, x as (select *, case when {sql_uniform("star||'|v'")} < 0.5 then 'val' else 'test' end as part from sc), a as {auc_sql('x', 's', keys='part')}, b as (select part, avg((s - y) * (s - y)) as brier from x group by 1),
l as (select part, 'auc' as metric, auc as v from a union all select part, 'brier', brier from b)
select metric, round(max(v) filter (where part = 'val'), 6) as val, round(max(v) filter (where part = 'test'), 6) as test, round(max(v) filter (where part = 'test') - max(v) filter (where part = 'val'), 6) as change from l group by 1""")
def _(t):
    from surveyframe.operators.screens import split_change
    x = scored(t).withColumn("part", F.when(uniform("star", F.lit("v")) < 0.5, "val").otherwise("test"))
    return r6(split_change(x, "part", "y", "s"), "val", "test", "change")


@query("expectation_table", "P20", f"""with {SC}, a as {auc_sql('sc', 's', keys='star')}, m as (select star, auc, (select count(*) from sc z where z.star = a.star) as rows from a)
select star, check_name, holds from (select star, 'auc above 0.6' as check_name, auc > 0.6 as holds from m union all select star, 'auc below 0.95', auc < 0.95 from m union all select star, 'at least 15 rows', rows >= 15 from m)""")
def _(t):
    from surveyframe.operators.screens import expectations
    a = M.roc_auc(scored(t), "y", "s", ["star"]).withColumn("rows", F.col("n_pos") + F.col("n_neg"))
    return expectations(a, ["star"], {"auc above 0.6": F.col("auc") > 0.6, "auc below 0.95": F.col("auc") < 0.95, "at least 15 rows": F.col("rows") >= 15})


@query("detection_calls", "P21", f"""with x as (select conv_id, {sql_uniform("conv_id::varchar||'|'||turn")} as a, {sql_uniform("conv_id::varchar||'|b'||turn")} as b from conversations),
g as (select conv_id, max(a) as p1, max(b) as p2, min((a + b) / 2) as lo, max((a + b) / 2) as hi from x group by 1)
select conv_id, case when lo < 0.5 and 0.5 <= hi then 'ambiguous' when p1 >= 0.8 and p2 >= 0.8 then 'present' when p1 <= 0.2 and p2 <= 0.2 then 'absent' else 'ambiguous' end as call from g""")
def _(t):
    from surveyframe.operators.screens import detection_call
    x = t.conversations.select("conv_id", uniform("conv_id", "turn").alias("a"), uniform("conv_id", F.concat(F.lit("b"), F.col("turn").cast("string"))).alias("b"))
    g = x.groupBy("conv_id").agg(F.max("a").alias("p1"), F.max("b").alias("p2"), F.min((F.col("a") + F.col("b")) / 2).alias("lo"), F.max((F.col("a") + F.col("b")) / 2).alias("hi"))
    return g.select("conv_id", detection_call("p1", "p2", "lo", "hi").alias("call"))


@query("prospective_resolution", "P23", f"""with {SC}, r as (select sc.star, sc.s, case when toxic = 0 and n_chars > 300 then y end as y from sc),
k as (select star, count(*) filter (where y = 1) as resolved_pos, count(*) filter (where y = 0) as resolved_neg, count(*) filter (where y is null) as open from r group by 1), a as {auc_sql('(select * from r where y is not null)', 's', keys='star')}
select star, resolved_pos, resolved_neg, open, case when resolved_pos >= 3 and resolved_neg >= 1 then round(auc, 6) end as auc from k left join a using (star)""")
def _(t):
    from surveyframe.operators.screens import prospective
    r = scored(t).withColumn("outcome", F.when((F.col("toxic") == 0) & (F.col("n_chars") > 300), F.col("y")))
    return r6(prospective(r, ["star"], "outcome", "s", 3, 1), "auc")
