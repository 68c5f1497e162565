"""Bootstrap, permutation and few-label queries on the labelled scores."""

from pyspark.sql import functions as F

from surveyframe.operators import metrics as M
from surveyframe.operators import resample as R
from surveyframe.plans.metrics import SC, auc_sql, r6, scored
from surveyframe.plans.registry import query, sql_uniform

B = 2000
UNITS = f"units as (select star, row_number() over (order by {sql_uniform(chr(39) + chr(39) + '||star||' + chr(39) + '|77' + chr(39))}, star) - 1 as idx from (select distinct star from sc))"
DRAWS = f"""dr as (select b, floor({sql_uniform("b||'|'||idx||'|1'")} * (select count(*) from units))::bigint as idx from units, range({B}) r(b)), wt as (select b, star, count(*)::double as w from dr join units using (idx) group by 1, 2)"""


def boot_auc(name, score):
    return f"""{name}_c as (select b, {score} as s, sum(case when y = 1 then w else 0 end) as pos, sum(case when y = 0 then w else 0 end) as neg from sc join wt using (star) group by 1, 2),
{name}_d as (select *, sum(neg) over (partition by b order by s) - neg / 2 as below from {name}_c), {name} as (select b, case when sum(pos) * sum(neg) > 0 then sum(pos * below) / (sum(pos) * sum(neg)) end as v from {name}_d group by 1)"""


@query("cluster_bootstrap_auc", "A31", f"""with {SC}, {UNITS}, {DRAWS}, {boot_auc('ba', 's')} select round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(v) as replicates,
(select round(auc, 6) from {auc_sql('sc', 's')}) as auc from ba where v is not null""")
def _(t):
    return r6(R.auc_interval(scored(t), "star", "y", "s", B), "low", "high", "auc")


@query("paired_bootstrap", "A32", f"""with {SC}, {UNITS}, {DRAWS}, {boot_auc('ba', 's')}, {boot_auc('bb', 's2')}, d as (select ba.v - bb.v as v from ba join bb using (b) where ba.v - bb.v is not null),
q as (select quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high, count(*) as replicates from d)
select round(low, 6) as low, round(high, 6) as high, replicates, round((select auc from {auc_sql('sc', 's')}) - (select auc from {auc_sql('sc', 's2')}), 6) as delta, low > 0 or high < 0 as excludes_zero from q""")
def _(t):
    return r6(R.paired_auc_difference(scored(t), "star", "y", "s", "s2", B), "low", "high", "delta")


@query("median_gap_bootstrap", "A33", f"""with {SC}, units as (select y, doc_id, row_number() over (partition by y order by {sql_uniform("doc_id||'|77'")}, doc_id) - 1 as idx, count(*) over (partition by y) as n from sc),
dr as (select y, b, floor({sql_uniform("b||'|'||idx||'|'||y||'|1'")} * n)::bigint as idx from units, range({B}) r(b)),
x as (select b, sc.y, s2, s from dr join units using (y, idx) join sc on sc.doc_id = units.doc_id), m as (select b, y, median(s2) as new, median(s) as old from x group by 1, 2),
g as (select b, sum(case when y = 1 then new - old else old - new end) as v from m group by 1) select round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(*) as replicates from g""")
def _(t):
    return r6(R.median_gap_change(scored(t), "doc_id", "y", "s2", "s", B), "low", "high")


@query("permutation_p_value", "A34")
def _(t):
    """100,000 relabellings; DuckDB cannot follow them, the tests compare with all relabellings of small tables."""
    return r6(R.permutation_p(scored(t), "y", "s"), "auc")


@query("leave_one_out_rate", "A46", f"""with {SC} select doc_id, round((sum(y) over (partition by star) - y) / nullif(count(*) over (partition by star) - 1, 0)::double, 6) as loo_rate from sc""")
def _(t):
    return r6(R.leave_one_out_rate(scored(t), "y", ["star"]).select("doc_id", "loo_rate"), "loo_rate")


_SHIFT = "({t} / {s} * p / ({t} / {s} * p + (1 - {t}) / (1 - {s}) * (1 - p)))"


def _clip(x):
    return f"greatest(0.01::double, least(0.99::double, {x}))"


@query("few_label_correction", "M10", f"""with {SC}, x as (select sc.doc_id, y, s2 as p, case when sc.n_chars < 600 then 0 when sc.n_chars < 2000 then 1 else 2 end as band, lang from sc join documents d on d.doc_id = sc.doc_id),
pr as (select band, avg(y) as pi_s from x where lang = 'en' group by 1), ov as (select avg(y) as o from x where lang = 'en'),
tg as (select * from x where lang <> 'en'), tr as (select band, avg(y) as pi_true, count(*) as size from tg group by 1), rt as (select tr.*, coalesce(pi_s, o) as pi_s from tr left join pr using (band), ov),
m as (select tg.*, b, row_number() over (partition by b, band order by {sql_uniform("b||'|'||doc_id||'|1'")}, doc_id) as rn from tg, range(200) r(b)),
l as (select m.*, pi_true, pi_s, rn <= 10 and size > 10 as lab from m join rt using (band)), e as (select b, band, avg(case when lab then y end) as est from l group by 1, 2),
h as (select l.b, doc_id, y, p, pi_s, pi_true, coalesce(est, pi_s) as est from l join e on e.b = l.b and e.band = l.band where not lab),
k as (select b, doc_id, y, 'few' as kind, {_SHIFT.format(t=_clip('est'), s=_clip('pi_s'))} as q from h union all select b, doc_id, y, 'oracle', {_SHIFT.format(t=_clip('pi_true'), s=_clip('pi_s'))} from h union all select b, doc_id, y, 'frozen', p from h),
nt as (select *, ntile(10) over (partition by b, kind order by q, doc_id) as bin from k), eb as (select b, kind, bin, abs(sum(y) - sum(q)) as d, count(*) as n from nt group by 1, 2, 3), ec as (select b, kind, sum(d) / sum(n) as ece from eb group by 1, 2),
a as {auc_sql('k', 'q', keys='b, kind')} select kind, round(median(ece), 6) as ece, round(median(auc), 6) as auc, count(*) as draws from ec join a using (b, kind) group by 1""")
def _(t):
    x = scored(t).join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("band", M.band_of("n_chars", [0, 600, 2000, float("inf")]))
    return r6(R.few_label(x.filter("lang <> 'en'"), x.filter("lang = 'en'"), "band", "y", "s2", "doc_id", 10, 200), "ece", "auc")
