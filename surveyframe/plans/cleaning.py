"""Projections, filters, labels, ordered deduplication, samples and text functions on the given tables."""

from pyspark.sql import functions as F

from surveyframe.functions import text as X
from surveyframe.functions.basics import epoch_days, finite, uniform
from surveyframe.operators import cleaning as C
from surveyframe.operators.scale import quantiles, salted_join, scalar_of, top_rows
from surveyframe.plans.registry import query, sql_uniform
from surveyframe.sources.text import artefact_kind

STATUS = {"F": "CONFIRMED", "O": "CANDIDATE", "P": "FALSE POSITIVE"}
STATUS_SQL = "case o_orderstatus when 'F' then 'CONFIRMED' when 'O' then 'CANDIDATE' when 'P' then 'FALSE POSITIVE' end"


@query("row_filter_counts", "P01", """select * from (select 0 as step, 'all' as condition, count(*) as rows from orders
union all select 1, 'o_orderstatus = F', count(*) from orders where o_orderstatus = 'F'
union all select 2, 'o_orderpriority = 1-URGENT', count(*) from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT')""")
def _(t):
    steps = C.filter_counts(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    # a row counts for a step when it passed it, so failing rows must not hide a step
    return steps


@query("label_harmonised", "P02", f"select o_orderkey, {STATUS_SQL} as label from orders")
def _(t):
    return C.harmonize_labels(t.orders, "o_orderstatus", STATUS).select("o_orderkey", F.col("label_harmonized").alias("label"))


@query("label_mapping", "A01", f"""select coalesce(o_orderstatus, '<blank>') as old_value, coalesce(new, '<blank>') as new_value, count(*) as rows
from (select o_orderstatus, case o_orderstatus when 'F' then 'CONFIRMED' when 'O' then 'CANDIDATE' end as new from orders) group by 1, 2""")
def _(t):
    df = C.harmonize_labels(t.orders, "o_orderstatus", {"F": "CONFIRMED", "O": "CANDIDATE"}, check=False)
    return C.mapping_table(df, "o_orderstatus")


@query("group_key_fallback", "P03", """select c_custkey, coalesce(case when c_nationkey < 20 then c_nationkey::varchar end, 'c_name:'||c_name) as star_group_id from customer""")
def _(t):
    df = t.customer.withColumn("host", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")))
    return C.add_group_key(df, "host", "c_name").select("c_custkey", "star_group_id")


@query("hashed_group_key", "P04", """select p_partkey, 'star_'||substr(sha1(p_type||'|'||p_size||'|'||floor(p_retailprice)::bigint), 1, 40) as star_group_id from part""")
def _(t):
    parts = [F.col("p_type"), F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string")]
    return t.part.select("p_partkey", C.hashed_group_key(parts).alias("star_group_id"))


@query("unified_ephemerides", "P05", """select 'Kepler' as mission, 'K'||o_orderkey as object_id, o_custkey as star_id, round(1 + o_totalprice / 1e4, 6) as period,
round(epoch_us(o_orderdate)/86400e6::double, 6) as epoch, round((0.1 + o_orderkey % 7) / 24, 6) as duration, abs(o_orderkey % 5 - 2)::double as period_err from orders
union all select 'TESS', 'T'||l_orderkey||'.'||l_linenumber, l_partkey, round(l_quantity, 6), round(epoch_us(l_shipdate)/86400e6::double + 2440000 - 2457000, 6),
round((1 + l_linenumber) / 24.0::double, 6), null from lineitem
union all select 'K2', 'E'||event_id, user_id, round(value, 6), round(epoch_us(ts)/86400e6::double + 2440000 - 2454833, 6), round(0.1 + value / 100, 6), null from events""")
def _(t):
    from surveyframe.operators.timeseries import ephemerides
    a = t.orders.select(F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("object_id"), F.col("o_custkey").alias("star_id"),
                        (1 + F.col("o_totalprice") / 1e4).alias("period"), epoch_days("o_orderdate").alias("epoch"),
                        (0.1 + F.col("o_orderkey") % 7).alias("duration_h"), (F.col("o_orderkey") % 5 - 2).cast("double").alias("period_err"))
    b = t.lineitem.select(F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("object_id"),
                          F.col("l_partkey").alias("star_id"), F.col("l_quantity").alias("period"), (epoch_days("l_shipdate") + 2440000).alias("epoch"),
                          (F.lit(1.0) + F.col("l_linenumber")).alias("duration_h"))
    c = t.events.select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("object_id"), F.col("user_id").alias("star_id"),
                        F.col("value").alias("period"), (epoch_days("ts") + 2440000).alias("epoch"), (24 * (0.1 + F.col("value") / 100)).alias("duration_h"))
    out = ephemerides({"Kepler": a, "TESS": b, "K2": c})
    return out.select("mission", "object_id", "star_id", F.round("period", 6).alias("period"), F.round("epoch", 6).alias("epoch"),
                      F.round("duration", 6).alias("duration"), "period_err")


@query("ephemeris_validity", "P06", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity - 10 is null or l_quantity - 10 <= 0 then 'invalid period'
when l_discount is null or l_discount <= 0 then 'invalid duration' end as reason from lineitem""")
def _(t):
    from surveyframe.operators.timeseries import validity_reason
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             validity_reason(F.col("l_quantity") - 10, epoch_days("l_shipdate"), F.col("l_discount")).alias("reason"))


@query("quality_mask_counts", "P07", """select user_id, count(*) as cadences, count(*) filter (where event_id & 5 <> 0) as masked,
count(*) filter (where event_id & 5 <> 0 and value >= 1) as masked_with_flux,
count(*) filter (where event_id & 5 = 0 and value < 1) as null_flux, count(*) filter (where event_id & 5 = 0 and value >= 1) as usable
from events group by 1 having count(*) filter (where event_id & 5 = 0 and value >= 1) >= 10""")
def _(t):
    from surveyframe.operators.timeseries import mask_report
    e = t.events.select("user_id", "event_id", F.when(F.col("value") >= 1, F.col("value")).alias("flux"))
    return mask_report(e, ["user_id"], "event_id", "flux", 5, 10)


@query("array_row_filter", "P09", """select label, count(*) as rows from embeddings where label >= 2 and
len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 group by label""")
def _(t):
    good = (F.col("label") >= 2) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return t.embeddings.filter(good).groupBy("label").agg(F.count("*").alias("rows"))


@query("three_valued_label", "P10", """select p_partkey, case when p_size = 7 then null else (p_size between 10 and 40 and p_retailprice < 950)::int::tinyint end as label from part""")
def _(t):
    p = t.part.withColumn("size", F.when(F.col("p_size") != 7, F.col("p_size")))
    rule = C.three_valued_rule({"size": F.col("size").between(10, 40), "price": F.col("p_retailprice") < 950},
                               [F.col("size"), F.col("p_retailprice")])
    return p.select("p_partkey", rule.alias("label"))


@query("curated_exclusions", "P11", """select c_custkey, case when c_acctbal < 0 then 'negative' when c_acctbal > 9000 then 'rich' end as category,
case when c_acctbal < 0 then 'below zero' when c_acctbal > 9000 then 'above 9000' end as reason, case when c_acctbal < 0 or c_acctbal > 9000 then c_mktsegment end as note from customer""")
def _(t):
    c = t.customer
    lists = {"negative": c.filter("c_acctbal < 0").select("c_custkey", F.lit("below zero").alias("reason"), F.col("c_mktsegment").alias("note")),
             "rich": c.filter("c_acctbal > 9000").select("c_custkey", F.lit("above 9000").alias("reason"), F.col("c_mktsegment").alias("note"))}
    return C.exclusions_lookup(c.select("c_custkey"), "c_custkey", lists)


@query("failure_categories", "P12", """with x as (select case event_type when 'error' then 'fetch' when 'view' then 'flatten' else 'fold' end as stage,
case when value < 1 then 'LookupError' when value < 20 then 'ValueError' else 'OSError' end as kind,
case when json_extract_string(props, '$.k')::int < 50 then 'invalid period 3' else 'too few usable cadences' end as msg from events)
select case when stage = 'fetch' then case when kind = 'LookupError' then 'api: no light curve found' else 'api fetch failure' end
when kind = 'ValueError' and regexp_matches(msg, 'invalid (period|epoch|duration)') then 'missing/invalid ephemeris'
when stage = 'flatten' then case when contains(msg, 'usable cadences') then 'insufficient data after masking' else 'flatten failure ('||kind||')' end
else 'other ('||kind||')' end as category, count(*) as rows from x group by 1""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    e = t.events.select(F.when(F.col("event_type") == "error", "fetch").when(F.col("event_type") == "view", "flatten").otherwise("fold").alias("stage"),
                        F.when(F.col("value") < 1, "LookupError").when(F.col("value") < 20, "ValueError").otherwise("OSError").alias("kind"),
                        F.when(k < 50, "invalid period 3").otherwise("too few usable cadences").alias("msg"))
    return e.groupBy(C.classify_failure("stage", "msg", "kind").alias("category")).agg(F.count("*").alias("rows"))


@query("error_buckets", "P13", """with c as (select quantile_cont(value, 0.75) as cut from events), x as (select value, case when event_type <> 'signup' then value / 2 end as snr from events)
select case when snr is null then 'unknown' when snr < 7.1 then 'below detection' when value > cut then 'noise-dominated' else 'genuine miss' end as bucket, count(*) as rows
from x, c group by 1""")
def _(t):
    cut = quantiles(t.events, [], {"cut": ("value", 0.75)}).select("cut").scalar()
    e = t.events.select("value", F.when(F.col("event_type") != "signup", F.col("value") / 2).alias("snr"))
    return e.groupBy(C.error_bucket("snr", "value", cut).alias("bucket")).agg(F.count("*").alias("rows"))


@query("suffix_matched_files", "P14", """with p as (select page_id, url, split_part(url, '/', -1) as base from pages),
f as (select distinct 'survey_'||lower(base) as file from p)
select page_id, base, count(file) as n_matches, min(file) as file from p left join f on file = lower(base) or ends_with(file, '_'||lower(base)) group by page_id, base""")
def _(t):
    p = t.pages.select("page_id", F.element_at(F.split("url", "/"), -1).alias("base"))
    f = p.select(F.concat(F.lit("survey_"), F.lower("base")).alias("file")).distinct()
    low = p.withColumn("key", F.lower("base"))
    got = C.match_by_suffix(low, f, "key", "file", check=False)
    return got.select("page_id", "base", "n_matches", "file")


@query("mode_from_text", "P15", """select mode, count(*) as rows from (select case when contains(text, 'the') then case when n_chars / 100.0 > 9 then 'MIRI_LRS' end
when contains(text, 'ing') then 'NIRISS_SOSS' when contains(text, 'la') then case when doc_id % 3 < 1.2 and n_chars / 100.0 > 4.5 then 'NIRSpec_PRISM'
when doc_id % 3 > 2.5 and n_chars / 100.0 > 4.5 then 'NIRSpec_G395' end end as mode from documents) group by 1""")
def _(t):
    has = lambda s: F.col("text").contains(s)
    inst = F.when(has("the"), "MIRI").when(has("ing"), "NIRISS").when(has("la"), "NIRSpec").otherwise("none")
    mode = C.infer_mode(inst, F.col("doc_id") % 3, F.col("n_chars") / 100.0)
    return t.documents.groupBy(mode.alias("mode")).agg(F.count("*").alias("rows"))


@query("artefact_rows", "P16", """with x as (select l_quantity as a, l_extendedprice as b, l_tax as c, l_discount as d from lineitem
union all select 0, 0, 0, 0 from lineitem where l_tax = 0 union all select null, null, l_tax, null from lineitem where l_tax = 0.01
union all select l_quantity, null, l_tax, null from lineitem where l_tax = 0.02)
select case when a is null and b is null then 'all null' when coalesce(a,1) = 0 and coalesce(b,1) = 0 and coalesce(c,0) = 0 and coalesce(d,0) = 0 then 'all zero'
when a is null or b is null then 'partial' end as artefact, count(*) as rows from x group by 1""")
def _(t):
    li = t.lineitem.select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_tax").alias("c"), F.col("l_discount").alias("d"))
    zero, null = F.lit(0.0), F.lit(None).cast("double")
    fault = F.array(F.struct("a", "b", "c", "d"),
                    F.when(F.col("c") == 0, F.struct(zero.alias("a"), zero.alias("b"), zero.alias("c"), zero.alias("d")))
                    .when(F.col("c") == 0.01, F.struct(null.alias("a"), null.alias("b"), F.col("c"), null.alias("d")))
                    .when(F.col("c") == 0.02, F.struct(F.col("a"), null.alias("b"), F.col("c"), null.alias("d"))))
    rows = li.select(F.explode(F.filter(fault, lambda s: s.isNotNull())).alias("s")).select("s.*")
    return rows.groupBy(artefact_kind("a", "b", "c", "d").alias("artefact")).agg(F.count("*").alias("rows"))


def _feature_sql():
    rules = {"l_orderkey": "identifier", "l_partkey": "identifier", "l_suppkey": "identifier", "l_linenumber": None, "l_quantity": None,
             "l_extendedprice": "review list", "l_discount": None, "l_tax": None, "l_returnflag": "verdict column",
             "l_linestatus": "verdict column", "l_shipdate": "not numeric"}
    return " union all ".join(
        f"select '{c}' as \"column\", min({c}) = max({c}) as constant, " + (f"'{r}'" if r else
        f"case when min({c}) = max({c}) then 'constant in train' else 'used' end") + " as reason from lineitem where l_linestatus = 'F'"
        for c, r in rules.items())


@query("feature_selection", "P17", _feature_sql())
def _(t):
    return C.select_features(t.lineitem, F.col("l_linestatus") == "F", "(flag|status)$", ["l_extendedprice"], ["l_orderkey", "l_partkey", "l_suppkey"])


@query("log_axis_columns", "P19", """select "column", lo > 0 and hi / lo >= 100 as log_scale from (
select 'value' as "column", min(value) as lo, max(value) as hi from events union all select 'o_totalprice', min(o_totalprice), max(o_totalprice) from orders
union all select 'l_quantity', min(l_quantity), max(l_quantity) from lineitem union all select 'c_acctbal', min(c_acctbal), max(c_acctbal) from customer)""")
def _(t):
    def one(df, c):
        lo, hi = F.min(c), F.max(c)
        return df.agg(((lo > 0) & F.coalesce(hi / F.when(lo > 0, lo) >= 100, F.lit(False))).alias("log_scale")).select(F.lit(c).alias("column"), "log_scale")
    return one(t.events, "value").unionByName(one(t.orders, "o_totalprice")).unionByName(one(t.lineitem, "l_quantity")).unionByName(one(t.customer, "c_acctbal"))


@query("call_status", "P22", """with f as (select l_orderkey, bool_or(l_returnflag = 'R') as seen, bool_and(l_linestatus = 'O') as pending from lineitem group by 1)
select o_orderkey, case when o_orderpriority = '3-MEDIUM' then 'ambiguous' when seen is null or pending then 'open'
when (o_orderstatus = 'F') = seen then 'hit' else 'miss' end as status from orders left join f on l_orderkey = o_orderkey""")
def _(t):
    seen = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("seen"), F.bool_and(F.col("l_linestatus") == "O").alias("pending"))
    j = salted_join(t.orders, seen, ["o_orderkey"], "left")
    call = F.when(F.col("o_orderpriority") == "3-MEDIUM", "ambiguous").when(F.col("o_orderstatus") == "F", "present").otherwise("absent")
    from surveyframe.operators.screens import call_status
    return j.select("o_orderkey", call_status(call, F.when(~F.col("pending"), F.col("seen"))).alias("status"))


@query("row_sum_flags", "P25", """select count(*) as rows, count(*) filter (where abs(l_discount + l_tax + 0.9 - 1) > 0.02) as off_by_more from lineitem""")
def _(t):
    df = t.lineitem.withColumn("rest", F.lit(0.9))
    return df.agg(F.count("*").alias("rows"), F.count_if(C.sum_check(["l_discount", "l_tax", "rest"], 0.02)).alias("off_by_more"))


@query("usable_inputs", "P26", """with d as (select source, lang, case when n_chars < 100 then 'unreadable' when not contains(text, 'e') then 'no data on the grid'
when not contains(text, 'the') then 'band not covered' end as reason from documents)
select source, coalesce(reason, 'used') as reason, reason is null as used, count(*) as rows from d group by all""")
def _(t):
    from surveyframe.operators.screens import usable_inputs
    rules = {"unreadable": F.col("n_chars") < 100, "no data on the grid": ~F.col("text").contains("e"), "band not covered": ~F.col("text").contains("the")}
    got = usable_inputs({"": t.documents.select("source", "text", "n_chars")}, rules, tag=None)
    return got.groupBy("source", "reason", "used").agg(F.count("*").alias("rows"))


@query("soft_labels", "P27", """select o_orderkey, case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 1.0::double when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' then 0.8::double
when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then 0.2::double when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 0.0::double end as soft from orders""")
def _(t):
    table = {("F", "1-URGENT"): 1.0, ("F", "2-HIGH"): 0.8, ("O", "1-URGENT"): 0.2, ("P", "5-LOW"): 0.0}
    from surveyframe.operators.screens import soft_label
    return t.orders.select("o_orderkey", soft_label("o_orderstatus", "o_orderpriority", table).alias("soft"))


@query("input_frame", "P28", """with x as (select *, row_number() over (partition by c_nationkey order by (case when c_acctbal > 0 then 1 else 0 end + case when c_mktsegment <> 'BUILDING' then 1 else 0 end) desc, c_custkey) as rn from customer)
select c_nationkey, regexp_replace(c_name, '[^0-9]', '', 'g')::bigint as id, c_acctbal, 1.0::double as weight from x where rn = 1 and c_acctbal > 0""")
def _(t):
    from surveyframe.operators.screens import input_frame
    c = t.customer.withColumn("bal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).withColumn(
        "seg", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    got = input_frame(c, "c_nationkey", ["bal", "seg"], "c_custkey", ["bal"], "c_name", {"weight": 1.0})
    return got.select("c_nationkey", F.col("id"), F.col("bal").alias("c_acctbal"), "weight")


# ---- ordered deduplication -------------------------------------------------------------------------

_CORE = "(o_totalprice > 150000)"
_YEAR = "case when o_orderpriority <> '4-NOT SPECIFIED' then year(o_orderdate) end"
_FILLED = "(length(o_orderpriority) % 3)"


@query("ordered_dedup", "W01", f"""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey
order by {_CORE} desc, coalesce({_YEAR}, -1) desc, {_FILLED} desc, o_orderkey) as rn from orders) where rn = 1""")
def _(t):
    return C.ordered_dedup(t.orders, "o_custkey", F.expr(_CORE), F.expr(_YEAR), F.expr(_FILLED), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("tie_break_stages", "W02", f"""with r as (select o_custkey, {_CORE}::int as c, coalesce({_YEAR}, -1) as y, {_FILLED} as f from orders),
b as (select *, max(c) over (partition by o_custkey) as bc, count(*) over (partition by o_custkey) as n from r),
b1 as (select *, max(y) over (partition by o_custkey) as by_, count(*) over (partition by o_custkey) as n1 from b where c = bc and n > 1),
b2 as (select *, max(f) over (partition by o_custkey) as bf, count(*) over (partition by o_custkey) as n2 from b1 where y = by_),
b3 as (select *, count(*) over (partition by o_custkey) as n3 from b2 where f = bf),
d as (select distinct o_custkey, n1, n2, n3 from b3)
select stage, count(*) filter (where s = stage) as keys_decided from (select case when n1 = 1 then 'core' when n2 = 1 then 'year' when n3 = 1 then 'filled' else 'row' end as s from d),
(values ('core'), ('year'), ('filled'), ('row')) v(stage) group by stage""")
def _(t):
    return C.tie_break_report(t.orders, "o_custkey", F.expr(_CORE), F.expr(_YEAR), F.expr(_FILLED))


@query("most_complete_row", "W03", """select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey order by
(case when l_discount > 0 then 1 else 0 end + case when l_tax > 0 then 1 else 0 end) desc, l_linenumber, l_partkey, l_suppkey) as rn from lineitem) where rn = 1""")
def _(t):
    li = t.lineitem.withColumn("d", F.when(F.col("l_discount") > 0, 1)).withColumn("x", F.when(F.col("l_tax") > 0, 1))
    got = top_rows(li, ["l_orderkey"], [C.filled_count(["d", "x"]).desc(), F.col("l_linenumber").asc(), F.col("l_partkey").asc(), F.col("l_suppkey").asc()])
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("first_value_set", "W04", """select o_custkey, o_totalprice, case when d then 'catalogue' else 'other set' end as o_totalprice_source from (select *, o_orderstatus = 'F' as d,
row_number() over (partition by o_custkey order by (o_orderstatus = 'F') desc, o_orderdate desc, o_orderkey) as rn from orders) where rn = 1""")
def _(t):
    return C.first_value_set(t.orders, "o_custkey", "o_totalprice", F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey")


@query("latest_record", "W05", """select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def _(t):
    return C.latest_record(t.events, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


# ---- sorts, top-k, samples -------------------------------------------------------------------------

@query("nulls_last_sort", "T01", """select row_number() over (order by o_totalprice desc nulls last, n_nationkey) as pos, n_nationkey, o_totalprice from (
select n_nationkey, max(case when c_acctbal > 9500 then o_totalprice end) as o_totalprice from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1)""")
def _(t):
    from surveyframe.operators.ranking import sorted_positions
    c = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 9500).alias("rich"))
    j = t.nation.join(c, "n_nationkey", "left").join(t.orders, "o_custkey", "left")
    return sorted_positions(j.groupBy("n_nationkey").agg(F.max(F.when(F.col("rich"), F.col("o_totalprice"))).alias("o_totalprice")),
                            [F.col("o_totalprice").desc_nulls_last(), F.col("n_nationkey").asc()], "pos")


@query("top_k_with_threshold", "T02", """with k as (select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25)
select *, (select min(o_totalprice) from k) as threshold from k""")
def _(t):
    from surveyframe.operators.ranking import top_k
    return top_k(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


_U = sql_uniform("o_orderkey::varchar||'|11'")


@query("stratified_sample", "T03", f"""select o_orderkey, o_orderstatus, o_orderpriority from (select *, row_number() over (partition by o_orderstatus, o_orderpriority
order by {_U}, o_orderkey) as rn from orders) where rn <= 20""")
def _(t):
    return C.stratified_sample(t.orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 20, 11).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("seeded_sample", "T04", f"select o_orderkey from orders order by {_U}, o_orderkey limit 500")
def _(t):
    return C.hashed_sample(t.orders.select("o_orderkey"), "o_orderkey", 500, 11).select("o_orderkey")


@query("quota_sample", "T04", f"""select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by {_U}, o_orderkey) as rn,
floor(count(*) over (partition by o_orderstatus) * 0.1::double) as q from orders) where rn <= q""")
def _(t):
    return C.quota_sample(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 0.1, 11).select("o_orderkey", "o_orderstatus")


@query("round_robin_picks", "T05", """with r as (select o_orderkey, o_orderstatus, o_orderpriority, row_number() over (partition by o_orderstatus, o_orderpriority order by o_totalprice desc, o_orderkey) as turn from orders)
select o_orderkey, o_orderstatus, o_orderpriority, pick from (select *, row_number() over (partition by o_orderstatus order by turn, o_orderpriority) as pick from r) where pick <= 12""")
def _(t):
    return C.round_robin(t.orders, "o_orderstatus", "o_orderpriority", F.col("o_totalprice"), "o_orderkey", 12).select("o_orderkey", "o_orderstatus", "o_orderpriority", "pick")


@query("shortlist", "T06", """with s as (select doc_id, """ + sql_uniform("doc_id::varchar||'|1'") + """ as p1, """ + sql_uniform("doc_id::varchar||'|2'") + """ as p2 from labels)
select row_number() over (order by p1 * p2 desc, doc_id) as pos, doc_id, round(p1 * p2, 6) as product from s where p1 >= 0.5 and p2 >= 0.3""")
def _(t):
    from surveyframe.operators.ranking import shortlist
    s = t.labels.select("doc_id", uniform("doc_id", 1).alias("p1"), uniform("doc_id", 2).alias("p2"))
    return shortlist(s, {"p1": 0.5, "p2": 0.3}, "doc_id").select("pos", "doc_id", F.round("product", 6).alias("product"))


# ---- text ------------------------------------------------------------------------------------------

@query("latest_year_in_text", "F13", r"""select doc_id, list_max(list_transform(regexp_extract_all(text, '\b(1[89][0-9]{2}|20[0-9]{2})\b', 1), lambda y: y::int)) as year from documents""")
def _(t):
    return t.documents.select("doc_id", X.reference_year("text").alias("year"))


@query("latest_year_in_pages", "F13", r"""select page_id, list_max(list_transform(regexp_extract_all(html, '\b(1[89][0-9]{2}|20[0-9]{2})\b', 1), lambda y: y::int)) as year from pages""")
def _(t):
    return t.pages.select("page_id", X.reference_year("html").alias("year"))


@query("name_keys", "F14", r"""select c_custkey, regexp_replace(lower(regexp_replace(regexp_replace(trim(n), '\s+A\s*([b-h])$', ' \1'), 'A([b-h])$', ' \1')), '[^a-z0-9]', '', 'g') as key,
regexp_replace(n, ' [^ ]*$', '') as host, regexp_replace(n, '[^A-Za-z0-9.]+', '_', 'g') as safe
from (select c_custkey, c_mktsegment||'-'||c_nationkey||' A'||substr('bcdefgh', (c_custkey % 7 + 1)::int, 1) as n from customer)""")
def _(t):
    n = F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"), F.lit(" A"), F.substring(F.lit("bcdefgh"), F.col("c_custkey") % 7 + 1, F.lit(1)))
    return t.customer.withColumn("n", n).select("c_custkey", X.name_key("n").alias("key"), X.host_of("n").alias("host"), C.safe_name("n").alias("safe"))


@query("paper_links", "F15", r"""select page_id, case when x <> '' then 'https://arxiv.org/abs/'||x else '' end as link from (
select page_id, regexp_extract(s, '(?:arXiv:|\()([0-9]{4}\.[0-9]{4,5})', 1) as x from (
select page_id, case when page_id % 2 = 0 then 'see arXiv:'||lpad(page_id::varchar, 4, '2')||'.'||(10000 + page_id) else url end as s from pages))""")
def _(t):
    s = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("see arXiv:"), F.lpad(F.col("page_id").cast("string"), 4, "2"), F.lit("."), (F.col("page_id") + 10000).cast("string"))).otherwise(F.col("url"))
    return t.pages.select("page_id", X.paper_link(s).alias("link"))


def _evidence_sql(table, key, text):
    return rf"""with s as (select {key}, list_filter(string_split(regexp_replace(regexp_replace({text}, '\s+', ' ', 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)),
lambda x: regexp_matches(x, '(?i)(the|la|der)') and length(x) > 30 and length(x) < 500) as l from {table}),
c as (select {key}, len(l)::bigint as n_sentences,
len(list_filter(l, lambda x: regexp_matches(x, '(?i)(tion|ment|lich)') and not regexp_matches(x, '(?i)(not|un|ne )') and not regexp_matches(x, '(?i)(ing|eau)')))::bigint as n_pos,
len(list_filter(l, lambda x: regexp_matches(x, '(?i)(not|un|ne )')))::bigint as n_neg, len(list_filter(l, lambda x: regexp_matches(x, '(?i)(ing|eau)')))::bigint as n_tentative,
coalesce(array_to_string(list_filter(string_split_regex(list_max(list_transform(l, lambda x, i: {{'score': regexp_matches(x, '(?:(?i)(tion|ment|lich))|(?:(?i)(not|un|ne ))')::int + regexp_matches(x, '\d\s*[-]?\s*(?:σ|sigma)|ppm')::int, 'at': -i, 's': x}})).s, '\s+'), lambda x: x <> '')[1:25], ' '), '') as snippet from s)
select *, case when n_pos >= 3 and n_pos >= 2 * greatest(n_neg, 1) then '1' when n_neg >= 2 and n_neg >= n_pos then '0' else 'unclear' end as rule_label from c"""


_STRIP_SQL = r"""regexp_replace(regexp_replace(html,
'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<annotation[^>]*>.*?</annotation>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"""
for _entity, _char in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}.items():      # those in the pages
    _STRIP_SQL = f"replace({_STRIP_SQL}, '{_entity}', '{_char}')"
_STRIP_SQL = rf"regexp_replace(regexp_replace({_STRIP_SQL}, '&amp;?', '&', 'g'), '\s+', ' ', 'g')"


def _evidence(df, key, text):
    e = X.evidence(text, "(?i)(the|la|der)", "(?i)(tion|ment|lich)", "(?i)(not|un|ne )", "(?i)(ing|eau)")
    got = df.select(key, e.alias("e")).select(key, "e.*")
    return got.withColumn("rule_label", X.evidence_label("n_pos", "n_neg"))


@query("evidence_sentences", "F16", _evidence_sql("documents", "doc_id", "text"))
def _(t):
    return _evidence(t.documents, "doc_id", F.col("text"))


@query("evidence_in_pages", "F16", _evidence_sql("pages", "page_id", _STRIP_SQL))
def _(t):
    return _evidence(t.pages, "page_id", X.strip_html("html"))
