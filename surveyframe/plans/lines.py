"""Line and file-list sources on lines made from the given tables, so that their parsers have SQL twins."""

from pyspark.sql import functions as F

from surveyframe.plans.registry import query
from surveyframe.sources import registry as R
from surveyframe.sources import text as X


def _lines(df, file, seq, line):
    return df.select(file.alias("file"), F.lit(0).cast("bigint").alias("block"), seq.cast("bigint").alias("seq"), line.alias("line"))


def _header(body, *lines):
    """The same leading lines for every file of the body; the body's own seq is not negative.

    A body line's text is made once, as a file would hold it: a generator keeps the readers' filters from writing it again.
    """
    at = F.array(*[F.struct(F.lit(i - len(lines)).cast("bigint").alias("seq"), F.lit(x).alias("line")) for i, x in enumerate(lines)])
    heads = body.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("block"), F.explode(at).alias("h"))
    body = body.select("file", "block", "seq", F.explode(F.array("line")).alias("line"))
    return body.unionByName(heads.select("file", "block", "h.seq", "h.line"))


def _item_lines(t, line):
    """A line per line item, dealt over seven files."""
    return _lines(t.lineitem, F.concat(F.lit("t"), F.col("l_suppkey") % 7), F.col("l_orderkey") * 10 + F.col("l_linenumber"), line)


@query("fixed_width_lines", "S06", """select 't'||(l_suppkey % 7) as file, l_orderkey as target, l_linenumber::integer as planet, case when l_returnflag <> 'N' then round(l_extendedprice, 2) end as period,
l_linestatus as mode from lineitem""")
def _(t):
    """Fixed columns after a dashed line; text where a number belongs gives NULL."""
    price = F.when(F.col("l_returnflag") != "N", F.format_string("%12.2f", F.col("l_extendedprice").cast("double"))).otherwise(F.lit("    no value"))
    line = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, " "), F.lpad(F.col("l_linenumber").cast("string"), 4, " "), price, F.lit("  "), F.col("l_linestatus"))
    lines = _header(_item_lines(t, line), "title", "-----", "note 5 5 5", "---------")
    got = X.fixed_width(lines, [(0, 12, "target", "bigint"), (12, 16, "planet", "int"), (16, 28, "period", "double"), (30, 45, "mode", "string")])
    return got


@query("point_table_lines", "S08", """select 't'||(l_suppkey % 7) as file, round(l_quantity / 7.0::double, 6) as wl, round(l_discount * 1e4::double, 6) as depth_ppm, round(l_tax * 1e4::double, 6) as err_ppm from lineitem""")
def _(t):
    """Columns picked by position, percent to ppm, comments after '#'."""
    n = lambda c: F.col(c).cast("double").cast("string")
    line = F.concat_ws(",", n("l_tax"), F.lit("skip"), n("l_discount"), (F.col("l_quantity").cast("double") / 7).cast("string"))
    lines = _header(_item_lines(t, F.concat(line, F.lit("  # late"))), "# tax,x,depth,wl", "")
    got = X.point_table(lines, (3, 2, 0), "percent", ",")
    return got.select("file", *[F.round(c, 6).alias(c) for c in ("wl", "depth_ppm", "err_ppm")])


@query("archive_spectrum_report", "S05", """with x as (select 't'||(l_suppkey % 7) as file, case when l_linenumber = 4 then null when l_linenumber = 5 then 0 else l_quantity::double end as w,
case when l_linenumber in (3, 4) then null when l_linenumber = 5 then 0 else l_discount::double end as d, case when l_linenumber = 5 then 0 else l_tax::double end as e from lineitem),
k as (select *, case when w is null and d is null then 'all null' when coalesce(w, 1) = 0 and coalesce(d, 1) = 0 and coalesce(e, 0) = 0 then 'all zero' when w is null or d is null then 'partial' end as kind from x)
select file, count(*) as rows_raw, count(*) filter (where kind = 'all null') as all_null, count(*) filter (where kind = 'all zero') as all_zero, count(*) filter (where kind = 'partial') as partial,
count(*) filter (where kind is null) as rows_kept, true as own_depth, round(sum(case when kind is null then d end) * 1e4, 3) as depth_sum, round(sum(case when kind is null then e end) * 1e4, 3) as err_sum from k group by 1""")
def _(t):
    """Column-headed archive lines: artefact rows counted, depths in ppm, errors as the mean of both sides."""
    width, line = 16, F.col("l_linenumber")
    cell = lambda c, empty: F.rpad(F.when(line == 5, F.lit("0")).when(empty, F.lit("")).otherwise(F.col(c).cast("double").cast("string")), width, " ")
    body = F.concat(F.lit(" "), cell("l_quantity", line == 4), F.lit(" "), cell("l_discount", line.isin(3, 4)), F.lit(" "), cell("l_tax", F.lit(False)), F.lit(" "), cell("l_tax", F.lit(False)))
    row = lambda cells: "|" + "|".join(c.ljust(width) for c in cells) + "|"
    head = ["\\KEY = 'value'", row(["CENTRALWAVELNG", "PL_TRANDEP", "PL_TRANDEPERR1", "PL_TRANDEPERR2"]), row(["double"] * 4), row(["microns", "%", "%", "%"]), row(["null"] * 4)]
    points, report = X.archive_spectra(_header(_item_lines(t, body), *head))
    sums = points.groupBy("file").agg(F.round(F.sum("depth_ppm"), 3).alias("depth_sum"), F.round(F.sum("err_ppm"), 3).alias("err_sum"))
    return report.join(sums, "file")


@query("registry_rules", "S03", """with r as (select 'd/'||p_type||case when p_size > 3 then '/'||p_brand else '' end||case when p_size > 5 then '/'||p_partkey else '' end as path,
case when p_size % 9 = 4 then 'derived' else 'source' end as role, case when p_partkey % 50 = 0 then ' ' else 'archive' end as provenance from part),
folders as (select path, role, unnest(list_transform(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as folder from r)
select path, 'in two roles' as problem from r group by path having count(distinct role) > 1
union select f.path, 'inside another role''s folder' from folders f join r o on f.folder = o.path and o.role <> f.role where f.folder <> f.path
union select path, 'no provenance' from r where trim(coalesce(provenance, '')) = ''""")
def _(t):
    """Violations of a registry made of parts: two roles, nested roles, no provenance."""
    path = F.concat(F.lit("d/"), "p_type", F.when(F.col("p_size") > 3, F.concat(F.lit("/"), "p_brand")).otherwise(""), F.when(F.col("p_size") > 5, F.concat(F.lit("/"), F.col("p_partkey").cast("string"))).otherwise(""))
    reg = t.part.select(path.alias("path"), F.when(F.col("p_size") % 9 == 4, "derived").otherwise("source").alias("role"), F.when(F.col("p_partkey") % 50 == 0, " ").otherwise("archive").alias("provenance"))
    return R.registry_problems(reg)


@query("file_index_paths", "S16", """select n_name as mission, c_custkey as id, 'views/'||c_nationkey||'/'||case when c_custkey % 3 = 0 then 'obj_'||c_custkey||'.npz' else lower(c_name) end as path
from customer join nation on c_nationkey = n_nationkey""")
def _(t):
    """(mission, id) to path; blank file names are rebuilt from the id."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("c_custkey") % 3 != 0, F.lower("c_name"))
    made = F.concat(F.lit("obj_"), F.col("c_custkey").cast("string"), F.lit(".npz"))
    manifest = c.select(F.col("n_name").alias("mission"), F.col("c_custkey").alias("id"), own.alias("file"))
    listing = c.select(F.coalesce(own, made).alias("file"), F.concat(F.lit("views/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.coalesce(own, made)).alias("path"))
    return R.file_index(manifest, listing, "obj_%d.npz")
