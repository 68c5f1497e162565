"""URL filters by a path-template tree, in DataFrame functions only.

A url's host and path give a branch of a tree per host.  Segments that look like values (numbers, hex strings, uuids,
dates, very long words) become wildcards by form; then, level by level from the root, the children of a node become one
wildcard where they are many and mostly seen once, or where their labelled shares of bad pages do not differ
(two-proportion test against the pooled share).  A branch goes down as deep as its path until nothing else shares its
node.  What is left is a small table of templates per host, on which all of
this runs; pages meet it once, spread over SALTS tasks per template.

A template's purity is its share of bad labels, smoothed towards its host's, which is smoothed towards all pages'; a
template is blocked above BLOCK_ABOVE.  Rules on (host, path prefix) go before: the one with the longest host and path
that fits decides.

A page is bad when its label has quality 0 or toxic 1.  Defined cases: NULL urls and urls without "://" have an empty
host and path and the template of the empty host; missing labels count in no purity; of several labels of a page any bad
one makes it bad; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, stored

SALTS = 16
MANY_CHILDREN, ROWS_PER_CHILD = 8, 3
DIFFER_Z, PRIOR, BLOCK_ABOVE = 1.96, 8.0, 0.5
#: Rules of the contract: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Forms of segments that stand for values, in the order they are tried.
FORMS = [("{uuid}", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), ("{date}", r"^\d{4}-\d{2}-\d{2}$"), ("{num}", r"^\d+$"),
         ("{num}.html", r"^\d+\.html?$"), ("{hex}", r"^[0-9a-fA-F]{8,}$"), ("{long}", r"^.{40,}$")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.when(has, F.substring_index(url, "://", 1)).otherwise(F.lit(""))
    after = F.when(has, url.substr(F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    tail = after.substr(F.length(host) + 1, F.length(after))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(tail, r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """host + path of the longest rule that fits, else NULL; a rule fits its host and all subdomains."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, h, p in rules:
        out = F.when(rule == h + p, F.lit(verdict)).otherwise(out)
    return out


def form_template(path: Column) -> Column:
    """Segments of a path with values replaced by their form."""

    def form(x: Column) -> Column:
        out = x
        for name, pattern in reversed(FORMS):
            out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, form)


def _generalise(t: DataFrame, depth: int) -> DataFrame:
    """One level of the tree: segment number `depth` of `made` becomes "{any}" where its siblings are to be merged.

    t: host, made (segments so far), n, labelled, bad, forms (the table's key).
    """
    seg = F.get("made", F.lit(depth))
    deep = F.size("made") > depth
    stem = F.array_join(F.slice("made", 1, depth), "/") if depth else F.lit("")
    t = t.withColumn("stem", stem).withColumn("seg", F.when(deep, seg))
    kids = t.filter(F.col("seg").isNotNull()).groupBy("host", "stem", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    nodes = kids.groupBy("host", "stem").agg(F.count("*").alias("kids"), F.sum("n").alias("rows"), F.sum("l").alias("ls"), F.sum("b").alias("bs"))
    k = kids.join(nodes, ["host", "stem"])
    pooled = F.col("bs") / F.greatest("ls", F.lit(1))
    spread = F.sqrt(pooled * (1 - pooled) / F.greatest("l", F.lit(1)))
    alike = F.abs(F.col("b") - F.col("l") * pooled) <= F.lit(DIFFER_Z) * spread * F.col("l")
    thin = (F.col("kids") >= MANY_CHILDREN) & (F.col("rows") < ROWS_PER_CHILD * F.col("kids"))
    merge = k.filter(F.col("seg").rlike(r"^\{") == F.lit(False)).filter(thin | ((F.col("kids") > 1) & alike)).select("host", "stem", "seg", F.lit(True).alias("merge"))
    out = t.join(merge, ["host", "stem", "seg"], "left")
    changed = F.concat(F.slice("made", 1, depth) if depth else F.array().cast("array<string>"), F.array(F.lit("{any}")), F.slice("made", F.lit(depth + 2), F.greatest(F.size("made") - depth - 1, F.lit(0))))
    return out.withColumn("made", F.when(F.col("merge"), changed).otherwise(F.col("made"))).drop("stem", "seg", "merge")


def template_tree(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, forms, template, purity: the template and smoothed share of bad pages of every branch by form.

    pages: page_id, host, forms.
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(bad).alias("is_bad"))
    seen = pages.join(known, pages["page_id"] == known["doc_id"], "left")
    t = seen.groupBy("host", "forms").agg(F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    live, done, depth = stored(t.withColumn("made", F.split("forms", "/"))), None, 0
    while not live.isEmpty():       # a branch is done where its path ends or nothing else shares its node
        t = _generalise(live, depth).withColumn("_node", F.array_join(F.slice("made", 1, depth + 1), "/"))
        alone = t.groupBy("host", "_node").agg(F.count("*").alias("_branches")).withColumnRenamed("host", "_host").withColumnRenamed("_node", "_key")
        t = stored(t.join(alone, (F.col("host") == F.col("_host")) & (F.col("_node") == F.col("_key"))).withColumn("_done", (F.size("made") <= depth + 1) | (F.col("_branches") == 1)))
        ended = t.filter("_done").drop("_node", "_host", "_key", "_branches", "_done")
        done = ended if done is None else done.unionByName(ended)
        live, depth = t.filter("not _done").drop("_node", "_host", "_key", "_branches", "_done"), depth + 1
    t = (live if done is None else done).withColumn("template", F.array_join("made", "/"))
    one = t.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    hosts = one.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    every = hosts.agg(F.struct(F.coalesce(F.sum("hl"), F.lit(0)).alias("l"), F.coalesce(F.sum("hb"), F.lit(0)).alias("b")).alias("s")).scalar()
    share = (every["b"] + 1) / (every["l"] + 2)
    host_share = (F.col("hb") + PRIOR * share) / (F.col("hl") + PRIOR)
    purity = (F.col("b") + PRIOR * host_share) / (F.col("l") + PRIOR)
    rated = one.join(hosts, "host").select("host", "template", purity.alias("purity"))
    return t.select("host", "forms", "template").join(rated, ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, template, purity, verdict of every page."""
    host, path = host_and_path(F.col("url"))
    p = need(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("forms", F.array_join(form_template(F.col("path")), "/"))
    tree = template_tree(p, labels).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") > BLOCK_ABOVE, "block").otherwise("allow")
    out = p.join(tree, ["host", "forms", "salt"], "left").withColumn("rule", rule)
    return out.select("page_id", "host", "path", "rule", "template", "purity", F.coalesce(verdict_of(F.col("rule"), rules), own).alias("verdict"))
