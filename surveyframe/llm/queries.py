"""One registered query per operator, over its whole table, and the SQL twins that exist."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosted_quality, collocations, decontamination, order_minhash, perspectives, piece_codec, pivotal_mixing, quality_rules, run_length_index, token_counts, toxicity, url_templates, vector_codes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item found in a document, with its word edits."""
    return decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_verdicts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.array_join("failed_rules", " ").alias("failed_rules"))


def op4_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_templates.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))
    return out.withColumn("purity", F.round("purity", 6))


def _op4_sql(levels: int = 7) -> str:
    """For paths of up to `levels` segments; the given ones have two."""
    u = url_templates
    form = "".join(f"when regexp_matches(x, '{pattern}') then '{name}' " for name, pattern in u.FORMS)
    fits = [(v, h, p, f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')") for v, h, p in sorted(u.RULES, key=lambda r: (len(r[1] + r[2]), r[1:]), reverse=True)]
    rule = "case " + " ".join(f"when {c} then '{h}{p}'" for _, h, p, c in fits) + " end"
    verdict = "case rule " + " ".join(f"when '{h}{p}' then '{v}'" for v, h, p, _ in fits) + " end"
    steps = []
    for d in range(levels):
        steps.append(f"""
s{d} as (select *, array_to_string(made[1:{d}], '/') as stem, case when len(made) > {d} then made[{d + 1}] end as seg from t{d}),
k{d} as (select host, stem, seg, sum(n) as n, sum(labelled) as l, sum(bad) as b from s{d} where seg is not null group by host, stem, seg),
v{d} as (select *, count(*) over w as kids, sum(n) over w as nrows, sum(b) over w / greatest(sum(l) over w, 1)::double as pooled from k{d} window w as (partition by host, stem)),
m{d} as (select host, stem, seg from v{d} where not starts_with(seg, '{{')
         and ((kids >= {u.MANY_CHILDREN} and nrows < {u.ROWS_PER_CHILD} * kids)
              or (kids > 1 and abs(b - l * pooled) <= {u.DIFFER_Z}::double * sqrt(pooled * (1 - pooled) / greatest(l, 1)) * l))),
t{d + 1} as (select host, forms, case when m{d}.seg is not null then list_concat(list_concat(made[1:{d}], ['{{any}}']), made[{d + 2}:]) else made end as made, n, labelled, bad
          from s{d} left join m{d} using (host, stem, seg))""")
    return f"""
with u as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) as path from h),
f as (select page_id, host, path, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from p),
g as (select page_id, host, path, {rule} as rule,
             array_to_string(list_transform(parts, lambda x: case {form} else x end), '/') as forms from f),
lab as (select doc_id, max(case when coalesce(quality = 0, false) or coalesce(toxic = 1, false) then 1 else 0 end) as is_bad from labels
        where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
t0 as (select host, forms, string_split(forms, '/') as made, count(*) as n, count(is_bad) as labelled, coalesce(sum(is_bad), 0) as bad
       from g left join lab on g.page_id = lab.doc_id group by host, forms),
{",".join(steps)},
t as (select *, array_to_string(made, '/') as template from t{levels}),
one as (select host, template, sum(labelled) as l, sum(bad) as b from t group by host, template),
hosts as (select host, sum(l) as hl, sum(b) as hb from one group by host),
share as (select (sum(hb) + 1) / (sum(hl) + 2)::double as s from hosts),
rated as (select host, template, (b + {u.PRIOR}::double * ((hb + {u.PRIOR}::double * s) / (hl + {u.PRIOR}::double))) / (l + {u.PRIOR}::double) as purity from one join hosts using (host), share)
select page_id, host, path, rule, template, round(purity, 6) as purity,
       coalesce({verdict}, case when purity > {u.BLOCK_ABOVE} then 'block' else 'allow' end) as verdict
from g join t using (host, forms) join rated using (host, template)
"""


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return run_length_index.remove_repeats(docs).select("doc_id", *[F.col("repeats")[c].alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


OP6_SQL = """
with d as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
piece as (      -- 1,024 windows each, as substr reads its whole string
  select r, p, substr(h, 2 * p + 1, 2 * (1024 + 399)) as s, least(1024, n - 399 - p) as k
  from (select r, h, n, unnest(range(0, n - 399, 1024)) as p from d where n >= 400)),
w as (select r, p + i as i, md5(substr(s, 2 * i + 1, 800)) as m from (select r, p, s, unnest(range(k)) as i from piece)),
c as (select m from w group by m having count(*) > 1),
s as (select r, i, lag(i) over (partition by r order by i) as p from w semi join c on w.m = c.m),
g as (select r, i, sum(case when p is null or i > p + 400 then 1 else 0 end) over (partition by r order by i) as k from s),
span as (select r, k, min(i) as a, max(i) + 400 as b from g group by r, k),
gap as (
  select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as p from span),
kept as (
  select d.r, string_agg(substr(d.h, 2 * gap.p + 1, 2 * (gap.a - gap.p)), '' order by gap.a) || substr(any_value(d.h), 2 * max(gap.b) + 1) as h,
         sum(gap.b - gap.a) as gone, count(*) as n_spans
  from d join gap on d.r = gap.r group by d.r)
select d.doc_id, d.n as n_bytes, coalesce(kept.gone, 0)::bigint as n_removed, coalesce(kept.n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join kept on d.r = kept.r
"""


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's side; spans as text "start-end start-end"."""
    out = perspectives.rotate(_read(spark, sf_dir, "conversations"))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " "))


OP7_SQL = """
with t as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as body,
         cast(floor(turn / 256.0) as bigint) as part
  from conversations),
people as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
line as (
  select t.conv_id, p.perspective, t.part, t.turn, t.speaker, t.body, t.speaker = p.perspective as own,
         '<|im_start|>' || case when t.speaker = 'system' then 'system' when t.speaker = p.perspective then 'assistant'
                                else 'user name=' || t.speaker end || chr(10) as head
  from t join people p on t.conv_id is not distinct from p.conv_id),
walk as (
  select *, sum(length(head) + length(body) + 11) over w - length(body) - 11 as s,
         sum(length(head) + length(body) + 11) over w - 1 as e,
         row_number() over w as k
  from line window w as (partition by conv_id, perspective, part order by turn nulls last, speaker, body rows unbounded preceding)),
parts as (
  select conv_id, perspective, part, count(*) as n_turns, sum(own::int) as n_trained,
         sum(length(head) + length(body) + 11) as chars,
         string_agg(head || body || '<|im_end|>' || chr(10), '' order by k) as rendered,
         coalesce(string_agg(case when own then s::bigint || '-' || e::bigint end, ' ' order by k), '') as spans
  from walk group by conv_id, perspective, part)
select conv_id, perspective, part, 0::bigint as cell, n_turns::int as n_turns, n_trained::int as n_trained,
       coalesce(sum(chars) over (partition by conv_id, perspective order by part nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as char_start,
       rendered, spans
from parts
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mixing.mix(_read(spark, sf_dir, "documents"))


def op10_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


OP11_SQL = """
with p as (select coalesce(lang, 'und') as lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
           from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from p),
u as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, s, array_to_string(ws[i:i + s - 1], ' ') as phrase from u, (values (1), (2), (3)) t(s) where i + s - 1 <= len(ws)),
f as (select lang, s, phrase, count(*) as f from g group by lang, s, phrase),
total as (select lang, sum(f)::bigint as n from f where s = 1 group by lang),
cand as (select lang, s, phrase, f as a, string_split(phrase, ' ') as ws from f where s >= 2 and f >= 10),
cut as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as lp, array_to_string(ws[k + 1:], ' ') as rp
        from (select *, unnest(range(1, s)) as k from cand)),
rated as (select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score
          from cut c join f x on c.lang = x.lang and c.lp = x.phrase join f y on c.lang = y.lang and c.rp = y.phrase),
best as (select * from rated qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (select lang, array_to_string(ws[i:i + 1], ' ') as phrase, max(a) as most from (select *, unnest([1, 2]) as i from cand where s = 3) group by 1, 2),
kept as (select b.* from best b left join held h on b.lang = h.lang and b.phrase = h.phrase where coalesce(100 * h.most < 50 * b.a, true)),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from placed join total using (lang) where rank <= 2000
"""


def op12_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = vector_codes.ROUNDS) -> str:
    v = vector_codes
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} as (select x.row, x.pos, b.entry, sum((x.v - b.v) * (x.v - b.v)) as dist from x join b{i} b on x.pos = b.pos and x.dim = b.dim group by x.row, x.pos, b.entry),
a{i} as (select row, pos, entry, dist from d{i} qualify row_number() over (partition by row, pos order by dist, entry) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select a.pos, a.entry, x.dim, sum(x.v)::hugeint as s, count(*)::hugeint as c from x join a{i} a on x.row = a.row and x.pos = a.pos group by a.pos, a.entry, x.dim),
b{i + 1} as (select b.pos, b.entry, b.dim, coalesce((m.s - ((m.s % m.c) + m.c) % m.c) // m.c, b.v)::bigint as v
        from b{i} b left join m{i} m on b.pos = m.pos and b.entry = m.entry and b.dim = m.dim)""")
    return f"""
with k as (select vec_id, label, row_number() over (order by vec_id nulls last, embedding) as row, embedding, len(embedding) // {v.PARTS} as size
           from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
e as (select row, unnest(embedding) as c, unnest(range(len(embedding))) as i, size from k),
x as (select row, i // size as pos, i % size as dim, floor({v.SCALE} * c::double)::bigint as v from e),
b0 as (select pos, row - 1 as entry, dim, v from x where row <= {v.ENTRIES}),
{",".join(steps)},
book as (select sha256(string_agg(v::varchar, ',' order by pos, entry, dim)) as h from b{rounds}),
coded as (select row, string_agg(format('{{:02x}}', entry), '' order by pos) as code, sum(dist)::bigint as error from a{rounds} group by row),
lab as (select label, sum(error)::bigint as t from coded join k using (row) group by label)
select k.vec_id, code, error, t as label_error, h as codebooks_sha256
from coded join k using (row) join lab on k.label is not distinct from lab.label, book
"""


def op13_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids, of their spans and of the decoded text."""
    out = piece_codec.encode(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")), packed=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                      F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ftrl_toxicity, op2_edit_embedding, op3_risk_controlled_rules, op4_template_tree, op5_order_minhash, op6_run_length_index, op7_perspective_rotation,
                                    op8_token_counts, op9_pivotal_mixing, op10_boosted_trees, op11_misra_gries_phrases, op12_trie_codes, op13_piece_spans)}


def oracle_sql() -> dict[str, str]:
    return {"op4_template_tree": _op4_sql(), "op6_run_length_index": OP6_SQL, "op7_perspective_rotation": OP7_SQL,
            "op11_misra_gries_phrases": OP11_SQL, "op12_trie_codes": _op12_sql()}
