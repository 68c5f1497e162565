"""Names, identifiers, years and evidence sentences in text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyframe.functions.basics import col

YEAR_PATTERN = r"\b(1[89][0-9]{2}|20[0-9]{2})\b"
ARXIV_PATTERN = r"(?:arXiv:|\()([0-9]{4}\.[0-9]{4,5})"


def reference_year(text: str | Column) -> Column:
    """Latest plausible year named in a text, NULL if none."""
    years = F.regexp_extract_all(col(text), F.lit(YEAR_PATTERN), F.lit(1))
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def name_key(name: str | Column) -> Column:
    """Join key of an object name: a host-letter 'A' before the last letter is dropped, then only a-z0-9 remain."""
    n = F.trim(col(name))
    n = F.regexp_replace(n, r"\s+A\s*([b-h])$", " $1")
    n = F.regexp_replace(n, r"A([b-h])$", " $1")
    return plain_key(n)


def plain_key(name: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(name)), "[^a-z0-9]", "")


def host_of(name: str | Column) -> Column:
    """Everything before the last blank of a name."""
    return F.regexp_replace(col(name), r" [^ ]*$", "")


def paper_link(text: str | Column) -> Column:
    found = F.regexp_extract(col(text), ARXIV_PATTERN, 1)
    return F.when(found != "", F.concat(F.lit("https://arxiv.org/abs/"), found)).otherwise("")


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """All named and numeric character references decoded; Spark has no function for them."""
    return text.map(html.unescape, na_action="ignore")


INVISIBLE = ["script", "style", "annotation"]


def strip_html(page: str | Column) -> Column:
    blocks = "|".join(f"<{t}[^>]*>.*?</{t}>" for t in INVISIBLE)
    t = F.regexp_replace(col(page), f"(?is){blocks}", " ")
    t = F.regexp_replace(t, "(?s)<[^>]+>", " ")
    return F.regexp_replace(unescaped(t), r"(?U)\s+", " ")


def sentences(text: str | Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(col(text), r"\s+", " "), r"([.!?])\s+", "$1\n")
    return F.split(marked, "\n")


# Wording that counts as a positive, negative or tentative statement of a detection.
POSITIVE = (r"(?i)(?:detect(?:ed|ion|s)?|evidence (?:for|of)|significance|[3-9](?:\.\d+)?\s*[-]?\s*(?:σ|sigma)"
            r"|\d\d(?:\.\d+)?\s*[-]?\s*(?:σ|sigma)|identif|confirm|presence of|ln\s*B)")
NEGATIVE = (r"(?i)(?:non-?detect|no (?:evidence|detection|significant|sign|clear|strong)|not detect|undetect|upper limit"
            r"|absence of|featureless|flat spectrum|rule[sd]? out|lack of|cannot confirm|does not show)")
TENTATIVE = (r"(?i)(?:tentative|hint|marginal|possibl|weak evidence|inconclusive|low significance"
             r"|2(?:\.\d+)?\s*[-]?\s*(?:σ|sigma))")
AMOUNT = r"\d\s*[-]?\s*(?:σ|sigma)|ppm"
GAS_NAMES = {"CH4": r"(?:CH\s*_?\{?\s*4|CH₄|methane)", "CO2": r"(?:CO\s*_?\{?\s*2|CO₂|carbon dioxide)"}


def evidence(text: str | Column, name: str, positive: str = POSITIVE, negative: str = NEGATIVE,
             tentative: str = TENTATIVE) -> Column:
    """Struct of counts of the sentences that name a term, of the positive, negative and tentative ones, and a snippet.

    One fold over the sentences, so every pattern meets a sentence once.  The snippet is the first 25 words of the
    strongest sentence: one that states a result and gives a significance or an amount goes before one that does either.
    """
    named = F.filter(sentences(text), lambda s: (F.length(s) > 30) & (F.length(s) < 500) & s.rlike(name))
    flags = F.transform(named, lambda s: F.struct(s.rlike(positive).alias("p"), s.rlike(negative).alias("n"), s.rlike(tentative).alias("t")))
    one = lambda c: c.cast("bigint")
    score = lambda s: s.rlike(f"(?:{positive})|(?:{negative})").cast("int") + s.rlike(AMOUNT).cast("int")
    best = F.array_max(F.transform(named, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("at"), s.alias("s"))))
    snippet = F.coalesce(F.array_join(F.slice(F.filter(F.split(best["s"], r"\s+"), lambda w: w != ""), 1, 25), " "), F.lit(""))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("n_sentences", "n_pos", "n_neg", "n_tentative")])
    n = F.aggregate(flags, zero, lambda a, f: F.struct(
        (a["n_sentences"] + 1).alias("n_sentences"), (a["n_pos"] + one(f["p"] & ~f["n"] & ~f["t"])).alias("n_pos"),
        (a["n_neg"] + one(f["n"])).alias("n_neg"), (a["n_tentative"] + one(f["t"])).alias("n_tentative")))
    return F.struct(*[n[c].alias(c) for c in ("n_sentences", "n_pos", "n_neg", "n_tentative")], snippet.alias("snippet"))


def evidence_label(n_pos: str | Column, n_neg: str | Column) -> Column:
    p, n = col(n_pos), col(n_neg)
    return (F.when((p >= 3) & (p >= 2 * F.greatest(n, F.lit(1))), "1")
            .when((n >= 2) & (n >= p), "0").otherwise("unclear"))
