"""The stages of the corpus pipeline, each one operator over all its predecessor kept.

quality rules      drop the documents that the base rules or the certified cutoffs reject
near-duplicates    keep one document of each class of near copies
repeated passages  cut every run of more than 50 words that is covered by strings that also start elsewhere; texts left empty go
decontamination    drop the documents that hold a benchmark item
mixing             copies of every document so that sources meet their target words; documents with none go

Every stage but the last returns the columns of its input.  `n_chars`, where there is one, follows the text.
Defined cases: an empty table gives an empty table; documents with a NULL text fail the first stage; extra columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, order_minhash, pivotal_mixing, quality_rules, run_length_index

#: Fewest words of a repeated passage, and the window of its search: 51 words with fewer bytes would have under four letters each.
PASSAGE_WORDS, PASSAGE_WINDOW = 51, 250


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accept(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_per_class(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = run_length_index.remove_repeats(docs, PASSAGE_WINDOW, min_words=PASSAGE_WORDS)
    found = F.col(f"`{out.columns[-1]}`")
    cut = found["n_removed"] > 0
    text = F.when(cut, found["kept_text"]).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    kept = out.filter(~cut | (F.regexp_count(text, F.lit(common.WORD)) > 0))
    return kept.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies of the documents that the mix takes."""
    return pivotal_mixing.mix(docs).filter("copies > 0")


STAGES = [("quality rules", quality_stage), ("near-duplicates", near_duplicate_stage), ("repeated passages", repeated_passage_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read back as the next one's input."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
