"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue is rendered once as the assistant; the others become users under their own
names and the training mask covers the participant's turns only.  A dialogue is rendered in parts of a bounded
number of turns, so that no task ever holds a whole dialogue; `char_start` places a part in the full rendering.

Defined cases: a NULL role is the speaker "unknown"; a NULL text renders as an empty turn; NULL turns come last;
turns with the same number are ordered by speaker, then text; a row repeated in all four columns is one turn; a
NULL conv_id is a dialogue of its own; a dialogue with context turns only (system) has no perspective and so no
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS_PER_PART, ROWS_PER_PART = 256, 1024
CONTEXT_ROLES = ("system",)


def _header(speaker: Column, perspective: Column, context: tuple[str, ...]) -> Column:
    who = (F.when(speaker.isin(*context), speaker).when(speaker == perspective, F.lit("assistant"))
           .otherwise(F.concat(F.lit("user name="), speaker)))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def _where(t: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """Rows of t whose part is (left_semi) or is not (left_anti) among `parts`; NULL is a value."""
    p = parts.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"))
    return t.join(p, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("part").eqNullSafe(F.col("_p")), how)


def _cut_dense(t: DataFrame, rows_per_part: int) -> DataFrame:
    """t with `cell`, the number of its piece of at most rows_per_part neighbouring turns within the part.

    The rows are dealt by ranges of (conv_id, part, turn, speaker, body), so no task holds a whole part.
    """
    order = [F.col("turn").isNull(), "turn", "speaker", "body"]
    dealt = stored(t.drop("cell").repartitionByRange("conv_id", "part", *order).withColumn("_task", F.spark_partition_id()))
    place = F.row_number().over(W.partitionBy("_task", "conv_id", "part").orderBy(*order))
    dealt = dealt.withColumn("_piece", F.floor((place - 1) / rows_per_part))
    pieces = dealt.groupBy("conv_id", "part", "_task", "_piece").agg(F.count("*").alias("_n"))      # a row for rows_per_part turns
    pieces = pieces.withColumn("cell", F.row_number().over(W.partitionBy("conv_id", "part").orderBy("_task", "_piece")).cast("long") - 1)
    right = pieces.select(*[F.col(c).alias(f"_r{c}") for c in ("conv_id", "part", "_task", "_piece")], "cell")
    same = F.lit(True)
    for c in ("conv_id", "part", "_task", "_piece"):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return dealt.join(right, same).select("conv_id", "turn", "speaker", "body", "part", "cell")


def rotate(turns: DataFrame, turns_per_part: int = TURNS_PER_PART, rows_per_part: int = ROWS_PER_PART,
           context: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """conv_id, perspective, part, cell, n_turns, n_trained, char_start, rendered, spans.

    spans: [start, end) code points inside the part that are trained on: the text of the perspective's turns
    with its end mark.  cell is 0 unless more than rows_per_part rows share a part, which then is cut into pieces of
    neighbouring turns; the pieces in order of cell are the part's one rendering.
    """
    t = need(turns, "conv_id", "turn", "role", "text").distinct().select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("body"))
    t = t.withColumn("part", F.floor(F.col("turn") / turns_per_part).cast("long"))
    full = stored(t.groupBy("conv_id", "part").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_part).select("conv_id", "part"))
    t = t.withColumn("cell", F.lit(0).cast("long"))
    if not full.isEmpty():
        dense = _cut_dense(_where(t, full, "left_semi"), rows_per_part)
        t = _where(t, full, "left_anti").unionByName(dense)
    cell = ["conv_id", "part", "cell"]
    line = F.struct(F.col("turn").isNull().alias("last"), "turn", "speaker", "body")
    blocks = t.groupBy(*cell).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    people = t.filter(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    seen = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    who = F.col("perspective")
    pieces = F.transform("lines", lambda x: F.concat(_header(x["speaker"], who, context), x["body"], F.lit(CLOSE + "\n")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(_header(x["speaker"], who, context))
        end = start + F.length(x["body"]) + len(CLOSE)
        more = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct((end + 1).alias("pos"), F.when(x["speaker"] == who, more).otherwise(acc["spans"]).alias("spans"))

    walked = F.aggregate("lines", F.struct(F.lit(0).alias("pos"), none.alias("spans")), step)
    seen = seen.select(*cell, "perspective", F.size("lines").alias("n_turns"), F.array_join(pieces, "").alias("rendered"), walked.alias("w"))
    seen = seen.select(*cell, "perspective", "n_turns", F.size("w.spans").alias("n_trained"), F.col("w.pos").cast("long").alias("chars"), "rendered", F.col("w.spans").alias("spans"))

    order = [F.col("part").asc_nulls_last(), "cell"]
    before = W.partitionBy("conv_id", "perspective").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = seen.select(*[F.col(c).alias(f"_{c}") for c in cell], F.col("perspective").alias("_w"),
                         F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("char_start"))
    same = F.col("perspective") == F.col("_w")
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return seen.join(placed, same).select("conv_id", "perspective", "part", "cell", "n_turns", "n_trained", "char_start", "rendered", "spans")
