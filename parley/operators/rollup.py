"""Utterance codes rolled up to turns, votes, and crosswalks between schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.labels import first_label, reduced, third_party_t1, third_party_t2
from parley.functions.text import normal_speaker


def volley_boundaries(rows: DataFrame, order: str, text: str = "cumulative_text") -> DataFrame:
    """Add ``volley`` (from 1 in a conversation): a new one where the speaker changes or the growing text of the
    turn does not go on from the row before."""
    by = Window.partitionBy("conv_id").orderBy(order)
    before, who = F.lag(text).over(by), F.lag("speaker").over(by)
    new = F.when(before.isNull() | ~F.col(text).startswith(before) | (F.col("speaker") != who), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("volley", F.sum("_new").over(by)).drop("_new")


def dense_volley_rank(rows: DataFrame) -> DataFrame:
    """Add ``volley_rank``: the turn's dense rank in its conversation, from 0."""
    return rows.withColumn("volley_rank", (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("conv_vol_idx")) - 1).cast("long"))


def volley_rollup(coded: DataFrame, label: str) -> DataFrame:
    """One row a turn: its codes in order, its first speaker and its last text."""
    place = F.col("conv_utt_idx")
    codes = F.array_sort(F.collect_list(F.struct(place.alias("i"), F.col(label).alias("code"))))
    return coded.groupBy("conv_id", "conv_vol_idx").agg(
        F.transform(codes, lambda x: x["code"]).alias("codes"), F.min_by("speaker", place).alias("speaker"), F.max_by("utt_text", place).alias("last_text")
    )


def majority_vote(votes: DataFrame, item: list[str], label: str) -> DataFrame:
    """The codes with most votes of every item, all of them on a tie, sorted; null votes do not count."""
    counts = votes.filter(F.col(label).isNotNull()).groupBy(*item, F.col(label).alias("code")).agg(F.count("*").alias("n"))
    best = counts.withColumn("rank", F.rank().over(Window.partitionBy(*item).orderBy(F.desc("n")))).filter("rank = 1")
    return best.groupBy(*item).agg(F.array_sort(F.collect_list("code")).alias("codes"))


def reduce_to_scheme(coded: DataFrame, item: list[str], label: str) -> DataFrame:
    """One code of the third party's scheme for every item: the most frequent; ties go to C, then S, else N; items
    without a mapped code get N (client) or O."""
    mapped = coded.withColumn("_code", reduced(F.col(label), F.col("speaker")))
    n = mapped.groupBy(*item, "speaker", "_code").agg(F.count("*").alias("n"))
    top = F.max(F.when(F.col("_code").isNotNull(), F.col("n"))).over(Window.partitionBy(*item, "speaker"))
    best = F.collect_set(F.when(F.col("n") == F.col("_top"), F.col("_code")))
    out = n.withColumn("_top", top).groupBy(*item, "speaker").agg(best.alias("_best"))
    pick = (
        F.when(F.size("_best") == 0, F.when(F.col("speaker") == "client", "N").otherwise("O"))
        .when(F.size("_best") == 1, F.get("_best", F.lit(0)))
        .when(F.array_contains("_best", "C"), "C")
        .when(F.array_contains("_best", "S"), "S")
        .otherwise("N")
    )
    return out.select(*item, "speaker", pick.alias("code"))


def crosswalk(rows: DataFrame, raw: str) -> DataFrame:
    """Third-party rows in this library's scheme: speaker normalised, t1_label and t2_label, null where unmapped."""
    code, who = first_label(F.col(raw)), F.col("speaker")
    rows = rows.withColumn("speaker", normal_speaker(who))
    return rows.withColumn("t1_label", third_party_t1(code, who)).withColumn("t2_label", third_party_t2(code, who))
