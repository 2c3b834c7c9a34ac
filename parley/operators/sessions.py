"""Quality of whole sessions, from coded utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import guarded_ratio, literal_map
from parley.operators.order import long_form, percentiles
from parley.vocab import COUNSELLOR_T2, MI_CONSISTENT, MI_INCONSISTENT


def session_metrics(coded: DataFrame, t1: str = "t1", t2: str = "t2") -> DataFrame:
    """Counts and shares by conversation: pct_mic, r_to_q, pct_ct between 0 and 1 (0 on an empty denominator).

    Change and sustain talk and questions count by their first tier; reflections and what is consistent or not count by
    the second tier alone, whatever the first tier or the speaker.
    """
    counts = coded.groupBy("conv_id").agg(
        F.count_if(F.col(t1) == "C").alias("n_c"),
        F.count_if(F.col(t1) == "S").alias("n_s"),
        F.count_if(F.col(t2).isin("CR", "SR")).alias("n_r"),
        F.count_if(F.col(t1) == "Q").alias("n_q"),
        F.count_if(F.col(t2).isin(MI_CONSISTENT)).alias("n_mico"),
        F.count_if(F.col(t2).isin(MI_INCONSISTENT)).alias("n_miin"),
    )
    return (
        counts.withColumn("pct_mic", guarded_ratio(F.col("n_mico"), F.col("n_mico") + F.col("n_miin")))
        .withColumn("r_to_q", guarded_ratio(F.col("n_r"), F.col("n_q")))
        .withColumn("pct_ct", guarded_ratio(F.col("n_c"), F.col("n_c") + F.col("n_s")))
    )


def code_counts(coded: DataFrame, codes: list[str], t2: str = "t2") -> DataFrame:
    """One row a conversation, one column ``n_<code>`` a code (signs spelt out)."""
    return coded.groupBy("conv_id").agg(*[F.count_if(F.col(t2) == c).alias(column_of(c)) for c in codes])


def column_of(code: str) -> str:
    return "n_" + code.lower().replace("+", "_plus").replace("-", "_minus")


def counted_metrics(counts: DataFrame) -> DataFrame:
    """From code counts, in per cent: pct_mic, r_to_q over open and closed questions, pct_ct, c_to_s."""
    total = lambda codes: sum((F.col(column_of(c)) for c in codes[1:]), F.col(column_of(codes[0])))
    from parley.vocab import CHANGE_TALK, SUSTAIN_TALK

    mico, miin, change, sustain = total(MI_CONSISTENT), total(MI_INCONSISTENT), total(CHANGE_TALK), total(SUSTAIN_TALK)
    return counts.select(
        "conv_id",
        (100 * guarded_ratio(mico, mico + miin)).alias("pct_mic"),
        guarded_ratio(total(["CR", "SR"]), total(["OQ", "CQ"])).alias("r_to_q"),
        (100 * guarded_ratio(change, change + sustain)).alias("pct_ct"),
        guarded_ratio(change, sustain).alias("c_to_s"),
    )


def older_pct_mic(coded: DataFrame, t1: str = "t1") -> DataFrame:
    """The older share of consistent behaviour: reflections and questions count as consistent."""
    good = F.count_if(F.col(t1).isin("IMC", "CRL", "SRL", "Q"))
    bad = F.count_if(F.col(t1) == "IMI")
    return coded.groupBy("conv_id").agg((100 * guarded_ratio(good, good + bad)).alias("pct_mic_older"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, min, max, quartiles, their distance and the population deviation of each column."""
    rows = long_form(df, columns)
    sums = rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))
    quartiles = percentiles(df, columns, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return sums.join(quartiles, "metric").withColumn("iqr", F.col("p75") - F.col("p25"))  # one row a metric


def code_flags(coded: DataFrame, t2: str = "t2", codes: list[str] = COUNSELLOR_T2) -> DataFrame:
    """One row an utterance with a 0/1 column for each code; several rows of an utterance are joined."""
    flag = lambda c: F.max(F.when(F.col(t2) == c, 1).otherwise(0)).cast("long").alias(column_of(c)[2:])
    return coded.groupBy("conv_id", "conv_utt_idx").agg(*map(flag, codes))


def outcome_delta(delta_with: str = "week_later") -> Column:
    """The outcome's change since ``pre``: to ``week_later`` (as by default) or to ``post``."""
    if delta_with not in ("week_later", "post"):
        raise ValueError(f"unknown end of the change: {delta_with}")
    return F.col(delta_with) - F.col("pre")


def quality_of(status: str):
    """1 where a status starts with high, 0 for other values."""
    return F.when(F.col(status).startswith("high"), 1).otherwise(0).cast("long")


def rated_label(speaker, tier: str, t1: str, t2: str):
    """The label of a rater that counts: of the counsellor the first tier, of the client the one of ``tier``."""
    return F.when(F.col(speaker) == "counsellor", F.col(t1)).otherwise(F.col(t1 if tier == "t1" else t2))


def mixed_label(speaker, t1: str, t2: str):
    """The other choice: the client's first tier, of everyone else the second."""
    return F.when(F.lower(F.col(speaker)) == "client", F.col(t1)).otherwise(F.col(t2))


def utterance_labels(rated: DataFrame, tier: str, codes: list[str], scale: dict[str, float], t1: str = "t1", t2: str = "t2") -> DataFrame:
    """One row an utterance and label: a 0/1 flag for each counsellor code among the utterance's rows, client_code (the
    client's label on a scale, null otherwise), its turn's dense rank, speaker and label.

    Rows of (conv_id, conv_vol_idx, conv_utt_idx, speaker, t1, t2); several rows of an utterance share flags and client
    code, and each distinct label keeps a row of its own.
    """
    rows = rated.withColumn("label", rated_label("speaker", tier, t1, t2))
    key = ["conv_id", "conv_utt_idx"]
    flag = lambda c: F.max(F.when(F.col("label") == c, 1).otherwise(0)).cast("long").alias(f"is_{column_of(c)[2:]}")
    flags = rows.groupBy(*key).agg(*map(flag, codes))
    first = F.min(F.when(F.col("speaker") == "client", F.col("label"))).alias("_label")
    client = rows.groupBy(*key).agg(first).select(*key, literal_map(scale)[F.col("_label")].alias("client_code"))
    meta = rows.select(*key, "conv_vol_idx", "speaker", "label").distinct()
    meta = meta.withColumn("volley_rank", (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("conv_vol_idx")) - 1).cast("long"))
    return flags.join(client, key, "left").join(meta, key, "left")
