"""From turns to indexed utterances: segmentation, indices, subsets, filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.labels import is_valid
from parley.functions.text import ingest_speaker, segments, strip
from parley.operators.order import running_index, running_sums

def load_volleys(turns: DataFrame) -> DataFrame:
    """conv_id, conv_vol_idx, speaker, vol_text from rows of conv_id, turn, role, text."""
    return turns.select("conv_id", F.col("turn").alias("conv_vol_idx"), ingest_speaker(F.col("role")).alias("speaker"), F.col("text").alias("vol_text"))


def split_utterances(volleys: DataFrame, segmenter=None) -> DataFrame:
    """One row an utterance: conv_id, speaker, conv_vol_idx, conv_utt_idx (from 0 in its conversation), utt_text.

    Turns are split by rule, or by a provider: ``segmenter()`` makes, in every task, an object whose ``split(texts)``
    gives a list of utterances for each text. Empty utterances are left out.
    """
    if segmenter is None:
        parts = segments(F.col("vol_text"))
    else:

        @F.pandas_udf("array<string>")
        def ask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            provider = segmenter()
            for some in texts:
                yield pd.Series(provider.split(some.fillna("").tolist()), dtype=object)

        parts = F.filter(ask(F.col("vol_text")), lambda x: strip(x) != "")
    rows = volleys.select("conv_id", "speaker", "conv_vol_idx", F.posexplode(parts).alias("pos", "utt_text"))
    place = Window.partitionBy("conv_id").orderBy("conv_vol_idx", "pos")
    return rows.withColumn("conv_utt_idx", (F.row_number().over(place) - 1).cast("long")).drop("pos")


def index_utterances(utterances: DataFrame) -> DataFrame:
    """Add corp_conv_idx, corp_vol_idx and corp_utt_idx: places in the whole corpus, from 0, in conversation order.

    Conversations are summed up over the corpus, one row each; inside a conversation places are its own.
    """
    by_volley = Window.partitionBy("conv_id").orderBy("conv_vol_idx")
    rows = utterances.withColumn("_nth_vol", F.dense_rank().over(by_volley) - 1)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("_utts"), (F.max("_nth_vol") + 1).alias("_vols"), F.lit(1).alias("_one"))
    starts = running_sums(sizes, ["conv_id"], {"_utt0": "_utts", "_vol0": "_vols", "corp_conv_idx": "_one"})
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("conv_utt_idx")) - 1
    out = rows.withColumn("_nth_utt", nth).join(starts.select("conv_id", "_utt0", "_vol0", "corp_conv_idx"), "conv_id")
    out = out.withColumn("corp_utt_idx", F.col("_utt0") + F.col("_nth_utt")).withColumn("corp_vol_idx", F.col("_vol0") + F.col("_nth_vol"))
    return out.drop("_nth_vol", "_nth_utt", "_utt0", "_vol0")


def with_status(volleys: DataFrame, demographics: DataFrame, status: str) -> DataFrame:
    """Volleys of conversations whose demographic row has the status."""
    return volleys.join(demographics.filter(F.col("status") == status).select("conv_id"), "conv_id", "left_semi")


def first_conversations(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Rows of the first ``n`` conversations by the smallest ``by`` of each (its id alone: sorted ids)."""
    first = df.groupBy("conv_id").agg(F.min(F.struct(*by, "conv_id")).alias("first")).orderBy("first").limit(n).select("conv_id")
    return df.join(F.broadcast(first), "conv_id", "left_semi")  # n rows


def not_yet_done(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those done: resuming after an interruption, gaps included."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def high_water_mark(done: DataFrame, key: str = "corp_utt_idx") -> DataFrame:
    return done.agg(F.max(key).alias("high_water_mark"))


def labelled(rows: DataFrame, label: str, tier: str) -> DataFrame:
    """Rows fit for examples: known speaker, a code of the speaker's set, text that is not blank."""
    return rows.filter(is_valid(F.col(label), F.col("speaker"), tier) & (F.length(strip(F.col("utt_text"))) > 0))


def valid_rows(rows: DataFrame, gold: str, codes: dict[str, list[str]]) -> DataFrame:
    """Rows whose true label is one of the codes of their speaker."""
    return rows.filter(reduce(or_, [(F.col("speaker") == who) & F.col(gold).isin(own) for who, own in codes.items()]))


def positional_zip(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables side by side by their places, as far as the shorter one goes."""
    a, b = running_index(left, left_order, "place"), running_index(right, right_order, "place")
    return a.join(b, "place")


def average_conversation_length(volleys: DataFrame) -> DataFrame:
    return volleys.groupBy("conv_id").count().agg(F.avg("count").alias("avg_volleys"))
