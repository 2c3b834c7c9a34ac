"""Codes from pluggable providers, tier by tier, resumable."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.labels import allowed_codes, allowed_in_group, array_of, parse_field
from parley.operators.context import with_context
from parley.operators.prepare import not_yet_done
from parley.vocab import VOCABULARY


class LabelProvider(Protocol):
    """Answers a batch of prompts with raw text, one answer a prompt. Built once in every task."""

    def answer(self, prompts: list[str]) -> list[str]: ...


def ask(df: DataFrame, prompt: str, out: str, make_provider) -> DataFrame:
    """Add the provider's raw answers to a prompt column; a provider's failure fails its task, which Spark retries."""
    shape = df.withColumn(out, F.lit("")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for f in frames:
            yield f.assign(**{out: provider.answer(f[prompt].tolist())})

    return df.mapInPandas(run, shape)


def annotate_tiered(utterances: DataFrame, make_t1, make_t2, done: DataFrame | None = None, mode: str = "interval", volleys: int = 3) -> DataFrame:
    """Two passes of providers: first tier, then second tier within the predicted group.

    Utterances of unknown speakers are left out; those in ``done`` (by conv_id, conv_utt_idx) are not asked again. An
    unreadable first tier leaves the speaker's full second tier open.
    """
    from parley.operators.prompts import messages_t1, messages_t2, render

    rows = with_context(utterances, mode, volleys).filter(F.col("speaker").isin("counsellor", "client"))
    if done is not None:
        rows = not_yet_done(rows, done, ["conv_id", "conv_utt_idx"])
    first = ask(messages_t1(rows).withColumn("_prompt", render(F.col("messages"))).drop("messages"), "_prompt", "t1_expl_auto", make_t1)
    own = F.when(F.col("speaker") == "client", array_of(VOCABULARY["client", "t1"])).otherwise(array_of(VOCABULARY["counsellor", "t1"]))
    first = first.withColumn("t1_label_auto", parse_field(F.col("t1_expl_auto"), own)).drop("_prompt")
    second = ask(messages_t2(first, "t1_label_auto").withColumn("_prompt", render(F.col("messages"))).drop("messages"), "_prompt", "t2_expl_auto", make_t2)
    return second.withColumn("t2_label_auto", parse_field(F.col("t2_expl_auto"), allowed_in_group(F.col("speaker"), F.col("t1_label_auto")))).drop("_prompt", "context")


def annotate_flat(utterances: DataFrame, make, done: DataFrame | None = None, mode: str = "interval", volleys: int = 3) -> DataFrame:
    """One pass of a provider over the speaker's full second tier: label_auto, expl_auto. Rows are left out and resumed as
    in ``annotate_tiered``."""
    from parley.operators.prompts import messages_flat, render

    rows = with_context(utterances, mode, volleys).filter(F.col("speaker").isin("counsellor", "client"))
    if done is not None:
        rows = not_yet_done(rows, done, ["conv_id", "conv_utt_idx"])
    asked = ask(messages_flat(rows).withColumn("_prompt", render(F.col("messages"))).drop("messages"), "_prompt", "expl_auto", make)
    return asked.withColumn("label_auto", parse_field(F.col("expl_auto"), allowed_codes(F.col("speaker"), "t2"))).drop("_prompt", "context")
