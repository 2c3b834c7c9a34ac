"""The conversation around an utterance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("interval", "cumulative", "all")


def merged(utterances: DataFrame) -> DataFrame:
    """Add _lead, _head, _same, _begin, _end: how each utterance goes on a conversation's text, and where it stands there.

    The text has one ``speaker: text text`` line for each run of a speaker. An utterance adds what parts it from the one
    before, the line's head if it begins one, and its own words; _begin (after the parting) and _end are in bytes.
    """
    by = Window.partitionBy("conv_id").orderBy("conv_utt_idx")
    first = F.row_number().over(by) == 1
    same = ~first & F.lag("speaker").over(by).eqNullSafe(F.col("speaker"))
    lead = F.when(first, F.lit("")).when(same, F.lit(" ")).otherwise(F.lit("\n"))
    head = F.when(same, F.lit("")).otherwise(F.concat("speaker", F.lit(": ")))
    out = utterances.withColumns({"_same": same, "_lead": lead}).withColumn("_head", head)
    out = out.withColumn("_end", F.sum(F.octet_length("_lead") + F.octet_length("_head") + F.octet_length("utt_text")).over(by))
    return out.withColumn("_begin", F.col("_end") - F.octet_length("_head") - F.octet_length("utt_text"))


def with_context(utterances: DataFrame, mode: str = "interval", volleys_before: int = 3) -> DataFrame:
    """Add ``context``: lines of the utterances around each one, itself included.

    interval: the volleys before (``volleys_before`` of them) whole, and the own volley up to the utterance;
    cumulative: everything up to it; all: the whole conversation. A conversation's text is built once, and a context is a
    slice of its bytes. One shuffle by conversation serves any mode. Results of ``interval`` grow with the text, those of
    the other modes with the text times its utterances, row by row.
    """
    if mode not in MODES:
        raise ValueError(f"unknown context mode: {mode}")
    rows = merged(utterances)
    row = F.struct(*utterances.columns)
    piece = F.concat("_lead", "_head", "utt_text")
    pieces = lambda *more: F.sort_array(F.collect_list(F.struct("conv_utt_idx", piece.alias("piece"), *more)))
    text = F.array_join(F.transform("_rows", lambda r: r["piece"]), "")
    if mode != "interval":
        whole = rows.groupBy("conv_id").agg(pieces().alias("_rows")).select("conv_id", text.alias("_text"))
        out = rows.select(*utterances.columns, "_end").join(whole, "conv_id")
        context = F.col("_text") if mode == "all" else F.substring(F.col("_text").cast("binary"), F.lit(1), F.col("_end").cast("int")).cast("string")
        return out.select(*utterances.columns, context.alias("context"))
    near = Window.partitionBy("conv_id").orderBy("conv_vol_idx").rangeBetween(-volleys_before, 0)
    cut = F.min_by(F.when(F.col("_same"), F.concat("speaker", F.lit(": "))).otherwise(F.lit("")), "_begin")
    rows = rows.withColumns({"_from": F.min("_begin").over(near), "_cut": cut.over(near)})
    whole = rows.groupBy("conv_id").agg(pieces("_from", "_end", "_cut", row.alias("row")).alias("_rows"))

    def sliced(t: Column) -> Column:
        def one(r: Column) -> Column:
            part = F.substring(t, r["_from"].cast("int") + 1, (r["_end"] - r["_from"]).cast("int")).cast("string")
            return F.struct(*[r["row"][c].alias(c) for c in utterances.columns], F.concat(r["_cut"], part).alias("context"))

        return F.transform("_rows", one)

    # The text is bound once to a lambda's variable: as a column it would be built again for every slice.
    return whole.select(F.inline(F.get(F.transform(F.array(text.cast("binary")), sliced), F.lit(0))))
