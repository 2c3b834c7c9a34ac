"""Prompts, chat messages and completions for code assignment. Wording is this library's own."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.labels import allowed_codes, allowed_in_group
from parley.functions.text import literal_map
from parley.operators.order import percentiles, running_index
from parley.vocab import T1_GROUPS

OUTPUT_HEADER = "## Answer format"
INSTRUCTIONS = {
    "counsellor": "You code what counsellors say in motivational conversations. Choose the behaviour that fits the utterance best.",
    "client": "You code what clients say about changing. Choose the kind of talk that fits the utterance best.",
}
RICH_TAIL = "\n## Answer format\nExplain in one sentence, then give the code as label."
CODE_ONLY = "Answer with the code alone."
SPECS = {group: f"{group}: one of {', '.join(codes)}" for group, codes in T1_GROUPS.items()}


def bare_prompt(speaker: Column, text: Column, tier: str) -> Column:
    codes = F.array_join(allowed_codes(speaker, tier), ", ")
    return F.concat(F.lit("Codes: "), codes, F.lit("\nSpeaker: "), speaker, F.lit("\nUtterance: "), text, F.lit("\nCode:"))


def rich_prompt(speaker: Column, text: Column, tier: str) -> Column:
    """The full instructions up to their answer format, then the demand for the code alone."""
    full = F.concat(literal_map(INSTRUCTIONS)[speaker], F.lit(RICH_TAIL))
    return F.concat(F.substring_index(full, OUTPUT_HEADER, 1), F.lit(CODE_ONLY + "\n"), bare_prompt(speaker, text, tier))


def plain_prompt(speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("Speaker: "), speaker, F.lit("\nUtterance: "), text, F.lit("\nLabel:"))


def completion(label: Column) -> Column:
    return F.concat(F.lit(" "), label, F.lit("\n"))


def _messages(system: Column, user: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", system), message("user", user))


def user_message(context: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("Conversation:\n"), context, F.lit("\n\nCode this: "), speaker, F.lit(": "), text)


def messages_t1(df: DataFrame) -> DataFrame:
    """Add ``messages``: the instructions with first-tier codes, and the utterance in its ``context``."""
    speaker = F.col("speaker")
    system = F.concat(literal_map(INSTRUCTIONS)[speaker], F.lit(" Codes: "), F.array_join(allowed_codes(speaker, "t1"), ", "))
    return df.withColumn("messages", _messages(system, user_message(F.col("context"), speaker, F.col("utt_text"))))


def messages_flat(df: DataFrame) -> DataFrame:
    """The same with the speaker's full second tier at once."""
    speaker = F.col("speaker")
    system = F.concat(literal_map(INSTRUCTIONS)[speaker], F.lit(" Codes: "), F.array_join(allowed_codes(speaker, "t2"), ", "))
    return df.withColumn("messages", _messages(system, user_message(F.col("context"), speaker, F.col("utt_text"))))


def messages_t2(df: DataFrame, t1: str, specs: dict[str, str] | None = None) -> DataFrame:
    """The same for the second tier, given a first-tier column (gold in training, predicted in use). ``specs`` describe
    the groups, as ``readers.read_specs`` gives them from a YAML file."""
    speaker = F.col("speaker")
    spec = F.coalesce(literal_map({**SPECS, **(specs or {})})[F.col(t1)], F.lit("any"))
    system = F.concat(
        literal_map(INSTRUCTIONS)[speaker], F.lit(" Group: "), spec, F.lit(" Codes: "), F.array_join(allowed_in_group(speaker, F.col(t1)), ", ")
    )
    return df.withColumn("messages", _messages(system, user_message(F.col("context"), speaker, F.col("utt_text"))))


def render(messages: Column, template: str = "<{role}>\n{content}\n") -> Column:
    """Messages as one string by a template; ``{role}`` and ``{content}`` stand for the parts."""
    quoted = json.dumps(template)  # the template is data: split it once, here
    parts = json.loads(quoted).replace("{role}", "\0r\0").replace("{content}", "\0c\0").split("\0")
    one = lambda m: F.concat(*[m["role"] if p == "r" else m["content"] if p == "c" else F.lit(p) for p in parts])
    return F.array_join(F.transform(messages, one), "")


def word_vocabulary(rows: DataFrame, text: str, first_id: int = 0) -> DataFrame:
    """word, id: dense numbers of the blank-separated words of all rows, the most frequent first, then by code points."""
    words = rows.select(F.explode(F.split(text, " ")).alias("word"))
    counts = words.groupBy("word").agg((-F.count("*")).alias("_less"))  # partial sums: a word may be a third of all
    return running_index(counts, ["_less", "word"], "id").select("word", (F.col("id") + first_id).cast("int").alias("id"))


def with_word_ids(rows: DataFrame, key: list[str], text: str, vocabulary: DataFrame, out: str = "ids") -> DataFrame:
    """Add an array of the ids of a text's words, in order; words that the vocabulary lacks are left out, a null text has
    none. ``key`` names a row."""
    each = rows.select(*key, F.posexplode(F.split(text, " ")).alias("_pos", "word"))
    found = each.join(vocabulary, "word").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "id"))).alias("_ids"))
    ids = F.coalesce(F.transform("_ids", lambda x: x["id"]), F.array().cast("array<int>"))
    return rows.join(found, key, "left").withColumn(out, ids).drop("_ids")


def mask_prompt(prompt_ids: Column, completion_ids: Column, end_id: int, max_length: int) -> Column:
    """input_ids and labels (prompt masked by -100), ended by ``end_id`` and cut to ``max_length``."""
    ids = F.slice(F.concat(prompt_ids, completion_ids, F.array(F.lit(end_id))), 1, max_length)
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), completion_ids, F.array(F.lit(end_id))), 1, max_length)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


def tokenised(rows: DataFrame, tokenizer: str, end_id: int, max_length: int) -> DataFrame:
    """Add input_ids, labels (prompt masked by -100) and attention_mask, each of ``max_length``: ended by ``end_id``, cut
    where longer and padded with it (masked in labels and attention) where shorter.

    ``tokenizer`` is a file of the tokenizers library on every executor. Prompt and completion are encoded apart, so the
    border between them is where training begins.
    """
    shape = rows.withColumns({c: F.array().cast("array<int>") for c in ("input_ids", "labels", "attention_mask")}).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        for f in frames:
            ids = [[x.ids for x in tok.encode_batch(f[c].fillna("").tolist(), add_special_tokens=False)] for c in ("prompt", "completion")]
            whole = [(a + b + [end_id])[:max_length] for a, b in zip(*ids)]
            masked = [([-100] * len(a) + b + [end_id])[:max_length] for a, b in zip(*ids)]
            pad = [max_length - len(x) for x in whole]
            yield f.assign(
                input_ids=[x + [end_id] * n for x, n in zip(whole, pad)],
                labels=[x + [-100] * n for x, n in zip(masked, pad)],
                attention_mask=[[1] * len(x) + [0] * n for x, n in zip(whole, pad)],
            )

    return rows.mapInPandas(run, shape)


def with_token_count(rows: DataFrame, text: str, tokenizer: str, out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of a text (null: 0) by a file of the tokenizers library that every executor has, without
    added tokens: what a length limit in tokens is held against."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        for some in texts:
            yield pd.Series([len(x.ids) for x in tok.encode_batch(some.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return rows.withColumn(out, count(F.col(text)))


def length_report(rows: DataFrame, length: str, max_length: int) -> DataFrame:
    """n, median, p95, longest, too_long (rows above ``max_length``) and cut (what those have too much, in all)."""
    over = F.greatest(F.col(length) - max_length, F.lit(0))
    sums = rows.agg(F.count(length).alias("n"), F.max(length).cast("long").alias("longest"), F.count_if(F.col(length) > max_length).alias("too_long"), F.sum(over).cast("long").alias("cut"))
    return percentiles(rows, [length], {"median": 0.5, "p95": 0.95}).drop("metric").crossJoin(sums)  # one row each
