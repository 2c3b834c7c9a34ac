"""Corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and is written and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import byte_bpe, language, repeats, similar, tiling
from parley.llm.common import remove, table, text_key, unused, written

RANKS = "byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear leading language go."""
    return language.keep_identified(docs, language.fit(language.training_sample(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: the one with the
    smallest id; of rows that share it, or have none, one of the group. Rows that share an id but not a group stay."""
    name, key, own = (unused(docs, x) for x in ("_kept_id", "_kept_key", "_own_key"))
    kept, _ = written(similar.survivors(docs).select(F.col("doc_id").alias(name), F.col("text_key").alias(key)), "kept")
    keyed = docs.withColumn(own, text_key())
    found = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[name]) & (keyed[own] == kept[key]), "left_semi")
    return found.dropDuplicates(["doc_id", own]).drop(own)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; every document stays with the rest of its text."""
    return repeats.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoding, of every document left."""
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Language fields and digests of learned stages have no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage wrote goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
