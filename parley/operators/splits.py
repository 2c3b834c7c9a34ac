"""Deterministic samples, folds and splits: order comes from a hash of the id, never from chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.order import running_index


def mixed(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample_n(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if fewer), the first by a seeded hash of the key."""
    return df.orderBy(mixed(F.concat_ws("|", *key), seed), *key).limit(n)


def conversation_folds(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """conv_id, fold: conversations in hash order, dealt in turn, so folds differ by one conversation at most."""
    each = df.select("conv_id").distinct().withColumn("_mixed", mixed(F.col("conv_id"), seed))
    return running_index(each, ["_mixed", "conv_id"], "_place").select("conv_id", (F.col("_place") % k).alias("fold"))


def fold_rows(df: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """All rows with ``part``: test for conversations of the fold, train for the others."""
    return df.join(folds, "conv_id").withColumn("part", F.when(F.col("fold") == fold, "test").otherwise("train"))


def train_valid(df: DataFrame, key: list[str], share: float, seed: int = 42) -> DataFrame:
    """Add ``part``: floor(rows * share) rows are valid, the rest train; none if that is less than one."""
    n_valid = int(df.count() * share)
    out = running_index(df.withColumn("_mixed", mixed(F.concat_ws("|", *key), seed)), ["_mixed", *key], "_place")
    return out.withColumn("part", F.when(F.col("_place") < n_valid, "valid").otherwise("train")).drop("_mixed", "_place")


def leave_dataset_out(examples: DataFrame, train: list[str], test: str) -> DataFrame:
    """Rows of the named datasets with ``split``; a test dataset that is trained on is an error."""
    if test in train:
        raise ValueError(f"{test} is both tested and trained on")
    split = F.when(F.col("dataset") == test, "test").when(F.col("dataset").isin(train), "train")
    return examples.withColumn("split", split).filter(F.col("split").isNotNull())


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "dataset").agg(F.count("*").alias("n"))
