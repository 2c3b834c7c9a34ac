"""Readers: CSV, JSON and JSON-lines sources with fixed schemas, and the registry of corpora."""

from __future__ import annotations

from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.functions.text import normal_speaker
from parley.operators.rollup import crosswalk
from parley.sources import schema


def read_csv(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line breaks and doubled quotes. Columns are found by name.

    Columns of the schema that the file lacks come as null; others of the file are left out.
    """
    wanted = StructType.fromDDL(shape) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], shape).schema
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = set(raw.columns)
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def read_volleys(spark: SparkSession, path: str) -> DataFrame:
    """Volleys with ``conv_vol_idx`` from the order of a file's rows inside a conversation."""
    raw = read_csv(spark, path, schema.VOLLEYS).withColumn("_at", F.monotonically_increasing_id())
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("_at")) - 1
    return raw.withColumn("conv_vol_idx", place.cast("long")).drop("_at")


def read_rows(df: DataFrame, index: str, skip: int = 0, n: int | None = None) -> DataFrame:
    """A range of rows by an explicit index."""
    out = df.filter(F.col(index) >= skip)
    return out if n is None else out.filter(F.col(index) < skip + n)


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels with ``row_pos``: place in (conv_id, corp_utt_idx, conv_utt_idx) order."""
    from parley.operators.order import running_index

    return running_index(read_csv(spark, path, schema.MANUAL), ["conv_id", "corp_utt_idx", "conv_utt_idx"], "row_pos")


def normal_form(df: DataFrame, dataset: str, t1: str | None = None, t2: str | None = None) -> DataFrame:
    """dataset, conv_id, speaker, utt_text, t1_label, t2_label; a label column that is not there is null."""
    pick = lambda c: F.col(c).cast("string") if c and c in df.columns else F.lit(None).cast("string")
    return df.select(
        F.lit(dataset).alias("dataset"), F.col("conv_id").cast("string").alias("conv_id"), normal_speaker(F.col("speaker")).alias("speaker"),
        "utt_text", pick(t1).alias("t1_label"), pick(t2).alias("t2_label"),
    )


def load_manual_corpus(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: normal_form(read_csv(spark, path, schema.MANUAL), name, "t1_label_GT", "t2_label_GT")


def load_third_party(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, schema.THIRD_PARTY).withColumnRenamed("vol_text", "utt_text")
    return normal_form(crosswalk(rows, "label"), "third_party", "t1_label", "t2_label")


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "manual_a": load_manual_corpus("manual_a"),
    "manual_b": load_manual_corpus("manual_b"),
    "third_party": load_third_party,
}


def load_dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """One row a participant: of repeated rows the first in the file."""
    rows = read_csv(spark, path, schema.OUTCOMES).withColumn("_place", F.monotonically_increasing_id())
    first = F.min_by(F.struct("status", "pre_confidence", "post_confidence", "week_later_confidence"), "_place")
    return rows.groupBy("participant_id").agg(first.alias("o")).select("participant_id", "o.*")


def read_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of all runs under a folder; an id that is missing is the name of the file's folder."""
    raw = spark.read.schema(schema.EXPERIMENT).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*metadata*.json").json(folder)
    parent = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return raw.withColumn("experiment_id", F.coalesce("experiment_id", parent))


def read_specs(path: str) -> dict[str, str]:
    """Second-tier descriptions by first-tier code, from a YAML file."""
    with open(path) as f:
        return {str(k): str(v).strip() for k, v in (yaml.safe_load(f) or {}).items()}


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(f"none of {paths}")


def check_presence(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, present, n_rows of CSV files that should be there."""
    rows = []
    for name, p in paths.items():
        try:
            at = first_existing(spark, [p])
            rows.append((name, True, spark.read.csv(at, header=True, multiLine=True, escape='"').count()))
        except FileNotFoundError:
            rows.append((name, False, 0))
    return spark.createDataFrame(rows, "name string, present boolean, n_rows long")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of two conditions beside the human label, one row an utterance."""
    return read_csv(spark, path, schema.PREDICTIONS)


def read_annotated(spark: SparkSession, path: str, structure: str = "tiered") -> DataFrame:
    """Utterances with automatic codes: tiered (two labels) or flat (one), as written by an earlier run."""
    if structure not in ("tiered", "flat"):
        raise ValueError(f"unknown class structure: {structure}")
    return read_csv(spark, path, schema.ANNOTATED_TIERED if structure == "tiered" else schema.ANNOTATED_FLAT)
