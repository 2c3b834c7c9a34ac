"""Sinks: CSV, JSON lines, appended annotations, small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.prepare import not_yet_done


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; nulls are left out."""
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the table at ``path`` lacks."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df = not_yet_done(df, spark.read.parquet(path), key)
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result table (metrics, not rows of data) as one JSON file on the driver."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)


def text_table(df: DataFrame, columns: list[str]) -> str:
    """A small comparison as aligned text."""
    rows = [columns, *[[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.select(*columns).collect()]]
    wide = [max(len(r[i]) for r in rows) for i in range(len(columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows)


def with_partition_path(df: DataFrame, dataset: str, subset: str | None, structure: str) -> DataFrame:
    """Constant columns to partition an output by."""
    return df.withColumns({"dataset": F.lit(dataset), "subset": F.lit(subset or "all"), "structure": F.lit(structure)})
