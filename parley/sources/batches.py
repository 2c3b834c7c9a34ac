"""A table that grows by batches, each of them exactly once.

A batch is written to a folder of its own, then a manifest of a few bytes names that folder. The manifest takes its place in
one step, so a reader sees a batch whole or not at all, and a batch that is written again (after a failure, or by a second
writer) replaces itself and nothing else. No append reads what is there already.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS = "_manifest"
_SHAPE = "batch string, attempt string, n_rows long, shape string"


def _folder(path: str, batch: str, attempt: str) -> str:
    return f"{path}/batch={batch}/attempt={attempt}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _again(work: Callable, times: int = 20):
    """What ``work`` gives. Where a file system replaces a file by two steps (a local one), another writer may be between
    them: then once more."""
    for n in range(times):
        try:
            return work()
        except (Py4JJavaError, AnalysisException, SparkRuntimeException):
            if n == times - 1:
                raise
            time.sleep(0.05 * (n + 1))


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears, or takes another one's place, in one step."""
    jvm = spark._jvm
    target, fs = _file_system(spark, path)
    target = fs.makeQualified(target)
    written = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(written, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    _again(lambda: files.rename(written, target, overwrite))


def committed(spark: SparkSession, path: str) -> dict[str, dict]:
    """The manifest of every batch, by its name: one row a batch reaches the driver."""
    at, fs = _file_system(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(at):
        return {}
    rows = _again(lambda: spark.read.schema(_SHAPE).json(f"{path}/{MANIFESTS}").collect())
    return {r["batch"]: r.asDict() for r in rows}


def _manifest_of(spark: SparkSession, path: str, batch: str) -> dict | None:
    at, fs = _file_system(spark, f"{path}/{MANIFESTS}/{batch}.json")
    return _again(lambda: spark.read.schema(_SHAPE).json(at.toString()).first().asDict() if fs.exists(at) else None)


def write_batch(df: DataFrame, path: str, batch: str) -> int:
    """Write ``df`` as the batch of that name (letters, digits, dots, dashes) and return its number of rows.

    Its cost is that of ``df``: neither other batches nor their manifests are read. Of writers of the same batch the last
    to finish counts. An empty batch is committed as well.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not a batch's name: {batch}")
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    folder = _folder(path, batch, attempt)
    df.write.parquet(folder)
    n = spark.read.schema(df.schema).parquet(folder).count()  # from the files' footers
    before = _manifest_of(spark, path, batch)
    put_file(spark, f"{path}/{MANIFESTS}/{batch}.json", json.dumps({"batch": batch, "attempt": attempt, "n_rows": n, "shape": df.schema.json()}))
    if before:
        at, fs = _file_system(spark, _folder(path, batch, before["attempt"]))
        fs.delete(at, True)
    return n


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches; columns that a batch lacks are null in it."""
    found = committed(spark, path)
    if not found:
        raise FileNotFoundError(f"no batch is committed at {path}")
    shape = StructType()
    for m in found.values():
        for f in StructType.fromJson(json.loads(m["shape"])).fields:
            if f.name not in shape.names:
                shape.add(f.name, f.dataType, True)
    return spark.read.schema(shape).parquet(*[_folder(path, m["batch"], m["attempt"]) for m in found.values()])


def remove_uncommitted(spark: SparkSession, path: str, older_than_ms: int = 86_400_000) -> int:
    """Delete attempts that no manifest names and that were not touched for so long; how many there were."""
    known = {(f"batch={m['batch']}", f"attempt={m['attempt']}") for m in committed(spark, path).values()}
    at, fs = _file_system(spark, path)
    now, gone = spark._jvm.System.currentTimeMillis(), 0
    for batch in fs.listStatus(at):
        if not batch.getPath().getName().startswith("batch="):
            continue
        for attempt in fs.listStatus(batch.getPath()):
            key = (batch.getPath().getName(), attempt.getPath().getName())
            if key not in known and now - attempt.getModificationTime() >= older_than_ms:
                gone += bool(fs.delete(attempt.getPath(), True))
    return gone
