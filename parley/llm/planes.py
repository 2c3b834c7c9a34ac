"""Token ids in bit-plane files: blocks of ids transposed to byte planes, each plane compressed by zstandard.

A file holds documents in ascending id order. Layout: magic; chunks (four byte planes of up to BLOCK_IDS
unsigned 32-bit ids, each a zstandard frame); the document index (an Arrow stream of doc_id and n_tokens);
a JSON footer with the chunk index (offset and plane lengths of every chunk) and the totals; its length; magic.
Any range of ids can be read by the chunk index alone.

Texts are dealt into ranges of (doc_id, text), encoded and written inside one task each, so ids are never shuffled. A
task that is run again writes files of other names; the index, which Spark commits once a task, names those that count.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.byte_bpe import pretokenise
from parley.llm.common import BATCH_BYTES, new_path, portions, small_batches, table, written
from parley.llm.memo import Memo, of_worker
from parley.llm.token_counts import library_tokenizer

MAGIC = b"PLANES01"
BLOCK_IDS = 65_536
#: UTF-8 bytes of texts in a task's range, and ids in a file, beyond which the next one begins.
RANGE_BYTES = 32 << 20
FILE_IDS = 16 << 20
#: Bytes of matches and their ids that a worker keeps, twice.
CACHE_BYTES = 64 << 20


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Four compressed byte planes of unsigned 32-bit ids, low byte first."""
    planes = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    out = np.empty((n, 4), np.uint8)
    for i, p in enumerate(planes):
        out[:, i] = np.frombuffer(unpack.decompress(p, max_output_size=n), np.uint8)
    return out.view("<u4").ravel()


class PlaneWriter:
    """Takes documents in order; memory holds one block of ids and the document index."""

    def __init__(self, out, id_type: pa.DataType, block: int = BLOCK_IDS):
        self.out, self.block, self.id_type = out, block, id_type
        self.pos, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.chunks: list[list[int]] = []
        self.doc_ids, self.lengths, self.n_ids = [], [], 0
        out.write(MAGIC)

    def _put(self, raw: bytes) -> int:
        self.out.write(raw)
        self.pos += len(raw)
        return len(raw)

    def _chunk(self, ids: np.ndarray) -> None:
        at = self.pos
        self.chunks.append([at, len(ids), *(self._put(p) for p in to_planes(ids))])

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) - len(flat) % self.block
            for a in range(0, whole, self.block):
                self._chunk(flat[a : a + self.block])
            self.waiting, self.n_waiting = [flat[whole:]], len(flat) - whole

    def close(self) -> tuple[int, int]:
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        index = pa.table({"doc_id": pa.array(self.doc_ids, self.id_type), "n_tokens": pa.array(self.lengths, pa.int64())})
        held = io.BytesIO()
        with pa.ipc.new_stream(held, index.schema) as stream:
            stream.write_table(index)
        at = self.pos
        size = self._put(zstandard.ZstdCompressor().compress(held.getvalue()))
        footer = json.dumps({"chunks": self.chunks, "index": [at, size], "n_docs": len(self.lengths), "n_ids": self.n_ids}).encode()
        self._put(footer)
        self._put(len(footer).to_bytes(8, "little") + MAGIC)
        return len(self.lengths), self.n_ids


def read_documents(source) -> Iterator[tuple[object, int, np.ndarray, pa.DataType]]:
    """(doc_id, start in the file, ids, the id's type) of every document, chunk by chunk."""
    size = source.size()
    tail = source.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a plane file")
    n = int.from_bytes(tail[:8], "little")
    footer = json.loads(source.read_at(n, size - 8 - len(MAGIC) - n))
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(source.read_at(footer["index"][1], footer["index"][0]))
    index = pa.ipc.open_stream(raw).read_all()
    chunks, held, start = iter(footer["chunks"]), np.zeros(0, "<u4"), 0
    for doc_id, length in zip(index["doc_id"].to_pylist(), index["n_tokens"].to_pylist()):
        parts = [held]
        have = len(held)
        while have < length:
            at, n_ids, *sizes = next(chunks)
            raw = source.read_at(sum(sizes), at)
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            parts.append(from_planes([raw[a:b] for a, b in zip(cuts, cuts[1:])], n_ids))
            have += n_ids
        joined = np.concatenate(parts) if len(parts) > 1 else held
        yield doc_id, start, joined[:length], index.schema.field(0).type
        held, start = joined[length:], start + length


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


def encoder(path: str):
    """Texts to arrays of ids as the tokenizers library gives them without added tokens.

    Its pre-tokeniser cuts a text into matches of public_tokenizers.PATTERN that do not depend on their
    surroundings, so the library's model encodes each distinct match once and a bounded cache serves the rest. Texts
    that hold the string of a special token go to the library whole.
    """
    return of_worker(("planes", path), lambda: _encoder(path))


def _encoder(path: str):
    tok = library_tokenizer(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    model, letters, number = tok.model, byte_letters(), attrgetter("id")

    def of(piece: bytes) -> bytes:
        ids = array("I", map(number, model.tokenize(piece.decode("latin-1").translate(letters))))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    memo = Memo(of, CACHE_BYTES)

    def encode(texts: list[str]) -> list[np.ndarray]:
        raw, at, first = pretokenise(texts)
        cuts = at.tolist()
        packed = list(map(memo.__getitem__, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        out = [np.frombuffer(b"".join(packed[a:b]), "<u4") for a, b in zip(first.tolist(), first[1:].tolist())]
        for i, text in enumerate(texts):
            if any(s in text for s in special):
                out[i] = np.array(tok.encode(text, add_special_tokens=False).ids, "<u4")
        return out

    return encode


def full_uri(spark: SparkSession, path: str) -> str:
    """The path as Spark resolves it, with its scheme: one without is on the default file system, not on a local disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file:///") else whole


def arrow_uri(uri: str) -> str:
    """A URI as Arrow spells it: the stores of Hadoop's s3a and s3n connectors are s3 there, those of wasb abfs."""
    scheme, mark, rest = uri.partition("://")
    return {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}.get(scheme, scheme) + mark + rest


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI of Spark's and the path there; credentials come from the executors' environment."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def ordered_ranges(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and text in ``n`` ranges in order of the id, null ids first. The text's digest and the row's place break
    ties, so that rows of one id spread over ranges too."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_tie", "_row"]
    return keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")


def write_planes(
    docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, range_bytes: int = RANGE_BYTES, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode every row, append ``end_id``, write files in ascending doc_id order (null ids first).

    Returns the files: range_no, file_no, file, n_docs, n_ids, in id order by (range_no, file_no). A null or empty text
    is the end id alone; repeated rows are written each; ids of any type that sorts will do; an empty table writes no
    file; other columns are ignored. ``tokenizer`` is a .json file of a byte-level tokenizer. ``path`` must be a folder
    that all executors share; files of lost tasks stay there under names that the index lacks.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    root = full_uri(spark, path or new_path(spark, "planes"))
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // range_bytes))
    small_batches(spark)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, no = encoder(tokenizer), TaskContext.get().partitionId()
        fs, folder = file_system(root)
        end, writer, done = np.array([end_id], "<u4"), None, []

        def finish() -> None:
            n_docs, n_ids = writer.close()
            writer.out.close()
            done.append((no, len(done), name, n_docs, n_ids))

        name = ""
        for batch in portions(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                if writer is None:
                    name = f"part-{no:07d}-{len(done):05d}-{uuid.uuid4().hex}.planes"
                    writer = PlaneWriter(fs.open_output_stream(f"{folder}/{name}", compression=None), batch.schema.field(0).type)
                writer.add(doc_id, np.concatenate([ids, end]))
                if writer.n_ids >= file_ids:
                    finish()
                    writer = None
        if writer:
            finish()
        names, kinds = ("range_no", "file_no", "file", "n_docs", "n_ids"), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], pa.schema(list(zip(names, kinds))))

    files, _ = written(ordered_ranges(docs, n).mapInArrow(put, "range_no int, file_no int, file string, n_docs long, n_ids long"), "plane-index")
    return files.withColumn("file", F.concat(F.lit(root + "/"), "file"))


def read_planes(files: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian 32-bit), from the files."""
    before = Window.orderBy("range_no", "file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, files.count())
    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, where = file_system(name)
                with fs.open_input_file(where) as source:
                    held, size = [], 0
                    kind = None
                    for doc_id, start, ids, kind in read_documents(source):
                        held.append((doc_id, base + start, len(ids), ids.tobytes()))
                        size += ids.nbytes
                        if len(held) >= 1024 or size >= BATCH_BYTES:
                            yield _rows(held, kind)
                            held, size = [], 0
                    if held:
                        yield _rows(held, kind)

    spread = based.select("file", "base", "range_no", "file_no").repartition(n, "range_no", "file_no").select("file", "base")
    return spread.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def _rows(held: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    doc_id, start, n, ids = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, id_type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "start", "n_tokens", "ids"],
    )


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_planes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_planes(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
