"""Benchmark decontamination by greedy string tiling.

Seeds: windows of ``MIN_MATCH`` normalised words that a document shares with a benchmark item. For every pair
with a seed, tiles are found by running Karp-Rabin (rolling hashes propose matches of the current length, the
words confirm them), always marking the longest match that overlaps no tile yet. An item is contaminated in a
document if tiles cover ``COVERAGE`` of its words, in whatever order they stand.

A benchmark of at most ``BROADCAST_BYTES`` of distinct texts (so of fewer seeds than that) is broadcast; a larger one
meets the documents in a shuffled join on seeds instead. There, seeds that many documents share are left out as far as
any contaminated document still shares another one of the item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import portions, remove, small_batches, table, unused, written
from parley.llm.memo import of_worker

MIN_MATCH = 5
COVERAGE = 0.8
BROADCAST_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of non-ASCII characters."""
    return (text or "").lower().encode().translate(_WORD_BYTES).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):  # Horner's rule over the window, all windows at once
        out = out * _BASE + hashes[i : i + n]
    return out


def tiles(item: list[bytes], doc: list[bytes], at: list[tuple[int, int]], k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, length) from seed matches ``at`` of (item, document) places.

    Matches grow to their full length; the longest is marked first, earlier places first among equals; a match
    partly covered by marks is cut to what is free and waits for its new length's turn.
    """
    seeds = {(i, j) for i, j in at if item[i : i + k] == doc[j : j + k]}
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, j in seeds:
        if (i - 1, j - 1) in seeds:
            continue
        n = k
        while (i + n - k + 1, j + n - k + 1) in seeds:
            n += 1
        waiting[n].append((i, j))
    used_item, used_doc, out = bytearray(len(item)), set(), []
    while waiting:
        n = max(waiting)
        for i, j in sorted(waiting.pop(n)):
            free = [not used_item[i + x] and j + x not in used_doc for x in range(n)]
            if all(free):
                out.append((i, j, n))
                used_item[i : i + n] = b"\1" * n
                used_doc.update(range(j, j + n))
                continue
            x = 0
            while x < n:
                y = x
                while y < n and free[y]:
                    y += 1
                if y - x >= k:
                    waiting[y - x].append((i + x, j + x))
                x = y + 1
    return out


def seed_table(texts: DataFrame, k: int = MIN_MATCH) -> DataFrame:
    """(key, seed, n, n_words) for every distinct window of ``text``: how often it stands there, and the text's words."""
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            words = [words_of(x) for x in batch.column(1).to_pylist()]
            seeds = [np.unique(rolling(word_hashes(w), k), return_counts=True) for w in words]
            sizes = [len(x) for x, _ in seeds]
            which = pa.array(np.repeat(np.arange(len(seeds)), sizes))
            flat = np.concatenate([*(x for x, _ in seeds), np.zeros(0, np.uint64)]).view(np.int64)
            counts = np.concatenate([*(n for _, n in seeds), np.zeros(0, np.int64)]).astype(np.int64)
            columns = [batch.column(0).take(which), pa.array(flat), pa.array(counts), pa.array(np.repeat([len(w) for w in words], sizes).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "seed", "n", "n_words"])

    return texts.select("key", "text").mapInArrow(run, f"key {kind}, seed long, n long, n_words long")


def needed_seeds(item_seeds: DataFrame, doc_seeds: DataFrame, k: int, coverage: float) -> DataFrame:
    """(seed, item_key): the seeds that must be looked for so that no contaminated document is missed.

    Tiles of ``k`` words or more that cover ``coverage`` of the item hold at least ``need`` of its windows, one a tile
    at least and one more for each word beyond k. So windows may be left out while their places are fewer than
    ``need``; those of the seeds that most documents share go first. One item's seeds, bounded by its length, are
    ranked in one task; documents are counted by partial sums.
    """
    met = doc_seeds.join(item_seeds.select("seed").distinct(), "seed", "left_semi").groupBy("seed").agg(F.count("*").alias("n_docs"))
    by_item = Window.partitionBy("key").orderBy(F.desc("n_docs"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    need = F.ceil(F.ceil(F.lit(coverage) * F.col("n_words") - 1e-9) / k)
    ranked = item_seeds.join(met, "seed").withColumn("out", F.sum("n").over(by_item))
    return ranked.filter(F.col("out") >= need).select("seed", F.col("key").alias("item_key"))


class Bench:
    """Items with the places of their seeds, as sorted arrays: 16 bytes a word beside the texts. Words are cut again where
    a text shares a seed."""

    def __init__(self, items: list[tuple[object, str]], k: int):
        self.k, self.items, hashes = k, items, []
        for _, text in items:
            hashes.append(rolling(word_hashes(words_of(text)), k))
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        seeds = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        del hashes
        order = np.argsort(seeds, kind="stable")  # of equal seeds by item and place
        self.seeds = seeds[order]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), sizes)[order]
        self.place = (np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]

    def covered(self, text: str | None):
        """(item_id, words covered, words of the item, tiles) of every item that shares a seed with the text."""
        words = words_of(text)
        if len(words) < self.k or not len(self.seeds):
            return
        h = rolling(word_hashes(words), self.k)
        low, high = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        by_item = defaultdict(list)
        for j in np.flatnonzero(high > low).tolist():
            at = slice(low[j], high[j])
            for n, i in zip(self.item[at].tolist(), self.place[at].tolist()):
                by_item[n].append((i, j))
        for n, at in sorted(by_item.items()):
            item = words_of(self.items[n][1])
            found = tiles(item, words, at, self.k)
            yield self.items[n][0], sum(x[2] for x in found), len(item), found


def contaminated(docs: DataFrame, items: DataFrame, k: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row a document and item whose words are covered to ``coverage`` or more: doc_id, item_id, n_covered,
    n_item, n_tiles, coverage, contaminated (true).

    Items of fewer than ``k`` words have no seed and contaminate nothing; null texts have no words. Repeated rows
    of documents or items give repeated rows, rows that share an id or have none count each by its own text. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    docs = docs.select("doc_id", "text")
    small_batches(spark)
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    shape = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_covered int, n_item int, n_tiles int"

    def row(doc_id, item_id, n_covered, n_item, found):
        return {"doc_id": doc_id, "item_id": item_id, "n_covered": n_covered, "n_item": n_item, "n_tiles": len(found)}

    item_type = _arrow_type(items)
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = of_worker(("bench", shared, k), lambda: Bench(shared.value, k))
            for batch in portions(batches, 1):
                rows = [row(d, *x) for d, t in zip(*(c.to_pylist() for c in batch.columns)) for x in bench.covered(t) if x[1] >= coverage * x[2]]
                yield pa.RecordBatch.from_pylist(rows, _arrow(batch.schema.field(0).type, item_type))

        found = docs.mapInArrow(scan, shape)
    else:
        # Texts meet by their digests; ids may be null or shared and only come back with the rows.
        digest = F.md5("text")
        item_seeds, at_items = written(seed_table(items.select(digest.alias("key"), "text").dropDuplicates(["key"]), k), "bench-seeds")
        doc_seeds = seed_table(docs.select(digest.alias("key"), "text"), k)
        known, at_known = written(doc_seeds.join(item_seeds.select("seed").distinct(), "seed", "left_semi"), "doc-seeds")
        wanted = needed_seeds(item_seeds, known, k, coverage)
        pairs, _ = written(known.select(F.col("key").alias("doc_key"), "seed").join(wanted, "seed").select("doc_key", "item_key").distinct(), "bench-pairs")
        for path in (at_items, at_known):
            remove(spark, path)
        own_items = items.select("item_id", F.col("text").alias("item_text"), digest.alias("item_key"))
        both = pairs.join(docs.withColumn("doc_key", digest), "doc_key").join(own_items, "item_key")

        def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, 2):
                rows = [
                    row(d, *x)
                    for d, i, t, it in zip(*(c.to_pylist() for c in batch.columns))
                    for x in Bench([(i, it)], k).covered(t)
                    if x[1] >= coverage * x[2]
                ]
                yield pa.RecordBatch.from_pylist(rows, _arrow(batch.schema.field(0).type, item_type))

        found = both.select("doc_id", "item_id", "text", "item_text").mapInArrow(tile, shape)
    return found.withColumn("coverage", F.col("n_covered") / F.col("n_item")).withColumn("contaminated", F.lit(True))


def _arrow_type(items: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(items.schema["item_id"].dataType)


def _arrow(doc_type: pa.DataType, item_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", doc_type), ("item_id", item_type), ("n_covered", pa.int32()), ("n_item", pa.int32()), ("n_tiles", pa.int32())])


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """All rows and columns of documents that hold no benchmark item. Each row goes or stays by its own text, whatever
    rows share its id: the text's digest stands for it."""
    name = unused(docs, "_bad_key")
    keyed = docs.select(F.md5("text").alias("doc_id"), "text")
    bad, _ = written(contaminated(keyed, items, **how).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(bad, F.md5(docs["text"]) == bad[name], "left_anti")


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
