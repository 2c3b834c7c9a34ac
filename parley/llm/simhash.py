"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are compared among distinct values only. Two values at Hamming distance 2 or less agree on two
of four 16-bit blocks, so each pair of blocks is a bucket key. Inside buckets, fingerprints lie as vertical bit
planes; all pairs at one shift along the sorted rows are compared at once: planes are XORed with their shifted
selves, carry-save counters add the 64 difference bits lane by lane, and words whose lanes all exceed the
radius are abandoned. A bucket yields a spanning forest of its links, never all pairs. Buckets above
``HOT_BUCKET`` values are linked exactly by shared one-bit neighbours instead, whose groups hold 65 values at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import portions, remove, small_batches, table, written
from parley.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
HOT_BUCKET = 2048
_PART = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash over XXH64 of word shingles (ASCII lower case); a bit is set if more than half the hashes set it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - k + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[k - 1 :] - 1).tolist() if len(words) >= k else [len(line)]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _PART):  # long texts in parts: memory stays bounded
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[i : i + _PART], stops[i : i + _PART])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)  # parts are shorter than 2**16
    set_bits = np.flatnonzero(2 * ones > n)
    return int(sum(1 << int(b) for b in set_bits))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; null and empty texts have 0."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) planes: bit r of word w of plane p is bit p of fingerprint 64*w + r."""
    pad = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    pad[: len(fps)] = fps
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def _shifted(plane: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
    """Words ``at`` of a plane (padded by two words and more) moved down by ``shift`` lanes."""
    word, bit = divmod(shift, 64)
    low = plane[at + word]
    return low if not bit else (low >> np.uint64(bit)) | (plane[at + word + 1] << np.uint64(64 - bit))


def _above(counts: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose bit-sliced count is more than ``limit``."""
    more, same = np.zeros_like(counts[0]), np.full_like(counts[0], ~np.uint64(0))
    for i in reversed(range(len(counts))):
        if limit >> i & 1:
            same &= counts[i]
        else:
            more |= same & counts[i]
            same &= ~counts[i]
    return more


def close_pairs_at(fps: np.ndarray, group: np.ndarray, shift: int, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows i where i and i + shift lie in one group at distance ``radius`` or less, and the distances.

    Counters of as many planes as the radius has bits take the 64 difference bits of all lanes; words whose lanes are
    all beyond the radius are abandoned.
    """
    n = len(fps)
    if n <= shift:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alike = np.zeros(planes.shape[1] * 64, bool)
    alike[: n - shift] = group[:-shift] == group[shift:]
    over = ~np.packbits(alike, bitorder="little").view(np.uint64)
    at = np.flatnonzero(~over)
    over = over[at]
    counts = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    for p in range(64):
        carry = planes[p][at] ^ _shifted(planes[p], at, shift)
        for i, held in enumerate(counts):
            counts[i], carry = held ^ carry, held & carry
        over |= carry
        if p % 8 == 7 or (p > 55 and radius < 4):
            over |= _above(counts, radius)
            live = over != ~np.uint64(0)
            if not live.all():
                at, over, counts = at[live], over[live], [c[live] for c in counts]
                if not len(at):
                    return at, at
    rows, lanes = np.nonzero(~_lanes(over))
    distance = sum((_lanes(c)[rows, lanes].astype(np.int64) << i) for i, c in enumerate(counts))
    return at[rows] * 64 + lanes, distance


def close_pairs(fps: np.ndarray, group: np.ndarray, shift: int, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    return close_pairs_at(fps, group, shift, planes, radius)[0]


def grouped_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int, int]]:
    """(i, j, distance) of all pairs of rows with equal keys (rows are sorted by key) within the radius, by growing j - i.

    Groups whose pairs are all done are dropped on the way, so what is left for large shifts is the large groups.
    """
    start = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(start)
    size = np.bincount(group)[group] if len(group) else group
    place = np.flatnonzero(size > 1)
    longest = int(size.max()) if len(place) else 0
    kept = -1
    for shift in range(1, longest):
        live = size[place] > shift
        if kept < 0 or 2 * live.sum() < kept:
            place = place[live]
            kept = len(place)
            planes = np.pad(bit_planes(fps[place]), ((0, 0), (0, longest // 64 + 2)))
        rows, distances = close_pairs_at(fps[place], group[place], shift, planes, radius)
        yield from zip(place[rows].tolist(), place[rows + shift].tolist(), distances.tolist())


def spanning_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links inside groups of equal keys; rows are sorted by key."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j, _ in grouped_pairs(keys, fps, radius):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(fps[i]), int(fps[j])))
    return links


def _bucket_keys():
    """Six keys of a fingerprint: two of its four blocks, tagged by which two."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [
        F.struct(F.lit(tag).alias("tag"), F.shiftleft(block[i], 16).bitwiseOR(block[j]).alias("key"))
        for tag, (i, j) in enumerate(combinations(range(4), 2))
    ]
    return F.explode(F.array(*keys))


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(src, dst): links between distinct fingerprints (fp), enough of them to connect all that are reachable."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp", _bucket_keys().alias("k")).select("fp", "k.tag", "k.key")
    hot, _ = written(keyed.groupBy("tag", "key").count().filter(F.col("count") > hot_bucket).select("tag", "key"), "hot-buckets")
    any_hot = not hot.isEmpty()
    cold = keyed.join(hot, ["tag", "key"], "left_anti") if any_hot else keyed
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        held, n = [tail], 0

        def compare(keys, fps):
            pairs = np.array(spanning_links(keys, fps), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

        for batch in batches:
            keys = batch.column(0).to_numpy() * np.int64(1 << 32) + batch.column(1).to_numpy()
            held.append((keys, batch.column(2).to_numpy().view(np.uint64)))
            n += len(keys)
            if n < 32_768:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held))
            others = np.flatnonzero(keys != keys[-1])
            whole = int(others[-1]) + 1 if len(others) else 0  # the last bucket may go on
            if whole:
                yield compare(keys[:whole], fps[:whole])
            held, n = [(keys[whole:], fps[whole:])], len(keys) - whole
        keys, fps = (np.concatenate(x) for x in zip(*held))
        if len(keys):
            yield compare(keys, fps)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = cold.select(F.col("tag").cast("long").alias("tag"), "key", "fp").repartition(parts, "tag", "key")
    found = dealt.sortWithinPartitions("tag", "key").mapInArrow(run, "src long, dst long")
    if not any_hot:
        return found
    near = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    inside = keyed.join(hot, ["tag", "key"], "left_semi").select("fp").distinct()
    shared = inside.select("fp", F.explode(F.transform(near, lambda m: F.col("fp").bitwiseXOR(m))).alias("near"))
    least = F.min("fp").over(Window.partitionBy("near"))  # 65 rows at most
    return found.union(shared.select(F.col("fp").alias("src"), least.alias("dst")).filter("src <> dst").distinct())


def near_duplicates(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, the row's own included) of every row.

    Null and empty texts share fingerprint zero, so they link. Repeated rows stay. A null id never is the smallest;
    a component of null ids alone has a null id. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prints, _ = written(fingerprints(docs), "fingerprints")
    least = F.min("doc_id").alias("least_id")
    distinct, at_distinct = written(prints.groupBy("fp").agg(least), "distinct-fps")
    roots = connected_components(links(distinct.select("fp"), hot_bucket))
    linked, at_linked = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "fp-roots")
    classes = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_fps"))
    # Only components of several fingerprints need a second look; the others keep their own smallest id.
    several, at_several = written(classes.filter("n_fps > 1").select("root", "component_id"), "fp-classes")
    named = linked.join(several, "root", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    named, _ = written(named, "fp-components")
    for path in (at_distinct, at_linked, at_several):
        remove(spark, path)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
