"""Near duplicates by word shingles: SimHash fingerprints compared in bit-sliced blocks, links confirmed exactly.

Texts with the same set of ``SHINGLE``-word shingles count as one. The sets meet in buckets: least hashes of a set
under several functions, ``BAND`` of them a bucket (sets of Jaccard similarity 0.8 share one of ``BANDS`` buckets but for 2
cases in 10,000). In a bucket, SimHash fingerprints are compared as bit planes within a wide radius, and the closest
pairs make a spanning forest; every pair of it is confirmed by the similarity of its sets. Where a refuted pair parts what
the forests hold together, all sets of that family are compared (``parted_links``). A bucket of ``BLOCK_ROWS`` sets at most
is compared whole. A larger one is first compared in blocks of neighbours, dealt in ranges of its sets' other buckets; then
each block of it with each, but for those that are one and the same group by then (``bridges``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import portions, remove, small_batches, text_key, written
from parley.llm.components import connected_components
from parley.llm.simhash import SEED, grouped_pairs
from parley.operators.order import running_by

SHINGLE = 5
SIMILARITY = 0.8
#: Buckets of a set, and least hashes in a bucket's key.
BANDS = 16
BAND = 4
#: Differing bits of 64 up to which a pair is looked at; sets of similarity 0.8 differ in 10 of them, in 20 hardly ever.
RADIUS = 20
BLOCK_ROWS = 2048
#: Rows of a block of a large bucket that are compared with those of another, and rows that are compared at once.
TILE_ROWS = 1 << 14
_STEP = 1024
#: Shingles of the sets that are compared with each other at once; larger families are compared block by block.
TILE_SHINGLES = 1 << 19
_PART = 1 << 15
_ODD = np.random.default_rng(7).integers(1, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the text's k-word shingles (ASCII lower case; fewer words: all of them; none: empty)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - k + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[k - 1 :] - 1).tolist() if len(words) >= k else [len(line)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n))


def _marks(found: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """Digest, SimHash and bucket keys of a shingle set."""
    digest = xxhash.xxh3_128_digest(found.tobytes())
    if not len(found):
        return digest, 0, np.zeros(0, np.int64)
    ones, least = np.zeros(64, np.int64), np.full(BANDS * BAND, ~np.uint64(0))
    for a in range(0, len(found), _PART):  # long texts in parts: memory stays bounded
        part = found[a : a + _PART]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
        for b in range(0, len(part), 1024):
            mixed = part[b : b + 1024, None] * _ODD
            least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)).min(0))
    fp = np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0]
    keys = [xxhash.xxh64_intdigest(least[BAND * i : BAND * (i + 1)].tobytes(), i) for i in range(BANDS)]
    return digest, int(fp), np.array(keys, np.uint64).view(np.int64)


def marked(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, set_key, fp, n (shingles of the set), keys (its buckets) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            sets = [shingle_set(x, k) for x in batch.column(2).to_pylist()]
            digests, fps, keys = zip(*map(_marks, sets)) if sets else ((), (), ())
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            flat = pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))
            columns = [pa.array(digests, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(list(map(len, sets)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "text_key", "set_key", "fp", "n", "keys"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, set_key binary, fp long, n int, keys array<long>")


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    src, dst = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], names=["src", "dst"])


def _in_blocks(dealt: DataFrame, pairs_of: Callable[[pa.Table], list[tuple[bytes, bytes]]], block_rows: int) -> DataFrame:
    """(src, dst) that ``pairs_of`` finds in blocks of bucket rows: key, n, fp, set_key, sorted by key in every task.

    Blocks hold whole buckets of up to ``block_rows`` rows; a larger one, or one that tasks share, comes in parts, which
    ``bridges`` must join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, block_rows - count)
                held.append(piece)
                at, count = at + piece.num_rows, count + piece.num_rows
                if count < block_rows:
                    continue
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield _links(pairs_of(pa.Table.from_batches([table])))
                keys = table.column(0).to_numpy()
                tail = int(np.searchsorted(keys, keys[-1]))  # sorted by key: where the last bucket begins
                held = [table.slice(tail) if tail else table.slice(0, 1)]
                count = held[0].num_rows
        if count:
            yield _links(pairs_of(pa.Table.from_batches(held)))

    return dealt.mapInArrow(run, "src binary, dst binary").distinct()


def _close(table: pa.Table, similarity: float) -> Iterator[tuple[int, int, int]]:
    """(distance, i, j) of rows of a block that share a bucket, lie within RADIUS and have sizes near enough."""
    n = table["n"].to_numpy()
    for i, j, d in grouped_pairs(table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64), RADIUS):
        if min(n[i], n[j]) >= similarity * max(n[i], n[j]):
            yield d, i, j


def bridging(fps: np.ndarray, n: np.ndarray, labels: np.ndarray, first: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs (i, j) of a tile's rows that lie within RADIUS, have sizes near enough, and join groups (``labels``, from 0) that
    such pairs join: no more than it takes, close ones first. The ``first`` rows are one block, the others another; without
    others all pairs are looked at, else those across."""
    labels, group, out = labels.copy(), np.arange(int(labels.max(initial=-1)) + 1), []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    across, far = first < len(fps), np.uint8(255)
    for a in range(0, first, _STEP):
        mine = slice(a, min(a + _STEP, first))
        for b in range(first if across else a, len(fps), _STEP):
            other = slice(b, b + _STEP)
            if (labels[mine] == labels[a]).all() and (labels[other] == labels[a]).all():
                continue
            distance = np.bitwise_count(fps[mine, None] ^ fps[None, other])
            near = distance <= RADIUS
            near &= (n[None, other] >= similarity * n[mine, None]) & (n[mine, None] >= similarity * n[None, other])
            while (near := near & (labels[mine, None] != labels[None, other])).any():  # every group that can grow does
                left = np.where(near, distance, far)
                down, right = left.argmin(0), left.argmin(1)
                at = np.concatenate([np.stack([np.arange(len(right)), right], 1), np.stack([down, np.arange(len(down))], 1)])
                reach = left[at[:, 0], at[:, 1]]
                for k in np.argsort(reach, kind="stable")[: int((reach < far).sum())].tolist():
                    i, j = a + int(at[k, 0]), b + int(at[k, 1])
                    x, y = root(labels[i]), root(labels[j])
                    if x != y:
                        group[max(x, y)] = min(x, y)
                        out.append((i, j))
                while (group[group] != group).any():
                    group[:] = group[group]
                labels = group[labels]
    return out


def _tiles(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """The rows in tables of equal numbers in the first ``by`` columns, by which they are sorted."""
    held, last = [], None
    for batch in batches:
        ids = np.stack([batch.column(i).to_numpy() for i in range(by)])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and (ids[:, a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = ids[:, a]
    if held:
        yield pa.Table.from_batches(held)


def bridges(rows: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(src, dst) that join what ``pairs`` leave apart of sets that share a bucket of ``rows`` (key, set_key, fp, n; each
    bucket whole), lie within RADIUS and have sizes near enough.

    A bucket's rows, ordered by what ``pairs`` hold together, are cut in blocks of ``tile_rows`` and each is compared with
    each, but for two of one and the same group. A tile gives fewer pairs than it has groups.
    """
    spark = rows.sparkSession
    small_batches(spark)
    labels = connected_components(pairs).select(F.col("node").alias("set_key"), F.col("root").alias("label"))
    rows = rows.join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    rows = running_by(rows, ["key"], ["label", "set_key"], {"ahead": F.lit(1)})
    rows, _ = written(rows.select("key", F.floor(F.col("ahead") / tile_rows).cast("int").alias("block"), "label", "set_key", "fp", "n"), "bucket-rows")
    blocks = rows.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pure = (F.col("a.low") == F.col("b.high")) & (F.col("a.high") == F.col("b.low"))
    tiles = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block")) & ~pure)
    tiles = tiles.select("a.key", F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    sides = tiles.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
    members = sides.join(rows, ["key", "block"]).select("key", "one", "two", "block", "label", "set_key", "fp", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches, 3):
            names, label = tile["set_key"].combine_chunks(), tile["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            fps, n = tile["fp"].to_numpy().view(np.uint64), tile["n"].to_numpy()
            first = int((tile["block"].to_numpy() == tile["one"].to_numpy()).sum())
            found = bridging(fps, n, label, first, similarity)
            yield _links([tuple(sorted((names[i].as_py(), names[j].as_py()))) for i, j in found])

    dealt = members.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "block", "label", "set_key")
    return dealt.mapInArrow(run, "src binary, dst binary").distinct()


def candidate_pairs(sets: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(src, dst): pairs of sets (set_key, fp, n, keys) that share a bucket, lie within RADIUS and have sizes near enough,
    such that all of these pairs are held together: of every bucket of ``block_rows`` at most a spanning forest, closest
    pairs first; of a larger one forests of blocks of neighbours, and pairs that join them (``bridges``)."""

    def forest(table: pa.Table) -> list[tuple[bytes, bytes]]:
        names = table["set_key"].to_pylist()
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for _, i, j in sorted(_close(table, similarity)):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append(tuple(sorted((names[i], names[j]))))
        return out

    spark = sets.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = sets.filter("n > 0").select("set_key", "fp", "n", "keys", F.posexplode("keys").alias("at", "key"))
    large, at_large = written(rows.groupBy("key").count().filter(F.col("count") > block_rows).select("key"), "large-buckets")
    small = rows if (none := large.isEmpty()) else rows.join(large, "key", "left_anti")
    whole = small.select("key", "n", "fp", "set_key").repartition(parts, "key").sortWithinPartitions("key", "n", "set_key")
    found = _in_blocks(whole, forest, block_rows)
    if none:
        remove(spark, at_large)
        return found
    rows = rows.join(large, "key", "left_semi")
    other = lambda i: F.get("keys", (F.col("at") + i) % BANDS)
    rows, _ = written(rows.select("key", other(1).alias("next"), other(2).alias("after"), "n", "fp", "set_key"), "large-rows")
    order = ["key", "next", "after", "n", "set_key"]
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)  # a large bucket spreads over tasks
    found, _ = written(found.union(_in_blocks(spread.select("key", "n", "fp", "set_key"), forest, block_rows)).distinct(), "block-pairs")
    remove(spark, at_large)
    return found.union(bridges(rows.select("key", "set_key", "fp", "n"), found, similarity, tile_rows))


def confirmed(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (src, dst) whose shingle sets have a Jaccard similarity of ``similarity`` or more; ``texts``: set_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            keep, last, held = [], None, None
            for key, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key != last:
                    last, held = key, shingle_set(a, k)
                other = shingle_set(b, k)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(both >= similarity * (len(held) + len(other) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: texts.select(F.col("set_key").alias(side), F.col("text").alias(f"{side}_text"))
    both = pairs.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", "src_text", "dst_text")
    return both.mapInArrow(run, "src binary, dst binary").distinct()


def tile_links(sets: list[np.ndarray], roots: list[bytes], first: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links between the groups ``roots`` of a tile's sets: pairs of roots, of sets whose similarity is ``similarity`` or
    more, no more than join the groups. The ``first`` sets are one block, the others another; without others, or in one
    block, all pairs are looked at, else those across. Shared shingles are counted by an inverted index."""
    n_sets = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n_sets)
    _, ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    held_by = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    holders, ends = np.repeat(np.arange(n_sets), sizes)[order], np.cumsum(held_by)  # holders of an id, in order
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    row = np.where(held_by * 16 > n_sets, np.cumsum(held_by * 16 > n_sets) - 1, -1)  # ids that many sets hold stand in a table
    table = np.zeros((int(row.max(initial=-1)) + 1, n_sets), np.uint8)
    often = row[ids[order]]
    table[often[often >= 0], holders[often >= 0]] = 1
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    names = list(number)
    label = np.array([number[r] for r in roots])  # the group of each set, kept up to date
    starts, out = np.cumsum(sizes) - sizes, []
    across = first < n_sets
    for i in range(first if across else n_sets):
        mine = slice(starts[i], starts[i] + sizes[i])
        own, begin = ids[mine], first if across else i + 1
        shared = np.zeros(n_sets - begin, np.int64)
        rows = row[own]
        if (rows >= 0).any():
            shared += np.add.reduce(table[rows[rows >= 0], begin:], axis=0, dtype=np.int32)
        few = rows < 0
        low, high = place[mine][few] + 1, ends[own[few]]  # later holders of the same shingles
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared += np.bincount(holders[at], minlength=n_sets)[begin:]
        near = np.flatnonzero((shared >= similarity * (sizes[begin:] + sizes[i] - shared) - 1e-9) & (shared > 0) & (label[begin:] != label[i]))
        for j in (near + begin).tolist():
            if label[i] != label[j]:
                out.append((names[label[i]], names[label[j]]))
                label[label == label[j]] = label[i]
    return out


def parted_links(labelled: DataFrame, texts: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, str]:
    """(src, dst) roots of groups that similar sets of one family join, and the path where they are written. ``labelled``:
    set_key, n, root, family.

    A refuted pair of a bucket's forest may have stood for a true one. All pairs that share a bucket, and are near enough
    by their fingerprints, lie in one group or in one family (groups that refuted pairs hold together), so families are
    compared whole: in blocks of ``TILE_SHINGLES``, ordered by group, each with each; two blocks of one and the same group are not.
    """
    spark = labelled.sparkSession
    rows = running_by(labelled.select("family", "root", "set_key", "n"), ["family"], ["root", "set_key"], {"ahead": F.col("n").cast("long")})
    rows, at_rows = written(rows.select("family", "root", "set_key", F.floor(F.col("ahead") / TILE_SHINGLES).cast("int").alias("block")), "families")
    blocks = rows.groupBy("family", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pure = (F.col("a.low") == F.col("b.high")) & (F.col("a.high") == F.col("b.low"))
    tiles = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.block") <= F.col("b.block")) & ~pure)
    tiles = tiles.select("a.family", F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    sides = tiles.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
    members = sides.join(rows, ["family", "block"]).join(texts, "set_key").select("family", "one", "two", "block", "set_key", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets, roots, first = None, [], [], 0

        def links() -> pa.RecordBatch:
            return _links(tile_links(sets, roots, first, similarity))

        for batch in portions(batches, 6):
            for family, one, two, block, root, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6))):
                if (family, one, two) != tile:
                    if sets:
                        yield links()
                    tile, sets, roots, first = (family, one, two), [], [], 0
                sets.append(shingle_set(text, k))
                roots.append(root)
                first += block == one
        if sets:
            yield links()

    small_batches(spark)
    dealt = members.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two", "block", "root", "set_key")
    found = written(dealt.mapInArrow(run, "src binary, dst binary").distinct(), "parted-links")
    remove(spark, at_rows)
    return found


def groups(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(root, least) of every group: least names its first row by doc_id (null last) and text_key.

    Null and empty texts have the empty set and are one group. Rows that share an id are told apart by their text.
    """
    spark = docs.sparkSession
    prints, at_prints = written(marked(docs, k), "marked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least")
    sets, at_sets = written(prints.groupBy("set_key").agg(least, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "sets")
    remove(spark, at_prints)
    pairs, at_pairs = written(candidate_pairs(sets, similarity, BLOCK_ROWS), "set-pairs")
    wanted = pairs.select(F.col("src").alias("set_key")).union(pairs.select("dst")).distinct()
    chosen, at_chosen = written(sets.join(wanted, "set_key", "left_semi"), "candidates")
    of = chosen.select("set_key", F.col("least.doc_id").alias("of_id"), F.col("least.text_key").alias("of_key"))
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    texts = rows.join(of, (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("set_key", "text")
    texts, at_texts = written(texts, "set-texts")
    roots = connected_components(confirmed(pairs, texts, k, similarity)).select(F.col("node").alias("set_key"), "root")
    labelled, at_labelled = written(chosen.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")), "labelled")
    root_of = lambda side: labelled.select(F.col("set_key").alias(side), F.col("root").alias(f"{side}_root"))
    refuted = pairs.join(root_of("src"), "src").join(root_of("dst"), "dst").filter("src_root <> dst_root").select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"))
    families = connected_components(refuted).select(F.col("node").alias("root"), F.col("root").alias("family"))
    links, at_links = parted_links(labelled.join(families, "root"), texts, k, similarity)
    merged = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    final = labelled.join(merged, "root", "left").select("set_key", F.coalesce("to", "root").alias("root"))
    linked = sets.join(final, "set_key", "left").select(F.coalesce("root", "set_key").alias("root"), "least")
    linked, _ = written(linked, "set-roots")
    for path in [at_chosen, at_texts, at_pairs, at_labelled, at_links, at_sets]:
        remove(spark, path)
    return linked.groupBy("root").agg(F.min("least").alias("least"))


def survivors(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key) of one row a group: the smallest id, of rows with that id (or of null ids alone) the least text_key."""
    return groups(docs, k, similarity).select("least.doc_id", "least.text_key")
