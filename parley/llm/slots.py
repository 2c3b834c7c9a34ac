"""Sharding by fixed virtual slots.

Every record hashes into one of ``n_slots`` fixed slots. Slots, never records, belong to shards: a
versioned slot-to-shard map is aggregated, stored and edited, so a rebalance moves whole slots and
leaves the rest where they are. Only the per-slot totals (``n_slots`` rows, a parameter) reach the
driver; records are numbered inside their shard from slot offsets, so no task ever holds a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import new_path, table, written

N_SLOTS = 8192
#: Rows of a slot are numbered in so many parts, so that equal rows (which share a slot) are not one task's load.
PARTS = 8
MAP_SCHEMA = "version int, slot int, shard int, n_rows long, n_bytes long"


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (null text: 0), vslot, part (by the row's
    place; write the rows before it is used twice).

    A record's slot depends on its id and text alone, so repeated rows share a slot; a null id is hashed
    like any other value. Texts that many ids share spread over all slots.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text), F.lit(n_slots)).cast("int").alias("vslot"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int").alias("part"),
    )


def slot_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def initial_map(n_slots: int, n_shards: int) -> dict[int, int]:
    """Version 0: slots dealt in turn; needs no statistics."""
    return {s: s % n_shards for s in range(n_slots)}


def rebalance(slot_shard: dict[int, int], n_bytes: dict[int, int], n_shards: int) -> dict[int, int]:
    """Edit a map until no move of a slot brings the shards' bytes nearer to each other.

    Shards above the mean give up their largest slots that still fit under the mean of a shard below it;
    what no single slot can mend is mended by swapping a slot of the fullest shard for a smaller one of the
    emptiest. ``n_shards`` may exceed the shards in use: the new ones then fill up from the others. Or it may be less:
    the slots of the shards that go are dealt, the largest first, to the emptiest of the others.
    """
    out = dict(slot_shard)
    load = [0] * n_shards
    members: list[set[int]] = [set() for _ in range(n_shards)]
    for s, shard in out.items():
        if shard < n_shards:
            load[shard] += n_bytes.get(s, 0)
            members[shard].add(s)
    emptiest = [(x, i) for i, x in enumerate(load)]
    heapq.heapify(emptiest)
    for s in sorted((s for s, shard in out.items() if shard >= n_shards), key=lambda s: (-n_bytes.get(s, 0), s)):
        _, to = heapq.heappop(emptiest)
        out[s] = to
        members[to].add(s)
        load[to] += n_bytes.get(s, 0)
        heapq.heappush(emptiest, (load[to], to))
    mean = sum(load) / n_shards

    def move(s: int, a: int, b: int) -> None:
        out[s] = b
        members[a].discard(s)
        members[b].add(s)
        load[a] -= n_bytes.get(s, 0)
        load[b] += n_bytes.get(s, 0)

    under = [(load[i], i) for i in range(n_shards) if load[i] < mean]
    heapq.heapify(under)
    for a in sorted(range(n_shards), key=lambda i: -load[i]):
        for s in sorted((s for s in members[a] if n_bytes.get(s)), key=lambda s: (-n_bytes[s], s)):
            if not under or load[a] <= mean:
                break
            if load[a] - n_bytes[s] < mean - (load[a] - mean):
                continue
            low, b = heapq.heappop(under)
            if b != a and low == load[b] and low + n_bytes[s] < load[a]:
                move(s, a, b)
            if load[b] < mean:
                heapq.heappush(under, (load[b], b))
    for _ in range(64 * n_shards):
        a, b = max(range(n_shards), key=lambda i: (load[i], -i)), min(range(n_shards), key=lambda i: (load[i], i))
        gap = load[a] - load[b]
        best = _best_swap(members[a], members[b], n_bytes, gap)
        if best is None:
            break
        give, take = best
        if give is not None:
            move(give, a, b)
        if take is not None:
            move(take, b, a)
    return out


def _best_swap(full: set[int], empty: set[int], n_bytes: dict[int, int], gap: int):
    """The slot to give and the slot to take (either may be None) that leave the smallest gap below ``gap``."""
    give = sorted((n_bytes.get(s, 0), s) for s in full)
    take = sorted((n_bytes.get(s, 0), s) for s in empty)
    take.insert(0, (0, None))
    best, best_gap, j = None, gap, 0
    for size, s in give:
        while j + 1 < len(take) and abs(gap - 2 * (size - take[j + 1][0])) <= abs(gap - 2 * (size - take[j][0])):
            j += 1
        left = abs(gap - 2 * (size - take[j][0]))
        if left < best_gap:
            best, best_gap = (s, take[j][1]), left
    return best


def store_map(spark: SparkSession, path: str, version: int, slot_shard: dict[int, int], totals: dict[int, tuple[int, int]]) -> None:
    """Write one version of a map (``n_slots`` rows) beside the others; a version once written is not changed."""
    rows = [(version, s, shard, *totals.get(s, (0, 0))) for s, shard in sorted(slot_shard.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v{version:06d}")


def stored_maps(spark: SparkSession, path: str) -> DataFrame:
    """All versions under ``path``."""
    return spark.read.schema(MAP_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A stored version (the last one unless named) and its slot-to-shard map."""
    maps = stored_maps(spark, path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return version, {r["slot"]: r["shard"] for r in maps.filter(F.col("version") == version).collect()}  # n_slots rows


def edit_map(spark: SparkSession, path: str, rows: DataFrame, n_shards: int) -> int:
    """Load the last stored version, move what slots the bytes of ``rows`` (from ``slotted``) and ``n_shards`` ask for,
    store the next version and return its number. Slots that need not move stay where they are."""
    version, held = load_map(spark, path)
    totals = {r["vslot"]: (r["n_rows"], r["n_bytes"]) for r in slot_totals(rows).collect()}  # n_slots rows
    if not totals.keys() <= held.keys():
        raise ValueError(f"rows have slots that the map of {len(held)} slots at {path} lacks")
    store_map(spark, path, version + 1, rebalance(held, {s: b for s, (_, b) in totals.items()}, n_shards), totals)
    return version + 1


def placed(rows: DataFrame, path: str, version: int) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, pos by a stored version whose totals are those of ``rows``: pos counts on
    from slot to slot of a shard, from part to part of a slot, and in a part by id, digest and size."""
    maps = stored_maps(rows.sparkSession, path).filter(F.col("version") == version)
    before = lambda by, order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    layout = maps.select(F.col("slot").alias("vslot"), "shard", F.coalesce(F.sum("n_rows").over(before("shard", "slot")), F.lit(0)).alias("base"))
    parts = rows.groupBy("vslot", "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(before("vslot", "part")), F.lit(0)))
    layout = parts.join(layout, "vslot").select("vslot", "part", "shard", (F.col("base") + F.col("ahead")).alias("base"))
    within = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(layout), ["vslot", "part"])  # n_slots * PARTS rows at most
    return numbered.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("nth") - 1).alias("pos"))


def shard_by_slots(
    docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, grow_to: int | None = None, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Assign every row to a shard; return (rows, map versions).

    rows: doc_id, size, text_crc32, vslot, shard, pos (its place in the shard, gapless from 0). Law: bytes of
    shards near equal, as far as single slots allow. Under ``path`` version 0 of the map is stored (slots dealt in
    turn), then edited by bytes (version 1) and, with ``grow_to``, for more shards (version 2); rows follow version 1
    as it is read back. A ``path`` that holds a map already goes on from its last version, with that map's slots whatever
    ``n_slots`` says, and for fewer or more shards than it had. An empty table gives no rows and a map of empty slots.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "slot-map")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        n_slots = len(load_map(spark, path)[1])
    else:
        store_map(spark, path, 0, initial_map(n_slots, n_shards), {})
    rows, _ = written(slotted(docs, n_slots), "slots")
    version = edit_map(spark, path, rows, n_shards)
    if grow_to:
        edit_map(spark, path, rows, grow_to)
    return placed(rows, path, version), stored_maps(spark, path)


def op8_fixed_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shard_by_slots(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("pos").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
