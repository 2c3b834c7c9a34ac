"""Connected components of an edge table, in Spark, by alternating stars of blocks and of neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import remove, written

#: A node's edges are dealt over so many parts, so that the root of a huge component is no single task's load.
SALTS = 8
MAX_ROUNDS = 60
#: Edges that a task holds at once.
BLOCK_EDGES = 1 << 17


def _with_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Add ``least``, the smallest of the node and its neighbours, by a salted join."""
    least = edges.groupBy(node).agg(F.min(F.least(node, other)).alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return salted.join(least, [node, "salt"]).drop("salt")


def _block_stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(src, dst): every node of the edges but the least of what they hold together, and that one."""
    src, dst = (pa.chunked_array([b.column(i) for b in batches]).combine_chunks() for i in (0, 1))
    names = pa.chunked_array([src, dst]).unique()
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(x, names).to_numpy() for x in (src, dst))
    own = np.arange(len(names))
    least = own.copy()
    while len(a):
        x, y = least[a], least[b]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    joined = np.flatnonzero(least != own)
    return pa.RecordBatch.from_arrays([names.take(pa.array(joined)), names.take(pa.array(least[joined]))], names=["src", "dst"])


def contracted(edges: DataFrame) -> DataFrame:
    """(src, dst) that hold together what ``edges`` do: stars of the blocks, ``BLOCK_EDGES`` or little more, that tasks read."""
    limit = BLOCK_EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= limit:
                yield _block_stars(held)
                held, count = [], 0
        if count:
            yield _block_stars(held)

    return edges.mapInArrow(run, edges.schema)


def _starred(edges: DataFrame) -> DataFrame:
    """Neighbours linked to the least node around them: large star, then small star."""
    both = edges.union(edges.select("dst", "src"))
    large = _with_least(both, "src", "dst").filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
    starred = _with_least(large, "src", "dst")
    small = starred.filter("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return small.union(starred.select("src", F.col("least").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes that keep them from being stars: sources of several edges, or of one and a target."""
    end = lambda side: F.struct(F.col(side).alias("node"), F.lit(int(side == "src")).alias("up"), F.lit(int(side == "dst")).alias("down"))
    ends = edges.select(F.explode(F.array(end("src"), end("dst"))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst); root is the least node reachable.

    Tasks first make stars of the edges they hold, in blocks (``contracted``); where blocks share nodes, neighbours are
    linked to the least node around them, by shuffles. These steps take turns until all edges are stars, and each is written
    out, which cuts the lineage. Rounds go with the logarithm of the component's size; edges that fit in one block need
    none. Loops, repeated edges and an empty table are fine; edges with a null end are ignored.
    """
    spark = edges.sparkSession
    pairs = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now, path = written(contracted(pairs), "edges")
    for turn in range(2 * MAX_ROUNDS):
        count, astray = _state(now)
        if not astray:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(
                now.select("dst").distinct().select(F.col("dst").alias("node"), F.col("dst").alias("root"))
            )
        new, new_path = written(_starred(now) if turn % 2 else contracted(now.coalesce(-(-count // BLOCK_EDGES))), "edges")
        remove(spark, path)
        now, path = new, new_path
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
