"""Dynamic time warping between sessions, and clustering by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.order import held


#: Cells of the cost tables that a task fills at once. Longer pairs of series are aligned by halves.
TABLE_CELLS = 1 << 20
#: Cells of the anti-diagonals of many short pairs that are filled side by side: what a processor's cache holds.
SIDE_BY_SIDE_CELLS = 1 << 15


def _step(a: np.ndarray, b: np.ndarray, d: int, i: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Costs of the cells (i, d - i) from the two diagonals before, all kept by i (from 1)."""
    return (a[i - 1] - b[d - i - 1]) ** 2 + np.minimum(np.minimum(before[i - 1], last[i - 1]), last[i])


def edge_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of the paths from the first pair to (len(a) - 1, j) for every j: the table's last row.

    Three anti-diagonals are held at a time.
    """
    n, m = len(a), len(b)
    before, last, row = np.full(n + 1, np.inf), np.full(n + 1, np.inf), np.empty(m)
    before[0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        now = np.full(n + 1, np.inf)
        now[i] = _step(a, b, d, i, last, before)
        before, last = last, now
        if i[-1] == n:
            row[d - n - 1] = now[n]
    return row


def _whole_path(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Squared distance and path from the full table."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + np.minimum(np.minimum(cost[i - 1, j - 1], cost[i - 1, j]), cost[i, j - 1])
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda c: cost[c])
    return float(cost[n, m]), path[::-1]


def dtw(a: np.ndarray, b: np.ndarray, table_cells: int = TABLE_CELLS) -> tuple[float, list[tuple[int, int]]]:
    """Distance (root of the summed squared differences along the best path) and the path.

    Costs are filled along anti-diagonals, whose cells depend on the two before only. A table of more than
    ``table_cells`` is cut: where the best path crosses the middle row follows from the costs to that row and, backwards,
    from it; both halves are aligned by themselves. So memory goes with the series' lengths, time with their product.
    """
    if not len(a) or not len(b):
        return float("nan"), []
    cost, path, todo = 0.0, [], [(0, len(a), 0, len(b))]
    while todo:  # in order of the path
        i0, i1, j0, j1 = todo.pop()
        if (i1 - i0) * (j1 - j0) <= table_cells or i1 - i0 < 3:
            part, found = _whole_path(a[i0:i1], b[j0:j1])
            if path and path[-1] == (i0, j0):  # halves share the pair that they meet in
                part, found = part - float((a[i0] - b[j0]) ** 2), found[1:]
            cost += part
            path += [(i0 + i, j0 + j) for i, j in found]
            continue
        mid = (i0 + i1) // 2
        ahead = edge_costs(a[i0 : mid + 1], b[j0:j1])
        back = edge_costs(a[mid:i1][::-1], b[j0:j1][::-1])[::-1]
        j = j0 + int(np.argmin(ahead + back - (a[mid] - b[j0:j1]) ** 2))
        todo += [(mid, i1, j, j1), (i0, mid + 1, j0, j + 1)]
    return float(np.sqrt(cost)), path


def _side_by_side(a: np.ndarray, b: np.ndarray, table_cells: int) -> int:
    """How many rows of ``b`` are aligned with ``a`` at once; 0 where one row's table is too large."""
    n, m = len(a), b.shape[1]
    return max(1, SIDE_BY_SIDE_CELLS // (n + 1)) if (n + m + 1) * (n + 1) <= table_cells else 0


def distances_many(a: np.ndarray, b: np.ndarray, below: np.ndarray, table_cells: int = TABLE_CELLS) -> np.ndarray:
    """Distances of one series to many of one length (rows of ``b``); infinite where it is found to be above ``below``."""
    at_once = _side_by_side(a, b, table_cells)
    if not at_once:
        return np.array([dtw(a, row, table_cells)[0] for row in b])
    parts = [_fill(a, b[r : r + at_once], below=below[r : r + at_once]) for r in range(0, len(b), at_once)]
    return np.sqrt(np.concatenate([*parts, np.zeros(0)]))


def dtw_many(a: np.ndarray, b: np.ndarray, table_cells: int = TABLE_CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one series against many of one length (rows of ``b``): distances, and along each best path the sums of the
    row's values, and their number, at every place of ``a``. Rows are aligned side by side; one whose table alone is
    larger than ``table_cells`` is aligned by halves."""
    n, m = len(a), b.shape[1]
    distances, sums, counts = np.zeros(len(b)), np.zeros((len(b), n)), np.zeros((len(b), n))
    at_once = _side_by_side(a, b, table_cells)
    for r in range(0, len(b), at_once or 1):
        if at_once:
            part = b[r : r + at_once]
            ways = np.empty((2, n + m + 1, n + 1, len(part)), bool)
            distances[r : r + at_once] = np.sqrt(_fill(a, part, ways))
            sums[r : r + at_once], counts[r : r + at_once] = _along_paths(ways, part)
            continue
        distances[r], path = dtw(a, b[r], table_cells)
        i, j = np.array(path).T
        np.add.at(sums[r], i, b[r][j])
        np.add.at(counts[r], i, 1)
    return distances, sums, counts


def _fill(a: np.ndarray, b: np.ndarray, ways: np.ndarray | None = None, below: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of ``a`` to every row of ``b``. Cell (i, j) of a row r stands at [i, r] of its anti-diagonal, so
    that what is computed at once is one stretch of memory; three of them are held. ``ways`` takes at [0, i + j, i, r]
    whether the best path comes from i - 1, at [1, i + j, i, r] whether it comes from the same j. Rows all of whose paths
    cost more than the square of ``below`` already are left out, as infinite."""
    n, (size, m) = len(a), b.shape
    column, back = a[:, None], np.ascontiguousarray(b.T[::-1])
    before, last, now, best = (np.full((n + 1, size), np.inf) for _ in range(4))
    before[0] = 0
    row, out = np.arange(size), np.full(size, np.inf)
    limit = None if below is None else below**2 * (1 + 1e-12)
    for d in range(2, n + m + 1):
        low, high = max(1, d - m), min(n, d - 1) + 1
        both, up, left, cell, least = before[low - 1 : high - 1], last[low - 1 : high - 1], last[low:high], now[low:high], best[: high - low]
        now[0] = np.inf
        if d <= n:
            now[d] = np.inf
        np.subtract(column[low - 1 : high - 1], back[m - d + low : m - d + high], out=cell)
        np.multiply(cell, cell, out=cell)
        np.minimum(both, up, out=least)
        if ways is not None:  # of equal ways the first of both, up, left
            np.less_equal(least, left, out=ways[0, d, low:high])
            np.less(up, both, out=ways[1, d, low:high])
            ways[1, d, low:high] &= up <= left
        np.minimum(least, left, out=least)
        cell += least
        before, last, now = last, now, before
        if limit is not None and d % 16 == 0 and d < n + m:
            cheapest = last[low:high].min(axis=0)
            if d > 2:
                cheapest = np.minimum(cheapest, before[max(1, d - 1 - m) : min(n, d - 2) + 1].min(axis=0))
            live = cheapest <= limit
            if 4 * live.sum() < 3 * len(live):
                row, limit, back = row[live], limit[live], np.ascontiguousarray(back[:, live])
                before, last, now, best = (np.ascontiguousarray(x[:, live]) for x in (before, last, now, best))
                if not len(row):
                    return out
    out[row] = last[n]
    return out


def _along_paths(ways: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of every row of ``b`` along its best path."""
    diagonals, places, size = ways.shape[1:]
    n, m = places - 1, b.shape[1]
    from_i, same_j, beside = ways[0].reshape(-1), ways[1].reshape(-1), places * size  # a step in j is ``beside`` back, one in i ``size`` more
    row = np.arange(size)
    at, mine, other = ((n + m) * places + n) * size + row, row * n + n - 1, row * m + m - 1
    passed, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        passed.append(mine)
        values.append(other)
        in_i, in_j = from_i.take(at), ~same_j.take(at)
        at, mine, other = at - in_i * (beside + size) - in_j * beside, mine - in_i, other - in_j
        live = at >= size  # costs are infinite beyond the edges, so every path ends in the first cell
        if not live.all():
            at, mine, other = at[live], mine[live], other[live]
    mine = np.concatenate(passed)
    sums = np.bincount(mine, b.reshape(-1)[np.concatenate(values)], size * n)
    return sums.reshape(size, n), np.bincount(mine, minlength=size * n).reshape(size, n).astype(float)


def least_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of one series to many (rows of ``b``) without aligning them.

    Every point is matched by some point of the other series, so it costs its distance to the other's envelope (least to
    largest value) at least; first and last points are matched by each other. The larger of both directions counts.
    """
    def outside(x: np.ndarray, low, high) -> np.ndarray:
        return np.maximum(0.0, np.maximum(x - high, low - x)) ** 2

    first, last = (b[:, 0] - a[0]) ** 2, (b[:, -1] - a[-1]) ** 2
    if len(a) < 2 or b.shape[1] < 2:  # then one point may be both ends
        return np.sqrt(np.maximum(first, last))
    of_b = outside(b[:, 1:-1], a.min(), a.max()).sum(axis=1)
    of_a = outside(a[None, 1:-1], b.min(axis=1)[:, None], b.max(axis=1)[:, None]).sum(axis=1)
    return np.sqrt(first + last + np.maximum(of_a, of_b)) * (1 - 1e-12)


def series(points: DataFrame, order: str, value: str) -> DataFrame:
    """conv_id, values: each session's values in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return points.filter(F.col(value).isNotNull()).groupBy("conv_id").agg(F.transform(rows, lambda r: r["v"]).alias("values"))


def pair_distances(sessions: DataFrame, pairs: DataFrame) -> DataFrame:
    """id_1, id_2, distance, path_length and path (pairs of places) of given pairs of sessions."""
    a = sessions.select(F.col("conv_id").alias("id_1"), F.col("values").alias("v1"))
    b = sessions.select(F.col("conv_id").alias("id_2"), F.col("values").alias("v2"))
    kind = sessions.schema["conv_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [dtw(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(f["v1"], f["v2"])]
            yield pd.DataFrame({"id_1": f["id_1"], "id_2": f["id_2"], "distance": [d for d, _ in got], "path_length": [len(p) for _, p in got], "path": [[list(x) for x in p] for _, p in got]})

    joined = pairs.select("id_1", "id_2").join(a, "id_1").join(b, "id_2").select("id_1", "id_2", "v1", "v2")
    return joined.mapInPandas(run, f"id_1 {kind}, id_2 {kind}, distance double, path_length long, path array<array<int>>")


def nearest(centres: list[np.ndarray], rows: np.ndarray, paths: bool = True) -> tuple[np.ndarray, np.ndarray, list, list, np.ndarray]:
    """Of rows of one length: the nearest centre (of equally near ones the first), its distance, sums and counts along the
    path (if ``paths``), and how many centres were aligned. A centre whose lower bound is above the best distance so far is
    left out; paths are followed to the nearest one only."""
    bounds = np.stack([least_distances(c, rows) for c in centres])
    turn = np.argsort(bounds, axis=0, kind="stable")
    n = len(rows)
    best, distance, aligned = np.full(n, len(centres)), np.full(n, np.inf), np.zeros(n, np.int32)
    for t in range(len(centres)):
        for c in range(len(centres)):
            at = np.flatnonzero((turn[t] == c) & (bounds[c] <= distance))
            if not len(at):
                continue
            d = distances_many(centres[c], rows[at], distance[at])
            aligned[at] += 1
            won = (d < distance[at]) | ((d == distance[at]) & (c < best[at]))
            best[at[won]], distance[at[won]] = c, d[won]
    sums, counts = [None] * n, [None] * n
    for c in range(len(centres) if paths else 0):
        at = np.flatnonzero(best == c)
        _, s, k = dtw_many(centres[c], rows[at])
        for x, i in enumerate(at.tolist()):
            sums[i], counts[i] = s[x], k[x]
    return best, distance, sums, counts, aligned


def _assign(centres: list[np.ndarray], kind: str):
    """conv_id, cluster, distance, aligned."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for length, same in f.groupby(f["values"].map(len)):
                rows = np.array(same["values"].tolist(), float).reshape(len(same), length)
                best, distance, _, _, aligned = nearest(centres, rows, paths=False)
                yield pd.DataFrame({"conv_id": same["conv_id"].to_numpy(), "cluster": best.astype("int32"), "distance": distance, "aligned": aligned})

    return run, f"conv_id {kind}, cluster int, distance double, aligned int"


def _totals(centres: list[np.ndarray]):
    """What the next centres need, one row a cluster and batch of sessions: sums and counts at every place of the centre
    along the paths, and its members' hashes (``who``) combined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for length, same in f.groupby(f["values"].map(len)):
                rows = np.array(same["values"].tolist(), float).reshape(len(same), length)
                best, _, sums, counts, _ = nearest(centres, rows)
                who = same["who"].to_numpy()
                for c in np.unique(best[best < len(centres)]).tolist():
                    at = np.flatnonzero(best == c).tolist()
                    total, number = np.sum([sums[x] for x in at], axis=0), np.sum([counts[x] for x in at], axis=0)
                    yield pd.DataFrame({"cluster": [c], "who": [int(np.bitwise_xor.reduce(who[at]))], "sums": [total], "counts": [number]})

    return run, "cluster int, who long, sums array<double>, counts array<double>"


def cluster(sessions: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """k-means under time warping: conv_id, cluster, distance to its centre, aligned (centres it was compared with).

    Centres start at the sessions whose ids have the least digests and move to the barycentre of what warps onto each of
    their places, until no session changes its cluster or for ``rounds`` rounds. Assignments and sums run as tasks; only
    the centres (k series) reach the driver.
    """
    kind = sessions.schema["conv_id"].dataType.simpleString()
    tasks = int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # Every round reads them; they are few bytes for the work they make, so they are dealt to a fixed number of tasks.
    sessions = held(sessions.select("conv_id", "values").repartition(tasks, "conv_id"))
    if sessions.isEmpty():
        return sessions.select("conv_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"), F.lit(0).alias("aligned"))
    first = sessions.orderBy(F.md5(F.col("conv_id").cast("string"))).limit(k).collect()  # k rows
    centres = [np.asarray(r["values"], float) for r in sorted(first, key=lambda r: str(r["conv_id"]))]
    before = None
    for _ in range(rounds):
        run, shape = _totals(centres)
        totals = sessions.select("values", F.xxhash64("conv_id").alias("who")).mapInPandas(run, shape)
        places = totals.select("cluster", "who", F.posexplode(F.arrays_zip("sums", "counts")).alias("i", "p"))
        sums = places.groupBy("cluster", "i").agg((F.sum("p.sums") / F.sum("p.counts")).alias("v"), F.bit_xor("who").alias("who")).collect()
        now = {(r["cluster"], r["who"]) for r in sums if r["i"] == 0}
        if now == before:  # no session went to another centre
            break
        before, centres = now, [c.copy() for c in centres]
        for r in sums:
            if r["v"] is not None:
                centres[r["cluster"]][r["i"]] = r["v"]
    run, shape = _assign(centres, kind)
    return sessions.mapInPandas(run, shape).select("conv_id", "cluster", "distance", "aligned")


def cluster_report(assigned: DataFrame, k: int) -> DataFrame:
    """Of each cluster n, mean and largest distance, and the share of comparisons with the k centres that bounds spared."""
    spared = (1 - F.avg("aligned") / k).alias("spared")
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), spared)
