"""Exact top-k search by inner product over norm buckets.

Vectors are numbered by falling length and cut into strips, strips into buckets of vectors of similar length. A query
knows a bar, its k-th best score so far. In a bucket whose longest vector has length l only vectors whose cosine with
the query q is bar / (|q| l) or more can pass: the local threshold. Above 1 the bucket is skipped. Else the bucket is
pruned by length (a prefix of it is long enough) or by coordinates: with cosine t or more, coordinate f of the unit vector
lies within q_f t +- sqrt((1 - q_f**2) (1 - t**2)), or up to the axis where the cone holds it, and sorted lists of the
bucket give the rows there. Products of what is left are computed exactly. Each bucket chooses from its own queries the
threshold from which coordinates cost less.

Queries first meet the strip of the longest vectors, which gives each a bar; then they go, with it, to those strips that
hold a vector long enough. A tile is one strip and one block of queries: its vectors are held (a bounded number), its
queries stream past them. No bound ever drops a candidate that could be among the best, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import remove, small_batches, table, written
from parley.operators.order import running_index

K = 5
SCALE = 256
BUCKET = 1024
#: Vectors of a strip: as many as give each task one, within these bounds. Results do not depend on it.
STRIP = (4096, 65536)
#: Queries of a block (a tile's share), and of a batch that is scored at once.
BLOCK = 8192
BATCH = 256
#: Coordinates of a query that are looked up; what a row found by them costs against a row of a length prefix, and what a
#: look-up costs besides.
LISTS = 2
LOOKUP, LOOKUP_ALONE = 6.0, 500
_SLACK = 1e-9
_LARGE = 2.0**53
_LONG = 2**63 - 1

VECTOR = "vec_id long, x binary, norm double"


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x (floor(scale * component) as 64-bit floats, which hold it exactly), norm. Null vectors, and those with a
    null or non-finite component, are left out; an empty one stays and has products of 0."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, norms = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) * scale)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                rows.append(x.tobytes())
                with np.errstate(over="ignore"):
                    norms.append(float(np.sqrt(x @ x)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "x", "norm"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, VECTOR)


def _matrix(rows: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    width = max([width, *(len(r) // 8 for r in rows)])
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r)
    return out


class Best:
    """The k best (score, id) of each query of a batch; ``bar``: the k-th best so far, or what was known before."""

    def __init__(self, bars: np.ndarray, k: int):
        self.bar, self.k = bars.copy(), k
        self.of, self.score, self.vec_id, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, of: np.ndarray, score: np.ndarray, vec_id: np.ndarray, no_id: np.ndarray) -> None:
        """Ties go to the smaller id, a null one last."""
        of, score = np.concatenate([self.of, of]), np.concatenate([self.score, score])
        vec_id, no_id = np.concatenate([self.vec_id, vec_id]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((vec_id, no_id, -score, of))
        of = of[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        nth = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        keep = nth < self.k
        order, last = order[keep], nth[keep] == self.k - 1
        self.of, self.score, self.vec_id, self.no_id = of[keep], score[order], vec_id[order], no_id[order]
        self.bar[self.of[last]] = np.maximum(self.bar[self.of[last]], self.score[last].astype(np.float64))


class Bucket:
    """Vectors of similar length, the longest first, with sorted lists of their unit vectors' coordinates."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, places: np.ndarray, ids: np.ndarray, no_id: np.ndarray):
        self.x, self.norms, self.places, self.ids, self.no_id = x, norms, places, ids, no_id
        self.narrow = x.astype(np.float32)
        self._lists = None

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._lists is None:
            unit = self.x / np.where(self.norms > 0, self.norms, 1.0)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._lists = unit, order, np.take_along_axis(unit, order, axis=0)
        return self._lists

    def products(self, rows, q: np.ndarray, bound: float) -> np.ndarray:
        """Exact products of some of the vectors with query rows, as longs; ``bound``: no product exceeds it."""
        if bound < 2.0**24:
            return (q.astype(np.float32) @ self.narrow[rows].T).astype(np.int64)
        if bound < _LARGE:
            return (q @ self.x[rows].T).astype(np.int64)
        whole = lambda m: np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object)
        return np.clip(whole(q) @ whole(self.x[rows]).T, -_LONG, _LONG).astype(np.int64)

    def search(self, best: Best, q: np.ndarray, norms: np.ndarray, places: np.ndarray) -> tuple[int, int]:
        """Offer this bucket's vectors to a batch of queries; (queries pruned by coordinates, by length)."""
        longest = float(self.norms[0])
        bound = longest * float(norms.max(initial=0.0))
        if not bound < _LARGE:  # no pruning where lengths are not exact
            self._take(best, np.arange(len(q)), len(self.norms), q, places, bound)
            return 0, len(q)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(norms > 0, best.bar / norms, np.where(best.bar > 0, np.inf, -np.inf))  # length that a vector must have
            t = need / longest if longest > 0 else np.where(need > 0, np.inf, -np.inf)
        live = np.flatnonzero(t <= 1 + _SLACK)
        by_length = np.searchsorted(-self.norms, -(need[live] * (1 - _SLACK)), side="right").astype(np.float64)
        ranges = self._ranges(q[live], norms[live], t[live])
        spare = by_length - (LOOKUP * ranges[:, 0] + LOOKUP_ALONE)
        order = np.argsort(-t[live], kind="stable")
        gain = np.cumsum(spare[order])
        m = int(np.argmax(gain)) + 1 if len(gain) and gain.max() > 0 else 0  # from this local threshold on: coordinates
        for i in order[:m]:
            if np.isfinite(ranges[i, 0]):
                self._look_up(best, live[i], ranges[i], q, places, bound)
        rest = live[order[m:]], by_length[order[m:]]
        unbounded = live[[i for i in order[:m] if not np.isfinite(ranges[i, 0])]] if m else live[:0]
        rest = np.concatenate([rest[0], unbounded]).astype(np.int64), np.concatenate([rest[1], np.full(len(unbounded), len(self.norms))])
        if len(rest[0]):
            self._take(best, rest[0], int(rest[1].max()), q, places, bound)
        return m - len(unbounded), len(rest[0])

    def _ranges(self, q: np.ndarray, norms: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of each query: the rows in its shortest list range, the list and the range, and another list with the values
        allowed there. Infinite where the threshold is 0 or less."""
        out = np.full((len(q), 7), np.inf)
        out[:, 1:] = 0
        some = np.flatnonzero(t > _SLACK)
        if not len(some) or not q.shape[1]:
            return out
        _, _, values = self.lists()
        unit = q[some] / norms[some, None]
        top = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :LISTS]
        at = np.take_along_axis(unit, top, axis=1)
        cos = np.minimum(t[some], 1.0)[:, None]
        wide = np.sqrt(np.maximum(0.0, 1 - at**2) * np.maximum(0.0, 1 - cos**2)) + 1e-7
        low, high = np.where(at <= -cos, -2.0, at * cos - wide), np.where(at >= cos, 2.0, at * cos + wide)
        first, last = np.zeros(top.shape, np.int64), np.zeros(top.shape, np.int64)
        for f in np.unique(top):
            of = top == f
            first[of] = np.searchsorted(values[:, f], low[of], side="left")
            last[of] = np.searchsorted(values[:, f], high[of], side="right")
        each = np.arange(len(some))
        pick, other = np.argmin(last - first, axis=1), np.argmax(last - first, axis=1)
        out[some, 0] = (last - first)[each, pick]
        for i, (a, b) in enumerate(((top, pick), (first, pick), (last, pick), (top, other), (low, other), (high, other))):
            out[some, i + 1] = a[each, b]
        return out

    def _look_up(self, best: Best, i: int, r: np.ndarray, q: np.ndarray, places: np.ndarray, bound: float) -> None:
        unit, order, _ = self.lists()
        rows = order[int(r[2]) : int(r[3]), int(r[1])]
        other = unit[rows, int(r[4])]
        rows = rows[(other >= r[5]) & (other <= r[6]) & (self.places[rows] != places[i])]
        if len(rows):
            score = self.products(rows, q[i : i + 1], bound)[0]
            rows, score = rows[score >= best.bar[i]], score[score >= best.bar[i]]
            best.add(np.full(len(rows), i), score, self.ids[rows], self.no_id[rows])

    def _take(self, best: Best, of: np.ndarray, n: int, q: np.ndarray, places: np.ndarray, bound: float) -> None:
        """The first ``n`` vectors against the queries ``of``."""
        score = self.products(slice(0, n), q[of], bound)
        own = places[of] - self.places[0]  # places of a bucket follow each other
        here = np.flatnonzero((own >= 0) & (own < n))
        score[here, own[here]] = -_LONG - 1
        bar = best.bar[of]
        if n > best.k:
            bar = np.maximum(bar, np.partition(score, n - best.k, axis=1)[:, n - best.k])
        hit = score >= bar[:, None]
        hit[here, own[here]] = False
        a, b = np.nonzero(hit)
        best.add(of[a], score[a, b], self.ids[b], self.no_id[b])


TILE = "strip int, block int, kind int, place long, vec_id long, x binary, norm double, bar double"
HIT = "of long, query_id long, vec_id long, score long"


def searched(tiles: DataFrame, k: int) -> DataFrame:
    """``HIT``: the k best vectors of its tile for each query, or fewer where no others reach its bar.

    ``tiles`` (``TILE``): kind 0 are vectors, 1 queries. The rows of a tile come together, its vectors first.
    """
    small_batches(tiles.sparkSession)

    def answer(buckets: list[Bucket], width: int, rows: dict) -> Iterator[pa.RecordBatch]:
        q = _matrix(rows["x"], width)
        norms, places = np.array(rows["norm"], float), np.array(rows["place"], np.int64)
        best = Best(np.array([-np.inf if b is None else b for b in rows["bar"]], float), k)
        for bucket in buckets:
            if bucket.x.shape[1] < q.shape[1]:  # longer queries: the rest of a vector counts as zeros
                wider = np.pad(bucket.x, ((0, 0), (0, q.shape[1] - bucket.x.shape[1])))
                bucket = Bucket(wider, bucket.norms, bucket.places, bucket.ids, bucket.no_id)
            bucket.search(best, q, norms, places)
        ids = pa.array(rows["vec_id"], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(places[best.of]), ids.take(pa.array(best.of)), pa.array(best.vec_id, mask=best.no_id), pa.array(best.score)], names=["of", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, buckets, width = None, [], None, 0
        for batch in batches:
            whole = batch.to_pydict()
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if tile != tuple(keys[a, :2]):
                    tile, parts, buckets = tuple(keys[a, :2]), [], None
                rows = {c: v[a:b] for c, v in whole.items()}
                if keys[a, 2] == 0:
                    parts.append((_matrix(rows["x"]), np.array(rows["norm"], float), np.array(rows["place"], np.int64), rows["vec_id"]))
                    continue
                if buckets is None:
                    width = max([0, *(p[0].shape[1] for p in parts)])
                    buckets = []
                    for x, norms, places, ids in parts:
                        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                        for c in range(0, len(norms), BUCKET):
                            own = ids[c : c + BUCKET]
                            buckets.append(Bucket(x[c : c + BUCKET], norms[c : c + BUCKET], places[c : c + BUCKET], np.array([i or 0 for i in own], np.int64), np.array([i is None for i in own])))
                    parts = []
                for c in range(0, b - a, BATCH):
                    yield from answer(buckets, width, {n: v[c : c + BATCH] for n, v in rows.items()})

    order = ["strip", "block", "kind", "place"]
    return tiles.repartition("strip", "block").sortWithinPartitions(*order).mapInArrow(run, HIT)


def _best_of(hits: DataFrame, k: int) -> DataFrame:
    """``hits`` with rank, the k best of each query."""
    by = Window.partitionBy("of").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, asks, k: int = K, strip: tuple[int, int] = STRIP, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row where ``asks`` (a column over vec_id) holds, the ``k`` other
    rows of largest inner product, ties to the smaller vec_id (null last); all of them if there are fewer.

    ``vectors``: vec_id, embedding (arrays of numbers, read as floor(256 * x)). Rows that share an id are rows of their
    own, each with its own results. Vectors of several sizes: what the shorter one lacks counts as 0. Products beyond a
    long are given as the largest or least long. Empty tables, or those without a query, give no rows.
    """
    spark = vectors.sparkSession
    rows = running_index(whole_numbers(vectors).withColumn("falling", -F.col("norm")), ["falling", "vec_id", "x"], "place")
    rows, at_rows = written(rows.select("place", "vec_id", "x", "norm", F.coalesce(asks, F.lit(False)).alias("asks")), "vectors")
    n, n_asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    if not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = max(strip[0], min(strip[1], -(-n // parts)))
    n_strips, n_blocks = -(-n // size), -(-n_asks // block)
    of_strip = rows.withColumn("strip", (F.col("place") / size).cast("int"))
    no_bar = F.lit(None).cast("double").alias("bar")
    held = of_strip.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("strip", "block", F.lit(0).alias("kind"), "place", "vec_id", "x", "norm", no_bar)
    queries = rows.filter("asks").withColumn("block", F.pmod(F.xxhash64("place"), F.lit(n_blocks)).cast("int"))
    begun = queries.select(F.lit(0).alias("strip"), "block", F.lit(1).alias("kind"), "place", "vec_id", "x", "norm", no_bar)
    hits, _ = written(searched(held.filter("strip = 0").unionByName(begun), k), "first-hits")
    if n_strips > 1:
        bars = hits.groupBy("of").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bar"))
        longest = of_strip.groupBy("strip").agg(F.max("norm").alias("longest"))
        asked = queries.join(bars, queries["place"] == bars["of"], "left").withColumn("strip", F.explode(F.sequence(F.lit(1), F.lit(n_strips - 1))))
        can = F.col("bar").isNull() | (F.col("bar") <= F.col("norm") * F.col("longest") * (1 + _SLACK))
        asked = asked.join(longest, "strip").filter(can).select("strip", "block", F.lit(1).alias("kind"), "place", "vec_id", "x", "norm", "bar")
        more, _ = written(searched(held.filter("strip > 0").unionByName(asked), k), "more-hits")
        hits = hits.unionByName(more)
    remove(spark, at_rows)
    return _best_of(hits, k).select("query_id", "rank", "vec_id", "score")


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP13_SQL = f"""
WITH rows AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
pairs AS (
  SELECT q.place, q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.x, p.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows q JOIN rows p ON q.place <> p.place WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
