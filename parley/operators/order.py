"""Places in a whole table's order: running numbers, running sums, ranks and exact percentiles.

Rows are dealt into key ranges, sorted inside and held in the checkpoint folder, so that ranges and places stay what
they are when an executor is lost. A range's total is one row; totals are summed up over ranges, rows over their own
range. No task sees the whole table.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder: spark.checkpoint.dir, or a temporary one in a session of one process."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="parley-"))
    return df.checkpoint(eager=True)


def in_ranges(df: DataFrame, order: list[str], keep: list[Column | str] = ("*",)) -> DataFrame:
    """``df`` with _range and _nth (from 0): the range of ``order`` that a row is in, and its place there. ``keep``: what
    is held of a row once it is sorted."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    kept = held(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*keep))
    place = F.monotonically_increasing_id()  # the partition above bit 33, the row below
    return kept.withColumn("_range", F.shiftright(place, 33).cast("int")).withColumn("_nth", place.bitwiseAND(F.lit((1 << 33) - 1)))


def _before(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """_range and, for every name of ``sums``, its total over the ranges before: one row a range."""
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]))


def running_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number the rows of a whole table from 0 in ``order``, a unique key."""
    ranged = in_ranges(df, order)
    out = ranged.join(_before(ranged, {"n": F.lit(1)}), "_range")
    return out.withColumn(name, F.col("_before_n") + F.col("_nth")).drop("_range", "_nth", "_before_n")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add for every name the sum of its column over the rows before, in ``order`` (a unique key)."""
    ranged = in_ranges(df, order)
    out = ranged.join(_before(ranged, {n: F.col(c) for n, c in sums.items()}), "_range")
    earlier = Window.partitionBy("_range").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({n: F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()})
    return out.drop("_range", "_nth", *[f"_before_{n}" for n in sums])


def running_by(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], keep: list[Column | str] = ("*",)) -> DataFrame:
    """Add for every name the sum of its column over the rows of the same group before, in ``order`` (unique in a group).

    A group of any size spreads over ranges: only a range's first group can have begun before it, and what it has so far
    is the sum of the ranges that end with it. ``keep`` must hold ``by``; ``sums`` are made of what is kept.
    """
    ranged = in_ranges(df, [*by, *order], keep)
    last = ranged.groupBy("_range").agg(F.max("_nth").alias("_nth"))
    firsts = ranged.filter("_nth = 0").select("_range", F.struct(*by).alias("_group"))
    lasts = ranged.join(F.broadcast(last), ["_range", "_nth"]).select("_range", F.struct(*by).alias("_group"))  # one row a range
    totals = ranged.join(F.broadcast(lasts), "_range").filter(F.struct(*by).eqNullSafe(F.col("_group")))
    totals = totals.groupBy("_range").agg(F.first("_group").alias("_group"), *[F.sum(c).alias(n) for n, c in sums.items()])
    asked = firsts.select("_range", "_group", F.lit(True).alias("_asks"), *[F.lit(None).alias(n) for n in sums])
    earlier = Window.partitionBy("_group").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_asks", F.lit(False)).unionByName(asked).select("_range", "_group", "_asks", *[F.sum(n).over(earlier).alias(f"_carried_{n}") for n in sums])
    carried = carried.filter("_asks").drop("_asks")
    here = Window.partitionBy("_range", *by).orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(carried), "_range")
    begun = F.struct(*by).eqNullSafe(F.col("_group"))
    none = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumns({n: none(F.sum(c).over(here)) + none(F.when(begun, F.col(f"_carried_{n}"))) for n, c in sums.items()})
    return out.drop("_range", "_nth", "_group", *[f"_carried_{n}" for n in sums])


def value_places(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of each group with n, their rows, and before, the rows of the group with smaller values. Groups may
    be of any number and size."""
    return running_by(rows.groupBy(*by, value).agg(F.count("*").alias("n")), by, [value], {"before": F.col("n")})


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value) of the named columns, nulls left out."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))
    return rows.filter(F.col("value").isNotNull())


def percentiles(df: DataFrame, columns: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of columns, linear between neighbours: metric and one column a name of ``shares``."""
    places = value_places(long_form(df, columns), ["metric"], "value")
    size = places.groupBy("metric").agg(F.sum("n").alias("_size"))
    at = places.join(F.broadcast(size), "metric")  # one row a metric
    found = []
    for name, share in shares.items():
        exact = F.lit(share) * (F.col("_size") - 1)
        inside = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("n"))
        low, high = (F.max(F.when(inside(p), F.col("value"))) for p in (F.floor(exact), F.ceil(exact)))
        part = F.first(exact - F.floor(exact))
        found.append((low + (high - low) * part).alias(name))
    return at.groupBy("metric").agg(*found)
