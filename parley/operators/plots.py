"""What violin and box plots draw, as tables: densities on a grid, boxes, whiskers and outliers of each group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.order import held, value_places

GRID = 100
#: A whisker reaches to the last value within so many interquartile ranges of the box.
REACH = 1.5


def long_groups(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(metric, group, value) of the named columns; missing and non-finite values are left out."""
    pair = lambda c: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
    rows = df.select(F.col(group).cast("string").alias("group"), F.inline(F.array(*map(pair, columns))))
    return rows.filter(F.col("value").isNotNull() & (F.abs("value") < float("inf"))).select("metric", "group", "value")


def _quantile(share: float) -> Column:
    """Linear between neighbours, from the places of distinct values (value, n, before, _size)."""
    at = F.lit(share) * (F.col("_size") - 1)
    inside = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("n"))
    low, high = (F.max(F.when(inside(p), F.col("value"))) for p in (F.floor(at), F.ceil(at)))
    return low + (high - low) * F.first(at - F.floor(at))


def boxes(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """metric, group, n, mean, q1, median, q3, whisker_low, whisker_high, n_outliers, outliers (distinct values, ascending).

    Quartiles are exact. All columns and groups come from one pass over the rows, which leaves their distinct values; a
    value outside the whiskers is an outlier. Groups without a value are left out.
    """
    keys = ["metric", "group"]
    places = held(value_places(long_groups(df, group, columns), keys, "value"))
    sizes = places.groupBy(*keys).agg(F.sum("n").alias("_size"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    sized = places.join(sizes, keys)
    box = sized.groupBy(*keys).agg(F.first("_size").alias("size"), F.first("mean").alias("mean"), *[_quantile(q).alias(c) for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    reach = REACH * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    marked = places.join(box, keys).withColumn("_in", inside)
    ends = marked.groupBy(*keys).agg(
        F.min(F.when(F.col("_in"), F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("_in"), F.col("value"))).alias("whisker_high"),
        F.sum(F.when(F.col("_in"), 0).otherwise(F.col("n"))).alias("n_outliers"),
        F.array_sort(F.collect_list(F.when(~F.col("_in"), F.col("value")))).alias("outliers"),
    )
    return box.join(ends, keys).select(*keys, F.col("size").alias("n"), "mean", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers", "outliers")


def violins(df: DataFrame, group: str, columns: list[str], grid: int = GRID, cut: float = 2.0) -> DataFrame:
    """metric, group, k, x, density: a Gaussian kernel density at ``grid`` even places from ``cut`` bandwidths below the
    least value to as many above the largest; the bandwidth is the deviation times n**(-1/5).

    Values go to the two places beside them in linear shares, by one partial aggregation; densities are the convolution
    of those ``grid`` weights with the kernel. Groups whose values do not vary have none.
    """
    keys = ["metric", "group"]
    rows = long_groups(df, group, columns)
    spread = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev_samp("value").alias("_s"), F.min("value").alias("_a"), F.max("value").alias("_b")).filter("_s > 0")
    spread = spread.withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    spread = spread.withColumn("_low", F.col("_a") - cut * F.col("_h")).withColumn("_step", (F.col("_b") - F.col("_a") + 2 * cut * F.col("_h")) / (grid - 1))
    spread = held(spread.select(*keys, "_n", "_h", "_low", "_step"))
    at = (F.col("value") - F.col("_low")) / F.col("_step")
    left = F.least(F.floor(at), F.lit(grid - 2)).cast("int")
    share = at - left
    both = F.array(F.struct(left.alias("bin"), (1 - share).alias("w")), F.struct((left + 1).alias("bin"), share.alias("w")))
    bins = rows.join(spread, keys).select(*keys, F.inline(both)).groupBy(*keys, "bin").agg(F.sum("w").alias("w"))
    weights = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", "w")).alias("_bins")).join(spread, keys)  # ``grid`` of them at most

    def density(k: Column) -> Column:
        z = lambda b: (k - b["bin"]) * F.col("_step") / F.col("_h")
        return F.aggregate("_bins", F.lit(0.0), lambda s, b: s + b["w"] * F.exp(-0.5 * z(b) * z(b)))

    cells = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: F.struct(k.alias("k"), density(k).alias("d")))
    each = weights.select(*keys, "_n", "_h", "_low", "_step", F.inline(cells))
    x = F.col("_low") + F.col("k") * F.col("_step")
    return each.select(*keys, "k", x.alias("x"), (F.col("d") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))
