"""Motivation over the course of a session: scores, momentum, slopes, resampling, regressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.stats import p_t
from parley.functions.text import literal_map
from parley.operators.order import value_places
from parley.vocab import MOBILISING, PREPARATORY, SCALES


def with_score(rows: DataFrame, label: str, scale: str = "motiv5") -> DataFrame:
    """Add ``score`` of a code on a named scale; codes outside it give null."""
    if scale not in SCALES:
        raise ValueError(f"unknown scale: {scale}")
    return rows.withColumn("score", literal_map(SCALES[scale])[F.col(label)])


def with_progress(utterances: DataFrame) -> DataFrame:
    """Add ``progress``: the utterance's place in the whole session in per cent; a session of one row has 0."""
    whole = Window.partitionBy("conv_id")
    n, place = F.count("*").over(whole), F.row_number().over(whole.orderBy("conv_utt_idx")) - 1
    return utterances.withColumn("progress", F.when(n > 1, 100.0 * place / (n - 1)).otherwise(0.0))


def _step(code: Column, alpha: float, tier: str) -> Column:
    """What a code adds; null where momentum fades or is carried on."""
    if tier == "t1":
        return F.when(code == "C", alpha).when(code == "S", -alpha)
    named = lambda stems, sign: code.isin([f"{x}{sign}" for x in stems])
    return F.when(named(MOBILISING, "+"), 2 * alpha).when(named(PREPARATORY, "+"), alpha).when(named(PREPARATORY, "-"), -alpha).when(named(MOBILISING, "-"), -2 * alpha)


#: Natural logarithm of what a block of fadings leaves at least: its powers stay within a double, and what is older than
#: the block before is less than the least double beside any other step.
_FADE_LOG = 600.0


def momentum(client_rows: DataFrame, label: str, alpha: float = 0.1, tier: str = "t1") -> DataFrame:
    """Running momentum of a session's client codes: conv_id, conv_utt_idx, momentum.

    Change talk raises it, sustain talk lowers it, other codes let it fade, missing ones carry it on; the first
    row starts at 0 whatever its code. With k the fadings so far and f what one leaves, a row's momentum is f**k times
    the sum of all steps over f**k of their own rows: a running sum, in blocks of k whose length follows from alpha, so
    that no power leaves the range of a double.
    """
    by = Window.partitionBy("conv_id").orderBy("conv_utt_idx")
    code, first = F.col(label), F.row_number().over(by) == 1
    step = _step(code, alpha, tier)
    rows = client_rows.select(
        "conv_id", "conv_utt_idx", F.when(first | step.isNull(), 0.0).otherwise(step).alias("_step"), F.when(first | code.isNull() | step.isNotNull(), 0).otherwise(1).alias("_fades")
    )
    left = 1.0 - alpha
    size = max(1, int(_FADE_LOG / -math.log1p(-alpha))) if 0 < left < 1 else 1 if left == 0 else 1 << 62
    k = F.sum("_fades").over(by)
    rows = rows.withColumn("_k", k).withColumn("_block", F.floor(F.col("_k") / size)).withColumn("_k", F.col("_k") % size)
    rows = rows.withColumn("_scaled", F.col("_step") / F.pow(F.lit(left), F.col("_k")))
    here = F.sum("_scaled").over(Window.partitionBy("conv_id", "_block").orderBy("conv_utt_idx"))
    past = F.coalesce(F.sum("_scaled").over(Window.partitionBy("conv_id").orderBy("_block").rangeBetween(-1, -1)), F.lit(0.0)) * left**size
    return rows.select("conv_id", "conv_utt_idx", (F.pow(F.lit(left), F.col("_k")) * (here + past)).alias("momentum"))


def correlation(x: str, y: str) -> Column:
    """Pearson's r, null where either column does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ordered_slope(x: list[float], y: list[float]) -> float | None:
    """Least-squares slope, its means and moments carried from point to point in the order given; null if x does not vary.

    The product that joins the co-moment is not rounded on its own (a fused multiply-add), as in the SQL: slopes that are
    0.05 but for rounding then fall to the same side of that edge, however the rows were dealt.
    """
    mean_x = mean_y = both = square = 0.0
    for n, (a, b) in enumerate(zip(x, y), 1):
        d = a - mean_x
        mean_x, mean_y = mean_x + d / n, mean_y + (b - mean_y) / n
        both, square = math.fma(d, b - mean_y, both), square + d * (a - mean_x)
    return both / len(x) / (square / len(x)) if square else None


def _ordered_slopes(x: Column, y: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ordered_slope(a.tolist(), b.tolist()) for a, b in zip(x, y)], dtype="float64")

    return run(x, y)


def slopes(points: DataFrame, x: str = "progress", y: str = "score", by: list[str] = ("conv_id",)) -> DataFrame:
    """Least-squares slope (its points taken in order of x), intercept and correlation by session; null for fewer than two points."""
    pair = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    out = points.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("intercept"), correlation(x, y).alias("r"), F.array_sort(F.collect_list(pair)).alias("_p"))
    return out.select(*by, "n", _ordered_slopes(F.col("_p.x"), F.col("_p.y")).alias("slope"), "intercept", "r")


def trend(slope: Column, edge: float = 0.05) -> Column:
    return F.when(slope > edge, "Increasing").when(slope < -edge, "Decreasing").otherwise("Flat")


def fill_linear(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Replace missing values by the line between neighbours by row; ends take the nearest value."""
    by = Window.partitionBy("conv_id").orderBy(order)
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("_row"))
    out = rows.withColumn("_row", F.row_number().over(by))
    out = out.withColumn("_x0", F.max(at).over(back)).withColumn("_x1", F.min(at).over(ahead))
    out = out.withColumn("_y0", F.last(value, True).over(back)).withColumn("_y1", F.first(value, True).over(ahead))
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col("_row") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    filled = F.coalesce(F.col(value), F.when(F.col("_x1") > F.col("_x0"), line), "_y0", "_y1")
    return out.withColumn(value, filled).drop("_row", "_x0", "_x1", "_y0", "_y1")


def grids(points: DataFrame, sizes: list[int], x: str = "progress", y: str = "score") -> DataFrame:
    """Values on equally spaced places from 0 to 100 by linear interpolation, flat beyond the ends: one row a session
    and number of places, conv_id, size, cells (array of x, y)."""
    sorted_points = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    each = points.filter(F.col(y).isNotNull()).groupBy("conv_id").agg(sorted_points.alias("p"))
    rows = each.select("conv_id", "p", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    rows = rows.withColumn("step", F.lit(100.0) / F.greatest(F.lit(1), F.col("size") - 1))
    low, high = "try_element_at(filter(p, q -> q.x <= k * step), -1)", "try_element_at(filter(p, q -> q.x >= k * step), 1)"
    ends = F.expr(f"transform(sequence(0, size - 1), k -> struct(k * step AS g, {low} AS lo, {high} AS hi))")

    def cell(e: Column) -> Column:
        line = e["lo"]["y"] + (e["hi"]["y"] - e["lo"]["y"]) * (e["g"] - e["lo"]["x"]) / (e["hi"]["x"] - e["lo"]["x"])
        value = F.when(e["lo"].isNull(), e["hi"]["y"]).when(e["hi"].isNull(), e["lo"]["y"]).when(e["hi"]["x"] > e["lo"]["x"], line)
        return F.struct(e["g"].alias("x"), value.otherwise(e["lo"]["y"]).alias("y"))

    return rows.select("conv_id", "size", F.transform(ends, cell).alias("cells"))


def resample(points: DataFrame, n: int, x: str = "progress", y: str = "score") -> DataFrame:
    """``grids`` of ``n`` places, one row a place: conv_id, k, x, y."""
    cells = grids(points, [n], x, y).select("conv_id", F.posexplode("cells").alias("k", "c"))
    return cells.select("conv_id", F.col("k").cast("long").alias("k"), "c.x", "c.y")


def local_slopes(points: DataFrame, sizes: list[int], x: str = "progress", y: str = "score", min_points: int = 5) -> DataFrame:
    """Slope in each of ``size`` overlapping parts, for every size: conv_id, size, chunk, slope, intercept.

    A part reaches one equal step to each side of its own (the last two: none to the right); bounds are
    half-open, so 100 itself is in none. Parts with fewer than two points have slope 0; sessions with fewer than
    ``min_points`` points, or than one point a part, are left out. A point goes to the few parts about its own only.
    """
    counts = points.groupBy("conv_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_points)
    kept = counts.select("conv_id", "_n", F.explode(F.array(*map(F.lit, sizes))).alias("size")).filter(F.col("_n") >= F.col("size")).drop("_n")
    frame = kept.select("conv_id", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("chunk"))
    c, last, step = F.col("chunk"), F.col("size") - 1, F.lit(100.0) / F.col("size")
    own = F.floor(F.col("_x") / step).cast("int")
    first = F.greatest(F.lit(0), F.least(last, own) - 2)
    near = points.select("conv_id", F.col(x).alias("_x"), F.col(y).alias("_y")).join(kept, "conv_id")
    near = near.filter(F.col("_x").isNotNull()).withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, F.least(last, own + 2)))))
    low = F.when(c > 0, (c - 1) * step).otherwise(0.0)
    high = F.when(c < last - 1, (c + 2) * step).otherwise((c + 1) * step)
    fits = near.filter((F.col("_x") >= low) & (F.col("_x") < high)).groupBy("conv_id", "size", "chunk").agg(
        F.count("*").alias("m"), F.regr_slope("_y", "_x").alias("s"), F.regr_intercept("_y", "_x").alias("i")
    )
    ok = F.col("m") >= 2
    return frame.join(fits, ["conv_id", "size", "chunk"], "left").select(
        "conv_id", "size", c.cast("long").alias("chunk"), F.when(ok, F.col("s")).otherwise(0.0).alias("slope"), F.when(ok, F.col("i")).otherwise(0.0).alias("intercept")
    )


def segment_slopes(points: DataFrame, n_chunks: int, x: str = "progress", y: str = "score", min_points: int = 5) -> DataFrame:
    """``local_slopes`` of one number of parts: conv_id, chunk, slope, intercept."""
    return local_slopes(points, [n_chunks], x, y, min_points).drop("size")


def spearman(df: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """Rank correlation of each column with the outcome over complete rows: metric, n, r. Equal values share their mean rank.

    Ranks come from the places of distinct values in the order of all columns at once, so no task ranks a whole column.
    """
    pair = lambda c: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("a"), F.col(outcome).cast("double").alias("b"))
    rows = df.select(F.inline(F.array(*map(pair, columns)))).dropna()
    side = lambda c: F.struct(F.lit(c).alias("side"), F.col(c).alias("value"))
    places = value_places(rows.select("metric", F.inline(F.array(side("a"), side("b")))), ["metric", "side"], "value")
    ranks = places.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    for c in ("a", "b"):
        rows = rows.join(ranks.filter(F.col("side") == c).select("metric", F.col("value").alias(c), F.col("rank").alias(f"{c}_rank")), ["metric", c])
    return rows.groupBy("metric").agg(F.count("*").alias("n"), correlation("a_rank", "b_rank").alias("r"))


def with_correlation_p(correlations: DataFrame) -> DataFrame:
    """Add the two-sided t-based p-value of a correlation; null for fewer than three rows."""
    df = F.col("n") - 2
    t = F.when((F.abs("r") < 1) & (df > 0), F.col("r") * F.sqrt(df / (1 - F.col("r") * F.col("r"))))
    return correlations.withColumn("p_value", F.when(F.abs("r") >= 1, 0.0).otherwise(p_t(t, F.when(df > 0, df.cast("double")))))


def simple_regressions(df: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """Pearson r and the least-squares line of the outcome on each column, in one pass: metric, n, r, slope, intercept, r2.
    A column without a complete row has n 0 and nulls."""
    pair = lambda c: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x"), F.col(outcome).cast("double").alias("y"))
    pairs = df.select(F.inline(F.array(*map(pair, columns))))
    x, y = (F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col(c)) for c in ("x", "y"))
    complete = pairs.select("metric", x.alias("x"), y.alias("y"))
    return complete.groupBy("metric").agg(F.count("x").alias("n"), correlation("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def leave_each_out(df: DataFrame, columns: list[str], y: str, key: str = "conv_id") -> DataFrame:
    """Predictions of each row by the line on one column fitted to all others: metric, key, y, predicted, error, pct_error.

    From the full fits and each row's leverage, no refits: one aggregation serves all columns. pct_error is null where y is
    near 0.
    """
    pair = lambda c: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x"))
    rows = df.select(key, F.col(y).cast("double").alias("y"), F.inline(F.array(*map(pair, columns)))).dropna(subset=["x", "y"])
    fit = rows.groupBy("metric").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_sxx("y", "x").alias("sxx"), F.avg("x").alias("mx")
    )
    out = rows.join(F.broadcast(fit), "metric")  # one row a column
    leverage = 1 / F.col("n") + (F.col("x") - F.col("mx")) ** 2 / F.col("sxx")
    left = (F.col("y") - F.col("a") - F.col("b") * F.col("x")) / (1 - leverage)
    out = out.withColumn("error", -left).withColumn("predicted", F.col("y") - left)
    return out.select("metric", key, "y", "predicted", "error", F.when(F.abs("y") > 1e-5, 100 * F.col("error") / F.col("y")).alias("pct_error"))


def leave_one_out(df: DataFrame, x: str, y: str, key: str = "conv_id") -> DataFrame:
    """``leave_each_out`` of one column."""
    return leave_each_out(df, [x], y, key).drop("metric")


def leave_one_out_summary(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, mean squared error and R2 of leave-one-out predictions, of each group if asked."""
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("error") ** 2).alias("mse"), (1 - F.sum(F.col("error") ** 2) / (F.count("*") * F.var_pop("y"))).alias("r2"))
