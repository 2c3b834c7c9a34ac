"""Agreement between coders: confusion, kappas, paired tests. One aggregation to label pairs; the rest is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.stats import p_mcnemar, p_normal


def _grid(spark, labels: list[str], *names: str) -> DataFrame:
    out = spark.createDataFrame([(x,) for x in labels], f"{names[0]} string")
    for name in names[1:]:
        out = out.crossJoin(spark.createDataFrame([(x,) for x in labels], f"{name} string"))  # labels x labels
    return out


def label_pairs(df: DataFrame, true: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Counts of (true, pred) pairs; rows with either one missing are left out."""
    kept = df.filter(F.col(true).isNotNull() & F.col(pred).isNotNull())
    return kept.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: list[str]) -> DataFrame:
    """(true, pred, n) for every pair of ``labels``, empty ones with 0; other labels are left out."""
    counts = label_pairs(df, true, pred)
    return _grid(df.sparkSession, labels, "true", "pred").join(counts, ["true", "pred"], "left").fillna(0, ["n"])


def kappa(df: DataFrame, true: str, pred: str, by: list[str] = (), theta4: str = "row_plus_column") -> DataFrame:
    """Cohen's kappa by group: n, p0, pe, kappa, variance (asymptotic) and z.

    ``theta4`` is how the variance weighs the cells (i, j): ``row_plus_column`` takes (row_i + column_j) squared,
    ``textbook`` (column_i + row_j) squared. Groups whose chance agreement is 1 have a null kappa.
    """
    cells = label_pairs(df if by else df.withColumn("_all", F.lit(0)), true, pred, list(by) or ["_all"])
    return kappa_of(cells, list(by) or ["_all"], theta4).select(*by, "n", "p0", "pe", "kappa", "variance", "z")


def kappa_of(cells: DataFrame, keys: list[str], theta4: str = "row_plus_column") -> DataFrame:
    """``kappa`` of groups from their counted label pairs (keys, true, pred, n)."""
    if theta4 not in ("row_plus_column", "textbook"):
        raise ValueError(f"unknown variant: {theta4}")
    none = F.lit(0).cast("long")
    agreed = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(none)
    side = lambda label, row, col, same: F.struct(F.col(label).alias("label"), row.alias("row_n"), col.alias("col_n"), same.alias("same_n"))
    both = F.array(side("true", F.col("n"), none, agreed), side("pred", none, F.col("n"), none))
    margins = cells.select(*keys, F.inline(both)).groupBy(*keys, "label").agg(*[F.sum(c).cast("double").alias(c) for c in ("row_n", "col_n", "same_n")])
    total = F.sum("row_n")
    sums = margins.groupBy(*keys).agg(
        total.cast("long").alias("n"),
        (F.sum("same_n") / total).alias("p0"),
        (F.sum(F.col("row_n") * F.col("col_n")) / (total * total)).alias("pe"),
        (F.sum(F.col("same_n") * (F.col("row_n") + F.col("col_n"))) / (total * total)).alias("t3"),
    )
    of_true, of_pred = ("row_n", "col_n") if theta4 == "row_plus_column" else ("col_n", "row_n")
    weight = lambda side, c: margins.select(*keys, F.col("label").alias(side), F.col(c).alias(f"w_{side}"))
    cross = cells.join(weight("true", of_true), [*keys, "true"]).join(weight("pred", of_pred), [*keys, "pred"])
    t4 = cross.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("w_true") + F.col("w_pred")) ** 2).alias("t4"))
    out = sums.join(t4, keys).withColumn("t4", F.col("t4") / F.col("n").cast("double") ** 3)
    free = F.when(F.col("pe") < 1, 1 - F.col("pe"))
    out = out.withColumn("kappa", (F.col("p0") - F.col("pe")) / free)
    miss = 1 - F.col("p0")
    variance = (
        F.col("p0") * miss / free**2
        + 2 * miss * (2 * F.col("p0") * F.col("pe") - F.col("t3")) / free**3
        + miss**2 * (F.col("t4") - 4 * F.col("pe") ** 2) / free**4
    ) / F.col("n")
    out = out.withColumn("variance", variance).withColumn("z", F.when(F.col("variance") > 0, F.col("kappa") / F.sqrt("variance")))
    return out.select(*keys, "n", "p0", "pe", "kappa", "variance", "z")


def with_p_value(kappas: DataFrame) -> DataFrame:
    """Add the two-sided normal p-value of z."""
    return kappas.withColumn("p_value", p_normal(F.col("z")))


def pairwise_kappa(ratings: DataFrame, item: list[str], by: list[str] = ()) -> DataFrame:
    """Kappa of every pair of raters over the items both coded, from (item, rater, label) rows.

    One shuffle by item: its labels are collected, as many as it has raters, and paired.
    """
    labels = F.array_sort(F.collect_list(F.struct("rater", "label")))
    each = ratings.filter(F.col("label").isNotNull()).groupBy(*item, *by).agg(labels.alias("_of"))
    first = each.select(*by, "_of", F.explode("_of").alias("_a"))
    pairs = first.select(*by, "_a", F.explode(F.filter("_of", lambda b: b["rater"] > F.col("_a")["rater"])).alias("_b"))
    kept = pairs.select(*by, F.col("_a.rater").alias("rater_1"), F.col("_b.rater").alias("rater_2"), F.col("_a.label").alias("x"), F.col("_b.label").alias("y"))
    return kappa(kept, "x", "y", [*by, "rater_1", "rater_2"])


def align(manual: DataFrame, auto: DataFrame, key: list[str], tiers: dict[str, tuple[str, str]]) -> DataFrame:
    """Human and automatic labels side by side by key: key, speaker (the human table's), and <tier>_gold, <tier>_auto of each
    tier; ``tiers`` names its human and its automatic column."""
    left = manual.select(*key, "speaker", *[F.col(mine).alias(f"{t}_gold") for t, (mine, _) in tiers.items()])
    return left.join(auto.select(*key, *[F.col(theirs).alias(f"{t}_auto") for t, (_, theirs) in tiers.items()]), key)


def agreement_report(manual: DataFrame, auto: DataFrame, key: list[str], tiers: dict[str, tuple[str, str]]) -> DataFrame:
    """Kappa of each tier and speaker over aligned rows whose two labels are both codes of the speaker in that tier:
    tier, speaker, n, p0, pe, kappa, variance, z. ``tiers`` names the human and the automatic column of each tier; both
    tables are joined once."""
    from parley.operators.reports import tier_pairs

    rows = align(manual, auto, key, tiers)
    return kappa(tier_pairs(rows, {t: (f"{t}_gold", f"{t}_auto") for t in tiers}), "true", "pred", ["tier", "speaker"])


def complete_items(ratings: DataFrame, item: list[str], n_raters: int) -> DataFrame:
    """(item, label, n) of items that all raters coded."""
    counts = ratings.filter(F.col("label").isNotNull()).groupBy(*item, "label").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*item).agg(F.sum("n").alias("of")).filter(F.col("of") == n_raters).drop("of")
    return counts.join(whole, item)


def fleiss_kappa(ratings: DataFrame, item: list[str], n_raters: int) -> DataFrame:
    """Fleiss' kappa over the items that all raters coded: n_items, p_bar, pe, kappa."""
    counts = complete_items(ratings, item, n_raters)
    agree = counts.groupBy(*item).agg(((F.sum(F.col("n") * F.col("n")) - n_raters) / (n_raters * (n_raters - 1))).alias("p"))
    left = agree.agg(F.count("*").alias("n_items"), F.avg("p").alias("p_bar"))
    by_label = counts.groupBy("label").agg(F.sum("n").alias("n"))
    right = by_label.agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("total"))
    both = left.crossJoin(right).withColumn("pe", F.col("squares") / (F.col("total") * F.col("total")))  # one row each
    return both.select("n_items", "p_bar", "pe", F.when(F.col("pe") < 1, (F.col("p_bar") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def disagreements(ratings: DataFrame, item: list[str], n_raters: int) -> DataFrame:
    """Items that all raters coded, with several codes: item and the number of codes."""
    return complete_items(ratings, item, n_raters).groupBy(*item).agg(F.count("*").alias("n_labels")).filter("n_labels > 1")


def mcnemar_cells(df: DataFrame, gold: str, first: str, second: str) -> DataFrame:
    """both right, only the first, only the second, neither."""
    x, y = F.col(first) == F.col(gold), F.col(second) == F.col(gold)
    return df.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_first"), F.count_if(~x & y).alias("only_second"), F.count_if(~x & ~y).alias("neither"))


def mcnemar(df: DataFrame, gold: str, first: str, second: str) -> DataFrame:
    """The cells with the exact two-sided p-value."""
    return mcnemar_cells(df, gold, first, second).withColumn("p_value", p_mcnemar(F.col("only_first"), F.col("only_second")))
