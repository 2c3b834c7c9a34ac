"""Classification metrics over fixed vocabularies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.agreement import _grid, label_pairs
from parley.operators.prepare import valid_rows


def report_of(cells: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1, support, predicted and tp of every row of ``labels`` (keys, label) from counted label pairs
    (keys, true, pred, n); ratios without a denominator are 0."""
    none, n = F.lit(0).cast("long"), F.col("n")
    same = F.when(F.col("true") == F.col("pred"), n).otherwise(none)
    side = lambda label, support, predicted, tp: F.struct(F.col(label).alias("label"), support.alias("support"), predicted.alias("predicted"), tp.alias("tp"))
    sides = cells.select(*keys, F.inline(F.array(side("true", n, none, same), side("pred", none, n, none))))
    sums = sides.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    out = labels.join(sums, [*keys, "label"], "left").fillna(0, ["support", "predicted", "tp"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))).select(*keys, "label", "precision", "recall", "f1", "support", "predicted", "tp")


def class_report(df: DataFrame, true: str, pred: str, labels: list[str]) -> DataFrame:
    """precision, recall, f1 and support of every label; ratios without a denominator are 0."""
    return report_of(label_pairs(df, true, pred), _grid(df.sparkSession, labels, "label"), [])


def averages(report: DataFrame, keys: list[str] = ()) -> DataFrame:
    """micro, macro and support-weighted averages of a class report, or of each group of it, one row each."""
    p, r, s = F.col("precision"), F.col("recall"), F.col("support")
    sums = report.groupBy(*keys).agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"),
        *[F.avg(x).alias(f"macro_{x}") for x in ("precision", "recall", "f1")],
        *[F.sum(c * s).alias(f"weighted_{n}") for n, c in (("precision", p), ("recall", r), ("f1", F.col("f1")))],
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, said, gold = F.col("tp"), F.col("predicted"), F.col("support")
    row = lambda name, a, b, c: F.struct(F.lit(name).alias("average"), a.alias("precision"), b.alias("recall"), c.alias("f1"), gold.alias("support"))
    rows = [
        row("micro", ratio(tp, said), ratio(tp, gold), ratio(2 * tp, said + gold)),
        row("macro", F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1")),
        row("weighted", *[ratio(F.col(f"weighted_{x}"), gold) for x in ("precision", "recall", "f1")]),
    ]
    return sums.select(*keys, F.inline(F.array(*rows)))


def summary_of(cells: DataFrame, labels: DataFrame, keys: list[str] = ()) -> DataFrame:
    """n, accuracy, f1_macro and f1_weighted of groups from counted label pairs; macro over ``labels`` (keys, label).
    A pair without a prediction is a wrong one."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    acc = cells.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(hit) / F.sum("n")).alias("accuracy"))
    s, f1 = F.sum("support"), F.sum(F.col("f1") * F.col("support"))
    means = report_of(cells, labels, list(keys)).groupBy(*keys).agg(F.avg("f1").alias("f1_macro"), F.when(s > 0, f1 / s).otherwise(0.0).alias("f1_weighted"))
    both = acc.join(means, list(keys)) if keys else acc.crossJoin(means)  # one row each
    return both.select(*keys, "n", "accuracy", "f1_macro", "f1_weighted")


def summary(df: DataFrame, true: str, pred: str, labels: list[str] | None = None) -> DataFrame:
    """n, accuracy, f1_macro, f1_weighted; macro over ``labels`` or, without them, over labels met on either side."""
    cells = label_pairs(df, true, pred)
    met = cells.select(F.col("true").alias("label")).union(cells.select("pred")).distinct() if labels is None else _grid(df.sparkSession, labels, "label")
    return summary_of(cells, met)


def speaker_summaries(df: DataFrame, true: str, pred: str, codes: dict[str, list[str]]) -> DataFrame:
    """``summary`` of each speaker over the rows whose true label is one of its ``codes``."""
    labels = df.sparkSession.createDataFrame([(who, c) for who, own in codes.items() for c in own], "speaker string, label string")
    return summary_of(label_pairs(valid_rows(df, true, codes), true, pred, ["speaker"]), labels, ["speaker"])


def subset_summaries(df: DataFrame, true: str, pred: str, subsets: dict[str, list[str]]) -> DataFrame:
    """Support-weighted precision, recall and f1 over named subsets of codes: subset, gold_inside, precision, recall, f1,
    support, from one scan.

    gold_inside: only rows whose true label is in the subset are judged; otherwise false alarms of other rows count too.
    """
    ways = [(name, inside) for name in subsets for inside in (True, False)]
    labels = df.sparkSession.createDataFrame([(name, inside, c) for name, inside in ways for c in subsets[name]], "subset string, gold_inside boolean, label string")
    way = lambda name, inside: F.struct(F.lit(name).alias("subset"), F.lit(inside).alias("gold_inside"))
    each = F.array(*[F.when(F.col("true").isin(subsets[name]), way(name, True)) if inside else way(name, False) for name, inside in ways])
    cells = label_pairs(df, true, pred).select("true", "pred", "n", F.inline(F.filter(each, lambda x: x.isNotNull())))
    keys = ["subset", "gold_inside"]
    return averages(report_of(cells, labels, keys), keys).filter("average = 'weighted'").drop("average")


def by_group(df: DataFrame, true: str, pred: str, by: str) -> DataFrame:
    """Accuracy and support of each value of ``by``."""
    return df.groupBy(by).agg(F.avg(F.when(F.col(true) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("support"))


def condition_summaries(merged: DataFrame, codes: dict[tuple[str, str], list[str]], scored: str = "ft_t2_pred", conditions: tuple[str, ...] = ("zs", "ft")) -> DataFrame:
    """n, accuracy, f1_macro and f1_weighted of each condition, tier and speaker over the same rows: those that have the
    ``scored`` prediction and, in a tier, a true label (``t1_gold``, ``t2_gold``) among the speaker's ``codes``.

    ``merged``: rows of ``merge_predictions``. A condition that has no prediction for such a row is wrong there. All
    conditions and tiers are counted in one scan.
    """
    tiers = sorted({tier for _, tier in codes})
    labels = [(c, tier, who, code) for c in conditions for (who, tier), own in codes.items() for code in own]
    labels = merged.sparkSession.createDataFrame(labels, "condition string, tier string, speaker string, label string")

    def of(condition: str, tier: str) -> Column:
        gold = F.col(f"{tier}_gold")
        own = reduce(or_, [(F.col("speaker") == who) & gold.isin(v) for (who, t), v in codes.items() if t == tier])
        pred = F.coalesce(F.col(f"{condition}_{tier}_pred"), F.lit(""))
        return F.when(own, F.struct(F.lit(condition).alias("condition"), F.lit(tier).alias("tier"), gold.alias("true"), pred.alias("pred")))

    each = F.array(*[of(c, t) for c in conditions for t in tiers])
    rows = merged.filter(F.col(scored).isNotNull()).select("speaker", F.inline(F.filter(each, lambda x: x.isNotNull())))
    keys = ["condition", "tier", "speaker"]
    return summary_of(rows.groupBy(*keys, "true", "pred").agg(F.count("*").alias("n")), labels, keys)


def family_recall(df: DataFrame, true: str, pred: str, families: dict[str, list[str]]) -> DataFrame:
    """Of each family of codes: support, exact hits, predictions in the family, recall and precision."""
    gold, said = F.col(true), F.col(pred)
    sums, rows = [], []
    for i, (name, codes) in enumerate(families.items()):
        inside = gold.isin(codes)
        sums += [F.count_if(inside).alias(f"s{i}"), F.count_if(inside & (gold == said)).alias(f"c{i}"), F.count_if(said.isin(codes)).alias(f"p{i}")]
        rows.append(F.struct(F.lit(name).alias("family"), F.col(f"s{i}").alias("support"), F.col(f"c{i}").alias("correct"), F.col(f"p{i}").alias("predicted")))
    out = df.agg(*sums).select(F.inline(F.array(*rows)))  # one pass for all families
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select("family", "support", "correct", "predicted", ratio("correct", "support").alias("recall"), ratio("correct", "predicted").alias("precision"))


def top_predictions(df: DataFrame, pred: str, k: int = 8) -> DataFrame:
    return df.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def comparison(first: DataFrame, second: DataFrame, key: str, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Metric tables of two conditions side by side, with deltas, in long form: key, metric, two values, delta."""
    numbers = [c for c, t in first.dtypes if c != key and t in ("double", "bigint")]
    long = lambda df, name: df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in numbers])))
    both = long(first, names[0]).join(long(second, names[1]), [key, "metric"])
    return both.withColumn("delta", F.col(names[1]) - F.col(names[0]))


def merge_predictions(rows: DataFrame, zero_shot: DataFrame, tuned: DataFrame, key: list[str]) -> DataFrame:
    """Rows with both conditions' predictions beside them: zs_t1_pred, zs_t2_pred, ft_t1_pred, ft_t2_pred, null where a
    condition has none. The predictions have the key, t1_pred and t2_pred, one row a key."""
    named = lambda df, short: df.select(*key, F.col("t1_pred").alias(f"{short}_t1_pred"), F.col("t2_pred").alias(f"{short}_t2_pred"))
    return rows.join(named(zero_shot, "zs"), key, "left").join(named(tuned, "ft"), key, "left")
