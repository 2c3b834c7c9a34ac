"""Agreement of all tiers and speakers from one scan.

Rows become (tier, speaker, true, pred) once, and one aggregation by grouping sets counts them for each speaker and for all
together. What follows works on these cells, of which there are as many as pairs of codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.labels import is_valid
from parley.operators.agreement import kappa_of
from parley.operators.metrics import averages, report_of
from parley.operators.order import held
from parley.operators.trajectory import leave_each_out, simple_regressions, spearman, with_correlation_p
from parley.vocab import VOCABULARY, vocabulary

ALL = "all"
KEYS = ["tier", "speaker"]


def tier_pairs(rows: DataFrame, tiers: dict[str, tuple[str, str]], own: Column | None = None) -> DataFrame:
    """(tier, speaker, true, pred, and the columns ``own`` names): a row for each tier of a row whose two labels are both
    codes of its speaker there. ``tiers``: the true and the predicted column of each tier."""
    keep = [own] if own is not None else []

    def of(tier: str, true: str, pred: str) -> Column:
        both = is_valid(F.col(true), F.col("speaker"), tier) & is_valid(F.col(pred), F.col("speaker"), tier)
        return F.when(both, F.struct(F.lit(tier).alias("tier"), F.col(true).alias("true"), F.col(pred).alias("pred")))

    each = F.array(*[of(tier, *columns) for tier, columns in tiers.items()])
    return rows.select("speaker", *keep, F.inline(F.filter(each, lambda x: x.isNotNull())))


def cells(pairs: DataFrame) -> DataFrame:
    """(tier, speaker, true, pred, n) of ``tier_pairs``; the speaker ``ALL`` stands for all of them."""
    sets = [["tier", "speaker", "true", "pred"], ["tier", "true", "pred"]]
    out = pairs.groupingSets(sets, *sets[0]).agg(F.count("*").alias("n"), F.grouping("speaker").alias("_over"))
    return out.withColumn("speaker", F.when(F.col("_over") == 1, ALL).otherwise(F.col("speaker"))).drop("_over")


def _codes(tiers) -> list[tuple[str, str, list[str]]]:
    own = {(tier, who): codes for (who, tier), codes in VOCABULARY.items() if tier in tiers}
    return [(tier, who, codes) for (tier, who), codes in own.items()] + [(tier, ALL, vocabulary(tier)) for tier in tiers]


def label_grid(spark: SparkSession, tiers, pairs: bool = False) -> DataFrame:
    """(tier, speaker, label), or (tier, speaker, true, pred) with ``pairs``: every code of a group, met or not."""
    if pairs:
        return spark.createDataFrame([(t, w, a, b) for t, w, codes in _codes(tiers) for a in codes for b in codes], "tier string, speaker string, true string, pred string")
    return spark.createDataFrame([(t, w, c) for t, w, codes in _codes(tiers) for c in codes], "tier string, speaker string, label string")


def confusions(found: DataFrame, tiers) -> DataFrame:
    """(tier, speaker, true, pred, n) with 0 for pairs that were not met."""
    return label_grid(found.sparkSession, tiers, pairs=True).join(found, [*KEYS, "true", "pred"], "left").fillna(0, ["n"])


def class_reports(found: DataFrame, tiers) -> DataFrame:
    """precision, recall, f1, support, predicted and tp of each code in each group."""
    return report_of(found, label_grid(found.sparkSession, tiers), KEYS)


def agreement_tables(rows: DataFrame, tiers: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """kappa, confusion, classes and averages of every tier and speaker, and of all speakers; ``rows`` are read once."""
    found = held(cells(tier_pairs(rows, tiers)).coalesce(1))  # pairs of codes
    classes = class_reports(found, tiers)
    return {"kappa": kappa_of(found, KEYS), "confusion": confusions(found, tiers), "classes": classes, "averages": averages(classes, KEYS)}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """CSV under ``path/<table>/tier=../speaker=..``: a reader of one group opens its files alone."""
    for name, df in tables.items():
        df.repartition(1, *KEYS).write.mode("overwrite").partitionBy(*KEYS).csv(f"{path}/{name}", header=True)


def outcome_tables(sessions: DataFrame, columns: list[str], outcome: str, key: str = "conv_id") -> dict[str, DataFrame]:
    """What relates session metrics to an outcome: the sessions themselves (agg), correlation (rank and product-moment, with
    p-values and the line) by metric, and loocv, the predictions of each session from the others by metric. Sessions are
    read from the checkpoint folder by all three."""
    rows = held(sessions.select(key, *columns, outcome))
    ranks = with_correlation_p(spearman(rows, columns, outcome)).select("metric", F.col("r").alias("rank_r"), F.col("p_value").alias("rank_p"))
    lines = with_correlation_p(simple_regressions(rows, columns, outcome))
    return {"agg": rows, "correlation": lines.join(ranks, "metric", "left"), "loocv": leave_each_out(rows, columns, outcome, key)}


def write_outcome_tables(tables: dict[str, DataFrame], path: str) -> None:
    """CSV with a header under ``path/<table>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)
