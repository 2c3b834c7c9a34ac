"""Queries: agreement, metrics, sessions, roll-ups, trajectories, models, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import labels as L
from parley.functions.stats import keyed_id
from parley.operators import adapter, agreement, annotate, dtw, embed, experiments, learn, metrics, plots, reports, rollup, sessions, trajectory
from parley.operators.order import held, running_by
from parley.plans import fixtures as fx
from parley.vocab import (
    CHANGE_TALK, CLIENT_REDUCED, CLIENT_T2, COUNSELLOR_REDUCED, COUNSELLOR_T1, COUNSELLOR_T2, MI_CONSISTENT, MI_INCONSISTENT, MOBILISING, PREPARATORY, SCALES, SUSTAIN_TALK, VOCABULARY, vocabulary,
)

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = fx.plain(sql)
        return f

    return add


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _values(values, name: str) -> str:
    return f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {name})"


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# Agreement.
for _tier in ("t1", "t2"):
    def _confusion(spark, sf, tier=_tier):
        return agreement.confusion_matrix(fx.coded(spark, sf), f"{tier}_gold", f"{tier}_auto", vocabulary(tier))

    QUERIES[f"confusion_{_tier}"] = _confusion
    SQL[f"confusion_{_tier}"] = fx.sql(
        f"""SELECT a.x AS "true", b.y AS pred, coalesce(n, 0) AS n FROM {_values(vocabulary(_tier), "x")} a CROSS JOIN {_values(vocabulary(_tier), "y")} b
        LEFT JOIN (SELECT {_tier}_gold AS g, {_tier}_auto AS p, count(*) AS n FROM coded GROUP BY ALL) c ON c.g = a.x AND c.p = b.y""",
        "coded",
    )


def _kappa_sql(source: str, by: str, variant: str = "row_plus_column") -> str:
    w = "coalesce(rt.n, 0) + coalesce(cp.n, 0)" if variant == "row_plus_column" else "coalesce(ct.n, 0) + coalesce(rp.n, 0)"
    k = lambda a, b: " AND ".join(f"{a}.{x.strip()} = {b}.{x.strip()}" for x in by.split(","))
    return f""", pairs AS ({source}), cells AS (SELECT {by}, g, p, count(*) AS n FROM pairs WHERE g IS NOT NULL AND p IS NOT NULL GROUP BY ALL),
    tot AS (SELECT {by}, sum(n) AS total FROM cells GROUP BY ALL), rw AS (SELECT {by}, g AS l, sum(n) AS n FROM cells GROUP BY ALL), cl AS (SELECT {by}, p AS l, sum(n) AS n FROM cells GROUP BY ALL),
    ch AS (SELECT {", ".join("rw." + x.strip() for x in by.split(","))}, sum(rw.n * cl.n) AS chance FROM rw JOIN cl ON {k("rw", "cl")} AND rw.l = cl.l GROUP BY ALL),
    s AS (SELECT {", ".join("cells." + x.strip() for x in by.split(","))}, any_value(total) AS n, sum(CASE WHEN g = p THEN cells.n / total ELSE 0 END) AS p0,
      sum(CASE WHEN g = p THEN cells.n / total * (rt.n + cp.n) / total ELSE 0 END) AS t3, sum(cells.n / total * power(({w}) / total, 2)) AS t4
      FROM cells JOIN tot ON {k("cells", "tot")} LEFT JOIN rw rt ON {k("cells", "rt")} AND rt.l = g LEFT JOIN cl cp ON {k("cells", "cp")} AND cp.l = p
      LEFT JOIN cl ct ON {k("cells", "ct")} AND ct.l = g LEFT JOIN rw rp ON {k("cells", "rp")} AND rp.l = p GROUP BY ALL),
    f AS (SELECT s.*, coalesce(chance / (s.n * s.n), 0) AS pe FROM s LEFT JOIN ch ON {k("s", "ch")}),
    v AS (SELECT *, (p0 - pe) / (1 - pe) AS kappa, (p0 * (1 - p0) / power(1 - pe, 2) + 2 * (1 - p0) * (2 * p0 * pe - t3) / power(1 - pe, 3) + power(1 - p0, 2) * (t4 - 4 * pe * pe) / power(1 - pe, 4)) / n AS variance FROM f)
    SELECT {by}, CAST(n AS BIGINT) AS n, {_r("p0", "pe", "kappa", "variance")}, round(CASE WHEN variance > 0 THEN kappa / sqrt(variance) END, 4) AS z FROM v"""


def _kappa_out(df):
    return _round(df, "p0", "pe", "kappa", "variance").withColumn("z", F.round("z", 4))


for _tier in ("t1", "t2"):
    def _kappa(spark, sf, tier=_tier):
        return _kappa_out(agreement.kappa(fx.coded(spark, sf), f"{tier}_gold", f"{tier}_auto", ["speaker"]))

    QUERIES[f"kappa_{_tier}"] = _kappa
    SQL[f"kappa_{_tier}"] = fx.sql(_kappa_sql(f"SELECT speaker, {_tier}_gold AS g, {_tier}_auto AS p FROM coded", "speaker"), "coded")


@query(fx.sql(_kappa_sql("SELECT speaker, t2_gold AS g, t2_auto AS p FROM coded", "speaker", "textbook"), "coded"))
def kappa_variance_textbook(spark, sf):
    return _kappa_out(agreement.kappa(fx.coded(spark, sf), "t2_gold", "t2_auto", ["speaker"], "textbook"))


@query()
def kappa_p_values(spark, sf):
    return agreement.with_p_value(agreement.kappa(fx.coded(spark, sf), "t2_gold", "t2_auto", ["speaker"]))


@query(
    fx.sql(
        _kappa_sql("SELECT a.speaker, a.rater AS rater_1, b.rater AS rater_2, a.label AS g, b.label AS p FROM ratings a JOIN ratings b ON a.conv_id = b.conv_id AND a.conv_utt_idx = b.conv_utt_idx AND a.rater < b.rater", "speaker, rater_1, rater_2"),
        "ratings",
    )
)
def pairwise_kappa(spark, sf):
    return _kappa_out(agreement.pairwise_kappa(fx.ratings(spark, sf), ["conv_id", "conv_utt_idx"], ["speaker"]))


_WHOLE = """, counts AS (SELECT conv_id, conv_utt_idx, label, count(*) AS n FROM ratings WHERE label IS NOT NULL GROUP BY ALL),
    whole AS (SELECT c.* FROM counts c JOIN (SELECT conv_id, conv_utt_idx FROM counts GROUP BY ALL HAVING sum(n) = 3) w ON c.conv_id = w.conv_id AND c.conv_utt_idx = w.conv_utt_idx)"""


@query(
    fx.sql(
        _WHOLE + """, i AS (SELECT (sum(n * n) - 3) / 6.0::DOUBLE AS p FROM whole GROUP BY conv_id, conv_utt_idx), l AS (SELECT label, sum(n) AS n FROM whole GROUP BY label),
        a AS (SELECT count(*) AS n_items, avg(p) AS p_bar FROM i), b AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS pe FROM l)
        SELECT n_items, round(p_bar, 6) AS p_bar, round(pe, 6) AS pe, round((p_bar - pe) / (1 - pe), 6) AS kappa FROM a, b""",
        "ratings",
    )
)
def fleiss_kappa(spark, sf):
    return _round(agreement.fleiss_kappa(fx.ratings(spark, sf), ["conv_id", "conv_utt_idx"], 3), "p_bar", "pe", "kappa")


@query(fx.sql(_WHOLE + " SELECT conv_id, conv_utt_idx, count(*) AS n_labels FROM whole GROUP BY ALL HAVING count(*) > 1", "ratings"))
def disagreement_rows(spark, sf):
    return agreement.disagreements(fx.ratings(spark, sf), ["conv_id", "conv_utt_idx"], 3)


def _wide_ratings(spark, sf):
    pick = lambda r: F.max(F.when(F.col("rater") == r, F.col("label"))).alias(r)
    return fx.ratings(spark, sf).groupBy("conv_id", "conv_utt_idx").agg(pick("a"), pick("b")).join(fx.coded(spark, sf).select("conv_id", "conv_utt_idx", "t2_gold"), ["conv_id", "conv_utt_idx"])


@query(
    fx.sql(
        """SELECT count_if(x AND y) AS "both", count_if(x AND NOT y) AS only_first, count_if(NOT x AND y) AS only_second, count_if(NOT x AND NOT y) AS neither FROM
        (SELECT a.label = c.t2_gold AS x, b.label = c.t2_gold AS y FROM coded c JOIN ratings a ON a.rater = 'a' AND a.conv_id = c.conv_id AND a.conv_utt_idx = c.conv_utt_idx
        JOIN ratings b ON b.rater = 'b' AND b.conv_id = c.conv_id AND b.conv_utt_idx = c.conv_utt_idx)""",
        "ratings",
    )
)
def mcnemar_cells(spark, sf):
    return agreement.mcnemar_cells(_wide_ratings(spark, sf), "t2_gold", "a", "b")


@query(
    fx.sql(
        """, cells AS (SELECT count_if(x AND y) AS "both", count_if(x AND NOT y) AS only_first, count_if(NOT x AND y) AS only_second, count_if(NOT x AND NOT y) AS neither FROM
        (SELECT a.label = c.t2_gold AS x, b.label = c.t2_gold AS y FROM coded c JOIN ratings a ON a.rater = 'a' AND a.conv_id = c.conv_id AND a.conv_utt_idx = c.conv_utt_idx
        JOIN ratings b ON b.rater = 'b' AND b.conv_id = c.conv_id AND b.conv_utt_idx = c.conv_utt_idx)),
        terms AS (SELECT only_first + only_second AS n, unnest(range(least(only_first, only_second) + 1)) AS i FROM cells)
        SELECT cells.*, round(least(1.0::DOUBLE, (SELECT 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM terms)), 6) AS p_value FROM cells""",
        "ratings",
    )
)
def mcnemar(spark, sf):
    return _round(agreement.mcnemar(_wide_ratings(spark, sf), "t2_gold", "a", "b"), "p_value")


_TIERS = {"t1": ("t1_gold", "t1_auto"), "t2": ("t2_gold", "t2_auto")}
_OWN = {(who, tier): _in(VOCABULARY[who, tier]) for who in ("counsellor", "client") for tier in ("t1", "t2")}
_ALIGNED = " UNION ALL ".join(
    f"SELECT m.speaker, '{tier}' AS tier, m.{tier}_gold AS g, a.{tier}_auto AS p FROM coded m JOIN coded a ON a.conv_utt_idx % 5 <> 0 AND a.conv_id = m.conv_id AND a.conv_utt_idx = m.conv_utt_idx "
    f"WHERE m.speaker = '{who}' AND m.{tier}_gold IN {_OWN[who, tier]} AND a.{tier}_auto IN {_OWN[who, tier]}"
    for who, tier in _OWN
)


@query(fx.sql(_kappa_sql(_ALIGNED, "speaker, tier"), "coded"))
def gold_auto_report(spark, sf):
    """Human and automatic tables joined by key, then kappa for each tier and speaker."""
    key = ["conv_id", "conv_utt_idx"]
    manual, auto = fx.coded(spark, sf).drop("t1_auto", "t2_auto"), fx.coded(spark, sf).filter("conv_utt_idx % 5 <> 0").select(*key, "t1_auto", "t2_auto")
    return _kappa_out(agreement.agreement_report(manual, auto, key, _TIERS))


_GROUPED = " UNION ALL ".join(
    f"SELECT speaker, '{tier}' AS tier, {tier}_gold AS g, {tier}_auto AS p FROM coded WHERE speaker = '{who}' AND {tier}_gold IN {_OWN[who, tier]} AND {tier}_auto IN {_OWN[who, tier]}" for who, tier in _OWN
)
_GROUPED = f"WITH own AS ({_GROUPED}) SELECT * FROM own UNION ALL SELECT 'all', tier, g, p FROM own"
_EVERY = [(t, w, VOCABULARY[w, t]) for t in ("t1", "t2") for w in ("counsellor", "client")] + [(t, "all", vocabulary(t)) for t in ("t1", "t2")]
_EVERY_LABEL = "(" + " UNION ALL ".join(f"SELECT '{t}' AS tier, '{w}' AS speaker, label FROM {_values(codes, 'label')}" for t, w, codes in _EVERY) + ")"
_GROUP_REPORT = f""", pairs AS ({_GROUPED}), rep AS (SELECT l.*, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted FROM {_EVERY_LABEL} l
    LEFT JOIN (SELECT tier, speaker, g AS label, count(*) AS support, count_if(g = p) AS tp FROM pairs GROUP BY ALL) a USING (tier, speaker, label)
    LEFT JOIN (SELECT tier, speaker, p AS label, count(*) AS predicted FROM pairs GROUP BY ALL) b USING (tier, speaker, label)),
    full_rep AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0::DOUBLE END AS "precision", CASE WHEN support > 0 THEN tp / support ELSE 0.0::DOUBLE END AS recall,
    CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0.0::DOUBLE END AS f1 FROM rep)"""


def _tables(spark, sf):
    return reports.agreement_tables(fx.coded(spark, sf), {"t1": ("t1_gold", "t1_auto"), "t2": ("t2_gold", "t2_auto")})


@query(fx.sql(_kappa_sql(_GROUPED, "speaker, tier"), "coded"))
def grouped_kappa(spark, sf):
    """Kappa of each tier for each speaker and for all, from one scan."""
    return _kappa_out(_tables(spark, sf)["kappa"])


@query(
    fx.sql(
        f""", pairs AS ({_GROUPED}), n AS (SELECT tier, speaker, g, p, count(*) AS n FROM pairs GROUP BY ALL)
        SELECT a.tier, a.speaker, a.label AS "true", b.label AS pred, coalesce(n, 0) AS n FROM {_EVERY_LABEL} a JOIN {_EVERY_LABEL} b USING (tier, speaker)
        LEFT JOIN n ON n.tier = a.tier AND n.speaker = a.speaker AND n.g = a.label AND n.p = b.label""",
        "coded",
    )
)
def grouped_confusion(spark, sf):
    return _tables(spark, sf)["confusion"]


@query(fx.sql(_GROUP_REPORT + ' SELECT tier, speaker, label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted, tp FROM full_rep', "coded"))
def grouped_class_reports(spark, sf):
    return _round(_tables(spark, sf)["classes"], "precision", "recall", "f1")


@query(
    fx.sql(
        _GROUP_REPORT
        + """ SELECT tier, speaker, 'micro' AS average, round(sum(tp) / sum(predicted), 6) AS "precision", round(sum(tp) / sum(support), 6) AS recall, round(2 * sum(tp) / (sum(predicted) + sum(support)), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM full_rep GROUP BY ALL
        UNION ALL SELECT tier, speaker, 'macro', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM full_rep GROUP BY ALL
        UNION ALL SELECT tier, speaker, 'weighted', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM full_rep GROUP BY ALL""",
        "coded",
    )
)
def grouped_averages(spark, sf):
    return _round(_tables(spark, sf)["averages"], "precision", "recall", "f1")


def _two_conditions(spark, sf):
    key = ["conv_id", "conv_utt_idx"]
    rows = fx.coded(spark, sf).select(*key, "speaker", "t1_gold", "t2_gold", "t1_auto", "t2_auto")
    zero = rows.filter("conv_utt_idx % 4 <> 1").select(*key, F.col("t1_auto").alias("t1_pred"), F.col("t2_auto").alias("t2_pred"))
    tuned = rows.filter("conv_utt_idx % 4 <> 2").select(*key, F.col("t1_gold").alias("t1_pred"), F.col("t2_gold").alias("t2_pred"))
    return rows, zero, tuned


@query(
    fx.sql(
        "SELECT conv_id, conv_utt_idx, speaker, t1_gold, t2_gold, CASE WHEN conv_utt_idx % 4 <> 1 THEN t1_auto END AS zs_t1_pred, CASE WHEN conv_utt_idx % 4 <> 1 THEN t2_auto END AS zs_t2_pred, "
        "CASE WHEN conv_utt_idx % 4 <> 2 THEN t1_gold END AS ft_t1_pred, CASE WHEN conv_utt_idx % 4 <> 2 THEN t2_gold END AS ft_t2_pred FROM coded",
        "coded",
    )
)
def merge_predictions(spark, sf):
    rows, zero, tuned = _two_conditions(spark, sf)
    return metrics.merge_predictions(rows.drop("t1_auto", "t2_auto"), zero, tuned, ["conv_id", "conv_utt_idx"])


_CONDITIONS = " UNION ALL ".join(
    f"SELECT '{c}' AS condition, '{tier}' AS tier, speaker, {tier}_gold AS g, CASE WHEN conv_utt_idx % 4 <> {skip} THEN {tier}_{source} END AS p FROM coded WHERE conv_utt_idx % 4 <> 2 AND speaker = '{who}' AND {tier}_gold IN {_OWN[who, tier]}"
    for c, source, skip in (("zs", "auto", 1), ("ft", "gold", 2)) for who, tier in _OWN
)
_CONDITION_LABELS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS tier, '{w}' AS speaker, label FROM {_values(VOCABULARY[w, t], 'label')}" for w, t in _OWN) + ")"


@query(
    fx.sql(
        f""", pairs AS ({_CONDITIONS}), acc AS (SELECT condition, tier, speaker, count(*) AS n, avg(CASE WHEN g = p THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pairs GROUP BY ALL),
        rep AS (SELECT c.condition, l.*, coalesce(s, 0) AS s, CASE WHEN coalesce(s, 0) + coalesce(q, 0) > 0 THEN 2 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(q, 0)) ELSE 0.0::DOUBLE END AS f1
          FROM {_CONDITION_LABELS} l CROSS JOIN (SELECT unnest(['zs', 'ft']) AS condition) c
          LEFT JOIN (SELECT condition, tier, speaker, g AS label, count(*) AS s, count_if(g = p) AS tp FROM pairs GROUP BY ALL) a ON a.condition = c.condition AND a.tier = l.tier AND a.speaker = l.speaker AND a.label = l.label
          LEFT JOIN (SELECT condition, tier, speaker, p AS label, count(*) AS q FROM pairs GROUP BY ALL) b ON b.condition = c.condition AND b.tier = l.tier AND b.speaker = l.speaker AND b.label = l.label)
        SELECT condition, tier, speaker, any_value(n) AS n, round(any_value(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * s) / sum(s), 6) AS f1_weighted FROM rep JOIN acc USING (condition, tier, speaker) GROUP BY ALL""",
        "coded",
    )
)
def scored_conditions(spark, sf):
    """Both conditions on the rows that the tuned one predicted, each tier and speaker."""
    rows, zero, tuned = _two_conditions(spark, sf)
    merged = metrics.merge_predictions(rows.drop("t1_auto", "t2_auto"), zero, tuned, ["conv_id", "conv_utt_idx"])
    return _round(metrics.condition_summaries(merged, VOCABULARY), "accuracy", "f1_macro", "f1_weighted")


def _labels_sql(tier: str, scale: str) -> str:
    label = f"CASE WHEN speaker = 'counsellor' THEN t1_gold ELSE {tier}_gold END"
    flags = ", ".join(f"CAST(max(CASE WHEN label = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS is_{c.lower()}" for c in COUNSELLOR_T1)
    return fx.sql(
        f""", l AS (SELECT conv_id, conv_utt_idx, conv_vol_idx, speaker, {label} AS label FROM coded), f AS (SELECT conv_id, conv_utt_idx, {flags} FROM l GROUP BY ALL),
        c AS (SELECT conv_id, conv_utt_idx, CAST({fx.sql_map(SCALES[scale], "label")} AS DOUBLE) AS client_code FROM l WHERE speaker = 'client'),
        m AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY conv_vol_idx) - 1 AS volley_rank FROM l)
        SELECT f.*, client_code, conv_vol_idx, speaker, label, volley_rank FROM f LEFT JOIN c USING (conv_id, conv_utt_idx) LEFT JOIN m USING (conv_id, conv_utt_idx)""",
        "coded",
    )


for _tier, _scale in (("t1", "plot_t1"), ("t2", "plot_t2")):
    def _labels(spark, sf, tier=_tier, scale=_scale):
        return sessions.utterance_labels(fx.coded(spark, sf), tier, COUNSELLOR_T1, SCALES[scale], "t1_gold", "t2_gold")

    QUERIES[f"utterance_labels_{_tier}"], SQL[f"utterance_labels_{_tier}"] = _labels, _labels_sql(_tier, _scale)


@query(fx.sql("SELECT conv_id, conv_utt_idx, CASE WHEN lower(speaker) = 'client' THEN t1_gold ELSE t2_gold END AS label FROM coded", "coded"))
def mixed_labels(spark, sf):
    return fx.coded(spark, sf).select("conv_id", "conv_utt_idx", sessions.mixed_label("speaker", "t1_gold", "t2_gold").alias("label"))


# Metrics.
def _report_sql(source: str, labels: list[str]) -> str:
    return f""", pairs AS ({source}), rep AS (SELECT l.label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
      CASE WHEN coalesce(predicted, 0) > 0 THEN coalesce(tp, 0) / predicted ELSE 0.0::DOUBLE END AS "precision", CASE WHEN coalesce(support, 0) > 0 THEN coalesce(tp, 0) / support ELSE 0.0::DOUBLE END AS recall,
      CASE WHEN coalesce(predicted, 0) + coalesce(support, 0) > 0 THEN 2 * coalesce(tp, 0) / (coalesce(predicted, 0) + coalesce(support, 0)) ELSE 0.0::DOUBLE END AS f1
      FROM {_values(labels, "label")} l LEFT JOIN (SELECT g AS label, count(*) AS support, count_if(g = p) AS tp FROM pairs GROUP BY g) a ON a.label = l.label
      LEFT JOIN (SELECT p AS label, count(*) AS predicted FROM pairs GROUP BY p) b ON b.label = l.label)"""


_PAIRS = "SELECT t2_gold AS g, t2_auto AS p FROM coded"


@query(fx.sql(_report_sql(_PAIRS, vocabulary("t2")) + ' SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted, tp FROM rep', "coded"))
def class_report(spark, sf):
    return _round(metrics.class_report(fx.coded(spark, sf), "t2_gold", "t2_auto", vocabulary("t2")), "precision", "recall", "f1")


@query(
    fx.sql(
        _report_sql(_PAIRS, vocabulary("t2"))
        + """ SELECT 'micro' AS average, round(sum(tp) / sum(predicted), 6) AS "precision", round(sum(tp) / sum(support), 6) AS recall, round(2 * sum(tp) / (sum(predicted) + sum(support)), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM rep
        UNION ALL SELECT 'macro', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rep
        UNION ALL SELECT 'weighted', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rep""",
        "coded",
    )
)
def report_averages(spark, sf):
    return _round(metrics.averages(metrics.class_report(fx.coded(spark, sf), "t2_gold", "t2_auto", vocabulary("t2"))), "precision", "recall", "f1")


@query(
    fx.sql(
        _report_sql(_PAIRS, vocabulary("t2"))
        + " SELECT (SELECT count(*) FROM pairs) AS n, (SELECT round(avg(CASE WHEN g = p THEN 1.0::DOUBLE ELSE 0 END), 6) FROM pairs) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep",
        "coded",
    )
)
def f1_summary(spark, sf):
    return _round(metrics.summary(fx.coded(spark, sf), "t2_gold", "t2_auto", vocabulary("t2")), "accuracy", "f1_macro", "f1_weighted")


@query(
    fx.sql(
        _report_sql("SELECT t2_gold AS g, t2_auto AS p FROM coded", vocabulary("t2"))
        + " SELECT (SELECT count(*) FROM pairs) AS n, (SELECT round(avg(CASE WHEN g = p THEN 1.0::DOUBLE ELSE 0 END), 6) FROM pairs) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep WHERE support > 0 OR predicted > 0",
        "coded",
    )
)
def f1_summary_met_labels(spark, sf):
    return _round(metrics.summary(fx.coded(spark, sf), "t2_gold", "t2_auto"), "accuracy", "f1_macro", "f1_weighted")


@query(fx.sql("SELECT speaker, round(avg(CASE WHEN t1_gold = t1_auto THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS support FROM coded GROUP BY speaker", "coded"))
def t1_accuracy_by_speaker(spark, sf):
    return _round(metrics.by_group(fx.coded(spark, sf), "t1_gold", "t1_auto", "speaker"), "accuracy")


_T2_BY = " UNION ALL ".join(
    f"""SELECT '{who}' AS speaker, (SELECT count(*) FROM coded WHERE speaker = '{who}') AS n, (SELECT round(avg(CASE WHEN t2_gold = t2_auto THEN 1.0::DOUBLE ELSE 0 END), 6) FROM coded WHERE speaker = '{who}') AS accuracy,
    round(avg(f1), 6) AS f1_macro, round(sum(f1 * s) / sum(s), 6) AS f1_weighted FROM (SELECT l.label, coalesce(s, 0) AS s, CASE WHEN coalesce(s, 0) + coalesce(q, 0) > 0 THEN 2 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(q, 0)) ELSE 0.0::DOUBLE END AS f1
    FROM {_values(VOCABULARY[who, "t2"], "label")} l LEFT JOIN (SELECT t2_gold AS label, count(*) AS s, count_if(t2_gold = t2_auto) AS tp FROM coded WHERE speaker = '{who}' GROUP BY 1) a ON a.label = l.label
    LEFT JOIN (SELECT t2_auto AS label, count(*) AS q FROM coded WHERE speaker = '{who}' GROUP BY 1) b ON b.label = l.label)"""
    for who in ("counsellor", "client")
)


@query(fx.sql(_T2_BY, "coded"))
def t2_metrics_by_speaker(spark, sf):
    found = metrics.speaker_summaries(fx.coded(spark, sf), "t2_gold", "t2_auto", {"counsellor": COUNSELLOR_T2, "client": CLIENT_T2})
    return _round(found, "accuracy", "f1_macro", "f1_weighted")


def _subset_sql(name: str, codes: list[str], inside: bool) -> str:
    source = f"SELECT t2_gold AS g, t2_auto AS p FROM coded WHERE speaker = 'client'" + (f" AND t2_gold IN {_in(codes)}" if inside else "")
    pairs, rest = f"({source})", f"{_values(codes, 'label')} l"
    return f"""SELECT '{name}' AS subset, {str(inside).lower()} AS gold_inside, round(sum(pr * s) / sum(s), 6) AS "precision", round(sum(rc * s) / sum(s), 6) AS recall, round(sum(f1 * s) / sum(s), 6) AS f1, CAST(sum(s) AS BIGINT) AS support FROM
      (SELECT coalesce(s, 0) AS s, CASE WHEN coalesce(q, 0) > 0 THEN coalesce(tp, 0) / q ELSE 0.0::DOUBLE END AS pr, CASE WHEN coalesce(s, 0) > 0 THEN coalesce(tp, 0) / s ELSE 0.0::DOUBLE END AS rc,
       CASE WHEN coalesce(s, 0) + coalesce(q, 0) > 0 THEN 2 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(q, 0)) ELSE 0.0::DOUBLE END AS f1
       FROM {rest} LEFT JOIN (SELECT g AS label, count(*) AS s, count_if(g = p) AS tp FROM {pairs} GROUP BY 1) a ON a.label = l.label LEFT JOIN (SELECT p AS label, count(*) AS q FROM {pairs} GROUP BY 1) b ON b.label = l.label)"""


@query(fx.sql(" UNION ALL ".join(_subset_sql(n, c, i) for n, c in (("change_talk", CHANGE_TALK), ("sustain_talk", SUSTAIN_TALK)) for i in (True, False)), "coded"))
def change_sustain(spark, sf):
    rows = fx.coded(spark, sf).filter("speaker = 'client'")
    found = metrics.subset_summaries(rows, "t2_gold", "t2_auto", {"change_talk": CHANGE_TALK, "sustain_talk": SUSTAIN_TALK})
    return _round(found, "precision", "recall", "f1")


_FAMILIES = {"change": CHANGE_TALK, "sustain": SUSTAIN_TALK, "neutral": ["N"], "questions": ["OQ", "CQ"], "reflections": ["CR", "SR", "RF"], "consistent": MI_CONSISTENT, "inconsistent": MI_INCONSISTENT}


@query(
    fx.sql(
        " UNION ALL ".join(
            f"""SELECT family, support, correct, predicted, round(CASE WHEN support > 0 THEN correct / support ELSE 0.0::DOUBLE END, 6) AS recall, round(CASE WHEN predicted > 0 THEN correct / predicted ELSE 0.0::DOUBLE END, 6) AS "precision" FROM
            (SELECT '{k}' AS family, count_if(t2_gold IN {_in(v)}) AS support, count_if(t2_gold IN {_in(v)} AND t2_gold = t2_auto) AS correct, count_if(t2_auto IN {_in(v)}) AS predicted FROM coded)"""
            for k, v in _FAMILIES.items()
        ),
        "coded",
    )
)
def family_recall(spark, sf):
    return _round(metrics.family_recall(fx.coded(spark, sf), "t2_gold", "t2_auto", _FAMILIES), "recall", "precision")


@query(fx.sql("SELECT t2_auto AS label, count(*) AS n FROM coded GROUP BY 1 ORDER BY n DESC, label LIMIT 8", "coded"))
def top_predictions(spark, sf):
    return metrics.top_predictions(fx.coded(spark, sf), "t2_auto")


def _condition(col: str) -> str:
    return f"(SELECT speaker, avg(CASE WHEN t2_gold = {col} THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*)::DOUBLE AS support FROM j GROUP BY speaker)"


@query(
    fx.sql(
        f""", j AS (SELECT c.speaker, c.t2_gold, c.t2_auto, r.label AS t2_b FROM coded c JOIN ratings r ON r.rater = 'b' AND r.conv_id = c.conv_id AND r.conv_utt_idx = c.conv_utt_idx)
        SELECT a.speaker, m.metric, round(CASE m.metric WHEN 'accuracy' THEN a.accuracy ELSE a.support END, 6) AS zero_shot, round(CASE m.metric WHEN 'accuracy' THEN b.accuracy ELSE b.support END, 6) AS tuned,
        round(CASE m.metric WHEN 'accuracy' THEN b.accuracy - a.accuracy ELSE b.support - a.support END, 6) AS delta FROM {_condition("t2_auto")} a JOIN {_condition("t2_b")} b ON a.speaker = b.speaker
        CROSS JOIN (SELECT unnest(['accuracy', 'support']) AS metric) m""",
        "ratings",
    )
)
def prediction_comparison(spark, sf):
    other = fx.ratings(spark, sf).filter("rater = 'b'").select("conv_id", "conv_utt_idx", F.col("label").alias("t2_b"))
    rows = fx.coded(spark, sf).join(other, ["conv_id", "conv_utt_idx"], "left")
    both = metrics.comparison(metrics.by_group(rows, "t2_gold", "t2_auto", "speaker"), metrics.by_group(rows, "t2_gold", "t2_b", "speaker"), "speaker", ("zero_shot", "tuned"))
    return _round(both, "zero_shot", "tuned", "delta")


# Sessions.
_SESSION = f""", m AS (SELECT conv_id, count_if(t1_auto = 'C') AS n_c, count_if(t1_auto = 'S') AS n_s, count_if(t2_auto IN ('SR', 'CR')) AS n_r, count_if(t1_auto = 'Q') AS n_q,
    count_if(t2_auto IN {_in(MI_CONSISTENT)}) AS n_mico, count_if(t2_auto IN {_in(MI_INCONSISTENT)}) AS n_miin FROM coded GROUP BY conv_id),
    sm AS (SELECT *, CASE WHEN n_mico + n_miin > 0 THEN n_mico / (n_mico + n_miin) ELSE 0.0::DOUBLE END AS pct_mic, CASE WHEN n_q > 0 THEN n_r / n_q ELSE 0.0::DOUBLE END AS r_to_q, CASE WHEN n_c + n_s > 0 THEN n_c / (n_c + n_s) ELSE 0.0::DOUBLE END AS pct_ct FROM m)"""


@query(fx.sql(_SESSION + " SELECT conv_id, n_c, n_s, n_r, n_q, n_mico, n_miin, round(pct_mic, 6) AS pct_mic, round(r_to_q, 6) AS r_to_q, round(pct_ct, 6) AS pct_ct FROM sm", "coded"))
def session_metrics(spark, sf):
    return _round(sessions.session_metrics(fx.coded(spark, sf), "t1_auto", "t2_auto"), "pct_mic", "r_to_q", "pct_ct")


_ALL_CODES = [*COUNSELLOR_T2, *CLIENT_T2]
_count = lambda codes: f"count_if(t2_auto IN {_in(codes)})"
_ratio = lambda a, b, k=1: f"round({k} * CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0.0::DOUBLE END, 6)"


@query(
    fx.sql(
        f"SELECT conv_id, {_ratio(_count(MI_CONSISTENT), _count([*MI_CONSISTENT, *MI_INCONSISTENT]), 100)} AS pct_mic, {_ratio(_count(['CR', 'SR']), _count(['OQ', 'CQ']))} AS r_to_q, {_ratio(_count(CHANGE_TALK), _count([*CHANGE_TALK, *SUSTAIN_TALK]), 100)} AS pct_ct, {_ratio(_count(CHANGE_TALK), _count(SUSTAIN_TALK))} AS c_to_s FROM coded GROUP BY conv_id",
        "coded",
    )
)
def session_metrics_pct(spark, sf):
    return _round(sessions.counted_metrics(sessions.code_counts(fx.coded(spark, sf), _ALL_CODES, "t2_auto")), "pct_mic", "r_to_q", "pct_ct", "c_to_s")


@query(fx.sql("SELECT conv_id, round(100 * CASE WHEN count_if(t1_auto IN ('IMC', 'IMI', 'CRL', 'SRL', 'Q')) > 0 THEN count_if(t1_auto IN ('IMC', 'CRL', 'SRL', 'Q')) / count_if(t1_auto IN ('IMC', 'IMI', 'CRL', 'SRL', 'Q')) ELSE 0.0::DOUBLE END, 6) AS pct_mic_older FROM coded GROUP BY conv_id", "coded"))
def older_pct_mic(spark, sf):
    return _round(sessions.older_pct_mic(fx.coded(spark, sf), "t1_auto"), "pct_mic_older")


@query(
    fx.sql(
        _SESSION
        + " UNION ALL ".join(
            f""" SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(min({c}), 6) AS "min", round(max({c}), 6) AS "max", round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.75), 6) AS p75,
            round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, round(stddev_pop({c}), 6) AS std FROM sm"""
            for c in ("pct_mic", "r_to_q", "pct_ct")
        ),
        "coded",
    )
)
def descriptive_stats(spark, sf):
    got = sessions.describe(sessions.session_metrics(fx.coded(spark, sf), "t1_auto", "t2_auto"), ["pct_mic", "r_to_q", "pct_ct"])
    return _round(got, "mean", "median", "min", "max", "p25", "p75", "iqr", "std")


@query(fx.sql("SELECT conv_id, conv_utt_idx, " + ", ".join(f"CAST(max(CASE WHEN label = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c.lower()}" for c in COUNSELLOR_T2) + " FROM ratings WHERE speaker = 'counsellor' GROUP BY ALL", "ratings"))
def code_flags(spark, sf):
    return sessions.code_flags(fx.ratings(spark, sf).filter("speaker = 'counsellor'"), "label")


@query(fx.sql("SELECT conv_id, " + ", ".join(f"count_if(t2_auto = '{c}') AS {sessions.column_of(c)}" for c in _ALL_CODES) + " FROM coded GROUP BY conv_id", "coded"))
def code_counts_pivot(spark, sf):
    return sessions.code_counts(fx.coded(spark, sf), _ALL_CODES, "t2_auto")


@query(fx.sql("SELECT conv_id, CASE WHEN status LIKE 'high%' THEN 1 ELSE 0 END::BIGINT AS quality FROM outcomes WHERE conv_id <> 3", "outcomes"))
def session_quality(spark, sf):
    return fx.outcomes(spark, sf).filter("conv_id <> 3").select("conv_id", sessions.quality_of("status").alias("quality"))


@query(fx.sql(_SESSION + " SELECT sm.conv_id, round(pct_mic, 6) AS pct_mic, post - pre AS delta FROM sm LEFT JOIN outcomes o ON o.conv_id = sm.conv_id WHERE post - pre IS NOT NULL", "coded", "outcomes"))
def session_outcomes(spark, sf):
    found = sessions.session_metrics(fx.coded(spark, sf), "t1_auto", "t2_auto").join(fx.outcomes(spark, sf), "conv_id", "left")
    return _round(found.select("conv_id", "pct_mic", (F.col("post") - F.col("pre")).alias("delta")).dropna(subset=["delta"]), "pct_mic")


@query(fx.sql(_SESSION + " SELECT sm.conv_id, round(pct_ct, 6) AS pct_ct, pre, week_later, week_later - pre AS delta FROM sm JOIN outcomes o ON o.conv_id = sm.conv_id", "coded", "outcomes"))
def session_outcomes_week_later(spark, sf):
    found = sessions.session_metrics(fx.coded(spark, sf), "t1_auto", "t2_auto").join(fx.outcomes(spark, sf), "conv_id")
    return _round(found.select("conv_id", "pct_ct", "pre", "week_later", sessions.outcome_delta().alias("delta")), "pct_ct")


# Plots.
_PLOTTED = ["pct_mic", "r_to_q", "pct_ct"]
_LONG = ", lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, status AS \"group\", {c} AS v FROM sm JOIN outcomes USING (conv_id)" for c in _PLOTTED) + ")"


def _plotted(spark, sf):
    return sessions.session_metrics(fx.coded(spark, sf), "t1_auto", "t2_auto").join(fx.outcomes(spark, sf), "conv_id")


@query(
    fx.sql(
        _SESSION + _LONG + """, bx AS (SELECT metric, "group", count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM lg GROUP BY ALL),
        mk AS (SELECT lg.*, v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) AS inside FROM lg JOIN bx USING (metric, "group"))
        SELECT metric, "group", n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(lo, 6) AS whisker_low, round(hi, 6) AS whisker_high, n_outliers, coalesce(outliers, '') AS outliers FROM bx
        JOIN (SELECT metric, "group", min(CASE WHEN inside THEN v END) AS lo, max(CASE WHEN inside THEN v END) AS hi, count_if(NOT inside) AS n_outliers FROM mk GROUP BY ALL) USING (metric, "group")
        LEFT JOIN (SELECT metric, "group", string_agg(CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY v) AS outliers FROM (SELECT DISTINCT metric, "group", v FROM mk WHERE NOT inside) GROUP BY ALL) USING (metric, "group")""",
        "coded", "outcomes",
    )
)
def box_table(spark, sf):
    """Boxes of session metrics by outcome status; outliers in thousandths."""
    found = plots.boxes(_plotted(spark, sf), "status", _PLOTTED)
    shown = F.array_join(F.transform("outliers", lambda v: F.round(v * 1000).cast("long").cast("string")), ",")
    return _round(found, "mean", "q1", "median", "q3", "whisker_low", "whisker_high").withColumn("outliers", shown)


@query(
    fx.sql(
        _SESSION + _LONG + """, sp AS (SELECT *, n::DOUBLE ** -0.2 * s AS h FROM (SELECT metric, "group", count(*) AS n, stddev_samp(v) AS s, min(v) AS a, max(v) AS b FROM lg GROUP BY ALL) WHERE s > 0),
        st AS (SELECT *, a - 2 * h AS low, (b - a + 4 * h) / 99 AS step FROM sp),
        pl AS (SELECT metric, "group", (v - low) / step AS pos, least(CAST(floor((v - low) / step) AS INTEGER), 98) AS l FROM lg JOIN st USING (metric, "group")),
        bn AS (SELECT metric, "group", bin, sum(w) AS w FROM (SELECT metric, "group", l AS bin, 1 - (pos - l) AS w FROM pl UNION ALL SELECT metric, "group", l + 1, pos - l FROM pl) GROUP BY ALL)
        SELECT metric, "group", k::INTEGER AS k, round(any_value(low) + k * any_value(step), 6) AS x, round(sum(w * exp(-0.5 * power((k - bin) * step / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
        FROM st JOIN bn USING (metric, "group") CROSS JOIN (SELECT unnest(range(100)) AS k) GROUP BY metric, "group", k""",
        "coded", "outcomes",
    )
)
def violin_table(spark, sf):
    return _round(plots.violins(_plotted(spark, sf), "status", _PLOTTED), "x", "density")


# Roll-ups.
@query(
    fx.sql(
        """SELECT conv_id, conv_utt_idx, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY conv_utt_idx) AS BIGINT) AS volley FROM (SELECT *, CASE WHEN lag(cum) OVER w IS NULL OR NOT starts_with(cum, lag(cum) OVER w) OR speaker <> lag(speaker) OVER w THEN 1 ELSE 0 END AS new
        FROM (SELECT *, string_agg(utt_text, ' ') OVER (PARTITION BY conv_id, conv_vol_idx ORDER BY conv_utt_idx) AS cum FROM coded) WINDOW w AS (PARTITION BY conv_id ORDER BY conv_utt_idx))""",
        "coded",
    )
)
def volley_boundaries(spark, sf):
    from pyspark.sql import Window

    turn = Window.partitionBy("conv_id", "conv_vol_idx").orderBy("conv_utt_idx")
    rows = fx.coded(spark, sf).withColumn("cumulative_text", F.array_join(F.collect_list("utt_text").over(turn), " "))
    return rollup.volley_boundaries(rows, "conv_utt_idx").select("conv_id", "conv_utt_idx", F.col("volley").cast("long").alias("volley"))


@query(fx.sql("SELECT conv_id, conv_utt_idx, dense_rank() OVER (PARTITION BY conv_id ORDER BY conv_vol_idx) - 1 AS volley_rank FROM coded", "coded"))
def dense_volley_rank(spark, sf):
    return rollup.dense_volley_rank(fx.coded(spark, sf)).select("conv_id", "conv_utt_idx", "volley_rank")


@query(fx.sql("SELECT conv_id, conv_vol_idx, string_agg(t2_auto, ',' ORDER BY conv_utt_idx) AS codes, arg_min(speaker, conv_utt_idx) AS speaker, md5(arg_max(utt_text, conv_utt_idx)) AS last_md5 FROM coded GROUP BY ALL", "coded"))
def volley_rollup(spark, sf):
    return rollup.volley_rollup(fx.coded(spark, sf), "t2_auto").select("conv_id", "conv_vol_idx", F.array_join("codes", ",").alias("codes"), "speaker", F.md5("last_text").alias("last_md5"))


@query(
    fx.sql(
        """SELECT conv_id, conv_utt_idx, string_agg(label, ',' ORDER BY label) AS codes FROM (SELECT conv_id, conv_utt_idx, label, rank() OVER (PARTITION BY conv_id, conv_utt_idx ORDER BY count(*) DESC) AS r
        FROM ratings WHERE label IS NOT NULL GROUP BY conv_id, conv_utt_idx, label) WHERE r = 1 GROUP BY ALL""",
        "ratings",
    )
)
def majority_vote(spark, sf):
    got = rollup.majority_vote(fx.ratings(spark, sf), ["conv_id", "conv_utt_idx"], "label")
    return got.select("conv_id", "conv_utt_idx", F.array_join("codes", ",").alias("codes"))


@query(
    fx.sql(
        f""", mp AS (SELECT conv_id, conv_utt_idx, speaker, CASE WHEN speaker = 'client' THEN {fx.sql_map(CLIENT_REDUCED, "label")} ELSE {fx.sql_map(COUNSELLOR_REDUCED, "label")} END AS code FROM ratings),
        best AS (SELECT conv_id, conv_utt_idx, speaker, list(code) AS b FROM (SELECT *, rank() OVER (PARTITION BY conv_id, conv_utt_idx, speaker ORDER BY count(*) DESC) AS r FROM mp WHERE code IS NOT NULL GROUP BY conv_id, conv_utt_idx, speaker, code) WHERE r = 1 GROUP BY ALL)
        SELECT k.conv_id, k.conv_utt_idx, k.speaker, CASE WHEN b IS NULL THEN CASE k.speaker WHEN 'client' THEN 'N' ELSE 'O' END WHEN len(b) = 1 THEN b[1] WHEN list_contains(b, 'C') THEN 'C' WHEN list_contains(b, 'S') THEN 'S' ELSE 'N' END AS code
        FROM (SELECT DISTINCT conv_id, conv_utt_idx, speaker FROM mp) k LEFT JOIN best ON best.conv_id = k.conv_id AND best.conv_utt_idx = k.conv_utt_idx AND best.speaker = k.speaker""".replace(
            "SELECT *, rank()", "SELECT conv_id, conv_utt_idx, speaker, code, rank()"
        ),
        "ratings",
    )
)
def reduce_to_scheme(spark, sf):
    return rollup.reduce_to_scheme(fx.ratings(spark, sf), ["conv_id", "conv_utt_idx"], "label")


_FLAG = lambda n: f"{fx.sql_number(n, 'conv_id', 'turn')} % 2 = 0"
_SUB = lambda n, v: f"list_extract({v}, 1 + CAST({fx.sql_number(n, 'conv_id', 'turn')} % {len(v)} AS INTEGER))"
_SUBS = {"ti": ["Information", "advice", "options", "negotiation"], "rf": ["simple", "Complex"], "qu": ["open", "closed"], "mb": ["other", "question"], "ct": ["change", "sustain", "neutral", "n/a"]}


@query(
    f"""SELECT conv_id, turn, array_to_string(list_sort(list_filter([CASE WHEN ti THEN CASE lower(tis) WHEN 'information' THEN 'GI' WHEN 'advice' THEN 'ADVI' WHEN 'options' THEN 'OPTI' WHEN 'negotiation' THEN 'NEGO' END END,
      CASE WHEN rf THEN CASE lower(rfs) WHEN 'simple' THEN 'SR' WHEN 'complex' THEN 'CR' END END, CASE WHEN qu THEN CASE lower(qus) WHEN 'open' THEN 'OQ' WHEN 'closed' THEN 'CQ' END END,
      CASE WHEN NOT ti AND NOT rf AND NOT qu AND lower(mbs) = 'other' THEN 'O' END, CASE lower(cts) WHEN 'change' THEN 'C' WHEN 'sustain' THEN 'S' WHEN 'neutral' THEN 'N' END], lambda x: x IS NOT NULL)), ',') AS codes FROM
      (SELECT conv_id, turn, {", ".join(f"{_FLAG(k)} AS {k}" for k in ("ti", "rf", "qu"))}, {", ".join(f"{_SUB('sub ' + k, v)} AS {k}s" for k, v in _SUBS.items())} FROM conversations)"""
)
def flag_row_codes(spark, sf):
    key = ("conv_id", "turn")
    flag = lambda n: fx.number(n, *key) % 2 == 0
    sub = lambda k: F.get(L.array_of(_SUBS[k]), (fx.number(f"sub {k}", *key) % len(_SUBS[k])).cast("int"))
    rows = fx.table(spark, sf, "conversations").withColumns(
        {
            "therapist_input_exists": flag("ti"), "therapist_input_subtype": sub("ti"), "reflection_exists": flag("rf"), "reflection_subtype": sub("rf"),
            "question_exists": flag("qu"), "question_subtype": sub("qu"), "main_therapist_behaviour": sub("mb"), "client_talk_type": sub("ct"),
        }
    )
    return rows.select("conv_id", "turn", F.array_join(L.flag_codes(), ",").alias("codes"))


# Trajectories.
@query(fx.sql("SELECT conv_id, conv_utt_idx, " + ", ".join(f"CAST({fx.sql_map(SCALES[s], 't2_auto')} AS DOUBLE) AS {s}" for s in ("motiv5", "motiv7", "motiv17", "plot_t2")) + f", CAST({fx.sql_map(SCALES['plot_t1'], 't1_auto')} AS DOUBLE) AS plot_t1 FROM coded", "coded"))
def score_map(spark, sf):
    out = fx.coded(spark, sf)
    for s in ("motiv5", "motiv7", "motiv17", "plot_t2"):
        out = trajectory.with_score(out, "t2_auto", s).withColumnRenamed("score", s)
    out = trajectory.with_score(out, "t1_auto", "plot_t1").withColumnRenamed("score", "plot_t1")
    return out.select("conv_id", "conv_utt_idx", "motiv5", "motiv7", "motiv17", "plot_t2", "plot_t1")


@query(fx.sql("SELECT conv_id, conv_utt_idx, round(progress, 6) AS progress, score FROM client_points", "client_points"))
def session_progress(spark, sf):
    return _round(fx.client_points(spark, sf).select("conv_id", "conv_utt_idx", "progress", "score"), "progress")


def _momentum_sql(tier: str) -> str:
    if tier == "t1":
        step = "CASE WHEN c.code = 'C' THEN m + 0.1 WHEN c.code = 'S' THEN m - 0.1 ELSE m * 0.9 END"
    else:
        plus = lambda stems, s: _in([x + s for x in stems])
        step = f"CASE WHEN c.code IN {plus(MOBILISING, '+')} THEN m + 0.2 WHEN c.code IN {plus(PREPARATORY, '+')} THEN m + 0.1 WHEN c.code IN {plus(PREPARATORY, '-')} THEN m - 0.1 WHEN c.code IN {plus(MOBILISING, '-')} THEN m - 0.2 ELSE m * 0.9 END"
    return fx.sql(
        f""", cl AS (SELECT conv_id, conv_utt_idx, CASE WHEN conv_utt_idx % 7 <> 0 THEN {tier}_auto END AS code, row_number() OVER (PARTITION BY conv_id ORDER BY conv_utt_idx) AS k FROM coded WHERE speaker = 'client'),
        walk AS (SELECT conv_id, conv_utt_idx, k, 0.0::DOUBLE AS m FROM cl WHERE k = 1 UNION ALL
          SELECT c.conv_id, c.conv_utt_idx, c.k, CAST(CASE WHEN c.code IS NULL THEN m ELSE {step} END AS DOUBLE) FROM walk w JOIN cl c ON c.conv_id = w.conv_id AND c.k = w.k + 1)
        SELECT conv_id, conv_utt_idx, round(m, 6) AS momentum FROM walk""",
        "coded", recursive=True,
    )


for _tier in ("t1", "t2"):
    def _momentum(spark, sf, tier=_tier):
        rows = fx.coded(spark, sf).filter("speaker = 'client'").withColumn("code", F.when(F.col("conv_utt_idx") % 7 != 0, F.col(f"{tier}_auto")))
        return _round(trajectory.momentum(rows, "code", 0.1, tier), "momentum")

    QUERIES[f"client_momentum_{_tier}"], SQL[f"client_momentum_{_tier}"] = _momentum, _momentum_sql(_tier)

_SLOPES = """, sl AS (SELECT conv_id, count(*) AS n, CASE WHEN var_pop(progress) > 0 THEN regr_slope(score, progress) END AS slope, CASE WHEN var_pop(progress) > 0 THEN regr_intercept(score, progress) END AS intercept,
    CASE WHEN var_pop(progress) > 0 AND var_pop(score) > 0 THEN corr(progress, score) END AS r FROM client_points GROUP BY conv_id)"""


@query(fx.sql(_SLOPES + " SELECT conv_id, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r FROM sl", "client_points"))
def session_slope(spark, sf):
    return _round(trajectory.slopes(fx.client_points(spark, sf)), "slope", "intercept", "r")


@query(
    fx.sql(
        _SLOPES
        + " SELECT trend, count(*) AS n, round(avg(post - pre), 6) AS mean_delta FROM (SELECT conv_id, CASE WHEN slope > 0.05 THEN 'Increasing' WHEN slope < -0.05 THEN 'Decreasing' ELSE 'Flat' END AS trend FROM sl WHERE slope IS NOT NULL) s JOIN outcomes o ON o.conv_id = s.conv_id GROUP BY trend",
        "client_points", "outcomes",
    )
)
def trend_classes(spark, sf):
    rows = trajectory.slopes(fx.client_points(spark, sf)).filter("slope IS NOT NULL").join(fx.outcomes(spark, sf), "conv_id")
    return _round(rows.groupBy(trajectory.trend(F.col("slope")).alias("trend")).agg(F.count("*").alias("n"), F.avg(F.col("post") - F.col("pre")).alias("mean_delta")), "mean_delta")


def _session_deltas(spark, sf):
    rows = sessions.session_metrics(fx.coded(spark, sf), "t1_auto", "t2_auto").join(fx.outcomes(spark, sf), "conv_id")
    return rows.withColumn("delta", sessions.outcome_delta("post"))


_DELTAS = _SESSION + ", sd AS (SELECT sm.*, post - pre AS delta FROM sm JOIN outcomes o ON o.conv_id = sm.conv_id)"


@query(
    fx.sql(
        _DELTAS
        + " UNION ALL ".join(
            f" SELECT '{c}' AS metric, count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS a, rank() OVER (ORDER BY delta) + (count(*) OVER (PARTITION BY delta) - 1) / 2 AS b FROM sd)"
            for c in ("pct_mic", "r_to_q", "pct_ct")
        ),
        "coded", "outcomes",
    )
)
def spearman_vs_outcome(spark, sf):
    return _round(trajectory.spearman(_session_deltas(spark, sf), ["pct_mic", "r_to_q", "pct_ct"], "delta"), "r")


@query()
def spearman_p_values(spark, sf):
    return trajectory.with_correlation_p(trajectory.spearman(_session_deltas(spark, sf), ["pct_mic", "r_to_q", "pct_ct"], "delta"))


@query(
    fx.sql(
        _DELTAS
        + " UNION ALL ".join(
            f" SELECT '{c}' AS metric, count(*) AS n, round(corr({c}, delta), 6) AS r, round(regr_slope(delta, {c}), 6) AS slope, round(regr_intercept(delta, {c}), 6) AS intercept, round(regr_r2(delta, {c}), 6) AS r2 FROM sd"
            for c in ("pct_mic", "r_to_q", "pct_ct")
        ),
        "coded", "outcomes",
    )
)
def pearson_ols(spark, sf):
    return _round(trajectory.simple_regressions(_session_deltas(spark, sf), ["pct_mic", "r_to_q", "pct_ct"], "delta"), "r", "slope", "intercept", "r2")


_LOO = (
    _DELTAS
    + """, fit AS (SELECT count(*) AS n, regr_slope(delta, pct_mic) AS b, regr_intercept(delta, pct_mic) AS a, regr_sxx(delta, pct_mic) AS sxx, avg(pct_mic) AS mx FROM sd),
    lo AS (SELECT conv_id, delta AS y, (delta - a - b * pct_mic) / (1 - (1 / n + power(pct_mic - mx, 2) / sxx)) AS e FROM sd, fit)"""
)


@query(fx.sql(_LOO + " SELECT conv_id, y, round(y - e, 6) AS predicted, round(-e, 6) AS error, round(CASE WHEN abs(y) > 0.00001 THEN 100 * -e / y END, 4) AS pct_error FROM lo", "coded", "outcomes"))
def loocv(spark, sf):
    got = trajectory.leave_one_out(_session_deltas(spark, sf), "pct_mic", "delta")
    return _round(got, "predicted", "error").withColumn("pct_error", F.round("pct_error", 4))


@query(fx.sql(_LOO + " SELECT count(*) AS n, round(avg(e * e), 6) AS mse, round(1 - sum(e * e) / (count(*) * var_pop(y)), 6) AS r2 FROM lo", "coded", "outcomes"))
def loocv_summary(spark, sf):
    return _round(trajectory.leave_one_out_summary(trajectory.leave_one_out(_session_deltas(spark, sf), "pct_mic", "delta")), "mse", "r2")


_LOO_ALL = _DELTAS + ", lo AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, conv_id, delta AS y, (delta - a - b * {c}) / (1 - (1 / n + power({c} - mx, 2) / sxx)) AS e FROM sd, "
    f"(SELECT count(*) AS n, regr_slope(delta, {c}) AS b, regr_intercept(delta, {c}) AS a, regr_sxx(delta, {c}) AS sxx, avg({c}) AS mx FROM sd)" for c in _PLOTTED
) + ")"


@query(fx.sql(_LOO_ALL + " SELECT metric, count(*) AS n, round(avg(e * e), 6) AS mse, round(1 - sum(e * e) / (count(*) * var_pop(y)), 6) AS r2 FROM lo GROUP BY metric", "coded", "outcomes"))
def loocv_by_metric(spark, sf):
    """Leave-one-out predictions of the outcome by every session metric, from one pass."""
    tables = reports.outcome_tables(_session_deltas(spark, sf), _PLOTTED, "delta")
    return _round(trajectory.leave_one_out_summary(tables["loocv"], ["metric"]), "mse", "r2")


@query(
    fx.sql(
        """, g AS (SELECT *, CASE WHEN conv_utt_idx % 3 <> 0 THEN score END AS v, row_number() OVER (PARTITION BY conv_id ORDER BY conv_utt_idx) AS k FROM client_points),
        b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY conv_id ORDER BY k) AS x0, min(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1 FROM g)
        SELECT b.conv_id, b.conv_utt_idx, round(coalesce(b.v, CASE WHEN x1 > x0 THEN p.v + (q.v - p.v) * (b.k - x0) / (x1 - x0) END, p.v, q.v), 6) AS score FROM b
        LEFT JOIN g p ON p.conv_id = b.conv_id AND p.k = x0 LEFT JOIN g q ON q.conv_id = b.conv_id AND q.k = x1""",
        "client_points",
    )
)
def interpolate_scores(spark, sf):
    rows = fx.client_points(spark, sf).withColumn("score", F.when(F.col("conv_utt_idx") % 3 != 0, F.col("score")))
    return _round(trajectory.fill_linear(rows, "conv_utt_idx", "score").select("conv_id", "conv_utt_idx", "score"), "score")


@query(
    fx.sql(
        """, grid AS (SELECT unnest(range(10)) AS k), pts AS (SELECT c.conv_id, k, k * (100.0::DOUBLE / 9) AS g FROM (SELECT DISTINCT conv_id FROM client_points) c, grid),
        lohi AS (SELECT pts.conv_id, pts.k, pts.g, max(CASE WHEN progress <= g THEN progress END) AS x0, min(CASE WHEN progress >= g THEN progress END) AS x1 FROM pts JOIN client_points p ON p.conv_id = pts.conv_id GROUP BY ALL)
        SELECT l.conv_id, l.k, round(l.g, 6) AS x, round(CASE WHEN x0 IS NULL THEN b.score WHEN x1 IS NULL THEN a.score WHEN x1 > x0 THEN a.score + (b.score - a.score) * (g - x0) / (x1 - x0) ELSE a.score END, 6) AS y FROM lohi l
        LEFT JOIN client_points a ON a.conv_id = l.conv_id AND a.progress = x0 LEFT JOIN client_points b ON b.conv_id = l.conv_id AND b.progress = x1""",
        "client_points",
    )
)
def resample_grid(spark, sf):
    return _round(trajectory.resample(fx.client_points(spark, sf), 10), "x", "y")


@query(
    fx.sql(
        """, sz AS (SELECT conv_id, count(*) AS n FROM client_points GROUP BY 1 HAVING count(*) >= 5 AND count(*) >= 4), ch AS (SELECT conv_id, unnest(range(4)) AS chunk FROM sz),
        f AS (SELECT ch.conv_id, chunk, count(*) AS m, regr_slope(score, progress) AS s, regr_intercept(score, progress) AS i FROM ch JOIN client_points p ON p.conv_id = ch.conv_id AND progress >= CASE WHEN chunk > 0 THEN (chunk - 1) * 25.0 ELSE 0 END AND progress < CASE WHEN chunk < 2 THEN (chunk + 2) * 25.0 ELSE (chunk + 1) * 25.0 END GROUP BY ALL)
        SELECT ch.conv_id, ch.chunk, round(CASE WHEN m >= 2 THEN s ELSE 0 END, 6) AS slope, round(CASE WHEN m >= 2 THEN i ELSE 0 END, 6) AS intercept FROM ch LEFT JOIN f ON f.conv_id = ch.conv_id AND f.chunk = ch.chunk""",
        "client_points",
    )
)
def segment_slopes(spark, sf):
    return _round(trajectory.segment_slopes(fx.client_points(spark, sf), 4), "slope", "intercept")


# Models.
@query()
def ridge(spark, sf):
    return learn.ridge_test(fx.table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@query()
def topk_dims(spark, sf):
    return learn.top_dimensions(spark, learn.ridge(fx.table(spark, sf, "embeddings"), "embedding", "label").coefficients)


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{end}' AS place, vec_id, CAST(embedding[3] AS DOUBLE) AS value FROM embeddings ORDER BY embedding[3] {way}, vec_id LIMIT 10)" for end, way in (("top", "DESC"), ("bottom", "ASC"))
    )
)
def topk_rows(spark, sf):
    value = F.get("embedding", F.lit(2)).cast("double").alias("value")
    rows = fx.table(spark, sf, "embeddings").select("vec_id", value)
    ends = [rows.orderBy(way("value"), "vec_id").limit(10).select(F.lit(end).alias("place"), "vec_id", "value") for end, way in (("top", F.desc), ("bottom", F.asc))]
    return ends[0].unionByName(ends[1])


def _determinant(names: list[str], of) -> str:
    """A determinant as an SQL expression; ``of(a, b)`` is the cell of two names."""
    def minor(rows: list[str], columns: list[str]) -> str:
        if not rows:
            return "1"
        return "(" + " ".join(f"{'+-'[i % 2]} {of(rows[0], c)} * {minor(rows[1:], [x for x in columns if x != c])}" for i, c in enumerate(columns)) + ")"

    return minor(names, names)


_PREDICTORS = ["pct_mic", "r_to_q", "pct_ct"]
_CELL = lambda a, b: "1.0::DOUBLE" if a == b else "c_" + "_x_".join(sorted((a, b)))
_CORRELATIONS = ", ".join(f"corr({a}, {b}) AS {_CELL(a, b)}" for i, a in enumerate([*_PREDICTORS, "delta"]) for b in [*_PREDICTORS, "delta"][:i])


@query(
    fx.sql(
        _DELTAS + f""", c AS (SELECT count(*) AS n, {_CORRELATIONS} FROM sd WHERE delta IS NOT NULL), r AS (SELECT n, 1 - {_determinant([*_PREDICTORS, "delta"], _CELL)} / {_determinant(_PREDICTORS, _CELL)} AS r2 FROM c)
        SELECT n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 4), 6) AS r2_adjusted, round(r2 / 3 / ((1 - r2) / (n - 4)), 4) AS f FROM r""",
        "coded", "outcomes",
    )
)
def ols_multi(spark, sf):
    got = learn.multiple_regression(_session_deltas(spark, sf), _PREDICTORS, "delta").select("n", "r2", "r2_adjusted", "f")
    return _round(got, "r2", "r2_adjusted").withColumn("f", F.round("f", 4))


@query()
def ols_multi_p_value(spark, sf):
    return learn.multiple_regression(_session_deltas(spark, sf), _PREDICTORS, "delta")


@query()
def grid_regression_sweep(spark, sf):
    """The outcome on a session's values at 2, 4, ..., 80 places."""
    sizes = list(range(2, 81, 2))
    rows = trajectory.grids(fx.client_points(spark, sf), sizes).join(_session_deltas(spark, sf).select("conv_id", "delta"), "conv_id")
    return learn.sweep(rows.select(F.col("size").alias("k"), F.col("cells.y").alias("x"), F.col("delta").alias("y")), sizes)


@query()
def segment_regression_sweep(spark, sf):
    """The outcome on a session's slopes in 1, 2, ..., 20 parts."""
    sizes = list(range(1, 21))
    slopes = F.array_sort(F.collect_list(F.struct("chunk", "slope")))
    wide = trajectory.local_slopes(fx.client_points(spark, sf), sizes).groupBy("conv_id", "size").agg(slopes.alias("s"))
    rows = wide.join(_session_deltas(spark, sf).select("conv_id", "delta"), "conv_id")
    return learn.sweep(rows.select(F.col("size").alias("k"), F.col("s.slope").alias("x"), F.col("delta").alias("y")), sizes)


@query()
def spline_fit(spark, sf):
    return learn.functional_regression(fx.client_points(spark, sf), _session_deltas(spark, sf).select("conv_id", "delta"), "delta")


def _dimensions(spark, sf):
    """Every embedding dimension along the ordered vectors of a class as the score of a session of its own, named by class
    and dimension. A vector's place in its class is found once, by ranges, whatever the class's share of all rows."""
    rows = fx.table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    placed = running_by(rows, ["label"], ["vec_id"], {"_at": F.lit(1).cast("long")}).join(rows.groupBy("label").agg(F.count("*").alias("_n")), "label")
    placed = placed.withColumn("progress", F.when(F.col("_n") > 1, 100.0 * F.col("_at") / (F.col("_n") - 1)).otherwise(0.0))
    each = placed.select("label", "progress", F.posexplode("embedding").alias("dim", "v"))
    return each.select(F.struct("label", "dim").alias("conv_id"), "progress", F.col("v").cast("double").alias("score"))


_SEGMENTS = 5
_LOW = f"CASE WHEN chunk > 0 THEN (chunk - 1) * {100 / _SEGMENTS}::DOUBLE ELSE 0 END"
_HIGH = f"CASE WHEN chunk < {_SEGMENTS - 2} THEN (chunk + 2) * {100 / _SEGMENTS}::DOUBLE ELSE (chunk + 1) * {100 / _SEGMENTS}::DOUBLE END"


@query(
    f"""WITH v AS (SELECT CAST(label AS BIGINT) * 1000 + dim AS conv_id, vec_id, CAST(embedding[dim + 1] AS DOUBLE) AS score FROM embeddings, (SELECT unnest(range(64)) AS dim)),
    p AS (SELECT conv_id, score, CASE WHEN count(*) OVER w > 1 THEN 100.0::DOUBLE * (row_number() OVER (PARTITION BY conv_id ORDER BY vec_id) - 1) / (count(*) OVER w - 1) ELSE 0.0::DOUBLE END AS progress FROM v WINDOW w AS (PARTITION BY conv_id)),
    sz AS (SELECT conv_id FROM p GROUP BY 1 HAVING count(*) >= {_SEGMENTS}), ch AS (SELECT conv_id, unnest(range({_SEGMENTS})) AS chunk FROM sz),
    f AS (SELECT ch.conv_id, chunk, count(*) AS m, regr_slope(score, progress) AS s, regr_intercept(score, progress) AS i FROM ch JOIN p ON p.conv_id = ch.conv_id AND progress >= {_LOW} AND progress < {_HIGH} GROUP BY ALL)
    SELECT ch.conv_id, ch.chunk, round(CASE WHEN m >= 2 THEN s ELSE 0 END, 6) AS slope, round(CASE WHEN m >= 2 THEN i ELSE 0 END, 6) AS intercept FROM ch LEFT JOIN f ON f.conv_id = ch.conv_id AND f.chunk = ch.chunk"""
)
def embedding_segments(spark, sf):
    slopes = trajectory.segment_slopes(_dimensions(spark, sf), _SEGMENTS)
    return _round(slopes.withColumn("conv_id", F.col("conv_id.label").cast("long") * 1000 + F.col("conv_id.dim")), "slope", "intercept")


@query()
def embedding_regression(spark, sf):
    """A class's outcome (a number of its id) on its segment slopes in the dimensions that ridge regression weighs most."""
    rows = fx.table(spark, sf, "embeddings")
    best = learn.top_dimensions(spark, learn.ridge(rows, "embedding", "label").coefficients, 3)
    outcome = rows.select("label").distinct().select("label", (fx.number("post", "label") % 11).cast("double").alias("delta"))
    slopes = trajectory.segment_slopes(_dimensions(spark, sf), _SEGMENTS).select("conv_id.label", "conv_id.dim", "chunk", "slope")
    wide = slopes.join(F.broadcast(best), "dim").join(outcome, "label")  # three dimensions
    names = [f"s{i}" for i in range(_SEGMENTS)]
    wide = wide.groupBy("dim", "label", "delta").agg(*[F.max(F.when(F.col("chunk") == i, F.col("slope"))).alias(n) for i, n in enumerate(names)])
    return learn.multiple_regression(wide, names, "delta")


@query()
def text_embedding_regression(spark, sf):
    """Ridge regression of an utterance's length on its text's vector: n_train, n_test, r2."""
    rows = fx.utterances(spark, sf).select(F.concat_ws("|", "conv_id", "conv_utt_idx").alias("utt"), "utt_text", F.log1p(F.length("utt_text")).alias("size"))
    return learn.ridge_test(embed.with_embeddings(rows, "utt_text", lambda: embed.HashedNgrams(dim=64)), "utt", "embedding", "size")


@query()
def text_embedding_segments(spark, sf):
    """The course of a session in each dimension of its utterances' vectors: slopes by segment."""
    rows = trajectory.with_progress(fx.utterances(spark, sf)).select("conv_id", "progress", "utt_text")
    each = embed.with_embeddings(rows, "utt_text", lambda: embed.HashedNgrams(dim=16)).select("conv_id", "progress", F.posexplode("embedding").alias("dim", "v"))
    points = each.select(F.struct("conv_id", "dim").alias("conv_id"), "progress", F.col("v").cast("double").alias("score"))
    return trajectory.segment_slopes(points, _SEGMENTS).select("conv_id.conv_id", "conv_id.dim", "chunk", "slope", "intercept")


@query()
def adapter_by_fold(spark, sf):
    """Held-out accuracy, by fold, of class prototypes of another corpus, of the same with a low-rank adapter, and of the
    trained classifier: the language of whole texts."""
    rows = fx.table(spark, sf, "documents").filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    rows = rows.withColumn("fold", (fx.number("fold", "doc_id") % 3).cast("int"))
    counted = learn.word_counts(rows.filter("doc_id % 40 <> 0"), "text")
    rows = held(embed.with_embeddings(rows, "text", lambda: embed.HashedNgrams(dim=32)).drop("text"))  # read at every step, so embedded once
    other, own = rows.filter("doc_id % 40 = 0"), rows.filter("doc_id % 40 <> 0")
    labels, base = adapter.prototypes(other, "embedding", "lang")
    models = adapter.train(own.select(F.col("embedding").alias("x"), F.col("lang").alias("label"), "fold"), labels, base, folds=3, rank=1, steps=20, rate=2.0)
    said = own.withColumn("_base", adapter.predicted([base] * 3, labels, F.col("embedding"), F.col("fold")))
    said = said.withColumn("_adapter", adapter.predicted([m.weights for m in models], labels, F.col("embedding"), F.col("fold")))
    right = lambda c: F.avg((F.col(c) == F.col("lang")).cast("double"))
    out = said.groupBy("fold").agg(F.count("*").alias("n"), right("_base").alias("base"), right("_adapter").alias("adapter"))
    trained = None
    for k in range(3):
        model, names = learn.fitted_classifier(counted.filter(F.col("fold") != k), "lang")
        one = learn.predict_counted(model, names, counted.filter(F.col("fold") == k), "_said").agg(right("_said").alias("classifier")).withColumn("fold", F.lit(k))
        trained = one if trained is None else trained.unionByName(one)
    return out.join(trained, "fold").withColumn("share", F.lit(models[0].share))


@query()
def dtw_pairs(spark, sf):
    """Whole sessions, the counsellor's turns filled in between the client's scores, each with the next one by id."""
    rows = trajectory.with_score(fx.coded(spark, sf), "t2_auto", "motiv7")
    sessions_ = dtw.series(trajectory.fill_linear(rows, "conv_utt_idx", "score"), "conv_utt_idx", "score")
    ids = sessions_.select("conv_id")
    return dtw.pair_distances(sessions_, ids.select(F.col("conv_id").alias("id_1"), (F.col("conv_id") + 1).alias("id_2")))


@query()
def dtw_kmeans(spark, sf):
    even = trajectory.resample(fx.client_points(spark, sf), 100)
    return dtw.cluster(dtw.series(even, "k", "y"), 3)


@query()
def dtw_cluster_report(spark, sf):
    return dtw.cluster_report(dtw_kmeans(spark, sf), 3)


_KEY = b"query key"
_PAD = lambda with_: bytes(b ^ with_ for b in _KEY.ljust(64, b"\0")).hex()


@query(f"SELECT conv_id, sha256(from_hex('{_PAD(0x5C)}') || from_hex(sha256(from_hex('{_PAD(0x36)}') || CAST(conv_id AS VARCHAR)::BLOB))) AS anonymous_id FROM (SELECT DISTINCT conv_id FROM conversations)")
def anonymize_ids(spark, sf):
    return fx.table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", keyed_id(F.col("conv_id"), _KEY).alias("anonymous_id"))


class _Echo:
    """A provider that answers with the first code its prompt offers."""

    def answer(self, asked: list[str]) -> list[str]:
        return [f'{{"label": "{p.split("Codes: ", 1)[1].split(",")[0].split()[0]}"}}' for p in asked]


_FIRST = {"counsellor": ("CRL", "CR"), "client": ("C", "O+")}  # what the echo answers with


@query(
    fx.sql("SELECT conv_id, conv_utt_idx, speaker, " + ", ".join(f"CASE speaker WHEN 'counsellor' THEN '{_FIRST['counsellor'][i]}' ELSE '{_FIRST['client'][i]}' END AS {c}" for i, c in enumerate(("t1_label_auto", "t2_label_auto"))) + " FROM utterances WHERE speaker <> 'unknown'", "utterances")
)
def tiered_annotation(spark, sf):
    got = annotate.annotate_tiered(fx.utterances(spark, sf), _Echo, _Echo)
    return got.select("conv_id", "conv_utt_idx", "speaker", "t1_label_auto", "t2_label_auto")


@query(fx.sql(f"SELECT conv_id, conv_utt_idx, CASE speaker WHEN 'counsellor' THEN '{_FIRST['counsellor'][1]}' ELSE '{_FIRST['client'][1]}' END AS label_auto FROM utterances WHERE speaker <> 'unknown' AND conv_id % 3 <> 0", "utterances"))
def flat_annotation(spark, sf):
    rows = fx.utterances(spark, sf)
    return annotate.annotate_flat(rows, _Echo, done=rows.filter("conv_id % 3 = 0")).select("conv_id", "conv_utt_idx", "label_auto")


@query()
def trained_vs_hashed(spark, sf):
    """Held-out accuracy of the trainable stand-in beside the hashed coder, by speaker."""
    rows = fx.coded(spark, sf)
    model, names = learn.text_classifier(rows.filter("conv_id % 5 <> 0"), "t1_gold")
    held = learn.predict_codes(model, names, rows.filter("conv_id % 5 = 0"), "t1_trained")
    first, second = metrics.by_group(held, "t1_gold", "t1_auto", "speaker"), metrics.by_group(held, "t1_gold", "t1_trained", "speaker")
    return metrics.comparison(first, second, "speaker", ("hashed", "trained"))


# Experiments: runs of two parsers, three annotators and three tunings, each scored on its part of the rated utterances.
_SETTINGS = ["parser", "annotator", "fine_tuning"]
_ID = "substr(md5(concat_ws('_', parser, annotator, coalesce(fine_tuning, 'none'))), 1, 8)"
_RUNS = f""", runs AS (SELECT *, {_ID} AS experiment_id FROM (SELECT CASE WHEN r.conv_id % 2 = 0 THEN 'org/p1' ELSE 'p2' END AS parser, r.rater AS annotator, CASE r.conv_utt_idx % 3 WHEN 1 THEN 'f1' WHEN 2 THEN 'f2' END AS fine_tuning,
    avg(CASE WHEN r.label = c.t2_gold THEN 1.0::DOUBLE ELSE 0 END) AS f1 FROM ratings r JOIN coded c USING (conv_id, conv_utt_idx) WHERE NOT (r.rater = 'c' AND r.conv_utt_idx % 3 = 2) GROUP BY ALL)),
    every AS (SELECT *, {_ID} AS experiment_id FROM (SELECT DISTINCT parser FROM runs) CROSS JOIN (SELECT DISTINCT annotator FROM runs) CROSS JOIN (SELECT DISTINCT fine_tuning FROM runs))"""


def _runs(spark, sf):
    rows = fx.ratings(spark, sf).drop("speaker").join(fx.coded(spark, sf).select("conv_id", "conv_utt_idx", "t2_gold"), ["conv_id", "conv_utt_idx"])
    rows = rows.withColumn("parser", F.when(F.col("conv_id") % 2 == 0, "org/p1").otherwise("p2")).withColumn("tuning", F.col("conv_utt_idx") % 3)
    rows = rows.filter(~((F.col("rater") == "c") & (F.col("tuning") == 2))).withColumn("fine_tuning", F.when(F.col("tuning") == 1, "f1").when(F.col("tuning") == 2, "f2"))
    runs = rows.groupBy("parser", F.col("rater").alias("annotator"), "fine_tuning").agg(F.avg(F.when(F.col("label") == F.col("t2_gold"), 1.0).otherwise(0.0)).alias("f1"))
    return runs.withColumn("experiment_id", experiments.experiment_id(*map(F.col, _SETTINGS)))


@query(fx.sql(_RUNS + " SELECT * FROM every", "ratings"))
def experiment_grid(spark, sf):
    return experiments.grid_of(_runs(spark, sf), _SETTINGS)


_PAIRS_SQL = """(SELECT b.parser, b.annotator, b.experiment_id AS base_id, b.f1 AS base, t.fine_tuning, t.experiment_id AS tuned_id, t.f1 AS tuned, t.f1 - b.f1 AS delta FROM runs b JOIN runs t
  ON b.parser = t.parser AND b.annotator = t.annotator WHERE b.fine_tuning IS NULL AND t.fine_tuning IS NOT NULL)"""


@query(fx.sql(_RUNS + f" SELECT parser, annotator, fine_tuning, base_id, tuned_id, {_r('base', 'tuned', 'delta')} FROM {_PAIRS_SQL}", "ratings"))
def experiment_pairs(spark, sf):
    return _round(experiments.fine_tuning_pairs(_runs(spark, sf), "f1"), "base", "tuned", "delta")


@query(fx.sql(_RUNS + f" SELECT count(*) AS n, round(avg(delta), 6) AS mean_delta FROM {_PAIRS_SQL}", "ratings"))
def mean_improvement(spark, sf):
    return _round(experiments.mean_improvement(experiments.fine_tuning_pairs(_runs(spark, sf), "f1")), "mean_delta")


@query(fx.sql(_RUNS + " SELECT parser, annotator, fine_tuning, experiment_id FROM every WHERE experiment_id NOT IN (SELECT experiment_id FROM runs)", "ratings"))
def experiments_left(spark, sf):
    from parley.operators.prepare import not_yet_done

    runs = _runs(spark, sf)
    return not_yet_done(experiments.grid_of(runs, _SETTINGS), runs, ["experiment_id"]).select(*_SETTINGS, "experiment_id")


@query(fx.sql("SELECT t1_gold AS label, count(DISTINCT conv_id) AS n_convs FROM coded GROUP BY 1", "coded"))
def distinct_sessions(spark, sf):
    return fx.coded(spark, sf).groupBy(F.col("t1_gold").alias("label")).agg(F.countDistinct("conv_id").alias("n_convs"))


@query(fx.sql("SELECT DISTINCT conv_id, speaker FROM coded UNION SELECT conv_id, 'outcome' FROM outcomes", "coded", "outcomes"))
def set_union(spark, sf):
    rows = fx.coded(spark, sf).select("conv_id", "speaker")
    return rows.unionByName(fx.outcomes(spark, sf).select("conv_id", F.lit("outcome").alias("speaker"))).distinct()


_DISPATCH_KAPPA = _kappa_sql(_ALIGNED.replace("a.conv_utt_idx % 5 <> 0 AND ", ""), "speaker, tier")


@query(
    "WITH k AS (" + fx.sql(_DISPATCH_KAPPA, "coded") + "), o AS (" + fx.sql(_DELTAS + " SELECT count(*) AS n, round(avg(delta), 6) AS d, round(avg(pct_ct), 6) AS c FROM sd", "coded", "outcomes") + "), j AS ("
    + fx.sql("SELECT speaker, round(avg(CASE WHEN conv_utt_idx % 4 <> 1 AND t2_gold = t2_auto THEN 1.0::DOUBLE ELSE 0 END), 6) AS zs, round(avg(CASE WHEN conv_utt_idx % 4 <> 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ft FROM coded GROUP BY speaker", "coded")
    + """) SELECT 'agreement' AS method, tier || '.' || speaker || '.kappa' AS metric, kappa AS value FROM k UNION ALL SELECT 'agreement', tier || '.' || speaker || '.n', n::DOUBLE FROM k
    UNION ALL SELECT 'outcomes', 'n', n::DOUBLE FROM o UNION ALL SELECT 'outcomes', 'delta', d FROM o UNION ALL SELECT 'outcomes', 'pct_ct', c FROM o
    UNION ALL SELECT 'comparison', speaker || '.zero_shot', zs FROM j UNION ALL SELECT 'comparison', speaker || '.tuned', ft FROM j"""
)
def evaluation_dispatch(spark, sf):
    """Every named evaluation over one run's tables, with the values it gave."""
    key = ["conv_id", "conv_utt_idx"]
    rows, zero, tuned = _two_conditions(spark, sf)
    merged = metrics.merge_predictions(rows, zero, tuned, key)
    value = lambda name, c: F.struct(name.alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value"))

    def agreed():
        found = agreement.agreement_report(rows, rows.select(*key, "t1_auto", "t2_auto"), key, _TIERS)
        return found.select(F.inline(F.array(*[value(F.concat_ws(".", "tier", "speaker", F.lit(c)), c) for c in ("kappa", "n")])))

    def outcomes():
        found = _session_deltas(spark, sf).agg(F.count("*").alias("n"), F.avg("delta").alias("delta"), F.avg("pct_ct").alias("pct_ct"))
        return found.select(F.inline(F.array(*[value(F.lit(c), c) for c in ("n", "delta", "pct_ct")])))

    def compared():
        both = metrics.comparison(metrics.by_group(merged, "t2_gold", "zs_t2_pred", "speaker"), metrics.by_group(merged, "t2_gold", "ft_t2_pred", "speaker"), "speaker", ("zero_shot", "tuned"))
        both = both.filter("metric = 'accuracy'").drop("metric")
        return both.select(F.inline(F.array(*[value(F.concat_ws(".", "speaker", F.lit(c)), c) for c in ("zero_shot", "tuned")])))

    jobs = {"agreement": agreed, "outcomes": outcomes, "comparison": compared}
    found = [df.withColumn("method", F.lit(name)) for name, df in experiments.evaluate(list(jobs), jobs).items()]
    return found[0].unionByName(found[1]).unionByName(found[2])
