"""Fitted models: ridge, multiple regression, functional regression, and a trainable stand-in for code models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.stats import f_upper
from parley.operators.factors import Factor, Solution, factors_of, fitted, triangular_factors
from parley.operators.order import held
from parley.operators.splits import mixed


def ridge(train: DataFrame, features: str, target: str, alpha: float = 1.0) -> Solution:
    """Ridge regression of a target on an array column; the intercept is free, the penalty in the units of the closed form."""
    return fitted(train, features, target, alpha)


def ridge_test(data: DataFrame, key: str, features: str, target: str, alpha: float = 1.0, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """n_train, n_test and test R2 of ridge regression on a hash split by ``key``."""
    part = F.conv(F.substring(mixed(F.col(key), seed), 1, 8), 16, 10).cast("long") % 1000
    split = data.withColumn("_test", part < int(1000 * test_share))
    model = ridge(split.filter(~F.col("_test")), features, target, alpha)
    rows = split.filter("_test").select(model.predict(F.col(features)).alias("prediction"), F.col(target).cast("double").alias("y")).dropna()
    out = rows.agg(F.count("*").alias("n_test"), (1 - F.sum((F.col("y") - F.col("prediction")) ** 2) / (F.count("*") * F.var_pop("y"))).alias("r2"))
    return out.withColumn("n_train", F.lit(model.n).cast("long"))


def top_dimensions(spark, coefficients, k: int = 10) -> DataFrame:
    """The k coefficients of largest size: dim, coefficient."""
    rows = [(i, float(v)) for i, v in enumerate(coefficients)]
    return spark.createDataFrame(rows, "dim long, coefficient double").orderBy(F.desc(F.abs("coefficient")), "dim").limit(k)


def multiple_regression(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """n, r2, adjusted r2, F and its p-value of ordinary least squares over complete rows, in one pass."""
    names = F.array(*[F.col(c).cast("double") for c in columns])
    return sweep(rows.select(F.lit(len(columns)).alias("k"), names.alias("x"), F.col(target).alias("y")), [len(columns)]).drop("k", "r")


def explained(factor: Factor) -> tuple[int, float | None, float | None, float | None, float | None]:
    """n, r2, adjusted r2, F and its p-value of a regression; nulls where there are too few rows."""
    n, k = factor.n, len(factor.origin) - 1
    if n <= k + 1:
        return n, None, None, None, None
    found = factor.solve()
    r2, rank = found.r2, found.rank
    free = n - rank - 1
    f = r2 / rank / ((1 - r2) / free) if rank and free > 0 and r2 < 1 else float("inf")
    return n, r2, 1 - (1 - r2) * (n - 1) / free if free > 0 else None, f, float(f_upper(f, rank, free)) if np.isfinite(f) else 0.0


def spline_basis(x: np.ndarray, n_bases: int = 10, order: int = 5) -> np.ndarray:
    """Values of clamped B-splines of an order (degree + 1) on [0, 100], by the recurrence in the order."""
    inner = np.linspace(0, 100, n_bases - order + 2)
    knots = np.concatenate([[0.0] * (order - 1), inner, [100.0] * (order - 1)])
    x = np.minimum(x, np.nextafter(100.0, 0))
    basis = ((knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])).astype(float)
    for p in range(1, order):
        left, right = knots[p:-1] - knots[: -p - 1], knots[p + 1 :] - knots[1:-p]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(left > 0, (x[:, None] - knots[: -p - 1]) / left, 0.0)
            b = np.where(right > 0, (knots[p + 1 :] - x[:, None]) / right, 0.0)
        basis = a * basis[:, :-1] + b * basis[:, 1:]
    return basis


def spline_coefficients(points: DataFrame, n_bases: int = 10, order: int = 5, ridge_penalty: float = 1e-3) -> DataFrame:
    """conv_id, coefs: each session's (progress, score) points in the spline basis, lightly penalised."""
    kind = points.schema["conv_id"].dataType.simpleString()

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=["score"])
        if not len(f):
            return pd.DataFrame({"conv_id": [], "coefs": []})
        b = spline_basis(f["progress"].to_numpy(float), n_bases, order)
        coefs = np.linalg.solve(b.T @ b + ridge_penalty * np.eye(n_bases), b.T @ f["score"].to_numpy(float))
        return pd.DataFrame({"conv_id": [f["conv_id"].iloc[0]], "coefs": [coefs.tolist()]})

    return points.select("conv_id", "progress", "score").groupBy("conv_id").applyInPandas(fit, f"conv_id {kind}, coefs array<double>")


def functional_regression(points: DataFrame, outcomes: DataFrame, target: str, n_bases: int = 10) -> DataFrame:
    """Multiple regression of the outcome on spline coefficients."""
    coefs = spline_coefficients(points, n_bases)
    wide = coefs.select("conv_id", *[F.get("coefs", F.lit(i)).alias(f"b{i}") for i in range(n_bases)])
    return multiple_regression(wide.join(outcomes, "conv_id"), [f"b{i}" for i in range(n_bases)], target)


def sweep(rows: DataFrame, settings: list[int]) -> DataFrame:
    """Multiple regressions for many settings at once: k, n, r2, r2_adjusted, f, p_value and r, the root of r2.

    ``rows``: k (the setting), x (array of k values), y. Rows with a missing value are left out; a setting with too few
    rows has nulls. One pass serves all settings, by triangular factors (``factors``): neither an offset of the outcome nor
    nearly dependent columns spoil the result. Each setting is solved by its own task.
    """

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(f["k"].iloc[0]), *explained(factors_of(f)[0]))], columns=["k", "n", "r2", "r2_adjusted", "f", "p_value"])

    found = triangular_factors(rows).groupBy("k").applyInPandas(solve, "k int, n long, r2 double, r2_adjusted double, f double, p_value double")
    every = rows.sparkSession.createDataFrame([(k,) for k in settings], "k int").join(found, "k", "left").fillna(0, ["n"])
    return every.withColumn("r", F.sqrt(F.when(F.col("r2") < 0, 0.0).otherwise(F.col("r2"))))


def text_classifier(train: DataFrame, label: str, text: str = "utt_text", n_features: int = 1 << 12):
    """Hashed words and a multinomial logistic regression: a small trainable stand-in for a fine-tuned model."""
    return fitted_classifier(_tokens(train, text, n_features), label)


def word_counts(rows: DataFrame, text: str, n_features: int = 1 << 12) -> DataFrame:
    """``rows`` with the hashed words of a text instead of the text, held: what several classifiers learn from and predict
    by is found once."""
    return held(_tokens(rows, text, n_features).drop("_w", text))


def fitted_classifier(counted: DataFrame, label: str):
    """The classifier of rows with hashed words (``word_counts``)."""
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc").fit(counted)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01).fit(index.transform(counted))
    return model, index.labels


def _tokens(df: DataFrame, text: str, n: int) -> DataFrame:
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+").transform(df)
    return HashingTF(inputCol="_w", outputCol="_x", numFeatures=n).transform(words)


def predict_codes(model, labels: list[str], rows: DataFrame, out: str, text: str = "utt_text") -> DataFrame:
    return predict_counted(model, labels, _tokens(rows, text, model.numFeatures).drop("_w"), out)


def predict_counted(model, labels: list[str], counted: DataFrame, out: str) -> DataFrame:
    """``predict_codes`` of rows with hashed words (``word_counts``)."""
    names = F.array(*map(F.lit, labels))
    found = model.transform(counted)
    return found.withColumn(out, F.get(names, F.col("prediction").cast("int"))).drop("_x", "rawPrediction", "probability", "prediction")
