"""Metrics over a column of truths and one of predictions: single-pass aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import ratio


def _c(x: str | Column) -> Column:
    return F.col(x).cast("double") if isinstance(x, str) else x


def mean_squared_error(y, p) -> Column:
    return F.avg((_c(y) - _c(p)) * (_c(y) - _c(p)))


def root_mean_squared_error(y, p) -> Column:
    return F.sqrt(mean_squared_error(y, p))


def mean_absolute_error(y, p) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def r2_score(y, p) -> Column:
    """0 where the truths do not vary."""
    total = F.var_pop(_c(y)) * F.count(_c(y))
    return F.when(total < 1e-10, 0.0).otherwise(1 - ratio(F.sum((_c(y) - _c(p)) * (_c(y) - _c(p))), total))


def adjusted_r2_score(y, p, n_features: int) -> Column:
    n = F.count(_c(y))
    return F.when(n > n_features + 1, 1 - (1 - r2_score(y, p)) * (n - 1) / (n - n_features - 1))


def accuracy(y, p) -> Column:
    return F.avg(F.when(F.abs(_c(y) - _c(p)) < 1e-10, 1.0).otherwise(0.0))


def _cells(y, p):
    t, q = _c(y) > 0.5, _c(p) > 0.5
    return tuple(F.count_if(x).cast("double") for x in (t & q, ~t & q, t & ~q, ~t & ~q))


def precision(y, p) -> Column:
    tp, fp, _, _ = _cells(y, p)
    return F.coalesce(ratio(tp, tp + fp), F.lit(0.0))


def recall(y, p) -> Column:
    tp, _, fn, _ = _cells(y, p)
    return F.coalesce(ratio(tp, tp + fn), F.lit(0.0))


def f1_score(y, p) -> Column:
    tp, fp, fn, _ = _cells(y, p)
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def matthews_corrcoef(y, p) -> Column:
    tp, fp, fn, tn = _cells(y, p)
    return F.coalesce(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


def log_loss(y, p) -> Column:
    q = F.least(F.greatest(_c(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(_c(y) * F.ln(q) + (1 - _c(y)) * F.ln(1 - q))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """truth, prediction, n over the full grid of labels 0..max, zero-filled."""
    counts = df.groupBy(F.col(y).cast("long").alias("truth"), F.col(p).cast("long").alias("prediction")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max(F.greatest("truth", "prediction")).alias("m"))
    labels = F.sequence(F.lit(0).cast("long"), F.col("m"))
    grid = top.select(F.explode(labels).alias("truth"), "m").select("truth", F.explode(labels).alias("prediction"))
    return grid.join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(accuracy(y, p).alias("accuracy"), precision(y, p).alias("precision"), recall(y, p).alias("recall"), f1_score(y, p).alias("f1"))


def regression_report(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(mean_squared_error(y, p).alias("mse"), root_mean_squared_error(y, p).alias("rmse"), mean_absolute_error(y, p).alias("mae"), r2_score(y, p).alias("r2"))
