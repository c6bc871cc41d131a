"""Feature scores and selection; all features of a table in one long pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..frames import check, ratio, unpivot
from .gram import least_squares


def f_classif(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, score: ANOVA F per feature; 0 where nothing varies within classes."""
    check(df, features)
    long = unpivot(df, features, [label])
    groups = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("ss"))
    w = Window.partitionBy("feature")
    groups = groups.withColumn("g", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    one = groups.groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2))).alias("ssb"), F.sum("ss").alias("ssw"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return one.select("feature", F.coalesce(ratio(ratio(F.col("ssb"), F.col("k") - 1), ratio(F.col("ssw"), F.col("n") - F.col("k"))), F.lit(0.0)).alias("score"))


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, score: r^2 (n - 2) / (1 - r^2)."""
    check(df, [*features, target])
    long = unpivot(df, features, [target]).withColumn("y", F.col(target).cast("double"))
    r2 = ratio(F.pow(F.covar_pop("x", "y"), F.lit(2)), F.var_pop("x") * F.var_pop("y"))
    one = long.groupBy("feature").agg(F.count("x").alias("n"), r2.alias("r2"))
    return one.select("feature", F.when(F.col("r2") < 1, F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))).otherwise(0.0).alias("score"))


def mutual_info_classif(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """feature, score: mutual information (nats) of equal-width bins and the label."""
    check(df, features)
    row = df.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.min, F.max)]).first()
    binned = []
    for i, c in enumerate(features):
        lo, hi = row[2 * i], row[2 * i + 1]
        width = ((hi - lo) / bins) if lo is not None and hi > lo else 1.0
        binned.append(F.least(F.floor((F.col(c).cast("double") - F.lit(lo)) / width), F.lit(bins - 1)).cast("double").alias(c))
    long = df.select(label, *binned).unpivot([label], features, "feature", "b").where("b is not null")
    joint = long.groupBy("feature", "b", label).agg(F.count("*").alias("n"))
    f, fb, fl = Window.partitionBy("feature"), Window.partitionBy("feature", "b"), Window.partitionBy("feature", label)
    total = F.sum("n").over(f)
    part = F.col("n") / total * F.ln(F.col("n") * total / (F.sum("n").over(fb) * F.sum("n").over(fl)))
    return joint.select("feature", part.alias("p")).groupBy("feature").agg(F.sum("p").alias("score"))


SCORES = {"f_classif": f_classif, "f_regression": f_regression, "mutual_info_classif": mutual_info_classif}


def select_k_best(df: DataFrame, features: list[str], target: str, k: int, score: str = "f_classif") -> DataFrame:
    """feature, score, rank of the k best; ties go to the feature named first."""
    if score not in SCORES:
        raise InvalidParameter("score", score)
    order = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature"))
    ranked = SCORES[score](df, features, target).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), order)))
    return ranked.where(F.col("rank") <= k)


def transform(df: DataFrame, selected: DataFrame, keep: list[str]) -> DataFrame:
    """The selected columns, best first."""
    return df.select(*keep, *[r["feature"] for r in selected.orderBy("rank").collect()])


def rfe(df: DataFrame, features: list[str], target: str, n_features: int, step: int = 1) -> list[str]:
    """Recursive elimination by |coefficient|; every round solves on one stored set of moments."""
    from .gram import moments, solve

    g = moments(df, features, target)
    left = list(features)
    while len(left) > n_features:
        beta = solve(g.subset(left))
        order = sorted(left, key=lambda c: abs(beta[c]))
        for c in order[: min(step, len(left) - n_features)]:
            left.remove(c)
    return left


__all__ = ["f_classif", "f_regression", "mutual_info_classif", "select_k_best", "transform", "rfe", "least_squares"]
