"""Generated and literal tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..operators.stochastic import normal

# Five rows of each class of the iris measurements.
IRIS = [
    (5.1, 3.5, 1.4, 0.2, 0.0), (4.9, 3.0, 1.4, 0.2, 0.0), (4.7, 3.2, 1.3, 0.2, 0.0), (4.6, 3.1, 1.5, 0.2, 0.0), (5.0, 3.6, 1.4, 0.2, 0.0),
    (7.0, 3.2, 4.7, 1.4, 1.0), (6.4, 3.2, 4.5, 1.5, 1.0), (6.9, 3.1, 4.9, 1.5, 1.0), (5.5, 2.3, 4.0, 1.3, 1.0), (6.5, 2.8, 4.6, 1.5, 1.0),
    (6.3, 3.3, 6.0, 2.5, 2.0), (5.8, 2.7, 5.1, 1.9, 2.0), (7.1, 3.0, 5.9, 2.1, 2.0), (6.3, 2.9, 5.6, 1.8, 2.0), (6.5, 3.0, 5.8, 2.2, 2.0),
]


def load_iris(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(IRIS)]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, f3 double, label double")


def make_regression(spark: SparkSession, n: int, p: int, noise: float = 0.1, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """id, f0.., y and the coefficients; normal features, uniform coefficients."""
    coef = [random.Random(seed * 1009 + j).uniform(-1, 1) for j in range(p)]
    df = spark.range(n).select("id", *[normal(seed + j, "id").alias(f"f{j}") for j in range(p)])
    y = sum((F.col(f"f{j}") * c for j, c in enumerate(coef)), F.lit(0.0)) + noise * normal(seed + p, "id")
    return df.withColumn("y", y), coef


def make_classification(spark: SparkSession, n: int, p: int, classes: int, seed: int = 0) -> DataFrame:
    """id, f0.., label: class c is centred at 3 c in every feature."""
    if n % classes:
        raise InvalidParameter("n", "must be a multiple of the number of classes")
    df = spark.range(n).withColumn("label", (F.col("id") % classes).cast("int"))
    return df.select("id", *[(3 * F.col("label") + normal(seed + j, "id")).alias(f"f{j}") for j in range(p)], "label")
