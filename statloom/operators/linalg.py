"""Dense algebra on small matrices (driver or task side) and tall matrices as frames (i, j, v)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, NumericalError, SingularMatrix


def _square(a) -> np.ndarray:
    a = np.asarray(a, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise DimensionMismatch(f"square matrix needed, not {a.shape}")
    return a


def det(a) -> float:
    d = float(np.linalg.det(_square(a)))
    return 0.0 if abs(d) < 1e-10 else d


def trace(a) -> float:
    return float(np.trace(_square(a)))


def qr(a) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal of R positive."""
    q, r = np.linalg.qr(np.asarray(a, float))
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    if (np.abs(np.diag(r)) < 1e-10).any():
        raise NumericalError("columns are linearly dependent")
    return q * s, r * s[:, None]


def svd(a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.linalg.svd(np.asarray(a, float), full_matrices=False)


def cholesky(a) -> np.ndarray:
    try:
        return np.linalg.cholesky(_square(a))
    except np.linalg.LinAlgError as e:
        raise NumericalError(str(e)) from e


def solve(a, b) -> np.ndarray:
    a = _square(a)
    if np.linalg.matrix_rank(a) < len(a):
        raise SingularMatrix("singular")
    return np.linalg.solve(a, np.asarray(b, float))


def lstsq(a, b) -> np.ndarray:
    return np.linalg.lstsq(np.asarray(a, float), np.asarray(b, float), rcond=None)[0]


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) x (i, j, v), sparse: one join on the inner index, partial sums before the shuffle."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("u"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", "c").agg(F.sum(F.col("v") * F.col("u")).alias("v")).withColumnRenamed("c", "j")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def norms(a: DataFrame) -> DataFrame:
    """frobenius, l1 (largest column sum), max."""
    cols = a.groupBy("j").agg(F.sum(F.abs("v")).alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max(F.abs("v")).alias("m"))
    return cols.agg(F.sqrt(F.sum("q")).alias("frobenius"), F.max("s").alias("l1"), F.max("m").alias("max"))
