"""Moments of a regression in one pass, and everything that follows from them on the driver.

For p columns the aggregate is one row of p (p + 1) / 2 sums, whatever the number of rows; columns are centred first
by a cheap pass so that the sums keep their digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyData, SingularMatrix
from ..frames import check
from ..functions.special import f_test_p_value, t_test_p_value


@dataclass
class Moments:
    """names ends with the target. mean: of each; cross: centred, weighted cross products; raw: uncentred."""

    names: list[str]
    n: int
    weight: float
    mean: np.ndarray
    cross: np.ndarray

    @property
    def raw(self) -> np.ndarray:
        return self.cross + self.weight * np.outer(self.mean, self.mean)

    def subset(self, features: list[str]) -> Moments:
        at = [self.names.index(c) for c in [*features, self.names[-1]]]
        return Moments([*features, self.names[-1]], self.n, self.weight, self.mean[at], self.cross[np.ix_(at, at)])


def _sums(cols: list[Column], w: Column) -> list[Column]:
    p = len(cols)
    return [F.sum(w * cols[i] * cols[j]) for i in range(p) for j in range(i, p)]


def _unpack(row, p: int) -> np.ndarray:
    out, k = np.zeros((p, p)), 0
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = row[k] or 0.0
            k += 1
    return out


def moments(df: DataFrame, features: list[str], target: str, weight: str | None = None) -> Moments:
    """Rows with a NULL in any of the columns are left out."""
    names = [*features, target]
    check(df, names)
    cols = [F.col(c).cast("double") for c in names]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in names))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    first = rows.agg(F.count("*"), F.sum(w), *[F.sum(w * c) for c in cols]).first()
    if not first[0]:
        raise EmptyData("no complete row")
    mean = np.array([v / first[1] for v in first[2:]])
    centred = [c - float(m) for c, m in zip(cols, mean, strict=True)]
    row = rows.agg(*_sums(centred, w)).first()
    return Moments(names, first[0], float(first[1]), mean, _unpack(row, len(names)))


def _inverse(a: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.abs(np.diag(a)))
    scale[scale == 0] = 1
    s = a / np.outer(scale, scale)
    if np.linalg.matrix_rank(s, tol=1e-13) < len(s):
        raise SingularMatrix("the columns are linearly dependent")
    return np.linalg.inv(s) / np.outer(scale, scale)


def solve(m: Moments, intercept: bool = True, alpha: float = 0.0) -> dict[str, float]:
    """Coefficients by name, with "intercept"."""
    a = m.cross if intercept else m.raw
    xx, xy = a[:-1, :-1], a[:-1, -1]
    beta = _inverse(xx + alpha * np.eye(len(xx))) @ xy if len(xx) else np.zeros(0)
    out = dict(zip(m.names[:-1], map(float, beta), strict=True))
    out["intercept"] = float(m.mean[-1] - m.mean[:-1] @ beta) if intercept else 0.0
    return out


@dataclass
class Fit:
    """A fitted linear model."""

    features: list[str]
    target: str
    coef: dict[str, float]
    std_errors: dict[str, float]
    r2: float
    adjusted_r2: float
    f: float
    f_p_value: float
    rss: float
    n: int
    df: int
    covariance: np.ndarray

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.expression())

    def expression(self) -> Column:
        return sum((F.col(c).cast("double") * self.coef[c] for c in self.features), F.lit(self.coef["intercept"]))

    def t_statistics(self) -> dict[str, float]:
        return {c: self.coef[c] / s if s else float("nan") for c, s in self.std_errors.items()}

    def p_values(self) -> dict[str, float]:
        return {c: t_test_p_value(t, self.df) for c, t in self.t_statistics().items()}

    def score(self, df: DataFrame) -> float:
        from .metrics import r2_score

        return self.predict(df, "_p").agg(r2_score(self.target, "_p")).first()[0]


def from_moments(m: Moments, intercept: bool = True) -> Fit:
    coef = solve(m, intercept)
    a = m.cross if intercept else m.raw
    k = len(m.names) - 1
    beta = np.array([coef[c] for c in m.names[:-1]])
    tss = float(a[-1, -1])
    rss = max(0.0, float(tss - 2 * beta @ a[:-1, -1] + beta @ a[:-1, :-1] @ beta))
    df = m.n - k - int(intercept)
    s2 = rss / df if df > 0 else float("nan")
    inv = _inverse(a[:-1, :-1]) if k else np.zeros((0, 0))
    cov = s2 * inv
    se = {c: float(np.sqrt(cov[i, i])) for i, c in enumerate(m.names[:-1])}
    if intercept:
        se["intercept"] = float(np.sqrt(s2 * (1 / m.weight + m.mean[:-1] @ inv @ m.mean[:-1])))
    r2 = 1 - rss / tss if tss > 0 else 1.0
    f = (r2 / k) / ((1 - r2) / df) if k and df > 0 and r2 < 1 else float("nan")
    adj = 1 - (1 - r2) * (m.n - int(intercept)) / df if df > 0 else float("nan")
    return Fit(m.names[:-1], m.names[-1], coef, se, r2, adj, f, f_test_p_value(f, k, df) if f == f else float("nan"), rss, m.n, df, cov)


def least_squares(df: DataFrame, features: list[str], target: str, intercept: bool = True, weight: str | None = None) -> Fit:
    """OLS, or WLS with a weight column."""
    return from_moments(moments(df, features, target, weight), intercept)


def gls(df: DataFrame, features: list[str], target: str, variance: str, intercept: bool = True) -> Fit:
    """Generalised least squares for independent errors of known variance."""
    return least_squares(df.withColumn("_w", 1 / F.col(variance)), features, target, intercept, "_w")


def ridge(df: DataFrame, features: list[str], target: str, alpha: float) -> dict[str, float]:
    """(X'X + alpha I) b = X'y, without intercept."""
    return solve(moments(df, features, target), intercept=False, alpha=alpha)


def lasso(df: DataFrame, features: list[str], target: str, alpha: float, sweeps: int = 1000, tol: float = 1e-12) -> dict[str, float]:
    """Coordinate descent on the moments: minimises half the squared error plus alpha times the L1 norm, no intercept."""
    a = moments(df, features, target).raw
    xx, xy = a[:-1, :-1], a[:-1, -1]
    b = np.zeros(len(xx))
    for _ in range(sweeps):
        old = b.copy()
        for j in range(len(b)):
            r = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - alpha, 0.0) / xx[j, j] if xx[j, j] > 0 else 0.0
        if np.abs(b - old).max(initial=0) < tol:
            break
    return {**dict(zip(features, map(float, b), strict=True)), "intercept": 0.0}


def elastic_net(df: DataFrame, features: list[str], target: str, l1: float, l2: float, sweeps: int = 1000) -> dict[str, float]:
    a = moments(df, features, target).raw
    xx, xy = a[:-1, :-1], a[:-1, -1]
    b = np.zeros(len(xx))
    for _ in range(sweeps):
        for j in range(len(b)):
            r = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (xx[j, j] + l2)
    return {**dict(zip(features, map(float, b), strict=True)), "intercept": 0.0}


def logistic(df: DataFrame, features: list[str], target: str, steps: int | None = None, rate: float = 0.01) -> dict[str, float]:
    """Binary logistic regression: Newton steps to convergence, or ``steps`` of full-batch gradient descent.

    Every step is one aggregate over all rows; nothing but sums reaches the driver.
    """
    check(df, [*features, target])
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y = F.col(target).cast("double")
    b = np.zeros(len(cols))
    for _ in range(steps or 25):
        z = sum((c * float(v) for c, v in zip(cols, b, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        aggs = [F.count("*"), *[F.sum((p - y) * c) for c in cols]]
        if steps is None:
            aggs += _sums(cols, p * (1 - p))
        row = df.agg(*aggs).first()
        g = np.array(row[1 : 1 + len(cols)], float)
        if steps is not None:
            b = b - rate * g / row[0]
            continue
        h = _unpack(row[1 + len(cols) :], len(cols))
        move = np.linalg.solve(h + 1e-10 * np.trace(h) * np.eye(len(cols)) / len(cols), g)
        b = b - move
        if np.abs(move).max() < 1e-9:
            break
    return {"intercept": float(b[0]), **dict(zip(features, map(float, b[1:]), strict=True))}


def logistic_probability(coef: dict[str, float]) -> Column:
    z = sum((F.col(c).cast("double") * v for c, v in coef.items() if c != "intercept"), F.lit(coef["intercept"]))
    return 1 / (1 + F.exp(-z))
