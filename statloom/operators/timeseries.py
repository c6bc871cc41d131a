"""Time series. A series is ordered by a column; ``by`` splits a table into many series that are treated side by side.

Lags, sums and products are window expressions and aggregates; recursions run on parameters and short tails.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..frames import ratio
from ..functions.special import chi_squared_p_value, f_test_p_value, normal_ppf
from .gram import Fit, from_moments, least_squares, moments


def _w(order: str, by: list[str] | None):
    return Window.partitionBy(*(by or [])).orderBy(order)


def lagged(df: DataFrame, column: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """df with column_lag1 ... column_lagN."""
    w = _w(order, by)
    return df.withColumns({f"{column}_lag{k}": F.lag(F.col(column).cast("double"), k).over(w) for k in range(1, lags + 1)})


def difference(df: DataFrame, column: str, order: str, d: int = 1, by: list[str] | None = None) -> DataFrame:
    """Column replaced by its d-th difference; the first d rows of a series go."""
    w = _w(order, by)
    for _ in range(d):
        df = df.withColumn("_diff", F.col(column).cast("double") - F.lag(F.col(column).cast("double")).over(w)).where("_diff is not null").withColumn(column, F.col("_diff")).drop("_diff")
    return df


def acf(df: DataFrame, column: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """lag, rho: sum of lagged products over the sum of squares, both centred; all lags in one pass."""
    keys = by or []
    e = F.col(column).cast("double") - F.avg(F.col(column).cast("double")).over(Window.partitionBy(*keys))
    rows = df.select(*keys, order, e.alias("e"))
    w = _w(order, by)
    rows = rows.withColumns({f"l{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    one = rows.groupBy(*keys).agg(F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("q"), *[F.sum(F.col("e") * F.col(f"l{k}")).alias(f"p{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), ratio(F.col(f"p{k}"), F.col("q")).alias("rho")) for k in range(1, lags + 1)])
    return one.select(*keys, "n", F.explode(pairs).alias("r")).select(*keys, "n", "r.*")


def ljung_box(df: DataFrame, column: str, order: str, lags: int, by: list[str] | None = None, p_value: bool = True) -> DataFrame:
    keys = by or []
    r = acf(df, column, order, lags, by)
    q = r.groupBy(*keys).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag")))).alias("q"))
    if p_value:
        from ..functions.special import column as over

        q = q.withColumn("p_value", over(lambda x: chi_squared_p_value(x, lags), "q"))
    return q


class ARIMA:
    """AR by Yule-Walker on the d-th difference, MA by the innovations of a long autoregression; forecasts integrate d times."""

    def __init__(self, p: int, d: int = 0, q: int = 0):
        self.p, self.d, self.q = p, d, q

    def fit(self, df: DataFrame, column: str, order: str) -> ARIMA:
        self.column, self.order = column, order
        work = difference(df.select(order, column), column, order, self.d)
        self.mean = work.agg(F.avg(F.col(column).cast("double"))).first()[0]
        depth = max(self.p, self.p + self.q + 3 if self.q else self.p)
        rho = [1.0] + [r["rho"] for r in acf(work, column, order, max(depth, 1)).orderBy("lag").collect()]
        toeplitz = lambda n: np.array([[rho[abs(i - j)] for j in range(n)] for i in range(n)])
        self.ar = np.linalg.solve(toeplitz(self.p), np.array(rho[1 : self.p + 1])) if self.p else np.zeros(0)
        self.ma = np.zeros(self.q)
        if self.q:
            long = np.linalg.solve(toeplitz(depth), np.array(rho[1 : depth + 1]))
            e = F.col(column) - self.mean
            resid = lagged(work.withColumn("_z", e), "_z", order, depth)
            resid = resid.withColumn("_e", F.col("_z") - sum((F.col(f"_z_lag{k}") * float(long[k - 1]) for k in range(1, depth + 1)), F.lit(0.0)))
            resid = lagged(lagged(resid.select(order, "_z", "_e"), "_e", order, self.q), "_z", order, max(self.p, 1)).dropna()
            names = [f"_z_lag{k}" for k in range(1, self.p + 1)] + [f"_e_lag{k}" for k in range(1, self.q + 1)]
            fit = least_squares(resid, names, "_z", intercept=False)
            self.ar = np.array([fit.coef[f"_z_lag{k}"] for k in range(1, self.p + 1)])
            self.ma = np.array([fit.coef[f"_e_lag{k}"] for k in range(1, self.q + 1)])
        return self

    def forecast(self, df: DataFrame, h: int, memory: int = 1000) -> list[float]:
        """From the last ``memory`` values: their innovations are filtered out one after the other (0 before them), later ones count as 0."""
        most = max(memory if self.q else 0, self.p + 1) + self.d
        tail = [float(r[0]) for r in df.orderBy(F.desc(self.order)).limit(most).select(F.col(self.column).cast("double")).collect()][::-1]
        levels = [np.array(tail)]
        for _ in range(self.d):
            levels.append(np.diff(levels[-1]))
        z, e = [], []

        def expected() -> float:
            return float(sum(a * v for a, v in zip(self.ar, z[::-1], strict=False)) + sum(m * v for m, v in zip(self.ma, e[::-1], strict=False)))

        for v in (levels[-1] - self.mean).tolist():
            e.append(v - expected() if len(z) >= self.p else 0.0)
            z.append(v)
        for _ in range(h):
            z.append(expected())
            e.append(0.0)
        out = np.array(z[-h:]) + self.mean
        for level in levels[-2::-1]:
            out = level[-1] + np.cumsum(out)
        return [float(v) for v in out]


class VAR:
    """Vector autoregression: one least-squares fit per column, all from one pass of moments."""

    def __init__(self, p: int):
        self.p = p

    def fit(self, df: DataFrame, columns: list[str], order: str) -> VAR:
        self.columns, self.order = columns, order
        rows = df.select(order, *columns)
        for c in columns:
            rows = lagged(rows, c, order, self.p)
        names = [f"{c}_lag{k}" for k in range(1, self.p + 1) for c in columns]
        self.fits: dict[str, Fit] = {c: from_moments(moments(rows.dropna(), names, c)) for c in columns}
        self.const = np.array([self.fits[c].coef["intercept"] for c in columns])
        self.coef = [np.array([[self.fits[c].coef[f"{x}_lag{k}"] for x in columns] for c in columns]) for k in range(1, self.p + 1)]
        return self

    def forecast(self, df: DataFrame, h: int) -> list[list[float]]:
        last = [np.array([float(r[c]) for c in self.columns]) for r in df.orderBy(F.desc(self.order)).limit(self.p).collect()]
        out = []
        for _ in range(h):
            new = self.const + sum(a @ v for a, v in zip(self.coef, last, strict=True))
            out.append([float(v) for v in new])
            last = [new, *last[:-1]]
        return out

    def irf(self, h: int) -> list[list[list[float]]]:
        """Responses to unit shocks at steps 0..h."""
        psi = [np.eye(len(self.columns))]
        for i in range(1, h + 1):
            psi.append(sum((psi[i - k] @ self.coef[k - 1] for k in range(1, min(i, self.p) + 1)), np.zeros_like(psi[0])))
        return [m.tolist() for m in psi]


def granger_causality(df: DataFrame, cause: str, effect: str, order: str, lags: int) -> dict:
    """F test of the lags of ``cause`` in the regression of ``effect`` on its own lags."""
    rows = lagged(lagged(df.select(order, cause, effect), cause, order, lags), effect, order, lags).dropna()
    own, other = [f"{effect}_lag{k}" for k in range(1, lags + 1)], [f"{cause}_lag{k}" for k in range(1, lags + 1)]
    m = moments(rows, own + other, effect)
    full, small = from_moments(m), from_moments(m.subset(own))
    f = ((small.rss - full.rss) / lags) / (full.rss / full.df)
    return {"f": f, "df1": lags, "df2": full.df, "p_value": f_test_p_value(f, lags, full.df)}


class GARCH:
    """GARCH(1, 1) by maximum likelihood; one series per task, so many series fit side by side."""

    def fit(self, df: DataFrame, column: str, order: str, by: list[str] | None = None) -> DataFrame:
        keys = by or []
        types = dict(df.dtypes)
        schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "omega double", "alpha double", "beta double", "last_variance double", "last_residual double", "log_likelihood double"])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            e = pdf.sort_values(order)[column].to_numpy(float)
            e = e - e.mean()
            v0 = float(e.var()) or 1e-12

            def nll(theta):
                a, b = theta
                if a < 0 or b < 0 or a + b >= 0.9999:
                    return np.inf, v0
                w, s, total = v0 * (1 - a - b), v0, 0.0
                for x in e:
                    total += 0.5 * (math.log(2 * math.pi * s) + x * x / s)
                    s = max(w + a * x * x + b * s, 1e-300)
                return total, s

            best, step = (0.1, 0.8), 0.1
            value, s = nll(best)
            while step > 1e-3:
                moves = [(nll((best[0] + i * step, best[1] + j * step)), (best[0] + i * step, best[1] + j * step)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                (low, ls), at = min(moves, key=lambda m: m[0][0])
                if low < value - 1e-9:
                    value, s, best = low, ls, at
                else:
                    step /= 2
            a, b = best
            head = [pdf[k].iloc[0] for k in keys]
            return pd.DataFrame([[*head, v0 * (1 - a - b), a, b, s, float(e[-1]), -value]], columns=[x.rsplit(" ", 1)[0] for x in schema.split(", ")])

        rows = df.select(*keys, order, F.col(column).cast("double").alias(column))
        if keys:
            return rows.groupBy(*keys).applyInPandas(run, schema)
        return rows.withColumn("_series", F.lit(0)).groupBy("_series").applyInPandas(run, schema)  # one series is one sequential recursion


def garch_forecast(omega: float, alpha: float, beta: float, last_variance: float, h: int) -> list[float]:
    """Variances of the next h steps; last_variance is that of the first of them."""
    out = [last_variance]
    for _ in range(h - 1):
        out.append(omega + (alpha + beta) * out[-1])
    return out


def value_at_risk(variance: float, level: float = 0.95, horizon: int = 1, mean: float = 0.0) -> float:
    if not 0 < level < 1:
        raise InvalidParameter("level", "between 0 and 1")
    return mean * horizon + normal_ppf(1 - level) * math.sqrt(variance * horizon)
