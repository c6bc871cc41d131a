"""Panel models, instruments, robust covariances and residual tests; every one from aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidData, InvalidParameter, SingularMatrix
from ..frames import check
from ..functions.special import chi_squared_p_value, f_test_p_value
from .gram import Fit, _inverse, _sums, _unpack, from_moments, least_squares, moments


class PanelData:
    """A panel with real keys."""

    def __init__(self, df: DataFrame, unit: str, time: str, y: str, features: list[str]):
        check(df, [y, *features])
        self.df, self.unit, self.time, self.y, self.features = df, unit, time, y, features

    def require_balanced(self) -> PanelData:
        r = self.df.agg(F.count("*"), F.countDistinct(self.unit), F.countDistinct(self.time)).first()
        if r[0] != r[1] * r[2]:
            raise InvalidData("the panel is not balanced")
        return self


def _demeaned(p: PanelData, theta=None) -> DataFrame:
    w = Window.partitionBy(p.unit)
    share = F.lit(1.0) if theta is None else theta
    return p.df.select(p.unit, p.time, *[(F.col(c).cast("double") - share * F.avg(F.col(c).cast("double")).over(w)).alias(c) for c in [p.y, *p.features]])


def pooled_ols(p: PanelData) -> Fit:
    return least_squares(p.df, p.features, p.y)


def between(p: PanelData) -> Fit:
    return least_squares(p.df.groupBy(p.unit).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [p.y, *p.features]]), p.features, p.y)


def fixed_effects(p: PanelData) -> Fit:
    """Within estimator; degrees of freedom lose one per unit."""
    fit = least_squares(_demeaned(p), p.features, p.y, intercept=False)
    units = p.df.select(p.unit).distinct().count()
    df = fit.n - units - len(p.features)
    if df > 0 and fit.df > 0:
        grow = fit.df / df
        fit.covariance = fit.covariance * grow
        fit.std_errors = {c: s * math.sqrt(grow) for c, s in fit.std_errors.items()}
        fit.df = df
    return fit


def unit_effects(p: PanelData, fit: Fit) -> DataFrame:
    mean = p.df.groupBy(p.unit).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [p.y, *p.features]])
    return mean.select(p.unit, (F.col(p.y) - sum((F.col(c) * fit.coef[c] for c in p.features), F.lit(0.0))).alias("effect"))


def random_effects(p: PanelData) -> Fit:
    """Quasi-demeaned by 1 - sqrt(se2 / (se2 + T su2)), T by unit."""
    fe, be = fixed_effects(p), between(p)
    se2 = fe.rss / fe.df
    t = p.df.groupBy(p.unit).agg(F.count("*").alias("t")).agg(F.avg("t")).first()[0]
    su2 = max(be.rss / max(be.df, 1) - se2 / t, 0.0)
    size = F.count("*").over(Window.partitionBy(p.unit))
    theta = 1 - F.sqrt(F.lit(se2) / (se2 + size * su2))
    rows = _demeaned(p, theta).withColumn("_one", F.lit(0.0))
    keyed = p.df.select(p.unit, p.time, (1 - theta).alias("_c"))
    rows = rows.drop("_one").join(keyed, [p.unit, p.time])
    return least_squares(rows, ["_c", *p.features], p.y, intercept=False)


def first_differences(p: PanelData) -> Fit:
    w = Window.partitionBy(p.unit).orderBy(p.time)
    rows = p.df.select(*[(F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(w)).alias(c) for c in [p.y, *p.features]]).dropna()
    return least_squares(rows, p.features, p.y, intercept=False)


def hausman(fe: Fit, re: Fit) -> dict:
    names = [c for c in fe.features if c in re.coef]
    d = np.array([fe.coef[c] - re.coef[c] for c in names])
    at = [re.features.index(c) for c in names]
    v = fe.covariance - re.covariance[np.ix_(at, at)]
    h = float(d @ np.linalg.pinv(v) @ d)
    return {"h": h, "df": len(names), "p_value": chi_squared_p_value(max(h, 0.0), len(names))}


def difference_in_differences(df: DataFrame, y: str, treated: str, post: str) -> DataFrame:
    """effect, std_error, t from four cells of one aggregate."""
    x, t, p = F.col(y).cast("double"), F.col(treated).cast("boolean"), F.col(post).cast("boolean")
    cells = {"tp": t & p, "tn": t & ~p, "cp": ~t & p, "cn": ~t & ~p}
    one = df.agg(*[a for k, c in cells.items() for a in (F.avg(F.when(c, x)).alias(f"m_{k}"), F.count(F.when(c, x)).alias(f"n_{k}"), (F.var_pop(F.when(c, x)) * F.count(F.when(c, x))).alias(f"s_{k}"))])
    effect = (F.col("m_tp") - F.col("m_tn")) - (F.col("m_cp") - F.col("m_cn"))
    n = sum((F.col(f"n_{k}") for k in cells), F.lit(0))
    s2 = sum((F.col(f"s_{k}") for k in cells), F.lit(0.0)) / (n - 4)
    se = F.sqrt(s2 * sum((1 / F.col(f"n_{k}") for k in cells), F.lit(0.0)))
    return one.select(effect.alias("effect"), se.alias("std_error"), F.try_divide(effect, se).alias("t"))


# instruments


def _pinv(a: np.ndarray) -> np.ndarray:
    """Projections need no independent instruments."""
    scale = np.sqrt(np.abs(np.diag(a)))
    scale[scale == 0] = 1
    return np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-11) / np.outer(scale, scale)


def _iv_moments(df: DataFrame, y: str, x: list[str], z: list[str]):
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in [*x, *z, y]]]
    row = df.dropna(subset=[*x, *z, y]).agg(F.count("*"), *_sums(cols, F.lit(1.0))).first()
    a = _unpack(row[1:], len(cols))
    xi = [0, *range(1, 1 + len(x))]
    zi = [0, *range(1 + len(x), 1 + len(x) + len(z))]
    return row[0], a, xi, zi


class TwoStageLeastSquares:
    """y on x (endogenous or not) with instruments z; both get an intercept. One pass of cross moments."""

    def __init__(self, y: str, x: list[str], z: list[str]):
        if len(z) < len(x):
            raise InvalidParameter("z", "fewer instruments than regressors")
        self.y, self.x, self.z = y, x, z

    def fit(self, df: DataFrame) -> TwoStageLeastSquares:
        n, a, xi, zi = _iv_moments(df, self.y, self.x, self.z)
        zz, zx, zy = a[np.ix_(zi, zi)], a[np.ix_(zi, xi)], a[zi, -1]
        w = _pinv(zz)
        try:
            bread = np.linalg.inv(zx.T @ w @ zx)
        except np.linalg.LinAlgError as e:
            raise SingularMatrix(str(e)) from e
        b = bread @ zx.T @ w @ zy
        xx, xy = a[np.ix_(xi, xi)], a[xi, -1]
        rss = float(a[-1, -1] - 2 * b @ xy + b @ xx @ b)
        self.n, self.beta, self.rss = n, b, rss
        self.coef = dict(zip(["intercept", *self.x], map(float, b), strict=True))
        se = np.sqrt(np.diag(bread) * rss / (n - len(b)))
        self.std_errors = dict(zip(["intercept", *self.x], map(float, se), strict=True))
        self._a, self._xi, self._zi = a, xi, zi
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, sum((F.col(c).cast("double") * self.coef[c] for c in self.x), F.lit(self.coef["intercept"])))

    def residual(self):
        return F.col(self.y).cast("double") - sum((F.col(c).cast("double") * self.coef[c] for c in self.x), F.lit(self.coef["intercept"]))

    def first_stage_f(self) -> dict[str, float]:
        a, zi, out = self._a, self._zi, {}
        for i, c in enumerate(self.x):
            at = self._xi[1 + i]
            tss = a[at, at] - a[0, at] ** 2 / self.n
            proj = a[zi, at] @ _pinv(a[np.ix_(zi, zi)]) @ a[zi, at]
            rss = a[at, at] - proj
            k = len(self.z)
            out[c] = float(((tss - rss) / k) / (rss / (self.n - k - 1))) if rss > 0 else math.inf
        return out

    def has_weak_instruments(self) -> bool:
        return min(self.first_stage_f().values()) < 10

    def sargan(self) -> dict:
        """n R^2 of the residuals on the instruments."""
        df = len(self.z) - len(self.x)
        if df < 1:
            raise InvalidParameter("z", "not over-identified")
        a, zi, xi = self._a, self._zi, self._xi
        ze = a[zi, -1] - a[np.ix_(zi, xi)] @ self.beta
        j = float(self.n * (ze @ _pinv(a[np.ix_(zi, zi)]) @ ze) / self.rss)
        return {"j": j, "df": df, "p_value": chi_squared_p_value(j, df)}


def gmm(df: DataFrame, y: str, x: list[str], z: list[str]) -> dict:
    """Two-step efficient GMM: 2SLS residuals weight the moments in a second pass."""
    first = TwoStageLeastSquares(y, x, z).fit(df)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in z]]
    e = first.residual()
    s = _unpack(df.dropna(subset=[*x, *z, y]).agg(*_sums(cols, e * e)).first(), len(cols))
    a, xi, zi = first._a, first._xi, first._zi
    w = np.linalg.pinv(s)
    zx, zy = a[np.ix_(zi, xi)], a[zi, -1]
    b = np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)
    g = zy - zx @ b
    df_ = len(z) - len(x)
    j = float(g @ w @ g)
    return {"coef": dict(zip(["intercept", *x], map(float, b), strict=True)), "j": j, "df": df_, "p_value": chi_squared_p_value(j, df_) if df_ > 0 else None}


def anderson_rubin(df: DataFrame, y: str, x: list[str], z: list[str], beta0: list[float]) -> dict:
    """F of y - X beta0 on the instruments."""
    rest = F.col(y).cast("double") - sum((F.col(c).cast("double") * b for c, b in zip(x, beta0, strict=True)), F.lit(0.0))
    fit = least_squares(df.withColumn("_r", rest), z, "_r")
    return {"f": fit.f, "df1": len(z), "df2": fit.df, "p_value": fit.f_p_value}


# covariances


def robust_covariance(df: DataFrame, fit: Fit, kind: str = "HC1", lags: int = 0, order: str | None = None, cluster: str | None = None) -> np.ndarray:
    """Sandwich over (intercept, features): White/HC0, HC1, HC2, HC3, NeweyWest (lags, order), Clustered (cluster).

    The bread is one aggregate; the meat another, in which leverages are expressions of the bread's inverse.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in fit.features]]
    k = len(cols)
    rows = df.dropna(subset=[*fit.features, fit.target])
    bread = _inverse(_unpack(rows.agg(*_sums(cols, F.lit(1.0))).first(), k))
    e = F.col(fit.target).cast("double") - fit.expression()
    if kind in ("White", "HC0", "HC1"):
        meat = _unpack(rows.agg(*_sums(cols, e * e)).first(), k)
        scale = fit.n / (fit.n - k) if kind == "HC1" else 1.0
        return scale * bread @ meat @ bread
    if kind in ("HC2", "HC3"):
        h = sum((cols[i] * cols[j] * float(bread[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
        meat = _unpack(rows.agg(*_sums(cols, e * e / F.pow(1 - h, F.lit(1 if kind == "HC2" else 2)))).first(), k)
        return bread @ meat @ bread
    if kind == "NeweyWest":
        w = Window.orderBy(order)
        scores = rows.select(order, *[(c * e).alias(f"s{i}") for i, c in enumerate(cols)])
        scores = scores.withColumns({f"s{i}_{m}": F.lag(f"s{i}", m).over(w) for i in range(k) for m in range(1, lags + 1)})
        aggs = [F.sum(F.col(f"s{i}") * F.col(f"s{j}" + (f"_{m}" if m else ""))) for m in range(lags + 1) for i in range(k) for j in range(k)]
        got = np.array([v or 0.0 for v in scores.agg(*aggs).first()]).reshape(lags + 1, k, k)
        meat = got[0] + sum(((1 - m / (lags + 1)) * (got[m] + got[m].T) for m in range(1, lags + 1)), np.zeros((k, k)))
        return bread @ meat @ bread
    if kind == "Clustered":
        sums = rows.groupBy(cluster).agg(*[F.sum(c * e).alias(f"s{i}") for i, c in enumerate(cols)])
        row = sums.agg(F.count("*"), *_sums([F.col(f"s{i}") for i in range(k)], F.lit(1.0))).first()
        g = row[0]
        return g / (g - 1) * (fit.n - 1) / (fit.n - k) * bread @ _unpack(row[1:], k) @ bread
    raise InvalidParameter("kind", kind)


def clustered_covariance(df: DataFrame, fit: Fit, cluster: str) -> np.ndarray:
    return robust_covariance(df, fit, "Clustered", cluster=cluster)


# residual tests


def _lm(df: DataFrame, features: list[str], target: str) -> dict:
    fit = least_squares(df, features, target)
    lm = fit.n * fit.r2
    return {"lm": lm, "df": len(features), "p_value": chi_squared_p_value(lm, len(features))}


def breusch_pagan(df: DataFrame, fit: Fit) -> dict:
    e = F.col(fit.target).cast("double") - fit.expression()
    return _lm(df.withColumn("_e2", e * e), fit.features, "_e2")


def white_test(df: DataFrame, fit: Fit) -> dict:
    """Levels, squares and cross products."""
    e = F.col(fit.target).cast("double") - fit.expression()
    extra = {f"_q{i}_{j}": F.col(a).cast("double") * F.col(b).cast("double") for i, a in enumerate(fit.features) for j, b in enumerate(fit.features) if i <= j}
    return _lm(df.withColumns({"_e2": e * e, **extra}), [*fit.features, *extra], "_e2")


def arch_test(df: DataFrame, column: str, order: str, lags: int) -> dict:
    from .timeseries import lagged

    rows = lagged(df.select(order, F.pow(F.col(column).cast("double"), F.lit(2)).alias("_e2")), "_e2", order, lags).dropna()
    return _lm(rows, [f"_e2_lag{k}" for k in range(1, lags + 1)], "_e2")


def ramsey_reset(df: DataFrame, fit: Fit, powers: int = 3) -> dict:
    """F of the powers 2..powers of the fitted values, scaled to unit mean size."""
    p = fit.expression()
    size = df.agg(F.avg(F.abs(p))).first()[0] or 1.0
    extra = {f"_p{k}": F.pow(p / size, F.lit(k)) for k in range(2, powers + 1)}
    m = moments(df.withColumns(extra), [*fit.features, *extra], fit.target)
    full, small = from_moments(m), from_moments(m.subset(fit.features))
    q = len(extra)
    f = ((small.rss - full.rss) / q) / (full.rss / full.df)
    return {"f": f, "df1": q, "df2": full.df, "p_value": f_test_p_value(f, q, full.df)}


def likelihood_ratio(ll0: float, ll1: float, df: int) -> dict:
    s = 2 * (ll1 - ll0)
    return {"lr": s, "df": df, "p_value": chi_squared_p_value(max(s, 0.0), df)}
