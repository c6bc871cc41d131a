"""Spatial statistics over edge lists (i, j, w); an n x n matrix only for the impacts of few regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import cut_lineage
from ..functions.special import column as over
from ..functions.special import normal_cdf
from .cluster import within
from .econometrics import TwoStageLeastSquares
from .gram import least_squares
from .models import nearest


def weights_within(df: DataFrame, id_column: str, features: str, threshold: float) -> DataFrame:
    """1 for all other rows at most ``threshold`` away."""
    return within(df, id_column, features, threshold).withColumn("w", F.lit(1.0))


def weights_knn(df: DataFrame, id_column: str, features: str, k: int) -> DataFrame:
    """Directed: 1 for the k nearest."""
    near = nearest(df, df, k, query_id=id_column, train_id=id_column, features=features, exclude_same=True)
    return near.select(F.col("query_id").alias("i"), F.col("train_id").alias("j"), F.lit(1.0).alias("w"))


def row_standardize(w: DataFrame) -> DataFrame:
    total = F.sum("w").over(Window.partitionBy("i"))
    return w.select("i", "j", F.coalesce(F.try_divide(F.col("w"), total), F.lit(0.0)).alias("w"))


def spatial_lag(df: DataFrame, w: DataFrame, id_column: str, column: str, name: str = "lag") -> DataFrame:
    """df with the weighted sum of neighbours' values; 0 without neighbours."""
    x = df.select(F.col(id_column).alias("j"), F.col(column).cast("double").alias("_x"))
    lag = w.join(x, "j").groupBy("i").agg(F.sum(F.col("w") * F.col("_x")).alias("_l"))
    return df.join(lag, F.col(id_column) == F.col("i"), "left").drop("i").withColumn(name, F.coalesce("_l", F.lit(0.0))).drop("_l")


def _weights(w: DataFrame) -> dict:
    """S0, S1, S2 in one pass over the edges and their mirror."""
    both = w.select("i", "j", "w", F.lit(0.0).alias("v")).union(w.select("j", "i", F.lit(0.0), "w"))
    pair = both.groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    s0, s1 = pair.agg(F.sum("w"), 0.5 * F.sum(F.pow(F.col("w") + F.col("v"), F.lit(2)))).first()
    s2 = pair.groupBy("i").agg(F.sum("w").alias("a"), F.sum("v").alias("b")).agg(F.sum(F.pow(F.col("a") + F.col("b"), F.lit(2)))).first()[0]
    return {"s0": s0 or 0.0, "s1": s1 or 0.0, "s2": s2 or 0.0}


def _paired(df: DataFrame, w: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int, float]:
    n, mean, m2 = df.agg(F.count("*"), F.avg(F.col(column).cast("double")), F.var_pop(F.col(column).cast("double"))).first()
    x = df.select(F.col(id_column).alias("id"), (F.col(column).cast("double") - mean).alias("z"))
    pairs = w.join(x.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(x.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    return pairs, n, m2 * n


def _z(row: DataFrame, value: str) -> DataFrame:
    z = F.try_divide(F.col(value) - F.col("expected"), F.sqrt("variance"))
    return row.withColumn("z", z).withColumn("p_value", over(lambda v: 2 * (1 - normal_cdf(abs(v))), "z"))


def morans_i(df: DataFrame, w: DataFrame, id_column: str, column: str) -> DataFrame:
    """i, expected, variance (normality), z, p_value."""
    pairs, n, ss = _paired(df, w, id_column, column)
    s = _weights(w)
    var = (n * n * s["s1"] - n * s["s2"] + 3 * s["s0"] ** 2) / ((n * n - 1) * s["s0"] ** 2) - 1 / (n - 1) ** 2
    one = pairs.agg((n / s["s0"] * F.sum(F.col("w") * F.col("zi") * F.col("zj")) / ss).alias("i"))
    return _z(one.withColumns({"expected": F.lit(-1 / (n - 1)), "variance": F.lit(float(var))}), "i")


def gearys_c(df: DataFrame, w: DataFrame, id_column: str, column: str) -> DataFrame:
    pairs, n, ss = _paired(df, w, id_column, column)
    s = _weights(w)
    var = ((2 * s["s1"] + s["s2"]) * (n - 1) - 4 * s["s0"] ** 2) / (2 * (n + 1) * s["s0"] ** 2)
    one = pairs.agg(((n - 1) / (2 * s["s0"]) * F.sum(F.col("w") * F.pow(F.col("zi") - F.col("zj"), F.lit(2))) / ss).alias("c"))
    return _z(one.withColumns({"expected": F.lit(1.0), "variance": F.lit(float(var))}), "c")


def local_morans_i(df: DataFrame, w: DataFrame, id_column: str, column: str, permutations: int = 0, seed: int = 0) -> DataFrame:
    """id, local_i, quadrant (HH, HL, LH, LL by value and lag against the mean), p_value (by conditional permutation)."""
    mean = df.agg(F.avg(F.col(column).cast("double"))).first()[0]
    lag = spatial_lag(df.select(id_column, column), w, id_column, column)
    x = F.col(column).cast("double")
    z = spatial_lag(df.select(id_column, (x - mean).alias("_z")), w, id_column, "_z", "_zl")
    quadrant = F.concat(F.when(x > mean, "H").otherwise("L"), F.when(F.col("lag") > mean, "H").otherwise("L"))
    out = lag.select(F.col(id_column).alias("id"), quadrant.alias("quadrant")).join(z.select(F.col(id_column).alias("id"), (F.col("_z") * F.col("_zl")).alias("local_i"), "_z"), "id")
    if not permutations:
        return out.drop("_z").withColumn("p_value", F.lit(None).cast("double"))
    n = df.count()
    ranked = df.select((x - mean).alias("v"), (F.row_number().over(Window.orderBy(id_column)) - 1).alias("r"))
    draws = w.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("r", F.pmod(F.xxhash64("i", "j", "perm", F.lit(seed)), F.lit(n)).cast("int"))
    sims = draws.join(ranked, "r").groupBy("i", "perm").agg(F.sum(F.col("w") * F.col("v")).alias("l")).withColumnRenamed("i", "id")
    far = out.join(sims, "id").groupBy("id").agg(((F.count_if(F.abs(F.col("l") * F.col("_z")) >= F.abs("local_i")) + 1) / (permutations + 1)).alias("p_value"))
    return out.join(far, "id", "left").drop("_z")


def significant_clusters(local: DataFrame, alpha: float = 0.05) -> DataFrame:
    return local.where(F.col("p_value") < alpha)


def _lagged(df: DataFrame, w: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    for c in columns:
        df = spatial_lag(df, w, id_column, c, f"w_{c}")
    return df


class SpatialLag:
    """y = rho W y + X b + e, by spatial two-stage least squares with W X and W^2 X as instruments."""

    def __init__(self, y: str, x: list[str], id_column: str):
        self.y, self.x, self.id = y, x, id_column

    def fit(self, df: DataFrame, w: DataFrame) -> SpatialLag:
        rows = _lagged(df.select(self.id, self.y, *self.x), w, self.id, [self.y, *self.x])
        rows = _lagged(rows, w, self.id, [f"w_{c}" for c in self.x])
        z = [*self.x, *[f"w_{c}" for c in self.x], *[f"w_w_{c}" for c in self.x]]
        self.iv = TwoStageLeastSquares(self.y, [f"w_{self.y}", *self.x], z).fit(rows)
        self.rho, self.coef = self.iv.coef[f"w_{self.y}"], self.iv.coef
        self.w, self.ids = w, df.select(self.id)
        return self

    def predict(self, df: DataFrame, w: DataFrame) -> DataFrame:
        return self.iv.predict(_lagged(df, w, self.id, [self.y]))

    def impacts(self, w: DataFrame | None = None, *, exact: int = 2000, draws: int = 16, orders: int = 40) -> dict[str, dict[str, float]]:
        """Average total, direct and indirect effects: b S for S = (I - rho W)^-1, its mean row sum and its mean diagonal.

        Up to ``exact`` regions S is computed. Beyond, its mean diagonal is the sum of rho^k tr(W^k) / n with traces taken from
        ``draws`` vectors of hashed signs, up to ``orders`` and only while rho^k matters; mean row sums come from W^k 1 alike.
        """
        w = self.w if w is None else w
        ids = self.ids.select(F.col(self.id).alias("i"))
        n = ids.count()
        if n <= exact:
            at = {r["i"]: k for k, r in enumerate(ids.orderBy("i").collect())}
            dense = np.zeros((n, n))
            for r in w.collect():
                dense[at[r["i"]], at[r["j"]]] += r["w"]
            inverse = np.linalg.inv(np.eye(n) - self.rho * dense)
            own, row = float(np.trace(inverse)) / n, float(inverse.sum()) / n
        else:
            signs = [F.lit(1.0).alias("u0"), *[(F.pmod(F.xxhash64("i", F.lit(k)), F.lit(2)) * 2.0 - 1).alias(f"u{k}") for k in range(1, draws + 1)]]
            start = ids.select("i", *signs)
            names, now, own, row = [f"u{k}" for k in range(draws + 1)], start, 1.0, 1.0
            for k in range(1, orders + 1):
                if abs(self.rho) ** k < 1e-7:
                    break
                moved = w.join(now.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
                now = cut_lineage(ids.join(moved, "i", "left").na.fill(0.0))
                first = start.select("i", *[F.col(c).alias(f"s_{c}") for c in names])
                got = now.join(first, "i").agg(F.avg("u0").alias("row"), *[F.avg(F.col(c) * F.col(f"s_{c}")).alias(c) for c in names[1:]]).first()
                row += self.rho**k * got["row"]
                own += self.rho**k * sum(got[c] for c in names[1:]) / draws
        return {c: {"direct": self.coef[c] * own, "indirect": self.coef[c] * (row - own), "total": self.coef[c] * row} for c in self.x}


def spatial_error(df: DataFrame, w: DataFrame, id_column: str, y: str, x: list[str], steps: int = 3) -> dict:
    """y = X b + u, u = lambda W u + e: lambda from residuals on their lag, then the filtered regression, repeated."""
    base = _lagged(df.select(id_column, y, *x), w, id_column, [y, *x])
    fit, lam = least_squares(base, x, y), 0.0
    for _ in range(steps):
        u = F.col(y).cast("double") - fit.expression()
        wu = F.col(f"w_{y}") - sum((F.col(f"w_{c}") * fit.coef[c] for c in x), F.lit(fit.coef["intercept"]))
        lam = base.agg(F.try_divide(F.sum(u * wu), F.sum(wu * wu))).first()[0] or 0.0
        filtered = base.select(*[(F.col(c).cast("double") - lam * F.col(f"w_{c}")).alias(c) for c in [y, *x]])
        fit = least_squares(filtered, x, y)
        fit.coef["intercept"] /= 1 - lam
    return {"coef": fit.coef, "lambda": lam, "rss": fit.rss}


def spatial_durbin(df: DataFrame, w: DataFrame, id_column: str, y: str, x: list[str]) -> SpatialLag:
    rows = _lagged(df.select(id_column, y, *x), w, id_column, x)
    return SpatialLag(y, [*x, *[f"w_{c}" for c in x]], id_column).fit(rows, w)


def gwr(df: DataFrame, id_column: str, features: str, y: str, x: str, bandwidth: float) -> DataFrame:
    """id, intercept, slope: one weighted regression per location over its neighbours within the bandwidth."""
    from ..functions.scalar import euclidean

    pts = df.select(F.col(id_column).alias("j"), F.col(features).cast("array<double>").alias("pj"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    at = df.select(F.col(id_column).alias("i"), F.col(features).cast("array<double>").alias("pi"))
    pairs = within(df, id_column, features, bandwidth).union(df.select(id_column, id_column))
    d = euclidean(F.col("pi"), F.col("pj")) / bandwidth
    rows = pairs.join(at, "i").join(pts, "j").withColumn("w", F.pow(1 - d * d, F.lit(2)))
    s = lambda e: F.sum(F.col("w") * e)
    one = rows.groupBy("i").agg(F.sum("w").alias("sw"), s(F.col("x")).alias("sx"), s(F.col("y")).alias("sy"), s(F.col("x") * F.col("x")).alias("sxx"), s(F.col("x") * F.col("y")).alias("sxy"))
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return one.select(F.col("i").alias("id"), slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"))


__all__ = ["weights_within", "weights_knn", "row_standardize", "spatial_lag", "morans_i", "gearys_c", "local_morans_i", "significant_clusters", "SpatialLag", "spatial_error", "spatial_durbin", "gwr"]
