"""Scalers, encoders, imputation. Fitting is one aggregate whose result is as wide as the table is; applying is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyData, InvalidParameter, NotFitted
from ..frames import check, clean


class _Fitted:
    params: dict | None = None

    def _need(self) -> dict:
        if self.params is None:
            raise NotFitted(type(self).__name__)
        return self.params

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _replace(self, df: DataFrame, body) -> DataFrame:
        return df.withColumns({c: body(F.col(c).cast("double"), *p) for c, p in self._need().items()})


class StandardScaler(_Fitted):
    """Population standard deviation; constants are only centred."""

    def __init__(self, columns: list[str], with_mean: bool = True, with_std: bool = True):
        self.columns, self.with_mean, self.with_std = columns, with_mean, with_std

    def fit(self, df: DataFrame) -> StandardScaler:
        check(df, self.columns)
        row = df.agg(F.count("*"), *[f(clean(c)) for c in self.columns for f in (F.avg, F.stddev_pop)]).first()
        if not row[0]:
            raise EmptyData("no rows")
        self.params = {}
        for i, c in enumerate(self.columns):
            m, s = row[1 + 2 * i], row[2 + 2 * i]
            self.params[c] = (m or 0.0 if self.with_mean else 0.0, s if self.with_std and s and s >= 1e-10 else 1.0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._replace(df, lambda x, m, s: (x - m) / s)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._replace(df, lambda x, m, s: x * s + m)


class MinMaxScaler(_Fitted):
    """Constants become the lower bound."""

    def __init__(self, columns: list[str], low: float = 0.0, high: float = 1.0):
        if low >= high:
            raise InvalidParameter("range", "low must be below high")
        self.columns, self.low, self.high = columns, low, high

    def fit(self, df: DataFrame) -> MinMaxScaler:
        check(df, self.columns)
        row = df.agg(*[f(clean(c)) for c in self.columns for f in (F.min, F.max)]).first()
        if row[0] is None:
            raise EmptyData("no rows")
        self.params = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(x: Column, lo: float, hi: float) -> Column:
            return F.lit(self.low) if hi - lo <= 1e-10 else (x - lo) / (hi - lo) * (self.high - self.low) + self.low

        return self._replace(df, scaled)


class Normalizer:
    """Row-wise; rows of norm 1e-10 or less stay."""

    def __init__(self, columns: list[str], norm: str = "l2"):
        if norm not in ("l1", "l2", "max"):
            raise InvalidParameter("norm", norm)
        self.columns, self.norm = columns, norm

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [F.col(c).cast("double") for c in self.columns]
        if self.norm == "max":
            norm = F.greatest(*[F.abs(c) for c in cols]) if len(cols) > 1 else F.abs(cols[0])
        else:
            norm = sum((F.abs(c) if self.norm == "l1" else c * c for c in cols), F.lit(0.0))
            norm = F.sqrt(norm) if self.norm == "l2" else norm
        return df.withColumns({c: F.when(norm > 1e-10, x / norm).otherwise(x) for c, x in zip(self.columns, cols, strict=True)})


class OneHotEncoder(_Fitted):
    """Sorted categories per column; unknown values become zeros. The number of categories must be small enough for columns."""

    MOST = 10_000

    def __init__(self, columns: list[str]):
        self.columns = columns

    def fit(self, df: DataFrame) -> OneHotEncoder:
        check(df, self.columns, numeric=False)
        self.params = {}
        for c in self.columns:
            rows = df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(self.MOST + 1).collect()
            if len(rows) > self.MOST:
                raise InvalidParameter(c, f"more than {self.MOST} categories")
            self.params[c] = [r[0] for r in rows]
        return self

    @property
    def n_features_out(self) -> int:
        return sum(map(len, self._need().values()))

    def categories(self) -> dict[str, list]:
        return dict(self._need())

    def transform(self, df: DataFrame) -> DataFrame:
        out = {f"{c}_{k}": F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0) for c, vs in self._need().items() for k, v in enumerate(vs)}
        return df.withColumns(out)


class SimpleImputer(_Fitted):
    """NULL and NaN are missing; a column without any value is filled with 0."""

    def __init__(self, columns: list[str], strategy: str = "mean", fill: float = 0.0):
        if strategy not in ("mean", "median", "mode", "constant"):
            raise InvalidParameter("strategy", strategy)
        self.columns, self.strategy, self.fill = columns, strategy, fill

    def fit(self, df: DataFrame) -> SimpleImputer:
        check(df, self.columns)
        if self.strategy == "constant":
            self.params = {c: (self.fill,) for c in self.columns}
            return self
        of = {"mean": F.avg, "median": lambda x: F.percentile(x, F.lit(0.5)), "mode": lambda x: F.mode(x, deterministic=True)}[self.strategy]
        row = df.agg(*[of(clean(c)) for c in self.columns]).first()
        self.params = {c: (0.0 if row[i] is None else float(row[i]),) for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(clean(c), F.lit(v)) for c, (v,) in self._need().items()})


class Pipeline(_Fitted):
    """Transformers and at most one model at the end, fitted one after the other; every step is a projection of the next."""

    def __init__(self, steps: list[tuple[str, object]]):
        names = [n for n, _ in steps]
        if len(set(names)) != len(names):
            raise InvalidParameter("steps", "names must differ")
        self.steps = steps

    def fit(self, df: DataFrame) -> Pipeline:
        for k, (_, step) in enumerate(self.steps):
            if hasattr(step, "fit"):
                step.fit(df)
            if k + 1 < len(self.steps) or hasattr(step, "transform"):
                df = step.transform(df)
        self.params = {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._need()
        for _, step in self.steps:
            if hasattr(step, "transform"):
                df = step.transform(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        return self.steps[-1][1].predict(self.transform(df))
