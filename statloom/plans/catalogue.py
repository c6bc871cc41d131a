"""The query catalogue: every operator applied to the driver's tables, with DuckDB SQL where it can be stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; no negative zero."""
    return df.select(*[(F.round(c, own.get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def one_row(spark, values: dict) -> DataFrame:
    """A result that is a handful of numbers."""
    cols: list[Column] = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols)


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def _load() -> None:
    from . import catalogue_data, catalogue_models, catalogue_more, catalogue_series, catalogue_stats  # noqa: F401
