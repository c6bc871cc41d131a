"""Frames in and out of operators: loading, checking, unpivoting, missing values."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FeatureMismatch, InvalidParameter

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def check(df: DataFrame, columns: list[str], numeric: bool = True) -> None:
    """Fail early if a column is missing or is no number."""
    types = dict(df.dtypes)
    for c in columns:
        if c not in types:
            raise FeatureMismatch(f"no column {c!r}")
        if numeric and not types[c].startswith(NUMERIC):
            raise InvalidParameter(c, f"type {types[c]} is not numeric")


def clean(c: str | Column) -> Column:
    """The number, with NaN as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def unpivot(df: DataFrame, columns: list[str], keep: list[str], name: str = "feature", value: str = "x") -> DataFrame:
    """One row per row and column, as doubles."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep, columns, name, value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe(name: str) -> str:
    return name.replace(".", "_")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in spark.checkpoint.dir, the folder that all nodes share.

    Only where that is unset (local tests) a folder of this machine stands in.
    """
    if not spark.conf.get("spark.checkpoint.dir", None):
        import tempfile

        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="statloom-"))
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: it is evaluated once, and a lost executor does not change it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_path(df.sparkSession, "lineage"))
    return df.checkpoint()
