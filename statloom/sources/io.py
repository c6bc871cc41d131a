"""Tables in Spark's formats, and fitted objects, both through Spark's file systems."""

from __future__ import annotations

import base64
import pickle

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidParameter, IoError, SerializationError

FORMATS = ("parquet", "csv", "json", "orc", "text", "avro")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    if kind not in FORMATS:
        raise InvalidParameter("kind", kind)
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, bucket: tuple[int, str] | None = None, table: str | None = None, **options) -> None:
    """bucket = (number, column) and table: a bucketed table, for joins without a shuffle."""
    if kind not in FORMATS:
        raise InvalidParameter("kind", kind)
    w = df.write.format(kind).mode(mode).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket and table:
        w.bucketBy(bucket[0], bucket[1]).sortBy(bucket[1]).option("path", path).saveAsTable(table)
    else:
        w.save(path)


def save_model(spark: SparkSession, model: object, path: str) -> None:
    """One row of text in a folder that any node can read; models hold parameters only, never rows."""
    try:
        text = base64.b64encode(pickle.dumps(model)).decode()
    except Exception as e:
        raise SerializationError(str(e)) from e
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> object:
    """Only for files of your own: unpickling runs code."""
    try:
        row = spark.read.option("wholetext", "true").text(path).first()
    except Exception as e:
        raise IoError(str(e)) from e
    if row is None:
        raise IoError(f"nothing at {path}")
    return pickle.loads(base64.b64decode(row[0]))
