"""Helpers shared by the pipeline operators: shared storage, skew-proof lookups, Arrow batch access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be looked up by broadcast: the most frequent ones, never more than this many.
HOT_KEYS = 1000
#: A key is a candidate for the hot list only with more rows than this.
HOT_ROWS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which the driver and all executors share.

    Only where that setting is absent (local tests) a temporary folder of this machine stands in.
    It is deleted through Spark's own file system when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="statloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean, spark)
    _made.append(path)
    return path


_made: list[str] = []


def _clean(spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM is gone at exit; the folder's owner clears it
        return


def written(df: DataFrame, spark: SparkSession, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there."""
    path = work_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def skew_lookup(rows: DataFrame, keyed: DataFrame, key: str, values: list[str], count: str, spread: list[str | Column]) -> DataFrame:
    """rows left-joined with ``keyed`` (one row per key), without sending a hot key's rows to one task.

    ``keyed[count]`` says how many rows hold the key. The at most HOT_KEYS most frequent keys are
    broadcast; their rows get the values there and are dealt by a hash of ``spread`` afterwards, and so are
    rows without a key. All other rows meet ``keyed`` by an ordinary shuffle on the key.
    """
    hot = keyed.where(F.col(count) > HOT_ROWS).orderBy(F.desc(count), key).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(F.col(key).alias("_hk"), F.lit(True).alias("_hot"), *[F.col(v).alias(f"_h_{v}") for v in values]))
    out = rows.join(hot, rows[key] == F.col("_hk"), "left").drop("_hk")
    kind = dict(rows.dtypes)[key]
    salt = F.xxhash64(*[F.col(s) if isinstance(s, str) else s for s in spread])
    salt = salt.cast(kind) if kind != "string" else F.concat(F.lit("~"), salt.cast("string"))
    out = out.withColumn("_jk", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(F.col(key)))
    cold = keyed.select(F.col(key).alias("_ck"), *[F.col(v).alias(f"_c_{v}") for v in values])
    out = out.join(cold, out["_jk"] == cold["_ck"], "left")
    found = [F.when(F.col("_hot"), F.col(f"_h_{v}")).when(F.col(key).isNotNull(), F.col(f"_c_{v}")).alias(v) for v in values]
    return out.select(*[F.col(c) for c in rows.columns], *found)


def tidy(run):
    """A function for mapInArrow that gives memory back at the end of each task: Python workers outlive tasks and stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                import ctypes

                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts come to about ``limit`` bytes, each with its UTF-8 bytes and offsets.

    A null text counts as empty. A text longer than the limit makes a slice of its own, whole.
    """
    col = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def replaced(row: pa.StructArray, at: int, column: pa.Array) -> pa.StructArray:
    """A struct array with one of its fields exchanged."""
    return pa.StructArray.from_arrays([column if k == at else row.field(k) for k in range(row.type.num_fields)], names=[f.name for f in row.type])


def text_of(data: np.ndarray, start: int, end: int) -> str:
    return data[start:end].tobytes().decode("utf-8", "replace")
