"""Streams of events: windows in event time with watermarks, and running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files; ``ts`` becomes a TIMESTAMP, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str, keys: list[str], late: str | None = None) -> DataFrame:
    """window_start, keys, n, total per window."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, length: str, slide: str, keys: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", length, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """session_start, session_end (last event plus the gap), keys, n, total."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n", "total")


def run_available(stream: DataFrame, spark: SparkSession, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Everything there is now, into a table in memory (for results that are small)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def reservoir(events: DataFrame, k: int, key: str) -> DataFrame:
    """A stream of the current sample of k values per key: algorithm R on hashed positions, state (n, values)."""

    def update(name, batches: Iterator[pd.DataFrame], state):
        import random

        n, kept = state.get if state.exists else (0, [])
        kept = list(kept)
        for pdf in batches:
            for v in pdf.sort_values("event_id")["value"]:
                n += 1
                if len(kept) < k:
                    kept.append(float(v))
                else:
                    j = random.Random(f"{name[0]}:{n}").randrange(n)
                    if j < k:
                        kept[j] = float(v)
        state.update((n, kept))
        yield pd.DataFrame({"key": [name[0]], "n": [n], "sample": [kept]})

    return events.select(key, "event_id", "value").groupBy(key).applyInPandasWithState(update, "key string, n long, sample array<double>", "n long, kept array<double>", "update", "NoTimeout")


def running_moments(events: DataFrame, key: str) -> DataFrame:
    """A stream of count, mean and variance per key, from mergeable sums."""
    return events.groupBy(key).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
