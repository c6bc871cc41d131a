"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line, stripped of ASCII white space at both ends and with A-Z lower-cased. The first document
(by id) that holds a key of ``min_chars`` code points or more owns it; all other documents lose their lines with it.

``LineRuns`` keeps the owned hashes as runs: tables bucketed and sorted by hash in the shared folder. A new batch is
reduced to one row per hash, merge-anti-joined with every run (the runs are already dealt and sorted, so only the
batch is shuffled) and what is left becomes a run of level 0. Once a level has ``fanout`` runs they are merged into
one run of the next level. Batches must come in the order of their ids.

Because each hash has one owner, the owners' hash lists go back to the documents by document id, and a line that
half of all documents hold is only one row there: no join meets a hot line.

Defined results: a null or empty text is one empty line; rows with a null id keep all their lines and own none;
rows that repeat an id count as one document and are cut alike; a very long text is cut whole, by one task; ids of any type that has an order will do; other columns are passed through untouched.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import chunks, replaced, tidy, work_dir

_SECOND = 0xA0761D6478BD642F


def line_keys(data: np.ndarray, offs: np.ndarray, min_chars: int):
    """Starts, ends and text number of all lines, whether each key is long enough, and two hashes of each key."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offs[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, offs[1:])), kind="stable")
    count = 1 + np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1])
    of = np.repeat(np.arange(len(offs) - 1), count)
    low = K.lowered(data)
    ws, we, _ = K.words(low, offs, K.SPACE)
    a, b = np.searchsorted(ws, starts), np.searchsorted(we, ends, "right")
    some = b > a
    ks, ke = starts.copy(), starts.copy()
    ks[some], ke[some] = ws[a[some]], we[b[some] - 1]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[ke] - points[ks] >= min_chars
    h1, h2 = np.zeros(len(ks), np.uint64), np.zeros(len(ks), np.uint64)
    h1[long] = K.spans(low, ks[long], ke[long])
    h2[long] = K.spans(low, ks[long], ke[long], _SECOND)
    return starts, ends, of, long, h1.view(np.int64), h2.view(np.int64)


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """doc_id, h1, h2: each long line's key once per text."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                _, _, of, long, h1, h2 = line_keys(data, offs, min_chars)
                rows = np.unique(np.rec.fromarrays([of[long], h1[long], h2[long]], names="d,a,b"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows["d"])), pa.array(rows["a"]), pa.array(rows["b"])], names=["doc_id", "h1", "h2"])

    pairs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return pairs.mapInArrow(tidy(run), f"doc_id {kind}, h1 long, h2 long")


class LineRuns:
    """Levelled runs of owned line hashes (h1, h2, owner)."""

    def __init__(self, spark: SparkSession, *, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.dir = work_dir(spark, "lineruns")
        self.levels: list[list[str]] = []

    def _store(self, df: DataFrame, level: int) -> None:
        name = f"lineruns_{uuid.uuid4().hex[:12]}"
        df = df.repartition(self.buckets, "h1")
        df.write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", f"{self.dir}/{name}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, hashes: DataFrame) -> None:
        """hashes: doc_id, h1, h2 of one batch, whose ids lie above those of all earlier batches."""
        new = hashes.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            new = new.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._store(new, 0)
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for n in names[1:]:
                    merged = merged.unionByName(self.spark.table(n))
                self._store(merged, level + 1)
                for n in names:
                    self.spark.sql(f"DROP TABLE IF EXISTS {n}")
                self.levels[level] = []

    def close(self) -> None:
        """Drop the runs' catalog entries; their files stay until the work folder goes."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def owned(self) -> DataFrame:
        """owner, keys: the hashes each document owns; as many as its own lines at most."""
        out = None
        for level in self.levels:
            for name in level:
                run = self.spark.read.schema(self.spark.table(name).schema).parquet(f"{self.dir}/{name}")
                out = run if out is None else out.unionByName(run)
        return out.groupBy("owner").agg(F.collect_list("h1").alias("_h1"), F.collect_list("h2").alias("_h2"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with ``text`` cut to its kept lines, plus n_lines (before) and n_dropped.

    ``batches``: the ids are dealt into so many ranges, which arrive one after the other.
    """
    spark = docs.sparkSession
    lo, hi = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    runs = LineRuns(spark, fanout=fanout)
    if lo is None:
        edges = [(None, None)]
    elif isinstance(lo, int):
        step = max(1, -(-(hi - lo + 1) // batches))
        edges = [(x, x + step) for x in range(lo, hi + 1, step)]
    else:
        # ids without arithmetic: ranges between approximate quantiles of their order
        cuts = _quantiles(docs, doc_id, batches)
        edges = list(zip([None, *cuts], [*cuts, None], strict=True))
    for a, b in edges:
        batch = docs if a is None else docs.where(F.col(doc_id) >= F.lit(a))
        batch = batch if b is None else batch.where(F.col(doc_id) < F.lit(b))
        runs.add(line_hashes(batch, doc_id, text, min_chars))
    owned = runs.owned().withColumn("_zero", F.lit(0).cast("long"))
    runs.close()
    # all columns travel as one struct, so that no name of theirs can clash
    rows = docs.withColumns({text: F.col(text).cast("string")})
    # rows without an id own nothing and are spread
    spread = F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id()).otherwise(0)
    packed = rows.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), spread.alias("_salt"))
    joined = packed.join(owned, (F.col("id") == F.col("owner")) & (F.col("_salt") == F.col("_zero")), "left").drop("owner", "_salt", "_zero")
    schema = f"row {dict(packed.dtypes)['row']}, n_lines long, n_dropped long"
    out = joined.mapInArrow(tidy(_cut(text, min_chars, rows.columns)), schema)
    return out.select(*[F.col("row")[c].alias(c) for c in rows.columns], "n_lines", "n_dropped")


def _quantiles(docs: DataFrame, doc_id: str, n: int) -> list:
    """At most n - 1 ids that part the ids into ranges: those at even places of a fixed share of id hashes; any cuts give the same result."""
    some = docs.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(1000)
    ids = [r[0] for r in some.orderBy(doc_id).collect()]
    return sorted({ids[len(ids) * k // n] for k in range(1, n)}) if ids else []


def _cut(text: str, min_chars: int, columns: list[str]):
    at = columns.index(text)

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            flat = pa.RecordBatch.from_arrays([row.field(at), batch.column("id"), batch.column("_h1"), batch.column("_h2"), row], names=["text", "id", "_h1", "_h2", "row"])
            for part, data, offs in chunks(flat, "text"):
                starts, ends, of, long, h1, h2 = line_keys(data, offs, min_chars)
                first = np.searchsorted(of, np.arange(part.num_rows + 1))
                own1, own2, ids = part.column("_h1"), part.column("_h2"), part.column("id")
                out, total, dropped = [], [], []
                for d in range(part.num_rows):
                    i, j = first[d], first[d + 1]
                    keep = np.ones(j - i, bool)
                    if ids[d].is_valid and long[i:j].any():
                        mine = set(zip(own1[d].values.to_numpy().tolist(), own2[d].values.to_numpy().tolist(), strict=True)) if own1[d].is_valid else set()
                        keep = np.fromiter((not g or (x, y) in mine for g, x, y in zip(long[i:j].tolist(), h1[i:j].tolist(), h2[i:j].tolist(), strict=True)), bool, j - i)
                    total.append(int(j - i))
                    dropped.append(int(j - i - keep.sum()))
                    if dropped[-1]:
                        out.append(b"\n".join(data[s:e].tobytes() for s, e in zip(starts[i:j][keep].tolist(), ends[i:j][keep].tolist(), strict=True)).decode())
                    else:
                        out.append(data[offs[d] : offs[d + 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([replaced(part.column("row"), at, pa.array(out, pa.string())), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "n_lines", "n_dropped"])

    return run
