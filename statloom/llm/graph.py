"""Connected components and group streams over Spark, without collecting links or components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_lookup, tidy, written


#: A graph of no more links than this is finished by one task of bounded size.
FEW_LINKS = 500_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of the components of few links: labels spread along sorted links until none changes."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["u", "p"])


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """node, label for every node of edges (a, b): label is one node of the component, the same for all of it.

    Every round each node hooks to its smallest neighbour and the graph is contracted; the edges left are written to
    the shared folder; once FEW_LINKS are left one task finishes them. Node numbers should be hashes: then a constant share of the nodes vanishes each round, however
    the graph is shaped. A node with very many links is looked up by broadcast, never gathered in one task.
    """
    spark = edges.sparkSession
    left = edges.where("a <> b").select("a", "b")
    hooks: list[DataFrame] = []
    while True:
        left = written(left.distinct(), spark, tag)
        n = left.count()
        if not n:
            break
        if n <= FEW_LINKS:
            hook = left.repartition(1).mapInArrow(tidy(_finish), "u long, p long")
            hooks.append(written(hook, spark, tag) if hooks else hook)
            break
        both = left.union(left.select("b", "a")).toDF("u", "v")
        hook = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"), F.count("*").alias("deg"))
        hook = written(hook, spark, tag)
        hooks.append(hook)
        one = skew_lookup(left.withColumnRenamed("a", "u"), hook, "u", ["p"], "deg", ["u", "b"]).select(F.col("p").alias("pa"), F.col("b").alias("u"))
        two = skew_lookup(one, hook, "u", ["p"], "deg", ["u", "pa"])
        left = two.select(F.col("pa").alias("a"), F.col("p").alias("b")).where("a <> b")
        left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = hooks[0].select(F.col("u").alias("node"), F.col("p").alias("u"))
    for hook in hooks[1:]:
        many = out.groupBy("u").agg(F.count("*").alias("_n"))
        known = hook.select("u", "p").join(many, "u")
        out = skew_lookup(out, known, "u", ["p"], "_n", ["node"]).select("node", F.coalesce("p", "u").alias("u"))
        out = written(out, spark, tag)
    return out.withColumnRenamed("u", "label")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream of batches that is sorted by integer keys, each whole, one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if change[0] and held:
            yield pa.Table.from_batches(held)
            held = []
            cuts = cuts[1:]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(i, j - i))
            if j < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
