"""Substring deduplication by prefix-partitioned suffix trees.

A window is ``span`` consecutive words (runs of anything but ASCII white space, unchanged) of one text. A window
repeats if its word sequence also starts in a text with a smaller id; every word covered by a repeating window goes.

* Suffixes are partitioned by prefixes, taken where the text itself marks it: the mark of a window is the smallest hash of its
  ``k``-grams, and the first partition is by that ``k``-word prefix of the suffix that begins at the mark. Equal windows have equal marks at
  equal places, so the groups can be treated apart, and consecutive windows of one group travel as one context.
  Groups that only one text holds cannot repeat and end there.
* A group of more than ``LIMIT`` words gets longer prefixes. First equal contexts are pre-aggregated to their
  smallest id, which settles all others. Then windows are split by the distance between their start and the mark into ranges a
  quarter as wide: all windows of a range share span - width + 1 words around the mark, and these are their new prefix. This goes on, with prefixes
  of about k, span - 6, span - 1 and span words, until each group fits; where the prefix is all of the window it is a deep node itself, whose
  smallest id is found by aggregation.
* Groups are taken together until they fill a task's batch, and the batch's truncated suffix tree is grown level by level: the nodes
  at depths 1, 2, 4, ... of all suffixes are numbered, in the order of their words, from pairs of shallower nodes, and branches that hold one text
  are cut. What is left at depth ``span`` are the deep internal nodes, with their first owner. Windows of these nodes that follow each other
  make a maximal repeat: ``repeated_spans`` returns them per text.

Covered words are removed from the texts afterwards; all windows are judged on the input.

Defined results: null and wordless texts have no words; texts of fewer than ``span`` words lose nothing; equal
windows inside one id, also in rows that repeat the id, do not repeat; rows with a null id keep everything and
remove nothing elsewhere; rows that repeat id and text are cut alike; the smallest of several ids that hold a window keeps it; very long
texts are read whole, one a task at worst; kept words are joined by one space; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import chunks, replaced, skew_lookup, tidy, written
from .graph import sorted_groups

#: Words of the contexts of one prefix that make a subtree in one task's memory; larger groups get longer prefixes.
LIMIT = 100_000
#: Words that a task treats at once: this many, and one more group.
BATCH_WORDS = 400_000
#: By how much ranges narrow from prefix to prefix.
NARROW = 4
_SECOND = 0xA0761D6478BD642F
_U = np.uint64


def marks(data: np.ndarray, offs: np.ndarray, span: int, k: int):
    """Runs of consecutive windows with one mark: text, mark, first and last window (word numbers within the text)."""
    starts, ends, first = K.words(data, offs, K.SPACE)
    least = K.sliding_min(K.grams(K.spans(data, starts, ends), k), span - k + 1)
    of = np.repeat(np.arange(len(offs) - 1), np.diff(first))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + span <= first[1:][of]) if len(least) else np.zeros(0, np.int64)
    least, of = least[at], of[at]
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
    a = np.flatnonzero(new)
    b = np.concatenate((a[1:], [len(at)])) - 1 if len(a) else a
    return of[a], least[a].view(np.int64), at[a] - first[of[a]], at[b] - first[of[a]]


def _shared_marks(texts: DataFrame, span: int, k: int) -> DataFrame:
    """mark, contexts, total (their words): marks that texts of two ids or more hold."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                of, mark, a, b = marks(data, offs, span, k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), pa.array(mark), pa.array(b - a + span)], names=["doc_id", "mark", "n"])

    held = texts.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, mark long, n long")
    return held.groupBy("mark").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("contexts"), F.sum("n").alias("total")).where("lo <> hi").select("mark", "contexts", "total")


def _runs(texts: DataFrame, span: int, k: int) -> DataFrame:
    """doc_id, digest, mark, at of all runs; at: first and last window in one number."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                of, mark, a, b = marks(data, offs, span, k)
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("digest").take(at), pa.array(mark), pa.array(a << 32 | b)], names=["doc_id", "digest", "mark", "at"])

    return texts.mapInArrow(tidy(run), f"doc_id {kind}, digest long, mark long, at long")


def _contexts(span: int):
    """From texts with their shared runs: one row per run with the words its windows cover."""

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                starts, ends, first = K.words(data, offs, K.SPACE)
                lists = part.column("runs").to_pylist()
                rows, size = [], 0
                for d, runs in enumerate(lists):
                    doc, digest = part.column("doc_id")[d].as_py(), part.column("digest")[d].as_py()
                    f = int(first[d])
                    for r in runs:
                        a, b = r["at"] >> 32, r["at"] & 0xFFFFFFFF
                        words = data[starts[f + a] : ends[f + b + span - 1]].tobytes()
                        rows.append((r["mark"], r["many"], doc, digest, a, b - a + 1, words))
                        size += len(words)
                        if size > 1 << 21:
                            yield _rows(rows, part)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows, part)

    return run


def _rows(rows: list[tuple], part: pa.RecordBatch) -> pa.RecordBatch:
    types = [pa.int64(), pa.bool_(), part.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "many", "doc_id", "r1", "a", "n", "words"])


def _hashed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends of many contexts, and where each context's words begin."""
    blobs = [x.as_buffer() for x in column]
    data = np.frombuffer(b"".join(blobs), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(x) for x in blobs]))).astype(np.int64)
    return data, *K.words(data, offs, K.SPACE)


def _named(*parts: np.ndarray) -> np.ndarray:
    """Numbers of distinct tuples."""
    if len(parts) == 1:
        return np.unique(parts[0], return_inverse=True)[1]
    return np.unique(parts[0] * (int(parts[1].max(initial=0)) + 1) + parts[1], return_inverse=True)[1]


def _shared(node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a node's suffixes come from two texts or more."""
    if not len(node):
        return np.zeros(0, bool)
    lo = np.full(node.max() + 1, np.iinfo(np.int64).max)
    hi = np.full(node.max() + 1, -1)
    np.minimum.at(lo, node, doc)
    np.maximum.at(hi, node, doc)
    return (lo < hi)[node]


def deep_nodes(words: np.ndarray, ends: np.ndarray, doc: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``span`` words start in two texts or more, and the node at that depth of each.

    words: hashes of the words of all contexts; ends: of the context of each word; doc: its text.
    """
    n = len(words)
    at = np.arange(n)
    node = np.full(n, -1)
    node[at] = _named(words.view(np.int64))
    depth = 1
    while True:
        keep = _shared(node[at], doc[at])
        node[at[~keep]] = -1
        at = at[keep]
        if depth == span or not len(at):
            break
        step = min(depth, span - depth)
        at = at[at + depth + step <= ends[at]]
        other = node[at + step]
        live = (other >= 0) & (node[at] >= 0)
        at, other = at[live], other[live]
        new = _named(node[at], other)
        node = np.full(n, -1)
        node[at] = new
        depth += step
    return at, node[at]


def _subtrees(span: int):
    """Streams contexts sorted by key and yields the removed spans of every context, in the places of what it was taken from."""

    def solve(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables)
        data, starts, ends, first = _hashed(t.column("words"))
        hashes = K.spans(data, starts, ends)
        ids, doc = np.unique(np.array(t.column("doc_id").to_pylist()), return_inverse=True)
        of = np.repeat(np.arange(t.num_rows), np.diff(first))
        at, node = deep_nodes(hashes, first[1:][of], doc[of], span)
        if not len(at):
            return
        owner = np.full(node.max() + 1, len(ids))
        np.minimum.at(owner, node, doc[of[at]])
        gone = np.sort(at[doc[of[at]] > owner[node]])
        yield from _spans(gone, of[gone], first, t, span)

    def run(batches):
        held, size = [], 0
        for group in sorted_groups(batches, ["key"]):
            if group.num_rows > 1:
                held.append(group)
                size += int(np.sum(group.column("n").to_numpy())) + span * group.num_rows
            if size >= BATCH_WORDS:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    return run


def _spans(gone: np.ndarray, of: np.ndarray, first: np.ndarray, t: pa.Table, span: int) -> Iterator[pa.RecordBatch]:
    """Runs of removed windows as word spans of their texts."""
    if not len(gone):
        return
    new = np.ones(len(gone), bool)
    new[1:] = (gone[1:] != gone[:-1] + 1) | (of[1:] != of[:-1])
    a = np.flatnonzero(new)
    b = np.concatenate((a[1:], [len(gone)])) - 1
    row = of[a]
    base = t.column("a").to_numpy()[row] - first[row]
    at = pa.array(row)
    for batch in pa.table({"doc_id": t.column("doc_id").take(at), "r1": t.column("r1").take(at), "r2": t.column("r2").take(at), "s": pa.array(gone[a] + base, pa.int32()), "e": pa.array(gone[b] + base + span, pa.int32())}).combine_chunks().to_batches():
        yield batch


def _split(span: int, k: int, width: int):
    """From contexts: runs of windows that share the prefix of their range of distances to the mark; q tells full prefixes apart for sure."""

    def solve(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, starts, ends, first = _hashed(part.column("words"))
        hashes = K.spans(data, starts, ends)
        n, last = len(hashes), np.iinfo(np.uint64).max
        of = np.repeat(np.arange(part.num_rows), np.diff(first))
        stop = first[1:][of]
        grams = np.full(n, last)
        grams[: n - k + 1] = K.grams(hashes, k)
        grams[np.arange(n) + k > stop] = last
        marked = grams == np.minimum.reduceat(grams, first[:-1])[of]
        nearest = np.minimum.accumulate(np.where(marked, np.arange(n), n)[::-1])[::-1]
        w = np.flatnonzero(np.arange(n) + span <= stop)
        far = nearest[w] - w
        low = far // width * width
        high = np.minimum(low + width - 1, span - k)
        prefix = np.zeros(len(w), _U)
        for apart in np.unique(high - low).tolist():
            some = np.flatnonzero(high - low == apart)
            prefix[some] = K.grams(hashes, span - apart)[w[some] + far[some] - low[some]]
        key = K.mix(prefix + low.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
        q = K.grams(K.spans(data, starts, ends, _SECOND), span)[w].view(np.int64) if width == 1 else key
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1] + 1) | (of[w[1:]] != of[w[:-1]]) | (key[1:] != key[:-1]) | (q[1:] != q[:-1])
        a = np.flatnonzero(new)
        b = np.concatenate((a[1:], [len(w)])) - 1 if len(a) else a
        rows = pa.array(of[w[a]])
        at = part.column("a").to_numpy()[of[w[a]]] + w[a] - first[of[w[a]]]
        words = [b""] * len(a) if width == 1 else [data[i:j].tobytes() for i, j in zip(starts[w[a]].tolist(), ends[w[b] + span - 1].tolist(), strict=True)]
        carried = [part.column(c).take(rows) for c in ("doc_id", "r1", "r2")]
        for i in range(0, len(a), 20_000):
            some = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[a[some]]), pa.array(q[a[some]]), *[c[some] for c in carried], pa.array(at[some], pa.int32()), pa.array((b - a + 1)[some], pa.int32()), pa.array(words[some], pa.binary())],
                names=["key", "q", "doc_id", "r1", "r2", "a", "n", "words"],
            )

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield from solve(batch.slice(i, min(1000, batch.num_rows - i)))

    return run


def _trees(contexts: DataFrame, span: int, kind: str) -> DataFrame:
    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_subtrees(span)), f"doc_id {kind}, r1 long, r2 long, s int, e int")


def _large(contexts: DataFrame, span: int, k: int) -> DataFrame:
    """doc_id, r1, s, e: the removed spans of contexts whose groups exceed LIMIT."""
    spark, kind = contexts.sparkSession, dict(contexts.dtypes)["doc_id"]
    one, two = F.xxhash64("words"), F.xxhash64("words", F.lit(1))
    named = contexts.withColumns({"c1": one, "c2": two})
    distinct = named.groupBy("key", "c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("words").alias("words"))
    distinct = written(distinct, spark, "substring-distinct")
    owners = distinct.select("c1", F.struct("c2", "doc_id").alias("o"), "copies").groupBy("c1").agg(F.collect_set("o").alias("os"), F.sum("copies").alias("copies"))
    held = skew_lookup(named.select("doc_id", "r1", "a", "n", "c1", "c2"), owners, "c1", ["os"], "copies", ["doc_id", "a"])
    held = held.withColumn("owner", F.array_min(F.transform(F.filter("os", lambda o: o["c2"] == F.col("c2")), lambda o: o["doc_id"]))).drop("os")
    out = held.where("owner < doc_id").select("doc_id", "r1", F.col("a").alias("s"), (F.col("a") + F.col("n") + (span - 1)).alias("e"))

    state = distinct.select("doc_id", F.col("c1").alias("r1"), F.col("c2").alias("r2"), F.lit(0).alias("a"), "n", "words")
    schema = f"key long, q long, doc_id {kind}, r1 long, r2 long, a int, n int, words binary"
    found, width = None, span - k + 1
    while state is not None:
        width = -(-width // NARROW)
        rows = written(state.mapInArrow(tidy(_split(span, k, width)), schema), spark, "substring-split")
        if width == 1:
            owned = rows.groupBy("key", "q").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("runs")).where("lo <> hi")
            owned = owned.groupBy("key").agg(F.collect_list(F.struct("q", "lo")).alias("os"), F.sum("runs").alias("runs"))
            some = skew_lookup(rows.drop("words"), owned, "key", ["os"], "runs", ["doc_id", "r1", "a"])
            some = some.where(F.exists("os", lambda o: (o["q"] == F.col("q")) & (o["lo"] < F.col("doc_id"))))
            some = some.select("doc_id", "r1", "r2", F.col("a").alias("s"), (F.col("a") + F.col("n") + (span - 1)).alias("e"))
            state = None
        else:
            sizes = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("runs"), F.sum(F.col("n") + (span - 1)).alias("total")).where("lo <> hi")
            sizes = written(sizes.select("key", "runs", "total"), spark, "substring-sizes")
            sized = skew_lookup(rows, sizes, "key", ["total"], "runs", ["doc_id", "r1", "a"])
            some = _trees(sized.where(F.col("total") <= LIMIT).drop("q", "total"), span, kind)
            state = sized.where(F.col("total") > LIMIT).drop("key", "q", "total") if sizes.where(F.col("total") > LIMIT).limit(1).count() else None
        found = some if found is None else found.unionByName(some)
    found = found.groupBy(F.col("r1").alias("f1"), F.col("r2").alias("f2")).agg(F.collect_list(F.struct("s", "e")).alias("cut"))
    first = held.where("owner = doc_id").join(found.hint("merge"), (F.col("c1") == F.col("f1")) & (F.col("c2") == F.col("f2")))
    first = first.select("doc_id", "r1", "a", F.explode("cut").alias("x")).select("doc_id", "r1", (F.col("a") + F.col("x.s")).alias("s"), (F.col("a") + F.col("x.e")).alias("e"))
    return out.unionByName(first)


def repeated_spans(texts: DataFrame, span: int, k: int) -> DataFrame:
    """doc_id, digest, cut (array of word spans s, e) of texts that hold repeating windows. texts: doc_id, text, digest."""
    spark = texts.sparkSession
    kind = dict(texts.dtypes)["doc_id"]
    shared = written(_shared_marks(texts, span, k), spark, "substring-marks")
    runs = skew_lookup(_runs(texts, span, k), shared, "mark", ["total"], "contexts", ["doc_id", "at"]).where("total is not null")
    # rows that repeat id and text name the same runs
    lists = runs.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("mark", (F.col("total") > LIMIT).alias("many"), "at")).alias("runs"))
    contexts = texts.join(lists.hint("merge"), ["doc_id", "digest"]).mapInArrow(tidy(_contexts(span)), f"key long, many boolean, doc_id {kind}, r1 long, a int, n int, words binary")
    contexts = written(contexts, spark, "substring-contexts")
    found = _trees(contexts.where("not many").drop("many").withColumn("r2", F.lit(0).cast("long")), span, kind).drop("r2")
    if shared.where(F.col("total") > LIMIT).limit(1).count():
        found = found.unionByName(_large(contexts.where("many").drop("many"), span, k))
    return found.groupBy("doc_id", F.col("r1").alias("digest")).agg(F.collect_set(F.struct("s", "e")).alias("cut"))


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 50, k: int = 24) -> DataFrame:
    """docs with ``text`` as its kept words, plus n_words (before) and n_removed."""
    rows = docs.withColumns({text: F.col(text).cast("string")})
    texts = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    cuts = repeated_spans(texts.where("doc_id is not null"), span, k)
    # all columns travel as one struct, so that no name of theirs can clash
    # rows without an id find nothing and are spread
    digest = F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(text))
    packed = rows.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), digest.alias("digest"))
    joined = packed.join(cuts.hint("merge"), ["doc_id", "digest"], "left").select("row", "cut")
    schema = f"row {dict(packed.dtypes)['row']}, n_words long, n_removed long"
    out = joined.mapInArrow(tidy(_remove(text, rows.columns)), schema)
    return out.select(*[F.col("row")[c].alias(c) for c in rows.columns], "n_words", "n_removed")


def _remove(text: str, columns: list[str]):
    place = columns.index(text)

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            flat = pa.RecordBatch.from_arrays([row.field(place), batch.column("cut"), row], names=["text", "cut", "row"])
            for part, data, offs in chunks(flat, "text"):
                out, total, gone = [], [], []
                for d, cut in enumerate(part.column("cut").to_pylist()):
                    words = data[offs[d] : offs[d + 1]].tobytes().split()
                    total.append(len(words))
                    if cut:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, [c["s"] for c in cut], 1)
                        np.add.at(edge, [c["e"] for c in cut], -1)
                        words = list(compress(words, np.cumsum(edge[:-1]) == 0))
                    gone.append(total[-1] - len(words))
                    out.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([replaced(part.column("row"), place, pa.array(out, pa.string())), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["row", "n_words", "n_removed"])

    return run
