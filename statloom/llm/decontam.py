"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into ASCII-lower-cased words. Of every window of ``span`` words the
smallest hash of its k-grams is the window's fingerprint, so any shared run of ``span`` words or more is
certain to share a fingerprint. Document windows whose fingerprint also occurs in the benchmark are extended to
the full window and compared; runs of matching windows merge into spans. Items of fewer than ``span`` words are
one window of their own length.

Documents and benchmark are joined on their fingerprints in one of two ways. The benchmark's size is measured first: up to
``block_bytes`` of text its fingerprints and windows are broadcast as one sorted index, and documents are not shuffled. A larger
benchmark stays a table: documents give one row per distinct fingerprint, those that the benchmark holds too are found by a shuffle
(skewed ones by broadcast of their counts), the windows of these fingerprints are extended and joined with the benchmark's windows alike,
and each document gets its matching windows back by its row. Texts are written once and read twice, however large the benchmark is.

Defined results: a null or wordless text has no words and no hit; null ids are carried through; repeated rows are
judged each for itself; null or wordless items match nothing; an item without an id hits, but no id is listed for it; a very long text is scanned whole; an empty benchmark leaves every document clean;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import chunks, skew_lookup, tidy, written

#: Text bytes of a benchmark that is broadcast; what the executors hold is a small multiple of it.
BLOCK_BYTES = 16 << 20

_U = np.uint64

SCHEMA = "doc_id {kind}, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"


class Index:
    """Window hashes of a benchmark, by window length, with the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], span: int, k: int):
        self.span, self.k, self.names = span, k, [i for i, _ in items]
        texts = [(t or "").encode() for _, t in items]
        data = K.lowered(np.frombuffer(b"".join(texts), np.uint8))
        offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts, ends, first = K.words(data, offs, K.NOT_ALNUM)
        hashes = K.spans(data, starts, ends)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = []
        for i in range(len(items)):
            own = hashes[first[i] : first[i + 1]]
            m = min(len(own), span)
            if m:
                windows = K.grams(own, m)
                found.setdefault(m, []).append((windows, np.full(len(windows), i)))
            if m == span:
                prints.append(K.sliding_min(K.grams(own, k), span - k + 1))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows = {}
        for m, parts in found.items():
            hs, who = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((who, hs))
            self.windows[m] = (hs[order], who[order])

    def matches(self, hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window length, start of each matching window, first and last entry of its items); ends: of the text of each word."""
        for m, (hs, _) in self.windows.items():
            n = len(hashes) - m + 1
            if n <= 0:
                continue
            at = np.arange(n)
            if m == self.span:
                least = K.sliding_min(K.grams(hashes, self.k), self.span - self.k + 1)
                at = at[_among(least, self.prints)]
            at = at[at + m <= ends[at]]
            if m < self.span:
                values = K.grams(hashes, m)[at]
            else:
                values = _at(hashes, at, m)
            lo, hi = np.searchsorted(hs, values, "left"), np.searchsorted(hs, values, "right")
            hit = hi > lo
            yield m, at[hit], lo[hit], hi[hit]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _at(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """K.grams(hashes, m) at some positions only, in pieces of bounded size."""
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(at), 1 << 14):
        rows = hashes[at[i : i + (1 << 14), None] + np.arange(m)[None, :]].ravel()
        out.append(K.grams(rows, m)[::m])
    return np.concatenate(out)


def _key(values: np.ndarray, m: int) -> np.ndarray:
    """One number for a hash of windows of m words."""
    return K.mix(values + _U(m) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _of_length(hashes: np.ndarray, ends: np.ndarray, m: int, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of m words within their texts, and the key of each one's fingerprint; a short window is its own."""
    n = len(hashes) - m + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(n) + m <= ends[:n])
    prints = K.sliding_min(K.grams(hashes, k), span - k + 1) if m == span else K.grams(hashes, m)
    return at, _key(prints[at], m)


def _hashed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, where each text's begin, and the end of the text of each word."""
    data = K.lowered(data)
    starts, ends, first = K.words(data, offs, K.NOT_ALNUM)
    return K.spans(data, starts, ends), first, np.repeat(first[1:], np.diff(first))


def _item_windows(span: int, k: int):
    """m, p (fingerprint), w (whole window), i of every window of the items."""

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "t"):
                hashes, first, ends = _hashed(data, offs)
                n = np.diff(first)
                for m in sorted(set(np.minimum(n[n > 0], span).tolist())):
                    at, p = _of_length(hashes, ends, m, span, k)
                    of = np.searchsorted(first, at, "right") - 1
                    own = np.minimum(n[of], span) == m
                    at, p, of = at[own], p[own], of[own]
                    w = _key(K.grams(hashes, m)[at], m + 1000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m), pa.int32()), pa.array(p), pa.array(w), part.column("i").take(pa.array(of))], names=["m", "p", "w", "i"])

    return run


def _text_prints(lengths: list[int], span: int, k: int):
    """row, p: the distinct fingerprints of every text."""

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                hashes, first, ends = _hashed(data, offs)
                for m in lengths:
                    at, p = _of_length(hashes, ends, m, span, k)
                    of = np.searchsorted(first, at, "right") - 1
                    rows = np.unique(np.rec.fromarrays([of, p], names="d,p"))
                    yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(rows["d"])), pa.array(rows["p"])], names=["row", "p"])

    return run


def _extended(lengths: list[int], span: int, k: int):
    """row, m, s, w: the windows of each text whose fingerprint is among its ``ps``."""

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                hashes, first, ends = _hashed(data, offs)
                lists = part.column("ps")
                known = np.unique(np.rec.fromarrays([np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()], names="d,p"))
                for m in lengths:
                    at, p = _of_length(hashes, ends, m, span, k)
                    of = np.searchsorted(first, at, "right") - 1
                    some = np.flatnonzero(np.isin(p, known["p"]))
                    mine = np.rec.fromarrays([of[some], p[some]], names="d,p")
                    some = some[known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine] if len(known) else some[:0]
                    at, of = at[some], of[some]
                    w = _key(_at(hashes, at, m), m + 1000)
                    for i in range(0, len(at), 100_000):
                        a = slice(i, i + 100_000)
                        yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(of[a])), pa.array(np.full(len(at[a]), m), pa.int32()), pa.array(at[a] - first[of[a]]), pa.array(w[a])], names=["row", "m", "s", "w"])

    return run


def _settled(batches):
    """From texts with their matching windows and items: the result."""
    for batch in batches:
        for part, data, offs in chunks(batch, "text"):
            _, first, _ = _hashed(data, offs)
            cover = np.zeros(int(first[-1]) + 1, np.int64)
            for d, wins in enumerate(part.column("wins").to_pylist()):
                for x in wins or ():
                    cover[first[d] + x["s"]] += 1
                    cover[first[d] + x["s"] + x["m"]] -= 1
            yield _result(part, first, cover, [set(x or ()) for x in part.column("names").to_pylist()])


def _joined(texts: DataFrame, items: DataFrame, span: int, k: int, schema: str) -> DataFrame:
    """find_hits by shuffled joins. texts: doc_id, text, kept; items: i, t."""
    spark = texts.sparkSession
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), spark, "decontam-texts")
    windows = written(items.mapInArrow(tidy(_item_windows(span, k)), "m int, p long, w long, i string").distinct(), spark, "decontam-windows")
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())
    prints = texts.select("row", "text").mapInArrow(tidy(_text_prints(lengths, span, k)), "row long, p long")
    shared = prints.groupBy("p").agg(F.count("*").alias("n")).join(windows.select("p").distinct().hint("merge"), "p")
    shared = written(shared, spark, "decontam-prints")
    lists = skew_lookup(prints, shared, "p", ["n"], "n", ["row"]).where("n is not null").groupBy("row").agg(F.collect_set("p").alias("ps"))
    found = texts.select("row", "text").join(lists.hint("merge"), "row").mapInArrow(tidy(_extended(lengths, span, k)), "row long, m int, s long, w long")
    found = written(found, spark, "decontam-found")
    named = windows.groupBy("w").agg(F.collect_set("i").alias("names")).join(found.groupBy("w").agg(F.count("*").alias("n")).hint("merge"), "w")
    hits = skew_lookup(found, written(named, spark, "decontam-named"), "w", ["names"], "n", ["row", "s"]).where("names is not null")
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("s", "m")).alias("wins"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))
    return texts.join(hits.hint("merge"), "row", "left").drop("row").mapInArrow(tidy(_settled), schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of words, end excluded), items (ids of items that occur, sorted) per row of docs.

    keep: other columns of docs to carry along, as a struct ``kept``.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    schema = SCHEMA.format(kind=kind)
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("boolean")
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), carried.alias("kept"))
    schema = f"{schema}, kept {dict(out.dtypes)['kept']}"
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total <= block_bytes:
        index = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in items.distinct().collect()], span, k))
        out = out.mapInArrow(tidy(_scan(index)), schema)
    else:
        out = _joined(out, items, span, k, schema)
    return out if keep else out.drop("kept")


def _scan(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                hashes, first, limit = _hashed(data, offs)
                cover = np.zeros(len(hashes) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(part.num_rows)]
                for m, at, lo, hi in index.matches(hashes, limit):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + m, -1)
                    who = index.windows[m][1]
                    of = np.searchsorted(first, at, "right") - 1
                    for d, a, b in zip(of.tolist(), lo.tolist(), hi.tolist(), strict=True):
                        items[d].update(index.names[j] for j in who[a:b] if index.names[j] is not None)
                yield _result(part, first, cover, items)

    return run


def _result(part: pa.RecordBatch, first: np.ndarray, cover: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    """cover: how many windows begin less how many end at each word."""
    counts, docs = np.diff(first), part.num_rows
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    spans: list[list[dict]] = [[] for _ in range(docs)]
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        d = int(np.searchsorted(first, s, "right")) - 1
        while s < e:  # a run of hits may go on into the next text
            stop = min(e, int(first[d + 1]))
            if stop > s:
                spans[d].append({"start": s - int(first[d]), "end": stop - int(first[d])})
            s, d = stop, d + 1
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(counts, pa.int64()),
            pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            part.column("kept"),
        ],
        names=["doc_id", "n_words", "n_hit", "spans", "items", "kept"],
    )
