"""Exact n-gram Jaccard join by parity sketches.

A text's set is that of its distinct k-word shingles (64-bit hashes). Two sets with Jaccard similarity of
``num``/``den`` or more differ in at most D = (a + b) (den - num) / (den + num) shingles. Sets are dealt into size
bands; in a band every shingle flips one bit of a sketch that is cut into P parts, P greater than the band's D: each
differing shingle changes one part at most, so similar sets agree in at least P - D parts (pigeonhole). A
part is compared by the XOR of its shingles' hashes, and equal parts meet in one shuffle: keys are dealt into buckets and travel
as packs, one row for a bucket's keys out of many sets, so that the JVM neither holds nor sorts a row per key.

* Empty parts are the same in all sets and therefore no keys. A set's slack is the number of parts it must share
  with any partner, less its empty parts, less one; only a set whose slack is negative makes its empty parts keys.
* A pair must share at least slack + 1 - (hot parts of the first) keys to stay a candidate.
* A part shared by more than ``GROUP`` sets is hot. Instead of all pairs it gives one link per member to its first
  member, and only for sets that have so many hot parts that their cold ones could not find all partners.

Links join candidates into blocks (connected components). Each block's sets meet in one task, or, beyond
``BLOCK_SHINGLES`` shingles, its chunks meet pairwise in tasks of bounded size. There a search from set to set
compares parity sketches (their Hamming distance is a lower bound of the symmetric difference) and verifies by
exact set intersection; pairs already joined are not compared again, and the verified links that join are returned.

Equal sets are one class from the start: only classes are compared, and copies are never paired.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing; texts of fewer than k
words are one shingle; rows that repeat an id are judged each by its own text and share the class of equal ones;
rows with a null id take the component of their class, if any; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import chunks, skew_lookup, tidy, written
from .graph import components, sorted_groups

#: Sets that share a part and are paired there; larger groups are linked to one member.
GROUP = 32
#: Shingles that meet in one verifying task: twice this many at most, but for a single longer pair.
BLOCK_SHINGLES = 2_000_000
#: Keys of one bucket, on average at most; a bucket's keys are sorted by one task.
BUCKET = 200_000
#: Keys that a task packs at a time, and keys of a bucket that are held until its hot ones are settled.
PACK, MEET = 1 << 19, 4_000_000
#: Growth of the size bands.
BAND = 1.75
_U = np.uint64


class Bands:
    """Size bands with their number of parts; fixed by the threshold alone."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < largest:
            low.append(max(low[-1] + 1, int(low[-1] * BAND)))
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1
        self.apart = 2 * top * (den - num) // (den + num)
        self.parts = self.apart + 4 + self.apart // 10

    def of(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which sets, their band): the own band, and each higher one that holds a size similar enough."""
        own = np.searchsorted(self.low, size, "right") - 1
        which, band = np.flatnonzero(size > 0), own[size > 0]
        while len(which):
            yield which, band
            band = band + 1
            near = self.den * size[which] >= self.num * self.low[band]
            which, band = which[near], band[near]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingles one after the other, and where each text's begin."""
    data = K.lowered(data)
    starts, ends, first = K.words(data, offs, K.SPACE)
    hashes = K.spans(data, starts, ends)
    all_grams = K.grams(hashes, k)
    sets = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = j - i
        if n >= k:
            sets.append(np.unique(all_grams[i : j - k + 1]))
        elif n:
            sets.append(K.grams(hashes[i:j], n))
        else:
            sets.append(np.zeros(0, _U))
    begin = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, _U), begin


def class_ids(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 63-bit number of each set."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(sets[i:j]) >> 1 for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], np.int64)


def part_keys(sets: np.ndarray, begin: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all emitted parts, the set each belongs to, and each set's slack: parts it may lose to hot keys."""
    size = np.diff(begin)
    slack = np.full(len(size), np.iinfo(np.int32).max, np.int64)
    keys, owner = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for which, band in bands.of(size):
        p = bands.parts[band]
        n = size[which]
        at = np.repeat(begin[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = sets[at]
        part = ((h >> _U(32)) * np.repeat(p, n).astype(_U)) >> _U(32)
        of = np.repeat(np.arange(len(which)), n)
        new = np.ones(len(h), bool)
        new[1:] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
        cut = np.flatnonzero(new)
        value = np.bitwise_xor.reduceat(K.mix(h ^ _U(0x5851F42D4C957F2D)), cut) if len(cut) else np.zeros(0, _U)
        seed = (band[of[cut]].astype(_U) << _U(48)) + part[cut]
        keys.append(K.mix(value ^ K.mix(seed)))
        owner.append(which[of[cut]])
        empty = p - np.bincount(of[cut], minlength=len(which))
        partner = np.minimum(bands.low[band + 1] - 1, bands.den * n // bands.num)
        spare = p - (n + partner) * (bands.den - bands.num) // (bands.den + bands.num) - 1 - empty
        for i in np.flatnonzero(spare < 0).tolist():
            some = np.zeros(int(p[i]), bool)
            some[part[cut[of[cut] == i]].astype(np.int64)] = True
            gaps = np.flatnonzero(~some).astype(_U)
            keys.append(K.mix(K.mix((_U(band[i]) << _U(48)) + gaps)))
            owner.append(np.full(len(gaps), which[i]))
        slack[which] = np.minimum(slack[which], np.maximum(spare, 0))
    return np.concatenate(keys), np.concatenate(owner), slack


def classes(docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """doc_id, digest (of the text), n, cls (null for an empty set), slack of every row."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                sets, begin = shingle_sets(data, offs, k)
                size = np.diff(begin)
                _, _, slack = part_keys(sets, begin, bands)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(size), pa.array(class_ids(sets, begin), mask=size == 0), pa.array(slack)], names=["doc_id", "digest", "n", "cls", "slack"])

    return _texts(docs, doc_id, text).withColumn("digest", F.xxhash64("text")).mapInArrow(tidy(run), f"doc_id {kind}, digest long, n long, cls long, slack long")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def _bits(shingles: int, partitions: int) -> int:
    """Leading bits of a key that make its bucket: several buckets a partition, of about BUCKET keys (two a shingle)."""
    return max(2 * shingles // BUCKET, 4 * partitions, 2).bit_length()


def _packed(keys: np.ndarray, cls: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """bucket, pack: the keys of each bucket, each followed by its class, as 64-bit numbers."""
    for i in range(0, len(keys), 1 << 22):
        some, own = keys[i : i + (1 << 22)], cls[i : i + (1 << 22)]
        order = np.argsort(some >> (64 - bits), kind="stable")
        rows = np.empty((len(some), 2), np.int64)
        rows[:, 0], rows[:, 1] = some[order], own[order]
        bucket = rows[:, 0] >> (64 - bits)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
        ends = pa.py_buffer((np.append(cut, len(rows)) * 16).astype(np.int32))
        packs = pa.Array.from_buffers(pa.binary(), len(cut), [None, ends, pa.py_buffer(rows)])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), packs], names=["bucket", "pack"])


def _keys(docs: DataFrame, k: int, num: int, den: int, bits: int) -> DataFrame:
    """bucket, pack: keys with the classes of every set, once for equal sets that one task meets."""

    def run(batches):
        bands = Bands(num, den)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            for _, data, offs in chunks(batch, "text"):
                sets, begin = shingle_sets(data, offs, k)
                cls = class_ids(sets, begin)
                fresh = []
                for i, c in enumerate(cls.tolist()):
                    if begin[i + 1] > begin[i] and c not in seen:
                        seen.add(c)
                        fresh.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                if not fresh:
                    continue
                own = np.concatenate([sets[begin[i] : begin[i + 1]] for i in fresh])
                size = np.array([begin[i + 1] - begin[i] for i in fresh])
                keys, owner, _ = part_keys(own, np.concatenate(([0], np.cumsum(size))), bands)
                held.append((keys.view(np.int64), cls[fresh][owner]))
                rows += len(keys)
                if rows >= PACK:
                    yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)
                    held, rows = [], 0
        if rows:
            yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)

    return docs.where("doc_id is not null").mapInArrow(tidy(run), "bucket long, pack binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets with their rows of key and class; a bucket may come in several parts, one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, col = batch.column("bucket").to_numpy(), batch.column("pack").cast(pa.large_binary())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(bucket[i]), data[offs[i] : offs[j]].view(np.int64).reshape(-1, 2)


def _meet_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_meet`` gives for packs sorted by bucket.

    A bucket of more than MEET keys settles its hot keys early: their members are linked to the first one met so far,
    and so are all that follow. A member met twice is then counted twice, which only admits more candidates.
    """
    held: list[np.ndarray] = []
    hot: dict[int, int] = {}
    at, size, most = None, 0, MEET

    def in_order():
        rows = np.concatenate(held)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def whole():
        if size:
            rows = in_order()
            yield from _meet(iter([pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], names=["key", "cls"])]))

    def links(rows):
        for i in range(0, len(rows), 1 << 16):
            part = rows[i : i + (1 << 16)]
            first = np.array([hot[x] for x in part[:, 0].tolist()], np.int64)
            n = np.ones(len(part), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int8)), pa.array(part[:, 1].copy()), pa.array(first), pa.array(n)], names=["hot", "a", "b", "n"])

    for bucket, rows in _unpacked(batches):
        if bucket != at:
            yield from whole()
            held, hot, at, size, most = [], {}, bucket, 0, MEET
        if hot:
            known = np.isin(rows[:, 0], np.array(list(hot), np.int64))
            yield from links(rows[known])
            rows = rows[~known]
        # a copy: the batch's memory is given back
        held.append(rows.copy())
        size += len(rows)
        if size > most:
            rows = in_order()
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            rows = rows[new]
            keys, first, n = np.unique(rows[:, 0], return_index=True, return_counts=True)
            many = n > GROUP
            hot.update(zip(keys[many].tolist(), rows[first[many], 1].tolist(), strict=True))
            settled = np.repeat(many, n)
            yield from links(rows[settled])
            held = [rows[~settled]]
            size = len(held[0])
            most = max(MEET, 2 * size)
    yield from whole()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and class: pairs of small groups with their number of keys (hot 0); members of hot groups with the first (hot 1)."""
    tail = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    hot_key, hot_first, hot_last = None, 0, 0

    def out(hot, a, b):
        if not len(a):
            return
        if not hot:
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            cut = np.flatnonzero(new)
            n = np.diff(np.concatenate((cut, [len(a)])))
            a, b = a[cut], b[cut]
        else:
            n = np.ones(len(a), np.int64)
        for i in range(0, len(a), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[s]), hot, np.int8)), pa.array(a[s]), pa.array(b[s]), pa.array(n[s])], names=["hot", "a", "b", "n"])

    def judge(key, cls, end):
        """Emit whole groups; give back the rows of the last one unless this is the end."""
        nonlocal hot_key, hot_first, hot_last
        if not len(key):
            return key, cls, [], []
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (cls[1:] == cls[:-1])
        key, cls = key[~same], cls[~same]
        hots = []
        if hot_key is not None:
            n = int(np.searchsorted(key, hot_key, "right"))
            if n:
                rest = cls[:n][cls[:n] != hot_last]
                hots.append((rest, np.full(len(rest), hot_first)))
                hot_last = cls[n - 1]
            key, cls = key[n:], cls[n:]
            if len(key):
                hot_key = None
        if not len(key):
            return key, cls, [], hots
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        cut = np.flatnonzero(new)
        size = np.diff(np.concatenate((cut, [len(key)])))
        keep = None
        if not end:
            if size[-1] > GROUP:
                hot_key, hot_first, hot_last = key[-1], cls[cut[-1]], cls[-1]
            else:
                keep = cut[-1]
                cut, size = cut[:-1], size[:-1]
        pairs = []
        for g in np.unique(size[size > 1]).tolist():
            at = cut[size == g]
            if g <= GROUP:
                m = cls[at[:, None] + np.arange(g)]
                i, j = np.triu_indices(g, 1)
                pairs.append((m[:, i].ravel(), m[:, j].ravel()))
            else:
                for s in at.tolist():
                    hots.append((cls[s : s + g], np.full(g, cls[s])))
        if keep is None:
            return key[:0], cls[:0], pairs, hots
        return key[keep:], cls[keep:], pairs, hots

    def flush(pairs, hots):
        for hot, parts in ((0, pairs), (1, hots)):
            if parts:
                yield from out(hot, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def joined():
        return tuple(np.concatenate(x) for x in zip(tail, *held, strict=True))

    for batch in batches:
        held.append((batch.column("key").to_numpy(), batch.column("cls").to_numpy()))
        rows += batch.num_rows
        if rows >= 200_000:
            *tail, pairs, hots = judge(*joined(), False)
            tail, held, rows = tuple(tail), [], 0
            yield from flush(pairs, hots)
    *_, pairs, hots = judge(*joined(), True)
    yield from flush(pairs, hots)


def _verify(num: int, den: int):
    """Streams blocks (sorted by block, i, j) and yields the verified links that join their sets."""

    def run(batches):
        for group in sorted_groups(batches, ["block", "i", "j"]):
            cls = group.column("cls").to_numpy()
            _, first = np.unique(cls, return_index=True)
            if len(first) < 2:
                continue
            group = group.take(pa.array(first))
            cls = cls[first]
            sets = [np.frombuffer(x.as_buffer(), _U) for x in group.column("shingles")]
            a, b = _links(sets, num, den)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b])], names=["a", "b"])

    return run


def _links(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the similarity graph over sets."""
    size = np.array([len(s) for s in sets])
    bits = 64
    while bits < 2 * np.median(size) and bits < 1 << 14:
        bits *= 2
    sketch = np.zeros((len(sets), bits // 64), _U)
    for i, s in enumerate(sets):
        flips = np.bincount((K.mix(s) % _U(bits)).astype(np.int64), minlength=bits) & 1
        sketch[i] = np.packbits(flips.astype(np.uint8)).view(_U)
    left = np.arange(len(sets))
    a, b = [], []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            n = size[left]
            near = (den * np.minimum(n, size[x]) >= num * np.maximum(n, size[x]))
            cand = left[near]
            if not len(cand):
                continue
            apart = np.bitwise_count(sketch[cand] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            cand = cand[apart * (den + num) <= (size[cand] + size[x]) * (den - num)]
            if not len(cand):
                continue
            joined = []
            for part in np.array_split(cand, 1 + len(cand) * int(size[x]) // 4_000_000):
                if not len(part):
                    continue
                flat = np.concatenate([sets[y] for y in part])
                at = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
                common = np.add.reduceat(sets[x][at] == flat, np.concatenate(([0], np.cumsum(size[part])[:-1])), dtype=np.int64)
                joined.append(part[den * common >= num * (size[part] + size[x] - common)])
            found = np.concatenate(joined)
            if len(found):
                a.append(np.full(len(found), x))
                b.append(found)
                todo += found.tolist()
                left = left[~np.isin(left, found)]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) per row of docs; with ``digest`` also xxhash64 of its text."""
    spark = docs.sparkSession
    texts = _texts(docs, doc_id, text)
    rows = written(classes(docs, doc_id, text, k, num, den), spark, "jaccard-rows")
    kinds = rows.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("slack").alias("slack"))
    kinds = written(kinds, spark, "jaccard-classes")

    shingles = kinds.agg(F.sum("n")).first()[0] or 0
    bits = _bits(shingles, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = _keys(texts, k, num, den, bits).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_meet_packs), "hot byte, a long, b long, n long")
    met = written(met, spark, "jaccard-met")
    warm = met.where("hot = 1").groupBy("a").agg(F.count("*").alias("h")).withColumnRenamed("a", "cls")
    state = kinds.select("cls", "slack").join(warm, "cls", "left").select(F.col("cls").alias("a"), (F.col("slack") - F.coalesce("h", F.lit(0))).alias("room"))
    pairs = met.where("hot = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).join(state, "a").where("n >= room + 1").select("a", "b")
    hot = met.where("hot = 1").groupBy("a", "b").agg(F.count("*").alias("n")).join(state.where("room < 0"), "a").select("a", "b")
    blocks = components(pairs.union(hot), "jaccard-blocks")

    member = blocks.withColumnRenamed("node", "cls").join(kinds.select("cls", "first", "n"), "cls")
    sized = member.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    member = skew_lookup(member, sized, "label", ["total"], "members", ["cls"])
    c = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    member = member.select("cls", "first", F.col("label").alias("block"), c.alias("c"), F.pmod(F.xxhash64("cls"), c).cast("int").alias("own"))
    member = written(member, spark, "jaccard-members")

    wanted = member.select(F.col("first").alias("doc_id"), "cls", "block", "c", "own")
    # wanted grows with the corpus: never broadcast
    loaded = texts.join(wanted.hint("merge"), "doc_id").mapInArrow(tidy(_load(k)), "cls long, block long, c int, own int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    tasks = loaded.withColumn("o", other).select("block", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "cls", "shingles")
    links = tasks.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(tidy(_verify(num, den)), "a long, b long")

    joined = components(links, "jaccard-links").withColumnRenamed("node", "cls")
    joined = joined.join(kinds.select("cls", "first"), "cls")
    least = joined.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("members"))
    joined = skew_lookup(joined.select("cls", "label"), least, "label", ["least"], "members", ["cls"])
    known = kinds.join(joined.select("cls", "least"), "cls", "left").where("copies > 1 or least is not null")
    known = known.select("cls", "copies", F.coalesce("least", "first").alias("component_id"))
    out = skew_lookup(rows, known, "cls", ["component_id"], "copies", ["doc_id"])
    return out.select("doc_id", *(["digest"] if digest else []), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _load(k: int):
    """Texts to shingle sets; a row whose text is not of the class that its id stands for is another row of that id."""

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                sets, begin = shingle_sets(data, offs, k)
                good = np.flatnonzero(class_ids(sets, begin) == part.column("cls").to_numpy())
                part = part.take(pa.array(good))
                blobs = pa.array([sets[begin[i] : begin[i + 1]].tobytes() for i in good.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("cls", "block", "c", "own")], blobs], names=["cls", "block", "c", "own", "shingles"])

    return run
