"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic model is trained from confirmed toxic texts (positives) and unlabelled texts with the risk
  pi R_p(+1) + max(0, R_u(-1) - pi R_p(-1)),
pi being the class prior: negatives are never needed, and the clamp keeps the corrected risk from going below zero.
The features of a text are its distinct words, ASCII-lower-cased, without ASCII punctuation, and the beginnings of
its words, hashed. Of those that two positives or more hold, those are kept that positives hold more often than all texts beyond
chance (their G statistic, at a level of one false feature in all), at most ``FEATURES``, the strongest first, smaller hashes first among equals.

Every text with an id is unlabelled: the features' counts and the unlabelled risk cover all of them. Texts are reduced to the
kept features they hold and dealt by a hash to shards of about ``SHARD`` texts, whose number grows with the corpus; in each round every
shard takes steps (Adam) on its own texts and all positives from the common weights, which are then averaged. Weights are
summed as integers, so the model does not depend on the order of rows or the number of partitions, up to rounding
within a shard. The driver receives the positives' frequent features (at most 2 ** SPACE_BITS), the kept features of the positives, and
one set of weights a round. Of the labelled rows at most ``most_positive`` positives are used, those of least id hash.

The class prior is a parameter; by default it is the share of toxic rows among the labels passed. Labels enter only through the frame of
training labels that the caller passes, and no constant was set by labels outside it: the decay
is that of a normal prior of variance ``variance`` on each weight.

Defined results: a null or wordless text gets the score of a text without any feature; with no positive or no
unlabelled text to train on every score is the prior (0 if unknown); null ids are scored but never trained on; ids
labelled more than once are positive if any label is; rows that repeat id and text are one text in the risk, and each is scored for
itself; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import chunks, tidy, written
from .graph import sorted_groups

#: Features kept at most.
FEATURES = 512
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
SPACE_BITS = 22
#: Unlabelled texts of one shard.
SHARD = 10_000
#: Weights are summed as multiples of 1 / _UNIT.
_UNIT = 1 << 32
_U = np.uint64


def features(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = K.NOT_ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of all texts, and the text each belongs to."""
    data = K.lowered(data)
    starts, ends, first = K.words(data, offs, sep)
    of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    summed = K.totals(data)
    hashes, owners = [K.spans(data, starts, ends, summed=summed)], [of]
    for n in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > n)
        starts, ends, of = starts[longer], ends[longer], of[longer]
        hashes.append(K.spans(data, starts, starts + n, summed=summed))
        owners.append(of)
    return (np.concatenate(hashes) >> _U(64 - SPACE_BITS)).astype(np.int64), np.concatenate(owners)


#: The last features that ``places`` was asked for, and its table of them.
_last: list[np.ndarray] = []


def places(hashed: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each feature in ``among`` (sorted), -1 for others: a table over all features is quicker than a search."""
    if not _last or _last[0] is not among:
        table = np.full(1 << SPACE_BITS, -1, np.int32)
        table[among] = np.arange(len(among), dtype=np.int32)
        _last[:] = among, table
    return _last[1][hashed]


@dataclass
class Model:
    """Kept features (sorted hashes), their weights, the bias; constant if there was nothing to learn from."""

    kept: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, hashed: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        if len(self.kept):
            at = places(hashed, self.kept)
            hit = np.flatnonzero(at >= 0)
            once = np.unique(of[hit] * len(self.kept) + at[hit])
            z += np.bincount(once // len(self.kept), self.weight[once % len(self.kept)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gain(cp: np.ndarray, cu: np.ndarray, positives: int, texts: int) -> np.ndarray:
    """G statistic of features that cp positives and cu texts hold; 0 where positives do not hold them more often."""
    a, b = (cp + 0.5) / (positives + 1), (cu + 0.5) / (texts + 1)
    return np.where(a > b, cp * np.log(a / b) - positives * (a - b), 0)


def risk(xp: np.ndarray, xu: np.ndarray, prior: float, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with logistic losses, and the direction to descend (weights, bias).

    Where the corrected negative risk is below zero the direction leads out of there.
    """
    zp, zu = xp @ w + bias, xu @ w + bias
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp, gu = sp / len(xp), su / len(xu)
    if negative >= 0:
        rp, ru = prior * (sp - 1) / len(xp) - prior * gp, gu
    else:
        rp, ru = prior * gp, -gu
    return positive + max(0.0, negative), np.concatenate((rp @ xp + ru @ xu, [rp.sum() + ru.sum()]))


def descend(xp: np.ndarray, xu: np.ndarray, prior: float, theta: np.ndarray, decay: float, *, steps: int = 100, rate: float = 0.05) -> np.ndarray:
    """Weights and bias after some steps."""
    theta = theta.copy()
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, steps + 1):
        grad = risk(xp, xu, prior, theta[:-1], theta[-1])[1]
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def _held(texts: DataFrame, among: np.ndarray | None) -> DataFrame:
    """f, n: how many texts hold each feature (or each number of ``among``, sorted features)."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                held.append(_distinct(data, offs, among)[1])
                size += len(held[-1])
                if size > 2_000_000:
                    yield from _counted(held)
                    held, size = [], 0
        yield from _counted(held)

    return texts.select("text").mapInArrow(tidy(run), "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray]):
    if held:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(n, pa.int64())], names=["f", "n"])


def _distinct(data: np.ndarray, offs: np.ndarray, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature (or place in ``among``), each pair once, sorted."""
    hashed, of = features(data, offs)
    if among is not None:
        if not len(among):
            return of[:0], hashed[:0]
        at = places(hashed, among)
        hit = np.flatnonzero(at >= 0)
        hashed, of = at[hit].astype(np.int64), of[hit]
    once = np.unique((of << SPACE_BITS) | hashed)
    return once >> SPACE_BITS, once & ((1 << SPACE_BITS) - 1)


def _reduced(texts: DataFrame, kept: np.ndarray, shards: int) -> DataFrame:
    """shard, key, f: the places in ``kept`` of each text's features, as 16-bit numbers; one row per text."""

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                of, f = _distinct(data, offs, kept)
                cut = np.searchsorted(of, np.arange(part.num_rows + 1))
                f = f.astype(np.uint16)
                key = part.column("key").to_numpy()
                shard = (K.mix(key.view(_U)) % _U(shards)).astype(np.int64)
                blobs = [f[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key), pa.array(blobs, pa.binary())], names=["shard", "key", "f"])

    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    return keyed.mapInArrow(tidy(run), "shard long, key long, f binary").groupBy("shard", "key").agg(F.first("f").alias("f"))


def _matrix(blobs: pa.ChunkedArray, size: int) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), np.uint16) for x in blobs]
    x = np.zeros((len(parts), size), np.float32)
    x[np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts) if parts else np.zeros(0, int)] = 1
    return x


def _average(rows: DataFrame, xp: np.ndarray, prior: float, theta: np.ndarray, decay: float, steps: int) -> np.ndarray:
    """One round: the mean over all shards of what each makes of theta."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((np.packbits(xp.astype(bool), axis=1), theta))

    def run(batches):
        packed, start = shared.value
        xp = np.unpackbits(packed, axis=1, count=len(start) - 1).astype(np.float32)
        total, n = np.zeros(len(start), np.int64), 0
        for group in sorted_groups(batches, ["shard"]):
            total += np.rint(descend(xp, _matrix(group.column("f"), len(start) - 1), prior, start, decay, steps=steps) * _UNIT).astype(np.int64)
            n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start) + 1), pa.int32()), pa.array(np.append(total, n))], names=["i", "v"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "key").mapInArrow(tidy(run), "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    shared.unpersist()
    v = summed.column("v").to_numpy()
    return v[:-1] / _UNIT / v[-1] if len(v) else theta


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", prior: float | None = None, most_positive: int = 4000, variance: float = 1.0, rounds: int = 4, steps: int = 50) -> Model:
    """labels: columns doc_id, toxic of the rows that may be learned from."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = float(known.agg(F.avg("toxic")).first()[0] or 0.0)
    ids = known.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positive)
    positive = written(texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"]), spark, "toxic-positive")
    positives, n = positive.count(), texts.count()
    if not positives or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    got = _held(positive, None).where("n > 1").toArrow().sort_by("f")
    among, cp = got.column("f").to_numpy().astype(np.int64), got.column("n").to_numpy()
    # The chance of a gain of x is below exp(-x): of all features looked at, one is expected to be kept by chance.
    least = np.log(max(len(among), 2))
    able = gain(cp, 0, positives, n) > least
    among, cp = among[able], cp[able]
    got, cu = _held(texts, among).toArrow(), np.zeros(len(among))
    cu[got.column("f").to_numpy()] = got.column("n").to_numpy()
    gained = gain(cp, cu, positives, n)
    best = np.argsort(-gained, kind="stable")[:FEATURES]
    kept = np.sort(among[best[gained[best] > least]])

    rows = written(_reduced(texts, kept, max(1, round(n / SHARD))), spark, "toxic-rows")
    xp = _matrix(_reduced(positive, kept, 1).toArrow().sort_by("key").column("f"), len(kept))
    theta = np.append(np.zeros(len(kept)), np.log(prior / (1 - prior)))
    for _ in range(rounds):
        theta = _average(rows, xp, prior, theta, prior / (positives * variance), steps)
    return Model(kept, theta[:-1], float(theta[-1]))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score per row of docs."""
    kind = dict(docs.dtypes)[doc_id]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                hashed, of = features(data, offs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(hashed, of, part.num_rows))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, score double")
