"""Principal components from one covariance pass; neighbour embeddings of bounded tables in one task."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter, NotFitted
from ..frames import cut_lineage
from .cluster import _large, _one_task, _Rows, _small, _squares
from .gram import _sums, _unpack
from .models import nearest


class PCA:
    """Centred; covariance with ddof 1; each component's largest loading is positive; ratios over the total variance."""

    def __init__(self, n_components: int, features: str):
        if n_components < 1:
            raise InvalidParameter("n_components", "at least 1")
        self.k, self.features = n_components, features
        self.components = None

    def fit(self, df: DataFrame) -> PCA:
        x = F.col(self.features).cast("array<double>")
        width = df.select(F.max(F.size(x))).first()[0]
        wide = df.select(*[F.get(x, F.lit(j)).alias(f"x{j}") for j in range(width)])
        row = wide.agg(F.count("*"), *[F.avg(f"x{j}") for j in range(width)]).first()
        n, mean = row[0], np.array(row[1:], float)
        cov = _unpack(_covariance(wide, width, mean), width) / max(n - 1, 1)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[: self.k]
        comp = vectors[:, order].T
        comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
        self.mean, self.components, self.explained = mean, comp, values[order]
        self.ratio = self.explained / max(values.sum(), 1e-300)
        return self

    def _need(self):
        if self.components is None:
            raise NotFitted("PCA")

    def transform(self, df: DataFrame, name: str = "components") -> DataFrame:
        self._need()
        x = F.col(self.features).cast("array<double>")
        return df.withColumn(name, F.array(*[_project(x, self.mean, c) for c in self.components]))

    def inverse_transform(self, df: DataFrame, column: str = "components", name: str = "restored") -> DataFrame:
        self._need()
        z = F.col(column)
        return df.withColumn(name, F.array(*[_project(z, np.zeros(self.k), self.components[:, j]) + float(self.mean[j]) for j in range(len(self.mean))]))


def _covariance(wide: DataFrame, width: int, mean: np.ndarray):
    """Cross products of centred columns; above 32 columns summed per batch in numpy and added up by Spark, in long form."""
    if width <= 32:
        return wide.agg(*_sums([F.col(f"x{j}") - float(mean[j]) for j in range(width)], F.lit(1.0))).first()

    def run(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            x = pdf.to_numpy(float) - mean
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"k": np.arange(len(i)), "v": total[i, j]})

    rows = wide.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return [r["v"] for r in rows]


def _project(x: Column, mean: np.ndarray, w: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(v)) for v in w])
    shift = float(mean @ w)
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - shift


def tsne(df: DataFrame, id_column: str, features: str, n_components: int = 2, perplexity: float = 30.0, rate: float = 200.0, steps: int = 300, seed: int = 0) -> DataFrame:
    """id, embedding: bisected perplexities, symmetric joint probabilities, early exaggeration, momentum.

    Beyond SMALL rows all distances are computed once, in blocks. Pairs of conditional probability min(FAR, NEAR * n) and more keep
    theirs; the sum of all smaller ones of a row, floor included, is spread evenly over all rows. Sums over all pairs of the embedding
    are interpolated on a grid.
    """
    if _large(df):
        return _tsne_large(df, id_column, features, n_components, perplexity, rate, steps, seed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["x"].to_numpy())
        n = len(x)
        d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
        p = np.zeros((n, n))
        goal = np.log(min(perplexity, max((n - 1) / 3, 1.01)))
        for i in range(n):
            lo, hi, b = 0.0, np.inf, 1.0
            row = np.delete(d[i], i)
            for _ in range(60):
                e = np.exp(-(row - row.min()) * b)
                s = e.sum()
                h = np.log(s) + b * ((row - row.min()) * e).sum() / s
                if abs(h - goal) < 1e-5:
                    break
                lo, hi = (b, hi) if h > goal else (lo, b)
                b = b * 2 if np.isinf(hi) else (lo + hi) / 2
            p[i, np.arange(n) != i] = e / s
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        rng = np.random.RandomState(seed)
        y, v = rng.normal(0, 1e-4, (n, n_components)), np.zeros((n, n_components))
        for t in range(steps):
            q = 1 / (1 + np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T, 0))
            np.fill_diagonal(q, 0)
            w = ((12 if t < steps // 4 else 1) * p - q / q.sum()) * q
            g = 4 * (w.sum(1)[:, None] * y - w @ y)
            v = (0.5 if t < steps // 4 else 0.8) * v - rate * g
            y = y + v
            y -= y.mean(0)
        return pd.DataFrame({"id": pdf["id"], "embedding": list(y)})

    return _one_task(_small(df, id_column, features), run, "id long, embedding array<double>")


#: The least joint probability.
FLOOR = 1e-12
#: A conditional probability of at least NEAR times the rows (FAR at most) keeps its pair; all others of a row are summed.
NEAR, FAR = 1e-9, 1e-4
#: The distance of no pair.
VOID = np.float32(3e38)
#: Kernel sums: grid nodes of a unit, nodes that a box of unit width reads, and nodes of a grid at most.
UNIT, NODES, GRID = 8, 16, 1 << 21


def _tail(r: np.ndarray, least: np.ndarray, b: np.ndarray, floor: np.ndarray):
    """Of rows of distances d beyond the least (float32): the sums of exp(-b d) times 1, d, d^2, d^3, and what lifting every term to the floor adds."""
    out = np.zeros((5, len(r)))
    least, b, floor = (v.astype(np.float32)[:, None] for v in (least, b, floor))
    for f in range(0, r.shape[1], 1024):
        d = r[:, f : f + 1024] - least
        e = d * -b
        np.exp(e, out=e)
        s = e.sum(1)
        out[0] += s
        out[4] += np.maximum(e, floor).sum(1) - s
        for m in (1, 2):
            out[m] += np.einsum("ij,ij->i", e, d)
            e *= d
        out[3] += np.einsum("ij,ij->i", e, d)
    return out


def _bisect(near: np.ndarray, goal: float, b: np.ndarray, low: np.ndarray, high: np.ndarray, far, close: float = 1e-6):
    """Precisions whose entropy is the goal, over near distances and what far(b, rows) gives for the others: their kernel sum and its first moment."""
    b, low, high, live = b.copy(), low.copy(), high.copy(), np.arange(len(b))
    for _ in range(60):
        r = np.where(np.isfinite(near[live]), near[live], 0)
        e = np.exp(-near[live] * b[live][:, None])
        s0, s1 = far(b[live], live)
        s = e.sum(1) + s0
        h = np.log(s) + b[live] * ((r * e).sum(1) + s1) / s
        open_ = ~(np.abs(h - goal) < close)
        live, h = live[open_], h[open_]
        if not len(live):
            break
        up = h > goal
        low[live], high[live] = np.where(up, b[live], low[live]), np.where(up, high[live], b[live])
        b[live] = np.where(np.isinf(high[live]), b[live] * 2, (low[live] + high[live]) / 2)
    return b


@np.errstate(over="ignore", under="ignore")
def _conditionals(x: np.ndarray, goal: float, lo: int, hi: int):
    """Of rows lo:hi, the kept pairs (row, other, conditional probability) and the sum of max(p / 2n, FLOOR / 2) over all others.

    Every row meets every other. Distances of near rows are exact sums of squared differences, those of all others float32.
    """
    n = len(x)
    least_kept = min(FAR, NEAR * n)
    sq = (x * x).sum(1)
    left, right = np.column_stack((-2 * x[lo:hi], sq[lo:hi], np.ones(hi - lo))), np.column_stack((x, np.ones(n), sq))
    group = max(1, min(16, n // 64))
    width = -(-n // group)
    pairs, rest = [], np.zeros(hi - lo)
    step = max(1, min(64, (1 << 23) // n))
    space = np.empty((step, width * group), np.float32)
    for a in range(lo, hi, step):
        rows = np.arange(a, min(hi, a + step))
        m = len(rows)
        r = space[:m]
        r[:, n:] = VOID
        for f in range(0, n, 2048):
            d = left[a - lo : a - lo + m] @ right[f : f + 2048].T
            np.maximum(d, 0, out=r[:, f : min(n, f + 2048)], casting="same_kind")
        r[np.arange(m), rows] = VOID
        first = r.reshape(m, group, width).min(1)
        k = min(96, width - 1)
        bound = np.minimum(np.partition(first, k, 1)[:, k].astype(float) * (1 + 1e-6) + 1e-12 * sq.max(), VOID / 2)
        j, near = _exactly(x, rows, r, first, bound)
        void = width * group - n + 1 + np.isfinite(near).sum(1)
        least = near.min(1)
        near -= least[:, None]
        # A start from every 64th of the others, then all of them.
        some = r[:, :: max(1, min(64, n // 64))] - least.astype(np.float32)[:, None]
        share = r.shape[1] / some.shape[1]

        def sampled(b, at, some=some, share=share):
            e = np.exp(some[at] * -b.astype(np.float32)[:, None])
            return share * e.sum(1), share * np.einsum("ij,ij->i", some[at], e)

        b = _bisect(near, goal, np.ones(m), np.zeros(m), np.full(m, np.inf), sampled, 1e-3)
        live, s, far, lift = np.arange(m), np.zeros(m), np.zeros(m), np.zeros(m)
        for _ in range(12):
            b0 = b[live]
            floor = n * FLOOR * (np.exp(-near[live] * b0[:, None]).sum(1) + sampled(b0, live)[0])
            sums = _tail(r if len(live) == m else r[live], least[live], b0, floor)
            lift[live] = sums[4] - floor * void[live]
            some_left = sums[0] > 0
            k1, k2, k3 = (np.where(some_left, q / np.where(some_left, sums[0], 1), 0) for q in sums[1:4])
            k3, k2 = k3 - 3 * k1 * k2 + 2 * k1**3, np.maximum(k2 - k1 * k1, 0)

            def carried(b, at, b0=b0, s0=sums[0], k1=k1, k2=k2, k3=k3):
                t = b - b0[at]
                s = s0[at] * np.exp(np.minimum(-k1[at] * t + k2[at] * t * t / 2 - k3[at] * t**3 / 6, 50))
                return s, s * (k1[at] - k2[at] * t + k3[at] * t * t / 2)

            b[live] = _bisect(near[live], goal, b0, b0 * 0.8, b0 * 1.25, carried)
            far[live] = carried(b[live], np.arange(len(live)))[0]
            s[live] = np.exp(-near[live] * b[live][:, None]).sum(1) + far[live]
            # The sums are carried over short ways only, else computed again.
            live = live[(np.abs(b[live] - b0) * np.sqrt(k2) > 0.1) & (b0 < 2.0**50)]
            if not len(live):
                break
        # Kept: all of at least the least probability, wherever they were.
        p = np.exp(-near * b[:, None]) / s[:, None]
        keep = np.isfinite(near) & (p >= least_kept)
        at = np.nonzero(keep)
        lost = np.where(keep | ~np.isfinite(near), 0, np.maximum(p, n * FLOOR)).sum(1) + (far + lift) / s
        pairs.append((rows[at[0]], j[at], p[at]))
        cut = least - np.log(least_kept * s) / b
        i, o = _within(r, first, cut)
        if len(i):
            q = np.exp(-np.maximum(r[i, o] - least[i], 0) * b[i]) / s[i]
            lost -= np.bincount(i, np.maximum(q, n * FLOOR), m)
            pairs.append((rows[i], o, q))
        rest[a - lo : a - lo + m] = np.maximum(lost, 0) / (2 * n)
    i, j, p = (np.concatenate(v) for v in zip(*pairs, strict=True))
    return i, j, p / (2 * n), rest


def _within(r: np.ndarray, first: np.ndarray, bound: np.ndarray):
    """Places in r of at most the bound; first has the least of every width-th column."""
    bound = bound.astype(np.float32)
    i, c = np.divmod(np.flatnonzero(first <= bound[:, None]), first.shape[1])
    at, g = np.nonzero(r.reshape(len(r), -1, first.shape[1])[i, :, c] <= bound[i][:, None])
    return i[at], g * first.shape[1] + c[at]


def _exactly(x: np.ndarray, rows: np.ndarray, r: np.ndarray, first: np.ndarray, bound: np.ndarray):
    """The others at distances up to the bound, padded by row, and their distances by differences; they are made void in r."""
    i, j = _within(r, first, bound)
    count = np.bincount(i, minlength=len(rows))
    place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    other, near = np.zeros((len(rows), max(1, count.max(initial=0))), int), np.full((len(rows), max(1, count.max(initial=0))), np.inf)
    other[i, place] = j
    for f in range(0, len(i), 1 << 16):
        at = slice(f, f + (1 << 16))
        d = x[rows[i[at]]] - x[j[at]]
        near[i[at], place[at]] = np.einsum("ij,ij->i", d, d)
    r[i, j] = VOID
    return other, near


def _kernel_sums(y: np.ndarray, charges: np.ndarray, square: int) -> np.ndarray | None:
    """Sums over all rows of charges * q and, of the first ones, charges * q * q, at every row, with q = 1 / (1 + d^2) in a plane.

    Interpolated on an even grid (15th degree, errors near 1e-6 of the charges), convolved by Fourier transforms. None beyond GRID nodes.
    """
    low = y.min(0)
    box = np.floor(y - low).astype(int)
    size = UNIT * box.max(0) + NODES
    if not np.isfinite(y).all() or size.prod() > GRID:
        return None
    order = np.lexsort((box[:, 1], box[:, 0]))
    at = box[order]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(at, axis=0) != 0).any(1), [True])))
    parts = [slice(f, min(e, f + 4096)) for s, e in zip(starts[:-1], starts[1:], strict=True) for f in range(s, e, 4096)]
    whole = np.arange(NODES)
    scale = np.array([np.prod(np.delete(k - whole, k).astype(float)) for k in whole])
    lines = []
    for c in (0, 1):
        u = ((y[order, c] - low[c]) - at[:, c]) * UNIT + (NODES - UNIT - 1) / 2
        d = u[:, None] - whole
        left, right = np.ones_like(d), np.ones_like(d)
        np.cumprod(d[:, :-1], 1, out=left[:, 1:])
        right[:, :-1] = np.cumprod(d[:, :0:-1], 1)[:, ::-1]
        lines.append(left * right / scale)
    w, q = charges[order], charges.shape[1]
    grid = np.zeros((q, *size))
    for part in parts:
        i, j = at[part.start] * UNIT
        a, b = lines[0][part], lines[1][part]
        grid[:, i : i + NODES, j : j + NODES] += ((w[part][:, :, None] * a[:, None]).reshape(len(a), -1).T @ b).reshape(q, NODES, NODES)
    wide = [_even(2 * int(v) - 1) for v in size]
    far = [(np.minimum(np.arange(v), v - np.arange(v)) / UNIT) ** 2 for v in wide]
    kernel = 1 / (1 + far[0][:, None] + far[1][None])
    forms = np.fft.rfft2(kernel).real, np.fft.rfft2(kernel * kernel).real
    field = np.zeros((q + square, *size))
    for c in range(q):
        form = np.fft.rfft2(grid[c], wide)
        field[c] = np.fft.irfft2(form * forms[0], wide)[: size[0], : size[1]]
        if c < square:
            field[q + c] = np.fft.irfft2(form * forms[1], wide)[: size[0], : size[1]]
    out = np.zeros((len(y), q + square))
    for part in parts:
        i, j = at[part.start] * UNIT
        f = field[:, i : i + NODES, j : j + NODES].transpose(1, 0, 2).reshape(NODES, -1)
        out[order[part]] = ((lines[0][part] @ f).reshape(-1, q + square, NODES) * lines[1][part][:, None]).sum(2)
    return out


def _even(n: int) -> int:
    """The least product of 2, 3 and 5 that is at least n."""
    return min(v for a in range(8) for b in range(5) for v in [3**a * 5**b << max(0, (-(-n // (3**a * 5**b)) - 1).bit_length())])


def _pair_sums(x: np.ndarray, state, lo: int, hi: int):
    """What _kernel_sums gives, of rows lo:hi, pair by pair, in any number of coordinates."""
    y, charges, square = state
    out = np.zeros((hi - lo, charges.shape[1] + square))
    for r in range(lo, hi, 128):
        at = slice(r, min(hi, r + 128))
        for f in range(0, len(y), 1024):
            q = 1 / (1 + _squares(y[at], y[f : f + 1024]))
            out[r - lo : at.stop - lo, : charges.shape[1]] += q @ charges[f : f + 1024]
            out[r - lo : at.stop - lo, charges.shape[1] :] += (q * q) @ charges[f : f + 1024, :square]
    return [[out]]


_pair_sums.kinds = (np.float64,)


def _joint(rows: _Rows, goal: float, size: int, parts: int) -> DataFrame:
    """Per block of so many rows: how many kept pairs each row has (i), with whom, their joint probabilities, and the sums of the others.

    All distances are computed once. A pair is sent to the blocks of both its rows, and the blocks are written once.
    """
    spark, shared, n = rows.spark, rows.shared, len(rows.ids)
    small = max(1, min(512, size, -(-n // (4 * spark.sparkContext.defaultParallelism))))
    count, blocks = -(-n // small), -(-n // size)
    # Keys that spread the blocks evenly over the partitions.
    dealt = spark.range(64 * parts).selectExpr("id", f"pmod(hash(id), {parts}) AS p").collect()
    free = {p: [r.id for r in dealt if r.p == p] for p in range(parts)}
    keys = [free[b % parts][b // parts] if b // parts < len(free[b % parts]) else 64 * parts + b for b in range(blocks)]
    names = ["k", "b", "i", "j", "p", "rest"]

    def run(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                lo, hi = c * small, min(n, (c + 1) * small)
                i, j, p, rest = _conditionals(shared.value, goal, lo, hi)
                for own in (True, False):
                    a, o = (i, j) if own else (j, i)
                    to = a // size
                    order = np.argsort(to, kind="stable")
                    ends = np.searchsorted(to[order], np.arange(blocks + 1))
                    first, last = lo // size, (hi - 1) // size
                    for b in range(blocks):
                        at = order[ends[b] : ends[b + 1]]
                        here = rest[max(lo, b * size) - lo : max(0, min(hi, (b + 1) * size) - lo)] if own and first <= b <= last else rest[:0]
                        if len(at) or len(here):
                            packed = (a[at] - b * size).astype(np.int32), o[at].astype(np.int32), p[at].astype(np.float32), np.concatenate(([max(lo, b * size) - b * size], here))
                            yield pa.RecordBatch.from_arrays([pa.array([keys[b]]), pa.array([b]), *[pa.array([v.tobytes()], pa.binary()) for v in packed]], names=names)

    def merge(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        i, j, p = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(c)]) for c, kind in (("i", np.int32), ("j", np.int32), ("p", np.float32)))
        rest = np.zeros(min(n, (b + 1) * size) - b * size)
        for v in table.column("rest"):
            t = np.frombuffer(v.as_buffer(), float)
            rest[int(t[0]) : int(t[0]) + len(t) - 1] += t[1:]
        pair = i.astype(np.int64) * n + j
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, int)
        p = np.add.reduceat(p[order].astype(float), head) if len(head) else np.zeros(0)
        packed = np.bincount(pair[head] // n, minlength=len(rest)).astype(np.int32), (pair[head] % n).astype(np.int32), p.astype(np.float32), rest
        return pa.table([pa.array([b]), *[pa.array([v.tobytes()], pa.binary()) for v in packed]], names=names[1:])

    tasks = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
    sent = spark.range(0, count, 1, tasks).mapInArrow(run, "k long, b long, i binary, j binary, p binary, rest binary")
    return cut_lineage(sent.repartition(parts, "k").groupBy("k").applyInArrow(merge, "b long, i binary, j binary, p binary, rest binary"))


def _attraction(pairs, y: np.ndarray) -> np.ndarray:
    """Sums of p * q * (y_i - y_j) over the kept pairs of every row."""
    now = pairs.context.broadcast(np.ascontiguousarray(y.T))

    def run(block):
        first, *packed = block
        y = now.value
        count, j, p = (np.frombuffer(v, kind) for v, kind in zip(packed, (np.int32, np.int32, np.float32), strict=True))
        ends = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        out = np.zeros((len(count), len(y)))
        lo = 0
        while lo < len(count):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 15), "right")) - 1)
            at = slice(ends[lo], ends[hi])
            d = [np.repeat(v[first + lo : first + hi], count[lo:hi]) for v in y]
            w = np.ones(at.stop - at.start)
            for v, own in zip(y, d, strict=True):
                own -= v.take(j[at])
                w += own * own
            np.divide(p[at], w, out=w)
            some = np.flatnonzero(count[lo:hi])
            if len(some):
                for c, v in enumerate(d):
                    v *= w
                    out[lo + some, c] = np.add.reduceat(v, ends[lo:hi][some] - ends[lo])
            lo = hi
        return first, out.tobytes()

    got = pairs.map(run).collect()
    now.destroy()
    return np.concatenate([np.frombuffer(v) for _, v in sorted(got)]).reshape(len(y), -1)


def _tsne_large(df: DataFrame, id_column: str, features: str, n_components: int, perplexity: float, rate: float, steps: int, seed: int) -> DataFrame:
    rows = _Rows(df, id_column, features)
    n, k = len(rows.ids), n_components
    rng = np.random.RandomState(seed)
    y, v = rng.normal(0, 1e-4, (n, k)), np.zeros((n, k))
    if steps > 0 and not np.isfinite(rows.x).all():
        y[:] = np.nan
        steps = 0
    if steps > 0:
        parts = rows.spark.sparkContext.defaultParallelism
        size = -(-n // (parts * -(-n // (8192 * parts))))
        pairs = _joint(rows, np.log(min(perplexity, max((n - 1) / 3, 1.01))), size, parts)
        rest = np.concatenate([np.frombuffer(r["rest"]) for r in pairs.select("b", "rest").orderBy("b").collect()])[:, None]
        pairs = pairs.select("b", "i", "j", "p").rdd.coalesce(parts).map(lambda r: (r[0] * size, bytes(r[1]), bytes(r[2]), bytes(r[3]))).persist(StorageLevel.MEMORY_AND_DISK)
    with ThreadPoolExecutor(1) as other:
        for t in range(steps):
            pull = other.submit(_attraction, pairs, y)
            one = np.concatenate((np.ones((n, 1)), y), 1)
            charges = np.concatenate((one, rest * one), 1)
            flat = np.concatenate((y, np.zeros((n, 1))), 1) if k == 1 else y
            sums = _kernel_sums(flat, charges, k + 1) if k <= 2 else None
            if sums is None:
                sums = rows.blocks(_pair_sums, (y, charges, k + 1), n)[0].reshape(n, -1)
            around, tail, push = (sums[:, c * (k + 1) : (c + 1) * (k + 1)] for c in range(3))
            far = (rest * (y * around[:, :1] - around[:, 1:]) + y * tail[:, :1] - tail[:, 1:]) / (n - 1)
            g = 4 * ((12 if t < steps // 4 else 1) * (pull.result() + far) - (y * push[:, :1] - push[:, 1:]) / (around[:, 0].sum() - n))
            v = (0.5 if t < steps // 4 else 0.8) * v - rate * g
            y = y + v
            y -= y.mean(0)
    if steps > 0:
        pairs.unpersist()
    rows.shared.destroy()
    return rows.spark.createDataFrame(pa.table({"id": rows.ids, "embedding": pa.array(list(y), pa.list_(pa.float64()))}))


def umap(df: DataFrame, id_column: str, features: str, n_components: int = 2, neighbours: int = 15, min_dist: float = 0.1, epochs: int = 200, seed: int = 0) -> DataFrame:
    """id, embedding: neighbour graph of weight exp(-d / min_dist), attraction along edges, repulsion from samples.

    Neighbours are searched in blocks by all tasks, for any number of rows; one task lays out the graph, in memory of n * neighbours numbers.
    """
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"))
    near = nearest(rows, rows, neighbours, query_id="id", train_id="id", features="x", exclude_same=True)
    lists = near.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "train_id", "distance"))).alias("near"))
    flat = rows.select("id").join(lists, "id", "left").select("id", F.expr("transform(near, v -> v.train_id)").alias("j"), F.expr("transform(near, v -> v.distance)").alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, n = pdf["id"].to_numpy(), len(pdf)
        k = np.array([0 if v is None else len(v) for v in pdf["j"]])
        rng = np.random.RandomState(seed)
        y = rng.normal(0, 1, (n, n_components))
        if not k.sum():
            return pd.DataFrame({"id": ids, "embedding": list(y)})
        i = np.repeat(np.arange(n), k)
        j = np.searchsorted(ids, np.concatenate([v for v in pdf["j"] if v is not None]))
        d = np.concatenate([v for v in pdf["d"] if v is not None]).astype(float)
        base = d - np.repeat(d[np.minimum(np.cumsum(k) - k, len(d) - 1)], k)
        w = np.exp(-base / max(min_dist, 1e-9) / max(np.median(d), 1e-9))
        share = k.max()
        for t in range(epochs):
            step = 1 - t / epochs
            far = rng.randint(n, size=len(i))
            move = np.zeros_like(y)
            for a in range(0, len(i), 1 << 20):
                at = slice(a, a + (1 << 20))
                delta, away = y[i[at]] - y[j[at]], y[i[at]] - y[far[at]]
                pull = -2 * delta / (1 + (delta**2).sum(1, keepdims=True)) * w[at][:, None]
                d2 = (away**2).sum(1, keepdims=True)
                push = 2 * away / ((0.001 + d2) * (1 + d2))
                for c in range(n_components):
                    move[:, c] += np.bincount(i[at], np.clip(pull[:, c] + push[:, c], -4, 4), n) / share
                    move[:, c] -= np.bincount(j[at], np.clip(pull[:, c], -4, 4), n) / share
            y = y + step * move
        return pd.DataFrame({"id": ids, "embedding": list(y)})

    return _one_task(flat.withColumn("_g", F.lit(0)), run, "id long, embedding array<double>")
