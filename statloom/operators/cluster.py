"""Clustering: Lloyd's k-means over rows, DBSCAN by a grid join and components, and small-n methods in one bounded task."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..frames import cut_lineage
from ..functions.scalar import euclidean
from .neighbours import matrix

#: Rows up to which a method keeps all distances in one task; beyond, tasks compute them again block by block.
SMALL = 5000
#: Rows compared with a block at once.
TILE = 4096


def _centres(centres: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])


def _distances(x: Column, centres: list[list[float]]) -> Column:
    return F.transform(_centres(centres), lambda c: euclidean(x, c))


def kmeans_transform(df: DataFrame, features: str, centres: list[list[float]], name: str = "distances") -> DataFrame:
    return df.withColumn(name, _distances(F.col(features).cast("array<double>"), centres))


def kmeans_assign(df: DataFrame, features: str, centres: list[list[float]]) -> DataFrame:
    """df with cluster (the first nearest centre) and distance. Centres are part of the plan; nothing is joined."""
    d = kmeans_transform(df, features, centres, "_d")
    return d.withColumns({"cluster": (F.array_position("_d", F.array_min("_d")) - 1).cast("int"), "distance": F.array_min("_d")}).drop("_d")


def kmeans_step(df: DataFrame, features: str, centres: list[list[float]]) -> tuple[list[list[float]], float]:
    """New centres and inertia; an empty cluster keeps its centre."""
    width = len(centres[0])
    x = F.col(features).cast("array<double>")
    rows = kmeans_assign(df, features, centres).groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance") * F.col("distance")).alias("sse"), *[F.avg(F.get(x, F.lit(j))).alias(f"m{j}") for j in range(width)]).collect()
    new, inertia = [list(c) for c in centres], 0.0
    for r in rows:
        new[r["cluster"]] = [r[f"m{j}"] for j in range(width)]
        inertia += r["sse"]
    return new, inertia


def kmeans_plus_plus(df: DataFrame, features: str, id_column: str, k: int, seed: int = 0) -> list[list[float]]:
    """k-means++: every further centre is the row of least -ln(u) / d^2, one aggregate per centre."""
    x = F.col(features).cast("array<double>")
    first = df.orderBy(F.xxhash64(F.col(id_column), F.lit(seed)), id_column).select(x.alias("x")).first()
    centres = [list(first["x"])]
    for i in range(1, k):
        d2 = F.pow(F.array_min(_distances(x, centres)), F.lit(2))
        u = (F.pmod(F.xxhash64(F.col(id_column), F.lit(seed + i)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        row = df.select(x.alias("x"), F.when(d2 > 0, -F.ln(u) / d2).alias("e"), F.col(id_column).alias("i")).where("e is not null").agg(F.min_by("x", F.struct("e", "i")).alias("x")).first()
        if row["x"] is None:
            break
        centres.append(list(row["x"]))
    return centres


def kmeans(df: DataFrame, features: str, id_column: str, k: int, max_iter: int = 300, n_init: int = 1, tol: float = 1e-4, seed: int = 0) -> dict:
    """centres, inertia, iterations of the best of n_init starts."""
    best = None
    for s in range(n_init):
        centres, last = kmeans_plus_plus(df, features, id_column, k, seed + 1000 * s), float("inf")
        for it in range(1, max_iter + 1):
            centres, inertia = kmeans_step(df, features, centres)
            if abs(last - inertia) < tol:
                break
            last = inertia
        if best is None or inertia < best["inertia"]:
            best = {"centres": centres, "inertia": inertia, "iterations": it}
    return best


def within(df: DataFrame, id_column: str, features: str, eps: float) -> DataFrame:
    """i, j of all pairs at most eps apart: rows meet in grid cells of that width over the first three coordinates."""
    x = F.col(features).cast("array<double>")
    base = df.select(F.col(id_column).alias("i"), x.alias("x"))
    width = df.select(F.max(F.size(x))).first()[0] or 1
    dims = min(3, width)
    cell = F.array(*[F.floor(F.get("x", F.lit(d)) / eps) for d in range(dims)])
    left = base.withColumn("cell", cell)
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = base.select(F.col("i").alias("j"), F.col("x").alias("y"), cell.alias("c"))
    for d in range(dims):
        right = right.withColumn(f"s{d}", F.explode(shift))
    right = right.withColumn("cell", F.array(*[F.get("c", F.lit(d)) + F.col(f"s{d}") for d in range(dims)])).select("j", "y", "cell")
    return left.join(right, "cell").where((F.col("i") != F.col("j")) & (euclidean(F.col("x"), F.col("y")) <= eps)).select("i", "j")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, root (the smallest id reachable) for nodes (id) and edges (i, j): labels spread and jump until none changes."""
    both = cut_lineage(edges.select("i", "j").union(edges.select(F.col("j"), F.col("i"))).distinct())
    state = nodes.select("id", F.col("id").alias("root"))
    while True:
        near = both.join(state, F.col("j") == F.col("id")).groupBy("i").agg(F.min("root").alias("m"))
        new = state.join(near, F.col("id") == F.col("i"), "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = new.select(F.col("id").alias("r"), F.col("root").alias("rr"))
        new = new.join(jump, F.col("root") == F.col("r")).select("id", "old", F.col("rr").alias("root"))
        new = cut_lineage(new)
        if not new.where("root <> old").limit(1).count():
            return new.select("id", "root")
        state = new.select("id", "root")


def dbscan(df: DataFrame, id_column: str, features: str, eps: float, min_samples: int) -> DataFrame:
    """id, cluster (-1 noise, else from 0 by smallest core id), is_core. The count of neighbours leaves out the row itself; a border row joins the cluster of its smallest core."""
    near = cut_lineage(within(df, id_column, features, eps))
    ids = df.select(F.col(id_column).alias("id"))
    core = near.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(F.col("i").alias("core"))
    links = near.join(core, F.col("i") == F.col("core")).drop("core").join(core, F.col("j") == F.col("core")).drop("core")
    roots = components(links, core.select(F.col("core").alias("id")))
    from pyspark.sql import Window

    numbers = roots.select("root").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("root")) - 1).cast("int"))
    cores = roots.join(numbers, "root").select(F.col("id").alias("c"), "cluster")
    border = near.join(cores, F.col("j") == F.col("c")).groupBy("i").agg(F.min_by("cluster", "c").alias("b"))
    out = ids.join(cores, F.col("id") == F.col("c"), "left").join(border, F.col("id") == F.col("i"), "left")
    return out.select("id", F.coalesce("cluster", "b", F.lit(-1)).alias("cluster"), F.col("c").isNotNull().alias("is_core"))


def _small(df: DataFrame, id_column: str, features: str) -> DataFrame:
    if df.limit(SMALL + 1).count() > SMALL:
        raise InvalidParameter("df", f"this method takes at most {SMALL} rows")
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x")).withColumn("_g", F.lit(0))


def _large(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() > SMALL


class _Rows:
    """All rows of a table by id, on the driver and broadcast; f(x, state, lo, hi) runs over blocks of rows in all tasks."""

    def __init__(self, df: DataFrame, id_column: str, features: str):
        self.spark = df.sparkSession
        table = df.select(F.col(id_column).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x")).toArrow().sort_by("id")
        self.ids, self.x = table.column("id").to_numpy(), matrix(table.column("x"))[0]
        self.shared = self.spark.sparkContext.broadcast(self.x)

    def blocks(self, f, state, n: int) -> list[np.ndarray]:
        """What f gives for the blocks of range(n), in order, each array of the results joined."""
        spark, kinds = self.spark, f.kinds
        size = max(1, min(1024, -(-n // (3 * spark.sparkContext.defaultParallelism))))
        count = -(-n // size)
        shared, now = self.shared, spark.sparkContext.broadcast(state)

        def run(batches):
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    parts = f(shared.value, now.value, b * size, min(n, (b + 1) * size))[0]
                    columns = [pa.array([b])] + [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in parts]
                    yield pa.RecordBatch.from_arrays(columns, names=["b", *[f"v{i}" for i in range(len(parts))]])

        tasks = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
        rows = spark.range(0, count, 1, tasks).mapInArrow(run, "b long, " + ", ".join(f"v{i} binary" for i in range(len(kinds)))).toArrow().sort_by("b")
        now.destroy()
        return [np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in rows.column(f"v{i}")] or [np.zeros(0, kind)]) for i, kind in enumerate(kinds)]

    def labelled(self, cluster: np.ndarray) -> DataFrame:
        self.shared.destroy()
        return self.spark.createDataFrame(pa.table({"id": self.ids, "cluster": cluster.astype("int32")}))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _tiles(n: int):
    return ((c, min(n, c + TILE)) for c in range(0, n, TILE))


def _ward_nearest(x: np.ndarray, state, lo: int, hi: int):
    """The nearest other cluster by Ward's distance, the first among equals, and that distance, of clusters todo[lo:hi]."""
    centre, size, todo = state
    rows = todo[lo:hi]
    best, at = np.full(len(rows), np.inf), np.full(len(rows), -1)
    for c, e in _tiles(len(centre)):
        d = _squares(centre[rows], centre[c:e]) * (2 * size[rows][:, None] * size[None, c:e] / (size[rows][:, None] + size[None, c:e]))
        own = np.flatnonzero((rows >= c) & (rows < e))
        d[own, rows[own] - c] = np.inf
        j = d.argmin(1)
        v = d[np.arange(len(rows)), j]
        less = v < best
        best[less], at[less] = v[less], j[less] + c
    return [[at, best]]


_ward_nearest.kinds = (np.int64, np.float64)


def _ward_large(df: DataFrame, id_column: str, features: str, n_clusters: int) -> DataFrame:
    """Ward's method by reciprocal nearest neighbours: all pairs nearest to each other merge at once, which are merges of the greedy order too.

    Only centres and sizes are kept. The merges of least height are then taken until n_clusters are left.
    """
    rows = _Rows(df, id_column, features)
    n = len(rows.ids)
    centre, size, name = rows.x.copy(), np.ones(n), np.arange(n)
    near, gap, height = np.full(n, -1), np.full(n, np.inf), np.zeros(n)
    merges, todo = [], np.arange(n)
    while len(centre) > 1:
        state = (centre, size, todo)
        near[todo], gap[todo] = rows.blocks(_ward_nearest, state, len(todo)) if len(todo) * len(centre) > 4_000_000 else _ward_nearest(rows.x, state, 0, len(todo))[0]
        i = np.flatnonzero((near[near] == np.arange(len(near))) & (np.arange(len(near)) < near))
        if not len(i):  # rounding only: the nearest pair of all
            i = np.array([int(gap.argmin())])
        j = near[i]
        h = np.maximum(gap[i], np.maximum(height[i], height[j]))
        merges += zip(h.tolist(), name[i].tolist(), name[j].tolist(), strict=True)
        total = size[i] + size[j]
        centre[i] = (size[i][:, None] * centre[i] + size[j][:, None] * centre[j]) / total[:, None]
        size[i], height[i], name[i] = total, h, np.minimum(name[i], name[j])
        gone = np.zeros(len(near), bool)
        gone[j] = True
        changed = gone.copy()
        changed[i] = True
        again = changed | changed[near]
        place = np.cumsum(~gone) - 1
        keep = ~gone
        near = np.where(again, -1, place[near])[keep]
        todo = np.flatnonzero(again[keep])
        centre, size, name, height, gap = centre[keep], size[keep], name[keep], height[keep], gap[keep]
    root = np.arange(n)

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    merges.sort(key=lambda m: m[0])
    for _, a, b in merges[: max(0, n - max(n_clusters, 1))]:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return rows.labelled(np.unique([top(v) for v in range(n)], return_inverse=True)[1])


def _shift(x: np.ndarray, state, lo: int, hi: int):
    """One step of mean shift for the modes m[lo:hi]; a mode with one row near is that row."""
    m, bandwidth = state
    m = m[lo:hi]
    total, weight, count, only = np.zeros_like(m), np.zeros(len(m)), np.zeros(len(m), int), np.zeros(len(m), int)
    for c, e in _tiles(len(x)):
        d2 = _squares(m, x[c:e])
        i, j = np.nonzero(d2 <= bandwidth**2)
        if not len(i):
            continue
        w = np.zeros_like(d2)
        w[i, j] = np.exp(-d2[i, j] / (2 * bandwidth**2))
        total += w @ x[c:e]
        weight += w.sum(1)
        count += np.bincount(i, minlength=len(m))
        only[i] = j + c
    new = total / np.maximum(weight, 1e-300)[:, None]
    new[count == 1] = x[only[count == 1]]
    return [[new]]


_shift.kinds = (np.float64,)


def _leading(x: np.ndarray, state, lo: int, hi: int):
    """Of modes todo[lo:hi]: whether an earlier one of unknown part is near, and the first leader near (-1: none)."""
    m, part, todo, reach = state
    rows = todo[lo:hi]
    unknown, first = np.zeros(len(rows), bool), np.full(len(rows), -1)
    for c, e in _tiles(int(rows.max(initial=0))):
        d2 = _squares(m[rows], m[c:e])
        i, j = np.nonzero((d2 < reach**2 + 1e-9 * (1 + reach**2)) & (np.arange(c, e)[None] < rows[:, None]))
        near = np.sqrt(((m[rows[i]] - m[j + c]) ** 2).sum(1)) < reach
        i, j = i[near], j[near] + c
        unknown[i[part[j] == 0]] = True
        lead = part[j] == 1
        a, b = i[lead][::-1], j[lead][::-1]
        found = np.full(len(rows), -1)
        found[a] = b
        first = np.where(first < 0, found, first)
    return [[unknown.astype(np.int8), first]]


_leading.kinds = (np.int8, np.int64)


def _mean_shift_large(df: DataFrame, id_column: str, features: str, bandwidth: float, max_iter: int) -> DataFrame:
    """The same steps and the same merging of modes in the order of ids, over blocks; modes that stand still are left alone."""
    rows = _Rows(df, id_column, features)
    n, width = rows.x.shape
    m, active = rows.x.copy(), np.arange(n)
    for _ in range(max_iter):
        new = rows.blocks(_shift, (m[active], bandwidth), len(active))[0].reshape(-1, width)
        step = np.sqrt(((new - m[active]) ** 2).sum(1))
        m[active] = new
        active = active[step > 0]
        if not len(active) or step.max() < 1e-3:
            break
    part, first, todo = np.zeros(n, np.int8), np.full(n, -1), np.arange(n)
    while len(todo):
        unknown, near = rows.blocks(_leading, (m, part, todo, bandwidth / 2), len(todo))
        part[todo] = np.where(near >= 0, 2, np.where(unknown > 0, 0, 1))
        todo = todo[part[todo] == 0]
    rest = np.flatnonzero(part == 2)
    if len(rest):
        first[rest] = rows.blocks(_leading, (m, part, rest, bandwidth / 2), len(rest))[1]
    lead = np.cumsum(part == 1) - 1
    return rows.labelled(lead[np.where(part == 1, np.arange(n), first)])


def _affinity(x: np.ndarray, state, lo: int, hi: int):
    """Rows lo:hi of exp(-gamma d^2) times the columns of v."""
    v, gamma = state
    out = np.zeros((hi - lo, v.shape[1]))
    for a in range(lo, hi, 256):
        b = min(hi, a + 256)
        for c, e in _tiles(len(x)):
            out[a - lo : b - lo] += np.exp(-gamma * _squares(x[a:b], x[c:e])) @ v[c:e]
    return [[out]]


_affinity.kinds = (np.float64,)


def _spectral_large(df: DataFrame, id_column: str, features: str, k: int, gamma: float, seed: int, spare: int = 8, blocks: int = 8, tol: float = 1e-8, passes: int = 300) -> DataFrame:
    """The eigenvectors by block Krylov spaces (restarted at their best vectors) until the residuals are below ``tol``; affinities are computed again in each pass."""
    rows = _Rows(df, id_column, features)
    n = len(rows.x)
    times = lambda v: rows.blocks(_affinity, (v, gamma), n)[0].reshape(n, -1)
    s = 1 / np.sqrt(times(np.ones((n, 1))))
    width = min(n, k + spare)
    v, q, mq = np.linalg.qr(np.random.RandomState(seed).normal(size=(n, width)))[0], np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(passes):
        mv = s * times(s * v)
        q, mq = np.concatenate((q, v), 1), np.concatenate((mq, mv), 1)
        t = q.T @ mq
        values, y = np.linalg.eigh((t + t.T) / 2)
        top = y[:, ::-1][:, :width]
        e = q @ top[:, :k]
        if np.linalg.norm(mq @ top[:, :k] - e * values[::-1][:k], axis=0).max() < tol or q.shape[1] >= n:
            return rows.labelled(_cut(e, k, seed))
        if q.shape[1] >= blocks * width:
            q, mq = q @ top, mq @ top
            mv = mq
        v = mv
        for _ in range(2):
            v = np.linalg.qr(v - q @ (q.T @ v))[0][:, : n - q.shape[1]]
    raise InvalidParameter("gamma", f"eigenvectors not found in {passes} passes")


def _cut(e: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means of the rows of e, scaled to length 1, from farthest starts."""
    e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    rng = np.random.RandomState(seed)
    c = [e[rng.randint(len(e))]]
    while len(c) < k:
        d = np.min([((e - q) ** 2).sum(1) for q in c], axis=0)
        c.append(e[int(d.argmax())])
    c = np.array(c)
    for _ in range(100):
        lab = ((e[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([e[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return lab


def _one_task(df: DataFrame, f, schema: str) -> DataFrame:
    return df.groupBy("_g").applyInPandas(f, schema)


def hierarchical(df: DataFrame, id_column: str, features: str, n_clusters: int, linkage: str = "average") -> DataFrame:
    """id, cluster by agglomeration with Lance-Williams updates; Ward's method for any number of rows, the others for at most SMALL."""
    if linkage not in ("single", "complete", "average", "ward"):
        raise InvalidParameter("linkage", linkage)
    if linkage == "ward" and _large(df):
        return _ward_large(df, id_column, features, n_clusters)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["x"].to_numpy())
        n = len(x)
        d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)) if n <= 800 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
        if linkage == "ward":
            d = d * d
        np.fill_diagonal(d, np.inf)
        size, label, alive = np.ones(n), np.arange(n), n
        while alive > max(n_clusters, 1):
            i, j = divmod(int(d.argmin()), n)
            i, j = min(i, j), max(i, j)
            a, b = d[i].copy(), d[j].copy()
            if linkage == "single":
                new = np.minimum(a, b)
            elif linkage == "complete":
                new = np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b))
            elif linkage == "average":
                new = (size[i] * a + size[j] * b) / (size[i] + size[j])
            else:
                t = size + size[i] + size[j]
                new = ((size + size[i]) * a + (size + size[j]) * b - size * d[i, j]) / t
            d[i], d[:, i] = new, new
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            label[label == j] = i
            alive -= 1
        return pd.DataFrame({"id": pdf["id"], "cluster": np.unique(label, return_inverse=True)[1].astype("int32")})

    return _one_task(_small(df, id_column, features), run, "id long, cluster int")


def mean_shift(df: DataFrame, id_column: str, features: str, bandwidth: float, max_iter: int = 300) -> DataFrame:
    """id, cluster: Gaussian weights within the bandwidth; modes closer than half of it merge."""
    if _large(df):
        return _mean_shift_large(df, id_column, features, bandwidth, max_iter)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["x"].to_numpy())
        m = x.copy()
        for _ in range(max_iter):
            d2 = np.maximum((m * m).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * m @ x.T, 0)
            w = np.where(d2 <= bandwidth**2, np.exp(-d2 / (2 * bandwidth**2)), 0)
            new = (w @ x) / np.maximum(w.sum(1, keepdims=True), 1e-300)
            moved = np.sqrt(((new - m) ** 2).sum(1)).max()
            m = new
            if moved < 1e-3:
                break
        modes, label = [], []
        for p in m:
            hit = next((k for k, q in enumerate(modes) if np.sqrt(((p - q) ** 2).sum()) < bandwidth / 2), None)
            if hit is None:
                modes.append(p)
                hit = len(modes) - 1
            label.append(hit)
        return pd.DataFrame({"id": pdf["id"], "cluster": np.array(label, "int32")})

    return _one_task(_small(df, id_column, features), run, "id long, cluster int")


def spectral(df: DataFrame, id_column: str, features: str, k: int, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """id, cluster: k-means on the smallest eigenvectors of the normalised Laplacian of the RBF affinity."""
    if _large(df):
        return _spectral_large(df, id_column, features, k, gamma, seed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["x"].to_numpy())
        a = np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
        s = 1 / np.sqrt(a.sum(1))
        e = np.linalg.eigh(np.eye(len(x)) - s[:, None] * a * s[None])[1][:, :k]
        lab = _cut(e, k, seed)
        return pd.DataFrame({"id": pdf["id"], "cluster": lab.astype("int32")})

    return _one_task(_small(df, id_column, features), run, "id long, cluster int")
