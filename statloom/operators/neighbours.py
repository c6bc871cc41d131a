"""Exact nearest neighbours of blocks of rows, in numpy.

Rows are dealt by recursive medians to leaves with bounding boxes. A leaf of queries meets the leaves of training rows from
the nearest box on, until no box can hold a neighbour. Squared distances are first taken by matrix products (of few
coordinates by differences); a few more rows than asked for are kept and compared by the distance that the DataFrame
expression gives, the root of the squares summed in the order of coordinates. A row for which rounding leaves open
whether those rows hold all nearest is compared with every training row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows kept beyond those asked for until exact distances decide.
SPARE = 8
#: Up to so many coordinates boxes are tight and leaves small.
FEW = 8


def matrix(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow array of lists as doubles, and which rows have a null or another length (NaN throughout)."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), int)
    if width is None:
        width = max(1, int(sizes.max(initial=0)))
    flat = column.flatten()
    nulls = np.asarray(flat.is_null().to_numpy(zero_copy_only=False), bool) if flat.null_count else np.zeros(len(flat), bool)
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    if (sizes == width).all():
        return values.reshape(n, width), nulls.reshape(n, width).any(1)
    x, bad = np.full((n, width), np.nan), np.ones(n, bool)
    at = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    for i in np.flatnonzero(sizes == width):
        x[i], bad[i] = values[at[i] : at[i + 1]], nulls[at[i] : at[i + 1]].any()
    return x, bad


def leaves(x: np.ndarray, group: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in parts of at most ``size``, each of one group, split at medians of the widest coordinate."""
    order = np.argsort(group, kind="stable")
    todo = [p for p in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(p)]
    out = []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(np.sort(part))
            continue
        rows = x[part]
        wide = int((rows.max(0) - rows.min(0)).argmax())
        cut = np.argpartition(rows[:, wide], len(part) // 2)
        todo += [part[cut[: len(part) // 2]], part[cut[len(part) // 2 :]]]
    return out


def distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Roots of the sums of squares in the order of coordinates, of rows that broadcast."""
    total = np.zeros(np.broadcast_shapes(q.shape[:-1], t.shape[:-1]))
    for j in range(q.shape[-1]):
        d = q[..., j] - t[..., j]
        total += d * d
    return np.sqrt(total)


@dataclass
class Index:
    """Training rows in the order of their ids; ``same`` numbers equal ids, ``group`` keeps rows of other groups apart."""

    x: np.ndarray
    same: np.ndarray
    group: np.ndarray

    def __post_init__(self):
        self.whole = np.flatnonzero(np.isfinite(self.x).all(1))
        self.holes = np.flatnonzero(~np.isfinite(self.x).all(1))
        w = self.x[self.whole]
        self.parts = [self.whole[p] for p in leaves(w, self.group[self.whole], 256 if w.shape[1] <= FEW else 2048)]
        self.low = np.array([self.x[p].min(0) for p in self.parts]).reshape(len(self.parts), w.shape[1])
        self.high = np.array([self.x[p].max(0) for p in self.parts]).reshape(len(self.parts), w.shape[1])
        self.of = np.array([self.group[p[0]] for p in self.parts], int)
        self.norm = (self.x * self.x).sum(1)

    def search(self, q: np.ndarray, same: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1 for none) and distances of the k nearest of each query: finite ones first, NaN last, ties by position.

        A training row of the query's ``same`` (-1: none) is left out.
        """
        at, d = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        holes = ~np.isfinite(q).all(1)
        whole = np.flatnonzero(~holes)
        for p in leaves(q[whole], group[whole], 256 if q.shape[1] <= FEW else 1024):
            at[whole[p]], d[whole[p]] = self._leaf(q[whole[p]], same[whole[p]], group[whole[p][0]], k)
        if len(self.holes) or holes.any():
            for i in np.flatnonzero(holes | (at < 0).any(1)):
                found = at[i][at[i] >= 0]
                more = np.arange(len(self.x)) if holes[i] else self.holes
                more = more[(self.group[more] == group[i]) & (self.same[more] != same[i])]
                far = distances(q[i][None], self.x[more])
                order = np.lexsort((more, far))[: k - len(found)]
                at[i, len(found) : len(found) + len(order)], d[i, len(found) : len(found) + len(order)] = more[order], far[order]
        return at, d

    def _leaf(self, q: np.ndarray, same: np.ndarray, group: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        m, keep = len(q), k + SPARE
        norm = (q * q).sum(1)
        slack = 1e-14 * (q.shape[1] + 4) * (norm.max() + (self.norm[self.whole].max() if len(self.whole) else 0))
        best, at = np.full((m, keep), np.inf), np.full((m, keep), -1)
        gap = np.maximum(np.maximum(self.low - q.max(0), q.min(0) - self.high), 0)
        bound = np.where(self.of == group, (gap * gap).sum(1), np.inf)
        for b in np.argsort(bound, kind="stable"):
            if not np.isfinite(bound[b]) or bound[b] > best[:, -1].max() + slack:
                break
            part = self.parts[b]
            d2 = self._squares(q, norm, part)
            d2[same[:, None] == self.same[part][None]] = np.inf
            rows = np.flatnonzero((d2 < best[:, -1:]).any(1))
            if not len(rows):
                continue
            both = np.concatenate((best[rows], d2[rows]), 1)
            places = np.concatenate((at[rows], np.broadcast_to(part, (len(rows), len(part)))), 1)
            pick = np.argpartition(both, keep - 1, 1)[:, :keep]
            pick = np.take_along_axis(pick, np.argsort(np.take_along_axis(both, pick, 1), 1), 1)
            best[rows], at[rows] = np.take_along_axis(both, pick, 1), np.take_along_axis(places, pick, 1)
        at[np.isinf(best)] = -1
        out, d = self._exact(q, at, k)
        for i in np.flatnonzero(np.isfinite(best[:, -1]) & (best[:, -1] <= best[:, k - 1] + 2 * slack)):
            every = self.whole[(self.group[self.whole] == group) & (self.same[self.whole] != same[i])]
            out[i], d[i] = (v[0] for v in self._exact(q[i : i + 1], every[None], k))
        return out, d

    def _squares(self, q: np.ndarray, norm: np.ndarray, part: np.ndarray) -> np.ndarray:
        t = self.x[part]
        if q.shape[1] > FEW:
            return norm[:, None] + self.norm[part][None] - 2 * (q @ t.T)
        d2 = np.zeros((len(q), len(t)))
        for j in range(q.shape[1]):
            d = q[:, j][:, None] - t[:, j][None]
            d2 += d * d
        return d2

    def _exact(self, q: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        d = np.where(at < 0, np.inf, distances(q[:, None], self.x[at]))
        order = np.lexsort((at, d), axis=1)[:, :k]
        at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
        if at.shape[1] < k:
            pad = ((0, 0), (0, k - at.shape[1]))
            at, d = np.pad(at, pad, constant_values=-1), np.pad(d, pad, constant_values=np.inf)
        return at, d
