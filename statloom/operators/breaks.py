"""Structural breaks from cumulative moments: one pass gives every prefix, and no segment is refitted from rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.special import f_test_p_value


def _rss(a: np.ndarray) -> float:
    """Residual sum of squares from moments whose last column is the target."""
    x, y = a[:-1, :-1], a[:-1, -1]
    return float(max(a[-1, -1] - y @ np.linalg.lstsq(x, y, rcond=None)[0], 0.0))


def chow_test(df: DataFrame, y: str, features: list[str], order: str, break_at) -> dict:
    """F for a break before the first row whose order value is ``break_at``; an intercept is added."""
    from .gram import _sums, _unpack

    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    shift = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    cols.append(F.col(y).cast("double") - float(shift))
    k = len(cols) - 1
    side = F.col(order) >= F.lit(break_at)
    rows = df.groupBy(side.alias("late")).agg(F.count("*").alias("n"), *_sums(cols, F.lit(1.0))).collect()
    if len(rows) != 2:
        raise InvalidParameter("break_at", "both sides need rows")
    parts = [_unpack(r[2:], k + 1) for r in rows]
    n = sum(r["n"] for r in rows)
    if min(r["n"] for r in rows) <= k:
        raise InvalidParameter("break_at", "each side needs more rows than parameters")
    whole, split = _rss(parts[0] + parts[1]), _rss(parts[0]) + _rss(parts[1])
    f = ((whole - split) / k) / (split / (n - 2 * k))
    return {"f": f, "df1": k, "df2": n - 2 * k, "p_value": f_test_p_value(f, k, n - 2 * k)}


def _series(df: DataFrame, y: str, features: list[str], order: str, by: list[str] | None, f, schema: str) -> DataFrame:
    keys = by or []
    types = dict(df.dtypes)
    full = ", ".join([*(f"{k} {types[k]}" for k in keys), schema])
    names = [p.strip().split(" ")[0] for p in full.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in features]])
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], *row] for row in f(x, pdf[y].to_numpy(float))], columns=names)

    rows = df.select(*keys, order, F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in features])
    rows = rows if keys else rows.withColumn("_series", F.lit(0))
    return rows.groupBy(*(keys or ["_series"])).applyInPandas(run, full)


def recursive_residuals(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Standardised one-step errors from the k-th row on, by rank-one updates of the inverse."""
    n, k = x.shape
    start = k
    while start < n and np.linalg.matrix_rank(x[:start]) < k:
        start += 1
    inv = np.linalg.pinv(x[:start].T @ x[:start])
    b = inv @ x[:start].T @ y[:start]
    out = []
    for t in range(start, n):
        v = inv @ x[t]
        s = 1 + x[t] @ v
        e = y[t] - x[t] @ b
        out.append(e / math.sqrt(s))
        b = b + v * e / s
        inv = inv - np.outer(v, v) / s
    return np.array(out)


def cusum_test(df: DataFrame, y: str, features: list[str], order: str, significance: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """statistic, critical, breaks, break_at (position of the first excess, -1 if none) per series."""
    # Critical constants of the recursive CUSUM boundary.
    constant = {0.01: 1.143, 0.05: 0.948, 0.1: 0.850}.get(significance, 0.948)

    def run(x, t):
        w = recursive_residuals(x, t)
        m = len(w)
        if m < 2 or not w.std(ddof=1):
            return [(0.0, constant, False, -1)]
        path = np.abs(np.cumsum(w) / w.std(ddof=1)) / (math.sqrt(m) * (1 + 2 * np.arange(1, m + 1) / m))
        over = np.flatnonzero(path > constant)
        return [(float(path.max()), constant, bool(len(over)), int(len(t) - m + over[0]) if len(over) else -1)]

    return _series(df, y, features, order, by, run, "statistic double, critical double, breaks boolean, break_at int")


def bai_perron(df: DataFrame, y: str, features: list[str], order: str, max_breaks: int = 5, min_size: int | None = None, by: list[str] | None = None) -> DataFrame:
    """n_breaks, breaks (positions), bic, rss per series: optimal partitions by dynamic programming, the number by BIC."""

    def run(x, t):
        n, k = x.shape
        least = min_size or max(int(0.15 * n), k + 5)
        z = np.column_stack([x, t - t.mean()])
        pre = np.concatenate([np.zeros((1, k + 1, k + 1)), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)])
        cost = {}

        def seg(i, j):
            if (i, j) not in cost:
                cost[i, j] = _rss(pre[j] - pre[i])
            return cost[i, j]

        best = {(0, j): (seg(0, j), []) for j in range(least, n + 1)}
        options = [(0, *best[0, n])] if (0, n) in best else [(0, seg(0, n), [])]
        for m in range(1, max_breaks + 1):
            for j in range((m + 1) * least, n + 1):
                got = [(best[m - 1, i][0] + seg(i, j), i) for i in range(m * least, j - least + 1) if (m - 1, i) in best]
                if got:
                    rss, i = min(got)
                    best[m, j] = (rss, [*best[m - 1, i][1], i])
            if (m, n) not in best:
                break
            options.append((m, *best[m, n]))
        scored = [(n * math.log(max(r, 1e-300) / n) + (k * (m + 1) + m) * math.log(n), m, r, b) for m, r, b in options]
        bic, m, r, b = min(scored, key=lambda s: s[0])
        return [(m, b, bic, r)]

    return _series(df, y, features, order, by, run, "n_breaks int, breaks array<int>, bic double, rss double")
