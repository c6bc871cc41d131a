"""Optimizers on numpy vectors; an objective may itself be a Spark aggregate (``frame_objective``)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame

Objective = Callable[[np.ndarray], float]


def numerical_gradient(f: Objective, x: np.ndarray, h: float = 1e-6) -> np.ndarray:
    g = np.zeros_like(x, float)
    for i in range(len(x)):
        e = np.zeros_like(x, float)
        e[i] = h
        g[i] = (f(x + e) - f(x - e)) / (2 * h)
    return g


def backtracking(f: Objective, x: np.ndarray, g: np.ndarray, d: np.ndarray, step: float = 1.0, shrink: float = 0.5, c: float = 1e-4) -> float:
    fx, slope = f(x), float(g @ d)
    for _ in range(50):
        if f(x + step * d) <= fx + c * step * slope:
            break
        step *= shrink
    return step


def gradient_descent(f: Objective, x0, grad=None, rate: float = 0.1, momentum: float = 0.0, nesterov: bool = False, steps: int = 1000, tol: float = 1e-6) -> np.ndarray:
    x, v = np.array(x0, float), np.zeros(len(x0))
    grad = grad or (lambda z: numerical_gradient(f, z))
    last = f(x)
    for _ in range(steps):
        g = grad(x + momentum * v) if nesterov else grad(x)
        v = momentum * v - rate * g
        x = x + v
        now = f(x)
        if abs(last - now) < tol:
            break
        last = now
    return x


def adam(f: Objective, x0, grad=None, rate: float = 0.1, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, steps: int = 1000, tol: float = 1e-6) -> np.ndarray:
    x, m, v = np.array(x0, float), np.zeros(len(x0)), np.zeros(len(x0))
    grad = grad or (lambda z: numerical_gradient(f, z))
    last = f(x)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
        x = x - rate * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + eps)
        now = f(x)
        if abs(last - now) < tol:
            break
        last = now
    return x


def lbfgs(f: Objective, x0, grad=None, memory: int = 10, steps: int = 200, tol: float = 1e-8) -> np.ndarray:
    x = np.array(x0, float)
    grad = grad or (lambda z: numerical_gradient(f, z))
    g, pairs = grad(x), []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step = backtracking(f, x, g, -q)
        new = x - step * q
        ng = grad(new)
        s, y = new - x, ng - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = np.abs(ng).max() < tol or np.abs(s).max() < tol
        x, g = new, ng
        if done:
            break
    return x


def coordinate_descent(f: Objective, x0, rate: float = 0.01, steps: int = 1000, tol: float = 1e-6, random: bool = False, seed: int = 0) -> np.ndarray:
    x, rng, last = np.array(x0, float), np.random.RandomState(seed), f(np.array(x0, float))
    for _ in range(steps):
        for i in rng.permutation(len(x)) if random else range(len(x)):
            e = np.zeros(len(x))
            e[i] = 1e-6
            x[i] -= rate * (f(x + e) - f(x - e)) / 2e-6
        now = f(x)
        if abs(last - now) < tol:
            break
        last = now
    return x


def frame_objective(df: DataFrame, loss: Callable[[list[float]], Column]) -> Objective:
    """An objective whose every value is one aggregate over all rows."""
    return lambda x: float(df.agg(loss([float(v) for v in x])).first()[0])
