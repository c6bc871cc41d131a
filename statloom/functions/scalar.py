"""Scalar and array functions as column expressions: activations, losses, kernels, distances, tensors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter

# activations


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(alpha * x)


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * (F.exp(x) - 1))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def swish(x: Column) -> Column:
    return x * sigmoid(x)


def tanh(x: Column) -> Column:
    return F.tanh(x)


def identity(x: Column) -> Column:
    return x


def relu_derivative(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0)


def sigmoid_derivative(x: Column) -> Column:
    return sigmoid(x) * (1 - sigmoid(x))


def tanh_derivative(x: Column) -> Column:
    return 1 - F.tanh(x) * F.tanh(x)


def softmax(a: Column) -> Column:
    """Of an array; shifted by its maximum."""
    e = F.transform(a, lambda v: F.exp(v - F.array_max(a)))
    return F.transform(e, lambda v: v / array_sum(e))


ACTIVATIONS: dict[str, Callable[..., Column]] = {f.__name__: f for f in (relu, leaky_relu, elu, gelu, sigmoid, swish, tanh, softmax, identity)}


def activate(name: str, x: Column, **options) -> Column:
    if name not in ACTIVATIONS:
        raise InvalidParameter("activation", name)
    return ACTIVATIONS[name](x, **options)


# arrays as vectors


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(by))


def dot(a: Column, b: Column) -> Column:
    return array_sum(multiply(a, b))


def matvec(m: Column, v: Column) -> Column:
    """m: array of rows."""
    return F.transform(m, lambda row: dot(row, v))


def matmul(a: Column, b: Column) -> Column:
    bt = transpose(b)
    return F.transform(a, lambda row: F.transform(bt, lambda c: dot(row, c)))


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def trace(m: Column) -> Column:
    return array_sum(F.transform(m, lambda row, i: F.get(row, i)))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def eye(n: int) -> Column:
    k = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(k, lambda i: F.transform(k, lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def reshape(a: Column, rows: int, cols: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(a, i * cols + 1, cols))


def l1_norm(a: Column) -> Column:
    return array_sum(F.transform(a, F.abs))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def max_norm(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def argmax(a: Column) -> Column:
    """Position of the first maximum, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    m = array_mean(a)
    var = array_mean(F.transform(a, lambda v: (v - m) * (v - m)))
    return F.transform(a, lambda v: (v - m) / F.sqrt(var + eps))


# distances and kernels


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(array_sum(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


DISTANCES = {"euclidean": euclidean, "manhattan": manhattan, "minkowski": minkowski}


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial_kernel(a: Column, b: Column, degree: int = 3, coef0: float = 1.0) -> Column:
    return F.pow(dot(a, b) + coef0, F.lit(max(degree, 1)))


def rbf_kernel(a: Column, b: Column, gamma: float = 1.0) -> Column:
    d = euclidean(a, b)
    return F.exp(-gamma * d * d)


def gaussian_kernel(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


# losses over (y, p) columns, as aggregates


def mse_loss(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae_loss(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def bce_loss(y: Column, p: Column, eps: float = 1e-10) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def cross_entropy_loss(y: Column, p: Column, eps: float = 1e-10) -> Column:
    """y, p: arrays over classes, one row per sample."""
    return F.avg(-array_sum(F.zip_with(y, p, lambda a, b: a * F.ln(b + eps))))


def focal_loss(y: Column, p: Column, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-10) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    pt = F.when(y > 0.5, q).otherwise(1 - q)
    weight = F.when(y > 0.5, alpha).otherwise(1 - alpha)
    return F.avg(-weight * F.pow(1 - pt, F.lit(gamma)) * F.ln(pt))


def huber_loss(y: Column, p: Column, delta: float = 1.0) -> Column:
    d = F.abs(y - p)
    return F.avg(F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta)))


# penalties over a column of weights


def l1_penalty(w: Column, lam: float) -> Column:
    return lam * F.sum(F.abs(w))


def l2_penalty(w: Column, lam: float) -> Column:
    return lam / 2 * F.sum(w * w)


def elastic_net_penalty(w: Column, l1: float, l2: float) -> Column:
    return l1_penalty(w, l1) + l2_penalty(w, l2)


# finance


def black_scholes(s: Column, k: Column, r: Column, sigma: Column, t: Column, call: bool = True) -> Column:
    """Price of a European option."""
    from .special import column, normal_cdf

    d1 = (F.ln(s / k) + (r + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    d2 = d1 - sigma * F.sqrt(t)
    n = lambda x: column(normal_cdf, x)
    if call:
        return s * n(d1) - k * F.exp(-r * t) * n(d2)
    return k * F.exp(-r * t) * n(-d2) - s * n(-d1)
