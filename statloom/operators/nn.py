"""Neural building blocks: schedules as column expressions, updates and layers in numpy inside tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter

# learning-rate schedules: functions of a step column


def cosine_annealing(step: Column, lr: float, t_max: int, lr_min: float = 0.0, restarts: bool = False) -> Column:
    """With restarts each cycle is twice as long as the last."""
    if restarts:
        k = F.floor(F.log2(step / t_max + 1))
        begin = t_max * (F.pow(F.lit(2.0), k) - 1)
        return lr_min + (lr - lr_min) * (1 + F.cos(math.pi * (step - begin) / (t_max * F.pow(F.lit(2.0), k)))) / 2
    return lr_min + (lr - lr_min) * (1 + F.cos(math.pi * F.least(step, F.lit(t_max)) / t_max)) / 2


def one_cycle(step: Column, lr_max: float, total: int, start: float = 0.3, div: float = 25.0, final_div: float = 1e4) -> Column:
    up = start * total
    low, end = lr_max / div, lr_max / final_div
    return F.when(step <= up, low + (lr_max - low) * step / up).otherwise(lr_max + (end - lr_max) * F.least((step - up) / (total - up), F.lit(1.0)))


def step_decay(step: Column, lr: float, size: int, gamma: float = 0.1) -> Column:
    return lr * F.pow(F.lit(gamma), F.floor(step / size))


def exponential_decay(step: Column, lr: float, gamma: float) -> Column:
    return lr * F.pow(F.lit(gamma), step)


def polynomial_decay(step: Column, lr: float, total: int, power: float = 1.0, end: float = 0.0) -> Column:
    return end + (lr - end) * F.pow(1 - F.least(step, F.lit(total)) / total, F.lit(power))


def warmup(step: Column, lr: float, steps: int) -> Column:
    return F.when(step < steps, lr * (step + 1) / steps).otherwise(F.lit(lr))


def plateau(metrics: Column, lr: float, factor: float = 0.1, patience: int = 10, threshold: float = 1e-4, lower: bool = True) -> Column:
    """Rates after each entry of an array of metrics: a fold with (best, waiting, rate, rates)."""
    worst = float("inf") if lower else float("-inf")
    zero = F.struct(F.lit(worst).alias("best"), F.lit(0).alias("wait"), F.lit(float(lr)).alias("lr"), F.array().cast("array<double>").alias("out"))

    def move(s: Column, m: Column) -> Column:
        better = m < s["best"] - threshold if lower else m > s["best"] + threshold
        wait = F.when(better, 0).otherwise(s["wait"] + 1)
        cut = wait > patience
        rate = F.when(cut, s["lr"] * factor).otherwise(s["lr"])
        return F.struct(F.when(better, m).otherwise(s["best"]).alias("best"), F.when(cut, 0).otherwise(wait).alias("wait"), rate.alias("lr"), F.concat(s["out"], F.array(rate)).alias("out"))

    return F.aggregate(metrics, zero, move, lambda s: s["out"])


def positional_encoding(spark: SparkSession, length: int, width: int) -> DataFrame:
    """pos, dim, value: sine for even, cosine for odd dimensions of one frequency."""
    rows = spark.range(length).withColumnRenamed("id", "pos").withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    angle = F.col("pos") / F.pow(F.lit(10000.0), 2 * F.floor(F.col("dim") / 2) / width)
    return rows.withColumn("value", F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)))


def causal_mask(spark: SparkSession, n: int) -> DataFrame:
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return rows.withColumn("mask", F.when(F.col("j") <= F.col("i"), 1.0).otherwise(0.0))


def dropout(x: Column, rate: float, key: Column, seed: int = 0) -> Column:
    from .stochastic import uniform

    if not 0 <= rate < 1:
        raise InvalidParameter("rate", "in [0, 1)")
    return F.when(uniform(seed, key) >= rate, x / (1 - rate)).otherwise(0.0)


def batch_norm(df: DataFrame, column: str, by: list[str] | None = None, eps: float = 1e-5, name: str = "normed") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*(by or []))
    x = F.col(column).cast("double")
    return df.withColumn(name, (x - F.avg(x).over(w)) / F.sqrt(F.var_pop(x).over(w) + eps))


# optimizers: step(params, grads) on one array; state kept between calls


class Optimizer:
    """kind: sgd, adam, adamw, radam, lamb, rmsprop, adagrad, adadelta, nadam, amsgrad."""

    def __init__(self, kind: str = "sgd", rate: float = 0.01, momentum: float = 0.0, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.0, rho: float = 0.9):
        if not hasattr(self, f"_{kind}"):
            raise InvalidParameter("kind", kind)
        self.kind, self.rate, self.momentum, self.b1, self.b2, self.eps, self.decay, self.rho = kind, rate, momentum, b1, b2, eps, decay, rho
        self.t, self.m, self.v, self.top = 0, 0.0, 0.0, 0.0

    def step(self, x, g) -> np.ndarray:
        self.t += 1
        x, g = np.asarray(x, float), np.asarray(g, float)
        return x - getattr(self, f"_{self.kind}")(x, g)

    def _moments(self, g):
        self.m = self.b1 * self.m + (1 - self.b1) * g
        self.v = self.b2 * self.v + (1 - self.b2) * g * g
        return self.m / (1 - self.b1**self.t), self.v / (1 - self.b2**self.t)

    def _sgd(self, x, g):
        self.m = self.momentum * self.m + g + self.decay * x
        return self.rate * self.m

    def _adam(self, x, g):
        m, v = self._moments(g + self.decay * x)
        return self.rate * m / (np.sqrt(v) + self.eps)

    def _adamw(self, x, g):
        m, v = self._moments(g)
        return self.rate * (m / (np.sqrt(v) + self.eps) + self.decay * x)

    def _nadam(self, x, g):
        m, v = self._moments(g)
        return self.rate * (self.b1 * m + (1 - self.b1) * g / (1 - self.b1**self.t)) / (np.sqrt(v) + self.eps)

    def _amsgrad(self, x, g):
        m, v = self._moments(g)
        self.top = np.maximum(self.top, v)
        return self.rate * m / (np.sqrt(self.top) + self.eps)

    def _radam(self, x, g):
        m, v = self._moments(g)
        last = 2 / (1 - self.b2) - 1
        r = last - 2 * self.t * self.b2**self.t / (1 - self.b2**self.t)
        if r <= 4:
            return self.rate * m
        fix = math.sqrt((r - 4) * (r - 2) * last / ((last - 4) * (last - 2) * r))
        return self.rate * fix * m / (np.sqrt(v) + self.eps)

    def _lamb(self, x, g):
        m, v = self._moments(g)
        u = m / (np.sqrt(v) + self.eps) + self.decay * x
        a, b = np.linalg.norm(x), np.linalg.norm(u)
        return self.rate * (a / b if a > 0 and b > 0 else 1.0) * u

    def _rmsprop(self, x, g):
        self.v = self.rho * self.v + (1 - self.rho) * g * g
        return self.rate * g / (np.sqrt(self.v) + self.eps)

    def _adagrad(self, x, g):
        self.v = self.v + g * g
        return self.rate * g / (np.sqrt(self.v) + self.eps)

    def _adadelta(self, x, g):
        self.v = self.rho * self.v + (1 - self.rho) * g * g
        d = np.sqrt(self.m + self.eps) / np.sqrt(self.v + self.eps) * g
        self.m = self.rho * self.m + (1 - self.rho) * d * d
        return d


# layers and a feed-forward network; autograd for small graphs

_ACT = {"relu": lambda z: np.maximum(z, 0), "tanh": np.tanh, "sigmoid": lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40))), "identity": lambda z: z}
_DER = {"relu": lambda a: (a > 0).astype(float), "tanh": lambda a: 1 - a * a, "sigmoid": lambda a: a * (1 - a), "identity": np.ones_like}


class Dense:
    def __init__(self, n_in: int, n_out: int, activation: str = "identity", init: str = "xavier", seed: int = 0):
        scale = math.sqrt(2 / n_in) if init == "he" else math.sqrt(2 / (n_in + n_out))
        self.w, self.b, self.activation = np.random.RandomState(seed).normal(0, scale, (n_in, n_out)), np.zeros(n_out), activation

    def forward(self, x):
        self.x = x
        self.a = _ACT[self.activation](x @ self.w + self.b)
        return self.a

    def backward(self, g):
        g = g * _DER[self.activation](self.a)
        self.gw, self.gb = self.x.T @ g, g.sum(0)
        return g @ self.w.T


class Sequential:
    """Mean squared error; trained on arrays, or on all rows of a frame; applied to frames batch by batch."""

    def __init__(self, layers: list[Dense], optimizer: dict | None = None):
        self.layers, self.options = layers, optimizer or {"kind": "adam", "rate": 0.01}

    def forward(self, x):
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def fit(self, x, y, epochs: int = 100, batch: int = 32, seed: int = 0) -> list[float]:
        x, y = np.asarray(x, float), np.asarray(y, float).reshape(len(x), -1)
        rng, losses = np.random.RandomState(seed), []
        opts = [(Optimizer(**self.options), Optimizer(**self.options)) for _ in self.layers]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                g = 2 * (self.forward(x[at]) - y[at]) / len(at)
                for layer, (ow, ob) in zip(reversed(self.layers), reversed(opts), strict=True):
                    g = layer.backward(g)
                    layer.w, layer.b = ow.step(layer.w, layer.gw), ob.step(layer.b, layer.gb)
            losses.append(float(((self.forward(x) - y) ** 2).mean()))
        return losses

    def fit_frame(self, df: DataFrame, features: str, target: str, epochs: int = 100) -> list[float]:
        """Gradient steps over all rows without missing values: tasks return sums of gradients, the driver adds and steps. Losses before each step."""
        rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).where("x is not null and y is not null and not isnan(y)")
        opts = [(Optimizer(**self.options), Optimizer(**self.options)) for _ in self.layers]
        losses = []
        for _ in range(epochs):
            layers = self.layers

            def run(batches, layers=layers):
                total, n, loss = None, 0, 0.0
                for pdf in batches:
                    if not len(pdf):
                        continue
                    out = np.stack(pdf["x"].to_numpy())
                    for layer in layers:
                        out = layer.forward(out)
                    g = out - pdf["y"].to_numpy().reshape(len(pdf), -1)
                    n, loss = n + len(pdf), loss + float((g * g).sum())
                    g, grads = 2 * g, []
                    for layer in reversed(layers):
                        g = layer.backward(g)
                        grads += [layer.gw.ravel(), layer.gb]
                    flat = np.concatenate(grads)
                    total = flat if total is None else total + flat
                if n:
                    yield pd.DataFrame({"n": [n], "loss": [loss], "g": [total]})

            got = rows.mapInPandas(run, "n long, loss double, g array<double>").toPandas()
            n = got["n"].sum()
            if not n:
                break
            losses.append(float(got["loss"].sum() / n))
            g, at = np.sum(np.stack(got["g"].to_numpy()), axis=0) / n, 0
            for layer, (ow, ob) in zip(reversed(self.layers), reversed(opts), strict=True):
                gw = g[at : at + layer.w.size].reshape(layer.w.shape)
                gb = g[at + layer.w.size : at + layer.w.size + layer.b.size]
                at += layer.w.size + layer.b.size
                layer.w, layer.b = ow.step(layer.w, gw), ob.step(layer.b, gb)
        return losses

    def predict(self, df: DataFrame, features: str, name: str = "prediction") -> DataFrame:
        model = self

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(list(model.forward(np.stack(s.to_numpy()))))

        return df.withColumn(name, run(F.col(features).cast("array<double>")))


def attention(q, k, v, mask=None) -> np.ndarray:
    """Scaled dot product; mask entries of 0 are left out."""
    s = q @ np.swapaxes(k, -1, -2) / math.sqrt(q.shape[-1])
    if mask is not None:
        s = np.where(mask > 0, s, -1e9)
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True) @ v


def layer_norm(x, eps: float = 1e-5):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


class MultiHeadAttention:
    def __init__(self, width: int, heads: int, seed: int = 0):
        if width % heads:
            raise InvalidParameter("heads", "must divide the width")
        rng = np.random.RandomState(seed)
        self.heads, (self.wq, self.wk, self.wv, self.wo) = heads, [rng.normal(0, 1 / math.sqrt(width), (width, width)) for _ in range(4)]

    def forward(self, q, k=None, v=None, mask=None):
        k, v = q if k is None else k, (q if k is None else k) if v is None else v
        cut = lambda x: np.stack(np.split(x, self.heads, axis=-1))
        out = attention(cut(q @ self.wq), cut(k @ self.wk), cut(v @ self.wv), mask)
        return np.concatenate(list(out), axis=-1) @ self.wo


class TransformerLayer:
    """Encoder layer, or with ``memory`` decoder layer; normalised after each part."""

    def __init__(self, width: int, heads: int, hidden: int, seed: int = 0):
        self.own, self.cross = MultiHeadAttention(width, heads, seed), MultiHeadAttention(width, heads, seed + 1)
        self.up, self.down = Dense(width, hidden, "relu", "he", seed + 2), Dense(hidden, width, seed=seed + 3)

    def forward(self, x, memory=None, mask=None):
        x = layer_norm(x + self.own.forward(x, mask=mask))
        if memory is not None:
            x = layer_norm(x + self.cross.forward(x, memory))
        return layer_norm(x + self.down.forward(self.up.forward(x)))


class Recurrent:
    """LSTM or GRU over one sequence (steps x inputs); returns all hidden states."""

    def __init__(self, kind: str, n_in: int, n_hidden: int, seed: int = 0):
        gates = {"lstm": 4, "gru": 3}[kind]
        rng = np.random.RandomState(seed)
        self.kind, self.h = kind, n_hidden
        self.w, self.u, self.b = rng.normal(0, 0.1, (gates, n_in, n_hidden)), rng.normal(0, 0.1, (gates, n_hidden, n_hidden)), np.zeros((gates, n_hidden))

    def forward_sequence(self, xs):
        h, c, out = np.zeros(self.h), np.zeros(self.h), []
        sig = _ACT["sigmoid"]
        for x in np.asarray(xs, float):
            z = [x @ w + b for w, b in zip(self.w, self.b, strict=True)]
            if self.kind == "lstm":
                i, f, o, g = (z[k] + h @ self.u[k] for k in range(4))
                c = sig(f) * c + sig(i) * np.tanh(g)
                h = sig(o) * np.tanh(c)
            else:
                r, u = sig(z[0] + h @ self.u[0]), sig(z[1] + h @ self.u[1])
                h = (1 - u) * h + u * np.tanh(z[2] + (r * h) @ self.u[2])
            out.append(h)
        return np.array(out)


class VAE:
    def __init__(self, n_in: int, hidden: int, latent: int, seed: int = 0):
        self.enc, self.mu, self.lv = Dense(n_in, hidden, "relu", "he", seed), Dense(hidden, latent, seed=seed + 1), Dense(hidden, latent, seed=seed + 2)
        self.dec, self.out, self.seed = Dense(latent, hidden, "relu", "he", seed + 3), Dense(hidden, n_in, "sigmoid", seed=seed + 4), seed

    def encode(self, x):
        h = self.enc.forward(np.asarray(x, float))
        return self.mu.forward(h), self.lv.forward(h)

    def reparameterize(self, mu, lv):
        return mu + np.exp(lv / 2) * np.random.RandomState(self.seed).normal(size=mu.shape)

    def decode(self, z):
        return self.out.forward(self.dec.forward(z))

    def loss(self, x) -> float:
        mu, lv = self.encode(x)
        p = np.clip(self.decode(self.reparameterize(mu, lv)), 1e-10, 1 - 1e-10)
        rec = -(x * np.log(p) + (1 - x) * np.log(1 - p)).sum(1).mean()
        return float(rec - 0.5 * (1 + lv - mu**2 - np.exp(lv)).sum(1).mean())


class GAN:
    def __init__(self, latent: int, hidden: list[int], n_out: int, seed: int = 0):
        sizes = [latent, *hidden]
        self.generator = [Dense(a, b, "relu", "he", seed + i) for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))] + [Dense(sizes[-1], n_out, "tanh", seed=seed + 50)]
        back = [n_out, *reversed(hidden)]
        self.discriminator = [Dense(a, b, "relu", "he", seed + 100 + i) for i, (a, b) in enumerate(zip(back, back[1:], strict=False))] + [Dense(back[-1], 1, "sigmoid", seed=seed + 150)]

    def generate(self, z):
        for layer in self.generator:
            z = layer.forward(z)
        return z

    def judge(self, x):
        for layer in self.discriminator:
            x = layer.forward(x)
        return x


class Tensor:
    """Reverse-mode differentiation over numpy arrays: +, *, @, relu, sigmoid, sum, mean."""

    def __init__(self, data, parents=(), back=None):
        self.data, self.grad, self._parents, self._back = np.asarray(data, float), None, parents, back

    def _make(self, data, parents, back):
        return Tensor(data, parents, back)

    @staticmethod
    def _fit(g, shape):
        while g.ndim > len(shape):
            g = g.sum(0)
        for i, n in enumerate(shape):
            if n == 1 and g.shape[i] != 1:
                g = g.sum(i, keepdims=True)
        return g

    def __add__(self, o):
        o = o if isinstance(o, Tensor) else Tensor(o)
        return self._make(self.data + o.data, (self, o), lambda g: (self._fit(g, self.data.shape), self._fit(g, o.data.shape)))

    def __mul__(self, o):
        o = o if isinstance(o, Tensor) else Tensor(o)
        return self._make(self.data * o.data, (self, o), lambda g: (self._fit(g * o.data, self.data.shape), self._fit(g * self.data, o.data.shape)))

    def __matmul__(self, o):
        return self._make(self.data @ o.data, (self, o), lambda g: (g @ o.data.T, self.data.T @ g))

    def relu(self):
        return self._make(np.maximum(self.data, 0), (self,), lambda g: (g * (self.data > 0),))

    def sigmoid(self):
        s = 1 / (1 + np.exp(-self.data))
        return self._make(s, (self,), lambda g: (g * s * (1 - s),))

    def sum(self):
        return self._make(self.data.sum(), (self,), lambda g: (np.broadcast_to(g, self.data.shape),))

    def mean(self):
        return self._make(self.data.mean(), (self,), lambda g: (np.broadcast_to(g / self.data.size, self.data.shape),))

    def zero_grad(self):
        self.grad = None

    def backward(self):
        order, seen = [], set()

        def visit(t):
            if id(t) not in seen:
                seen.add(id(t))
                for p in t._parents:
                    visit(p)
                order.append(t)

        visit(self)
        self.grad = np.ones_like(self.data)
        for t in reversed(order):
            if t._back:
                for p, g in zip(t._parents, t._back(t.grad), strict=True):
                    p.grad = g if p.grad is None else p.grad + g
