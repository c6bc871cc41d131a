"""Reinforcement learning over frames of transitions: returns and advantages as folds, tables updated in order per task."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scan(gamma: float):
    """Streams rows whose groups come whole, last step first: ret = r + gamma times the ret of the row before, but at a start."""

    def run(batches):
        carry = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column("start").to_numpy(zero_copy_only=False).astype(bool)
            steps = zip(batch.column("r").to_pylist(), np.where(start, 0.0, gamma).tolist(), strict=True)
            ret = list(accumulate(steps, lambda g, x: x[0] + x[1] * g, initial=carry))[1:]
            carry = ret[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ret, pa.float64())], names=["by", "order", "ret"])

    return run


def discounted_returns(df: DataFrame, by: str, order: str, reward: str, gamma: float = 0.99, done: str | None = None) -> DataFrame:
    """by, order, ret: reward plus gamma times what follows, starting anew after ``done``.

    One sort by (by, order); the recursion runs through Arrow batches with one number carried, so a long episode streams through its task.
    """
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) == 1
    start = last | F.coalesce(F.col(done).cast("boolean"), F.lit(False)) if done else last
    rows = df.select(F.col(by).alias("by"), F.col(order).alias("order"), F.coalesce(F.col(reward).cast("double"), F.lit(0.0)).alias("r"), start.alias("start"))
    kinds = dict(df.dtypes)
    return rows.mapInArrow(_scan(gamma), f"by {kinds[by]}, order {kinds[order]}, ret double").toDF(by, order, "ret")


def generalized_advantage(df: DataFrame, by: str, order: str, reward: str, value: str, gamma: float = 0.99, lam: float = 0.95, done: str | None = None) -> DataFrame:
    """by, order, advantage."""
    w = Window.partitionBy(by).orderBy(order)
    d = F.col(done).cast("boolean") if done else F.lit(False)
    delta = F.col(reward).cast("double") + F.when(d, 0.0).otherwise(gamma * F.coalesce(F.lead(F.col(value).cast("double")).over(w), F.lit(0.0))) - F.col(value).cast("double")
    rows = df.select(by, order, delta.alias("_delta"), d.alias("_done"))
    return discounted_returns(rows, by, order, "_delta", gamma * lam, "_done").withColumnRenamed("ret", "advantage")


def transitions(events: DataFrame, user: str, ts: str, state: str, reward: str) -> DataFrame:
    """s, a (the next state reached), r, s2, done of consecutive events of one user."""
    w = Window.partitionBy(user).orderBy(ts, state)
    nxt = F.lead(state).over(w)
    return events.select(user, ts, F.col(state).alias("s"), F.col(reward).cast("double").alias("r"), nxt.alias("s2"), nxt.isNull().alias("done"))


class QLearning:
    """Tabular Q by user-defined keys; fold() applies transitions in order, one table per group."""

    def __init__(self, states: int, actions: int, alpha: float = 0.1, gamma: float = 0.99, epsilon: float = 0.1, seed: int = 0):
        self.q, self.alpha, self.gamma, self.epsilon, self.rng = np.zeros((states, actions)), alpha, gamma, epsilon, np.random.RandomState(seed)

    def greedy(self, s: int) -> int:
        return int(self.q[s].argmax())

    def select(self, s: int) -> int:
        return int(self.rng.randint(self.q.shape[1])) if self.rng.rand() < self.epsilon else self.greedy(s)

    def update(self, s: int, a: int, r: float, s2: int, done: bool) -> None:
        goal = r + (0.0 if done else self.gamma * self.q[s2].max())
        self.q[s, a] += self.alpha * (goal - self.q[s, a])

    def decay(self, factor: float, least: float = 0.01) -> None:
        self.epsilon = max(self.epsilon * factor, least)

    def fold(self, df: DataFrame, by: str, order: str) -> DataFrame:
        """df: by, order, s, a, r, s2, done (integers but r). by, s, a, q."""
        states, actions = self.q.shape
        alpha, gamma = self.alpha, self.gamma
        kind = dict(df.dtypes)[by]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            t = QLearning(states, actions, alpha, gamma)
            for r in pdf.sort_values(order).itertuples():
                t.update(int(r.s), int(r.a), float(r.r), int(r.s2), bool(r.done))
            s, a = np.indices(t.q.shape)
            return pd.DataFrame({by: pdf[by].iloc[0], "s": s.ravel(), "a": a.ravel(), "q": t.q.ravel()})

        return df.groupBy(by).applyInPandas(run, f"{by} {kind}, s int, a int, q double")


def replay_buffer(df: DataFrame, order: str, capacity: int) -> DataFrame:
    """The last ``capacity`` rows."""
    return df.orderBy(F.desc(order)).limit(capacity)


def prioritized_weights(df: DataFrame, priority: str, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """df with prob and weight, the largest weight being 1.

    As in SQL over doubles: a priority of 0 has an infinite weight before scaling, so that it becomes NaN and all others 0;
    NaN also where all priorities are 0 or one is negative. A missing priority has neither prob nor weight.
    """
    p = F.pow(F.col(priority).cast("double"), F.lit(alpha))
    total = df.agg(F.sum(p).alias("s"), F.count("*").alias("n"), F.min(p).alias("least")).first()
    if total["s"] is None:
        return df.withColumns({"prob": p, "weight": p})
    prob = p / total["s"] if total["s"] else p * float("nan")
    least = total["n"] * total["least"] / total["s"] if total["s"] else float("nan")
    top = least**-beta if least else float("inf")
    return df.withColumns({"prob": prob, "weight": F.pow(total["n"] * prob, F.lit(-beta)) / top})


class DQN:
    """Linear action values with a target copy and a bounded memory."""

    def __init__(self, n_state: int, n_action: int, rate: float = 0.01, gamma: float = 0.99, epsilon: float = 0.1, capacity: int = 10_000, seed: int = 0):
        rng = np.random.RandomState(seed)
        self.w, self.rate, self.gamma, self.epsilon, self.capacity, self.rng = rng.normal(0, 0.01, (n_state, n_action)), rate, gamma, epsilon, capacity, rng
        self.target, self.memory = self.w.copy(), []

    def q_values(self, s):
        return np.asarray(s, float) @ self.w

    def select(self, s) -> int:
        return int(self.rng.randint(self.w.shape[1])) if self.rng.rand() < self.epsilon else int(self.q_values(s).argmax())

    def remember(self, *step) -> None:
        self.memory = [*self.memory, step][-self.capacity :]

    def train(self, batch: int = 32) -> None:
        for k in self.rng.randint(len(self.memory), size=min(batch, len(self.memory))):
            s, a, r, s2, done = self.memory[k]
            goal = r + (0 if done else self.gamma * (np.asarray(s2, float) @ self.target).max())
            self.w[:, a] += self.rate * (goal - self.q_values(s)[a]) * np.asarray(s, float)

    def update_target(self) -> None:
        self.target = self.w.copy()


class Policy:
    """Softmax (kind ppo, a2c), deterministic with clipped noise (td3) or squashed Gaussian (sac) over linear scores."""

    def __init__(self, n_state: int, n_action: int, kind: str = "ppo", noise: float = 0.1, seed: int = 0):
        self.rng = np.random.RandomState(seed)
        self.w, self.kind, self.noise = self.rng.normal(0, 0.1, (n_state, n_action)), kind, noise

    def select_action(self, s, explore: bool = True):
        z = np.asarray(s, float) @ self.w
        if self.kind in ("ppo", "a2c"):
            p = np.exp(z - z.max())
            p /= p.sum()
            a = int(self.rng.choice(len(p), p=p)) if explore else int(p.argmax())
            return a, float(np.log(p[a]))
        if self.kind == "td3":
            a = np.tanh(z) + (np.clip(self.rng.normal(0, self.noise, len(z)), -0.5, 0.5) if explore else 0)
            return np.clip(a, -1, 1)
        return np.tanh(z + (self.noise * self.rng.normal(size=len(z)) if explore else 0))
