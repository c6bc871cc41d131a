"""Simulated processes: path x step frames from seeded hashes, running sums over each path.

Draws are functions of (seed, path, step), so results depend neither on partitions nor on retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import black_scholes


def uniform(seed: int, *keys: str | Column) -> Column:
    """In (0, 1)."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: str | Column) -> Column:
    """Box-Muller."""
    return F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1_000_003, *keys))


def _grid(spark: SparkSession, paths: int, steps: int) -> DataFrame:
    return spark.range(paths).withColumnRenamed("id", "path").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))


def _running(e: Column) -> Column:
    return F.sum(e).over(Window.partitionBy("path").orderBy("step"))


def brownian_motion(spark: SparkSession, paths: int, t: float, steps: int, mu: float = 0.0, sigma: float = 1.0, x0: float = 0.0, seed: int = 0) -> DataFrame:
    """path, step, t, value; steps + 1 points a path."""
    dt = t / steps
    move = F.when(F.col("step") == 0, F.lit(x0)).otherwise(mu * dt + sigma * math.sqrt(dt) * normal(seed, "path", "step"))
    return _grid(spark, paths, steps).select("path", "step", (F.col("step") * dt).alias("t"), _running(move).alias("value"))


def geometric_brownian_motion(spark: SparkSession, paths: int, t: float, steps: int, s0: float, mu: float, sigma: float, seed: int = 0) -> DataFrame:
    """Exact log steps."""
    b = brownian_motion(spark, paths, t, steps, mu - sigma**2 / 2, sigma, 0.0, seed)
    return b.withColumn("value", s0 * F.exp("value"))


def poisson_process(spark: SparkSession, paths: int, rate: float, t: float, seed: int = 0) -> DataFrame:
    """path, step, arrival: exponential gaps up to time t."""
    most = int(rate * t + 12 * math.sqrt(rate * t) + 30)
    gaps = _grid(spark, paths, most).where("step > 0").select("path", "step", _running(-F.ln(uniform(seed, "path", "step")) / rate).alias("arrival"))
    return gaps.where(F.col("arrival") < t)


def ornstein_uhlenbeck(spark: SparkSession, paths: int, t: float, steps: int, theta: float, mu: float, sigma: float, x0: float = 0.0, seed: int = 0) -> DataFrame:
    """Euler recursion; linear, so each point is a decayed running sum."""
    dt = t / steps
    a = 1 - theta * dt
    noise = F.when(F.col("step") == 0, F.lit(x0 - mu)).otherwise(sigma * math.sqrt(dt) * normal(seed, "path", "step"))
    rows = _grid(spark, paths, steps).withColumn("_e", noise)
    acc = F.collect_list("_e").over(Window.partitionBy("path").orderBy("step"))
    value = F.aggregate(acc, F.lit(0.0), lambda s, e: s * a + e) + mu
    return rows.select("path", "step", (F.col("step") * dt).alias("t"), value.alias("value"))


def heston(spark: SparkSession, paths: int, t: float, steps: int, s0: float, v0: float, mu: float, kappa: float, theta: float, xi: float, rho: float, seed: int = 0) -> DataFrame:
    """path, step, value, variance: full-truncation Euler, folded over each path's draws."""
    dt = t / steps
    base = spark.range(paths).withColumnRenamed("id", "path")
    z = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.struct(normal(seed, F.col("path"), k).alias("a"), normal(seed + 7, F.col("path"), k).alias("b")))
    init = F.array(F.struct(F.lit(float(s0)).alias("s"), F.lit(float(v0)).alias("v")))

    def step(acc: Column, d: Column) -> Column:
        last = F.element_at(acc, -1)
        v = F.greatest(last["v"], F.lit(0.0))
        s = last["s"] * F.exp((mu - v / 2) * dt + F.sqrt(v * dt) * d["a"])
        w = last["v"] + kappa * (theta - v) * dt + xi * F.sqrt(v * dt) * (rho * d["a"] + math.sqrt(1 - rho**2) * d["b"])
        return F.concat(acc, F.array(F.struct(s.alias("s"), w.alias("v"))))

    path = base.select("path", F.posexplode(F.aggregate(z, init, step)).alias("step", "p"))
    return path.select("path", "step", F.col("p.s").alias("value"), F.col("p.v").alias("variance"))


def monte_carlo_price(paths: DataFrame, steps: int, payoff: Column, r: float, t: float) -> DataFrame:
    """price, std_error of exp(-r t) times a payoff over the last values."""
    end = paths.where(F.col("step") == steps).select(payoff.alias("p"))
    d = math.exp(-r * t)
    return end.agg((d * F.avg("p")).alias("price"), (d * F.stddev_samp("p") / F.sqrt(F.count("p"))).alias("std_error"))


def black_scholes_call(s, k, r, sigma, t) -> Column:
    return black_scholes(s, k, r, sigma, t, call=True)


def black_scholes_put(s, k, r, sigma, t) -> Column:
    return black_scholes(s, k, r, sigma, t, call=False)
