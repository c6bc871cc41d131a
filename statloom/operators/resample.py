"""Splits, bootstraps, samplers, synthetic oversampling.

Every random choice is a hash of the id and a seed, so results do not depend on partitioning. Ranks over a whole
table are taken with ``numbered``, which sorts by range and adds per-partition offsets instead of one global window.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..frames import cut_lineage
from .models import nearest


def numbered(df: DataFrame, order: list[str | Column], name: str = "rn") -> DataFrame:
    """df with its position (from 0) in the order; no task sees all rows.

    Range-partitioned and sorted; the partitions' row counts (one number per partition) are summed on the driver.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [F.struct(*cols).alias("_k")]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = df.select("*", *keys).repartitionByRange(n, "_k").sortWithinPartitions("_k").withColumn("_p", F.spark_partition_id())
    parts = cut_lineage(parts)
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offsets, at = [], 0
    for p in range(max(sizes, default=0) + 1):
        offsets.append(F.lit(at).cast("long"))
        at += sizes.get(p, 0)
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
    return parts.withColumn(name, inside + F.element_at(F.array(*offsets), F.col("_p") + 1)).drop("_k", "_p")


def _shuffled(id_column: str, seed: int) -> list[str | Column]:
    return [F.xxhash64(F.col(id_column), F.lit(seed)), id_column]


def kfold(df: DataFrame, id_column: str, k: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """df with ``fold``: contiguous folds of n div k rows, the last takes the rest."""
    if k < 2:
        raise InvalidParameter("k", "at least 2")
    rows = numbered(df, _shuffled(id_column, seed) if shuffle else [id_column])
    size = rows.count() // k
    fold = F.least(F.floor(F.col("rn") / size), F.lit(k - 1)) if size else F.lit(k - 1)
    return rows.withColumn("fold", fold.cast("int")).drop("rn")


def split_fold(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)


def train_test_split(df: DataFrame, id_column: str, test_size: float = 0.25, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """df with ``is_test``: the last round(n * test_size) rows."""
    rows = numbered(df, _shuffled(id_column, seed) if shuffle else [id_column])
    n = rows.count()
    return rows.withColumn("is_test", F.col("rn") >= n - int(n * test_size + 0.5)).drop("rn")


def cross_val_score(df: DataFrame, id_column: str, k: int, score: Callable[[DataFrame, DataFrame], float]) -> list[float]:
    folds = kfold(df, id_column, k)
    return [score(*split_fold(folds, i)) for i in range(k)]


def grid_search(df: DataFrame, id_column: str, k: int, grid: dict[str, list], score: Callable[[DataFrame, DataFrame, dict], float]) -> dict:
    """best_params, best_score, results; the first of equals wins."""
    results = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        scores = cross_val_score(df, id_column, k, lambda a, b, p=params: score(a, b, p))
        results.append({"params": params, "mean_score": sum(scores) / len(scores), "scores": scores})
    best = max(results, key=lambda r: r["mean_score"])
    return {"best_params": best["params"], "best_score": best["mean_score"], "results": results}


# bootstraps: index frames (iteration, draw, id), joined with the data by id


def bootstrap(df: DataFrame, id_column: str, iterations: int, size: int | None = None, seed: int = 0) -> DataFrame:
    """With replacement: each draw is a position hashed from (iteration, draw)."""
    rows = numbered(df.select(id_column), [id_column])
    n = rows.count()
    draws = df.sparkSession.range(iterations * (size or n)).select((F.col("id") % iterations).alias("iteration"), F.floor(F.col("id") / iterations).alias("draw"))
    at = F.pmod(F.xxhash64("iteration", "draw", F.lit(seed)), F.lit(max(n, 1))).alias("rn")
    return draws.select("iteration", "draw", at).join(rows, "rn").select("iteration", "draw", id_column)


def out_of_bag(df: DataFrame, id_column: str, drawn: DataFrame, iterations: int) -> DataFrame:
    every = df.select(id_column).withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    return every.join(drawn.select("iteration", id_column).distinct(), ["iteration", id_column], "left_anti")


def stratified_bootstrap(df: DataFrame, id_column: str, label: str, iterations: int, seed: int = 0) -> DataFrame:
    """As many draws within each class as it has rows."""
    w = Window.partitionBy(label).orderBy(id_column)
    rows = df.select(id_column, label, (F.row_number().over(w) - 1).alias("rn"))
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    draws = sizes.withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long")))).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    draws = draws.withColumn("rn", F.pmod(F.xxhash64(label, "iteration", "draw", F.lit(seed)), "n").cast("int")).drop("n")
    return draws.join(rows, [label, "rn"]).select("iteration", "draw", label, id_column)


def block_bootstrap(df: DataFrame, id_column: str, iterations: int, length: int, seed: int = 0) -> DataFrame:
    """Moving blocks of consecutive rows, cut to n draws."""
    rows = numbered(df.select(id_column), [id_column])
    n = rows.count()
    blocks = -(-n // length)
    starts = df.sparkSession.range(iterations * blocks).select((F.col("id") % iterations).alias("iteration"), F.floor(F.col("id") / iterations).alias("block"))
    start = F.pmod(F.xxhash64("iteration", "block", F.lit(seed)), F.lit(max(n - length + 1, 1)))
    draws = starts.withColumn("s", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    draws = draws.select("iteration", (F.col("block") * length + F.col("k")).alias("draw"), (F.col("s") + F.col("k")).alias("rn")).where(F.col("draw") < n)
    return draws.join(rows, "rn").select("iteration", "draw", id_column)


def balanced_bootstrap(df: DataFrame, id_column: str, iterations: int, seed: int = 0) -> DataFrame:
    """Every id is drawn exactly ``iterations`` times over all iterations: one pool, shuffled, cut into blocks."""
    pool = df.select(id_column).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    n = df.count()
    pool = numbered(pool, [F.xxhash64(id_column, "copy", F.lit(seed)), id_column, "copy"])
    return pool.select(F.floor(F.col("rn") / max(n, 1)).alias("iteration"), (F.col("rn") % max(n, 1)).alias("draw"), id_column)


def jackknife_mean(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, estimate: the mean without each row, from the total less the row's own value."""
    x = F.col(column).cast("double")
    total = df.agg(F.sum(x), F.count(x)).first()
    return df.select(id_column, F.try_divide(F.lit(total[0]) - x, F.lit(float(total[1] - 1))).alias("estimate"))


def bootstrap_ci(df: DataFrame, id_column: str, column: str, iterations: int = 200, level: float = 0.95, statistic: Callable[[Column], Column] = F.avg, seed: int = 0) -> DataFrame:
    """estimate, lower, upper: percentile interval of a statistic given as an aggregate expression."""
    drawn = bootstrap(df, id_column, iterations, seed=seed).join(df.select(id_column, column), id_column)
    reps = drawn.groupBy("iteration").agg(statistic(F.col(column)).alias("s"))
    alpha = (1 - level) / 2
    lo, hi = min(int(iterations * alpha), iterations - 1), min(int(iterations * (1 - alpha)), iterations - 1)
    sorted_reps = F.sort_array(F.collect_list("s"))  # one number per iteration
    est = df.agg(statistic(F.col(column)).alias("estimate"))
    return est.join(F.broadcast(reps.agg(F.get(sorted_reps, F.lit(lo)).alias("lower"), F.get(sorted_reps, F.lit(hi)).alias("upper"))))


# samplers


def reservoir_sample(df: DataFrame, id_column: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, all sets alike; all rows if there are no more."""
    return df.orderBy(F.xxhash64(F.col(id_column), F.lit(seed)), id_column).limit(k)


def stratified_sample(df: DataFrame, id_column: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """round(n * share) rows of each class, one at least."""
    total = df.count()
    sizes = df.groupBy(label).agg(F.greatest(F.round(F.lit(n) * F.count("*") / max(total, 1)), F.lit(1)).alias("_want"))
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(id_column), F.lit(seed)), id_column)
    return df.withColumn("_r", F.row_number().over(w)).join(sizes, label).where("_r <= _want").drop("_r", "_want")


def importance_weights(df: DataFrame, target: Column, proposal: Column, name: str = "weight") -> DataFrame:
    return df.withColumn(name, F.try_divide(target, proposal))


def weighted_sample(df: DataFrame, id_column: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """k draws with replacement by weight: uniform positions on the cumulative weight, found by a sorted union."""
    rows = numbered(df.where(F.col(weight) > 0), [id_column]).withColumn("_w", F.col(weight).cast("double"))
    bucket = F.floor(F.col("rn") / 100_000)
    sums = {r["b"]: r["s"] for r in rows.groupBy(bucket.alias("b")).agg(F.sum("_w").alias("s")).collect()}
    start, at = {}, 0.0
    for b in sorted(sums):
        start[b] = at
        at += sums[b]
    total = at
    if not start:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    base = F.element_at(F.array(*[F.lit(start.get(b, 0.0)) for b in range(int(max(start)) + 1)]), (bucket + 1).cast("int"))
    cum = F.sum("_w").over(Window.partitionBy(bucket).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)) + base
    rows = rows.withColumns({"_hi": cum, "_b": bucket}).withColumn("_lo", F.col("_hi") - F.col("_w"))
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40) * total
    edges = F.array(*[F.lit(start[b]) for b in sorted(start)])
    draws = df.sparkSession.range(k).select(F.col("id").alias("draw"), u.alias("u"))
    draws = draws.withColumn("_b", (F.size(F.filter(edges, lambda e: e <= F.col("u"))) - 1).cast("long"))
    return draws.join(rows, (draws["_b"] == rows["_b"]) & (F.col("u") >= F.col("_lo")) & (F.col("u") < F.col("_hi"))).select("draw", *df.columns)


def smote(df: DataFrame, id_column: str, features: str, label: str, k: int = 5, strategy: str | dict = "auto", seed: int = 0) -> DataFrame:
    """Original rows and synthetic ones (id null, ``synthetic`` true) until each class has its target size.

    auto: as many as the largest class; an int under "all": that size; a dict: sizes by class. Neighbours are those
    of the same class. Only classes that must grow are compared with themselves.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if strategy == "auto":
        want = {c: max(sizes.values()) for c in sizes}
    else:
        want = {c: strategy if isinstance(strategy, int) else strategy.get(c, n) for c, n in sizes.items()}
    need = {c: want[c] - n for c, n in sizes.items() if want[c] > n and n > 1}
    base = df.select(id_column, F.col(features).cast("array<double>").alias(features), label).withColumn("synthetic", F.lit(False))
    if not need:
        return base
    some = base.where(F.col(label).isin(list(need)))
    near = nearest(some, some, k, query_id=id_column, train_id=id_column, features=features, exclude_same=True, by=label)
    lists = near.groupBy(F.col("query_id").alias(id_column)).agg(_ids(F.lit(True))).join(some.select(id_column, label), id_column)
    ranked = lists.withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy(id_column)) - 1)
    spark = df.sparkSession
    new = spark.createDataFrame([(c, n, sizes[c]) for c, n in need.items()], f"{label} {dict(df.dtypes)[label]}, _need long, _size long")
    new = new.withColumn("_draw", F.explode(F.sequence(F.lit(1).cast("long"), "_need")))
    new = new.withColumn("_rn", F.pmod(F.xxhash64(label, "_draw", F.lit(seed)), "_size").cast("int"))
    made = new.join(ranked, [label, "_rn"])
    pick = F.get("_ns", F.pmod(F.xxhash64(label, "_draw", F.lit(seed + 1)), F.size("_ns")).cast("int"))
    alpha = F.pmod(F.xxhash64(label, "_draw", F.lit(seed + 2)), F.lit(1 << 30)) / float(1 << 30)
    made = _between(made.withColumns({"_pick": pick, "_alpha": alpha}), some, id_column, features)
    made = made.select(F.lit(None).cast(dict(df.dtypes)[id_column]).alias(id_column), features, label, F.lit(True).alias("synthetic"))
    return base.unionByName(made)


def _ids(wanted: Column) -> Column:
    """_ns: the ids of the wanted neighbours, nearest first."""
    ranked = F.sort_array(F.collect_list(F.when(wanted, F.struct("rank", "train_id"))))
    return F.transform(ranked, lambda s: s["train_id"]).alias("_ns")


def _between(made: DataFrame, rows: DataFrame, id_column: str, features: str) -> DataFrame:
    """made with the point at ``_alpha`` of the way from the row of id_column to that of ``_pick``."""
    one = rows.groupBy(id_column).agg(F.first(features).alias("_f"))
    made = made.join(one, id_column).join(one.select(F.col(id_column).alias("_pick"), F.col("_f").alias("_p")), "_pick")
    return made.withColumn(features, F.zip_with("_f", "_p", lambda a, b: a + F.col("_alpha") * (b - a)))


def adasyn(df: DataFrame, id_column: str, features: str, label: str, k: int = 5, beta: float = 1.0, seed: int = 0) -> DataFrame:
    """Oversamples the rarest class; rows with more other-class rows among their k nearest get more synthetic ones."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    rare = min(sizes, key=lambda c: (sizes[c], c))
    total = int((max(sizes.values()) - sizes[rare]) * beta)
    base = df.select(id_column, F.col(features).cast("array<double>").alias(features), label).withColumn("synthetic", F.lit(False))
    few = base.where(F.col(label) == rare)
    near = nearest(few, base, k, query_id=id_column, train_id=id_column, features=features, exclude_same=True)
    near = near.join(base.select(F.col(id_column).alias("train_id"), F.col(label).alias("_nl")), "train_id")
    other = F.avg(F.when(F.col("_nl") != rare, 1.0).otherwise(0.0)).alias("_g")
    g = cut_lineage(near.groupBy(F.col("query_id").alias(id_column)).agg(other, _ids(F.col("_nl") == rare)))
    mass = g.agg(F.sum("_g")).first()[0] or 0.0
    if not mass or total <= 0:
        return base
    new = g.withColumn("_n", F.round(F.col("_g") / mass * total).cast("int")).where("_n > 0 and size(_ns) > 0").withColumn("_draw", F.explode(F.sequence(F.lit(1), "_n")))
    pick = F.get("_ns", F.pmod(F.xxhash64(id_column, "_draw", F.lit(seed)), F.size("_ns")).cast("int"))
    alpha = F.pmod(F.xxhash64(id_column, "_draw", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    new = _between(new.withColumns({"_pick": pick, "_alpha": alpha}), base, id_column, features)
    made = new.select(F.lit(None).cast(dict(df.dtypes)[id_column]).alias(id_column), features, F.lit(rare).cast(dict(df.dtypes)[label]).alias(label), F.lit(True).alias("synthetic"))
    return base.unionByName(made)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))
