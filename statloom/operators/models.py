"""Classifiers and regressors beside linear models: naive Bayes, neighbours, trees, ensembles, support vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..frames import check, cut_lineage
from ..functions.scalar import DISTANCES, linear_kernel, polynomial_kernel, rbf_kernel

#: Rows of training points that may be broadcast for exact neighbour search; more are matched in blocks.
BROADCAST_ROWS = 50_000


class GaussianNB:
    """Population variances plus 1e-9; the smallest class wins ties. Parameters: one row per class and feature."""

    def __init__(self, features: list[str], label: str):
        self.features, self.label = features, label

    def fit(self, df: DataFrame) -> GaussianNB:
        check(df, self.features)
        aggs = [a for c in self.features for a in (F.avg(F.col(c).cast("double")), F.var_pop(F.col(c).cast("double")))]
        rows = df.where(F.col(self.label).isNotNull()).groupBy(self.label).agg(F.count("*"), *aggs).orderBy(self.label).collect()
        n = sum(r[1] for r in rows)
        self.classes = [(r[0], r[1] / n, [(r[2 + 2 * i], r[3 + 2 * i] + 1e-9) for i in range(len(self.features))]) for r in rows]
        return self

    def log_joint(self) -> list[Column]:
        out = []
        for _, prior, params in self.classes:
            s = F.lit(math.log(prior))
            for c, (m, v) in zip(self.features, params, strict=True):
                d = F.col(c).cast("double") - F.lit(m)
                s = s - 0.5 * math.log(2 * math.pi * v) - d * d / (2 * v)
            out.append(s)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, _best(self.log_joint(), [c for c, _, _ in self.classes]))

    def predict_log_proba(self, df: DataFrame, name: str = "log_proba") -> DataFrame:
        return df.withColumn(name, _log_normalised(F.array(*self.log_joint())))

    def predict_proba(self, df: DataFrame, name: str = "proba") -> DataFrame:
        return df.withColumn(name, F.transform(_log_normalised(F.array(*self.log_joint())), F.exp))

    def score(self, df: DataFrame) -> float:
        return self.predict(df, "_p").agg(F.avg((F.col("_p") == F.col(self.label)).cast("double"))).first()[0]


def _best(scores: list[Column], values: list) -> Column:
    a = F.array(*scores)
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.array_position(a, F.array_max(a)).cast("int"))


def _log_normalised(a: Column) -> Column:
    top = F.array_max(a)
    z = top + F.ln(F.aggregate(F.transform(a, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))
    return F.transform(a, lambda v: v - z)


class MultinomialNB:
    """ln((count + alpha) / (total + alpha d)) per class and feature; unsmoothed priors."""

    def __init__(self, features: list[str], label: str, alpha: float = 1.0):
        self.features, self.label, self.alpha = features, label, alpha

    def fit(self, df: DataFrame) -> MultinomialNB:
        check(df, self.features)
        rows = df.groupBy(self.label).agg(F.count("*"), *[F.sum(F.col(c).cast("double")) for c in self.features]).orderBy(self.label).collect()
        n, d = sum(r[1] for r in rows), len(self.features)
        self.classes = []
        for r in rows:
            total = sum(r[2:]) + self.alpha * d
            self.classes.append((r[0], math.log(r[1] / n), [math.log((x + self.alpha) / total) for x in r[2:]]))
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        scores = [sum((F.col(c).cast("double") * w for c, w in zip(self.features, ws, strict=True)), F.lit(p)) for _, p, ws in self.classes]
        return df.withColumn(name, _best(scores, [c for c, _, _ in self.classes]))


def nearest(queries: DataFrame, train: DataFrame, k: int, *, query_id: str = "query_id", train_id: str = "train_id", features: str = "features", metric: str = "euclidean", p: float = 3.0, exclude_same: bool = False, by: str | None = None) -> DataFrame:
    """query_id, train_id, distance, rank: exact k nearest; ties go to the smaller train id. With ``by`` only rows of equal ``by`` are compared.

    The training side is broadcast if a count shows it small; otherwise it is dealt into blocks of that size, every
    block gives each query its k nearest, and the blocks' answers are merged. Euclidean neighbours are searched in numpy,
    where distances that are not numbers come last; no pair leaves its task but the k nearest.
    """
    if metric not in DISTANCES:
        raise InvalidParameter("metric", metric)
    group = F.lit(0) if by is None else F.col(by)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(features).cast("array<double>").alias("_q"), group.alias("_qg"))
    t = train.select(F.col(train_id).alias("train_id"), F.col(features).cast("array<double>").alias("_t"), group.alias("_tg"))
    if exclude_same:
        q, t = q.where("query_id is not null"), t.where("train_id is not null")
    n = t.count()
    blocks = max(1, -(-n // BROADCAST_ROWS))
    if metric == "euclidean":
        return _nearest_euclidean(q, t, k, blocks, exclude_same)
    out = None
    for b in range(blocks):
        part = t if blocks == 1 else t.where(F.pmod(F.xxhash64("train_id"), F.lit(blocks)) == b)
        alike = F.col("_qg") == F.col("_tg")
        pairs = q.join(F.broadcast(part), alike & (F.col("query_id") != F.col("train_id")) if exclude_same else alike)
        d = DISTANCES[metric](F.col("_q"), F.col("_t"), p) if metric == "minkowski" else DISTANCES[metric](F.col("_q"), F.col("_t"))
        best = _top(pairs.select("query_id", "train_id", d.alias("distance")), k)
        out = best if out is None else out.unionByName(best)
    return out if blocks == 1 else _top(out.drop("rank"), k)


def _nearest_euclidean(q: DataFrame, t: DataFrame, k: int, blocks: int, exclude_same: bool) -> DataFrame:
    spark = q.sparkSession
    q, t = q.where("_qg is not null"), t.where("_tg is not null")
    schema = f"query_id {dict(q.dtypes)['query_id']}, train_id {dict(t.dtypes)['train_id']}, distance double, rank int"
    # So many rows of queries in a task that some thousands share the cost of an index.
    q = q.repartition(max(1, min(-(-q.count() // 2000), 4 * spark.sparkContext.defaultParallelism)))
    out = None
    for b in range(blocks):
        part = t if blocks == 1 else t.where(F.pmod(F.xxhash64("train_id"), F.lit(blocks)) == b)
        table = part.toArrow().sort_by("train_id").combine_chunks()
        shared = spark.sparkContext.broadcast(table)
        best = q.mapInArrow(_search(shared, k, exclude_same), schema)
        if blocks > 1:
            best = cut_lineage(best if out is None else _top(out.unionByName(best).drop("rank"), k))
            shared.unpersist()
        out = best
    return out


def _search(shared, k: int, exclude_same: bool):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from statloom.operators import neighbours

        table = shared.value
        ids, groups = (table.column(c).combine_chunks() for c in ("train_id", "_tg"))
        if not len(ids):
            return
        x, holes = neighbours.matrix(table.column("_t"))
        first_id, first_group = (pc.unique(v) for v in (ids, groups))
        place = lambda v, among: pc.fill_null(pc.index_in(v, value_set=among), -1).to_numpy(zero_copy_only=False).astype(int)
        x[holes] = np.nan
        index = neighbours.Index(x, place(ids, first_id) if exclude_same else np.zeros(len(ids), int), place(groups, first_group))
        for batch in batches:
            if not batch.num_rows:
                continue
            qid = batch.column("query_id")
            y, none = neighbours.matrix(batch.column("_q"), x.shape[1])
            y[none] = np.nan
            same = place(qid, first_id) if exclude_same else np.full(len(y), -1)
            at, d = index.search(y, same, place(batch.column("_qg"), first_group), k)
            i, r = np.nonzero(at >= 0)
            null = none[i] | holes[at[i, r]]
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(i)), ids.take(pa.array(at[i, r])), pa.array(d[i, r], mask=null), pa.array((r + 1).astype(np.int32))], names=["query_id", "train_id", "distance", "rank"])

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "train_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_classify(queries: DataFrame, train: DataFrame, label: str, k: int, *, train_id: str = "train_id", **options) -> DataFrame:
    """query_id, prediction: majority of the k nearest, the smallest label on a tie."""
    near = nearest(queries, train, k, train_id=train_id, **options)
    votes = near.join(train.select(F.col(train_id).alias("train_id"), F.col(label).alias("label")), "train_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("prediction"))


def knn_regress(queries: DataFrame, train: DataFrame, target: str, k: int, weights: str = "uniform", *, train_id: str = "train_id", **options) -> DataFrame:
    near = nearest(queries, train, k, train_id=train_id, **options)
    near = near.join(train.select(F.col(train_id).alias("train_id"), F.col(target).cast("double").alias("y")), "train_id")
    w = F.lit(1.0) if weights == "uniform" else F.when(F.col("distance") < 1e-10, 1e10).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    return near.groupBy("query_id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("prediction"))


# trees and ensembles: pyspark.ml grows them by binned histograms, distributed over rows


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


_TREES = {
    "decision_tree_classifier": ("DecisionTreeClassifier", {"impurity": "gini", "maxDepth": 5}),
    "decision_tree_regressor": ("DecisionTreeRegressor", {"impurity": "variance", "maxDepth": 5}),
    "random_forest_classifier": ("RandomForestClassifier", {"featureSubsetStrategy": "sqrt", "numTrees": 20}),
    "random_forest_regressor": ("RandomForestRegressor", {"featureSubsetStrategy": "onethird", "numTrees": 20}),
    "gradient_boosting_classifier": ("GBTClassifier", {"stepSize": 0.1, "maxDepth": 3, "maxIter": 20}),
    "gradient_boosting_regressor": ("GBTRegressor", {"stepSize": 0.1, "maxDepth": 3, "maxIter": 20}),
    "linear_svc": ("LinearSVC", {"maxIter": 50}),
    "perceptron": ("MultilayerPerceptronClassifier", {"maxIter": 50}),
}


class TreeModel:
    """fit / predict / score / feature_importances over named columns."""

    def __init__(self, kind: str, features: list[str], label: str, seed: int = 0, **params):
        if kind not in _TREES:
            raise InvalidParameter("kind", kind)
        from pyspark.ml import classification, regression

        name, defaults = _TREES[kind]
        cls = getattr(classification, name, None) or getattr(regression, name)
        self.features, self.label = features, label
        self.regression = kind.endswith("regressor")
        options = {**defaults, **params}
        if hasattr(cls, "setSeed"):
            options["seed"] = seed
        self.estimator = cls(featuresCol="_features", labelCol="_label", predictionCol="prediction", **options)

    def fit(self, df: DataFrame) -> TreeModel:
        self.model = self.estimator.fit(_assembled(df.withColumn("_label", F.col(self.label).cast("double")), self.features))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_assembled(df, self.features)).drop("_features", "rawPrediction", "probability")

    def score(self, df: DataFrame) -> float:
        from .metrics import accuracy, r2_score

        return self.predict(df).agg((r2_score if self.regression else accuracy)(self.label, "prediction")).first()[0]

    def feature_importances(self) -> dict[str, float]:
        return dict(zip(self.features, map(float, self.model.featureImportances.toArray()), strict=True))


def best_split(df: DataFrame, feature: str, target: str) -> DataFrame:
    """threshold, gain: the exact best variance-reduction split of one feature, at midpoints of distinct values.

    Values are pre-aggregated, then prefix sums over the distinct values give every candidate at once.
    """
    y = F.col(target).cast("double")
    per = df.groupBy(F.col(feature).cast("double").alias("v")).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    total = per.agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    run = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    pre = per.select("v", F.lead("v").over(Window.orderBy("v")).alias("nv"), *[F.sum(c).over(run).alias(c) for c in ("n", "s", "q")]).where("nv is not null")
    n, s, q = total
    sse = F.col("q") - F.col("s") * F.col("s") / F.col("n") + (q - F.col("q")) - (s - F.col("s")) * (s - F.col("s")) / (n - F.col("n"))
    gain = (q - s * s / n - sse) / n
    return pre.select(((F.col("v") + F.col("nv")) / 2).alias("threshold"), gain.alias("gain")).orderBy(F.desc("gain"), "threshold").limit(1)


def voting_hard(votes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """votes: id, model, pred. id, prediction: largest weight, the smallest label on a tie."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.element_at(F.create_map(*[x for m, v in weights.items() for x in (F.lit(m), F.lit(float(v)))]), F.col("model")), F.lit(0.0))
    sums = votes.groupBy("id", "pred").agg(F.sum(w).alias("w"))
    return sums.groupBy("id").agg(F.min_by("pred", F.struct(-F.col("w"), F.col("pred"))).alias("prediction"))


def voting_soft(probas: DataFrame) -> DataFrame:
    """probas: id, model, label, p."""
    means = probas.groupBy("id", "label").agg(F.avg("p").alias("p"))
    return means.groupBy("id").agg(F.min_by("label", F.struct(-F.col("p"), F.col("label"))).alias("prediction"))


def bagging_mean(preds: DataFrame) -> DataFrame:
    """preds: id, model, pred."""
    return preds.groupBy("id").agg(F.avg("pred").alias("prediction"))


def stacked(df: DataFrame, id_column: str, bases: list, meta_fit, target: str, folds: int = 5) -> DataFrame:
    """Out-of-fold base predictions (columns m0, m1, ...) and the meta model's prediction.

    bases: functions (train) -> (df -> df with ``prediction``); meta_fit: (train, features) -> the same.
    """
    from .resample import kfold, split_fold

    rows = cut_lineage(kfold(df, id_column, folds))
    out = None
    for i in range(folds):
        train, test = split_fold(rows, i)
        for k, base in enumerate(bases):
            test = base(train)(test).withColumnRenamed("prediction", f"m{k}")
        out = test if out is None else out.unionByName(test)
    features = [f"m{k}" for k in range(len(bases))]
    return meta_fit(out, features)(out).drop("fold")


def blended(train: DataFrame, holdout: DataFrame, bases: list, meta_fit, target: str) -> DataFrame:
    for k, base in enumerate(bases):
        holdout = base(train)(holdout).withColumnRenamed("prediction", f"m{k}")
    return meta_fit(holdout, [f"m{k}" for k in range(len(bases))])(holdout)


def random_subspaces(features: list[str], models: int, size: int, seed: int = 0) -> list[list[str]]:
    rng = np.random.RandomState(seed)
    return [[features[i] for i in sorted(rng.choice(len(features), size, replace=False))] for _ in range(models)]


class KernelSVC:
    """Kernel machine on a bounded training sample (``most`` rows by id hash), solved by simplified SMO on the driver; scoring is a broadcast of the support vectors."""

    def __init__(self, features: str, label: str, c: float = 1.0, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, most: int = 2000, passes: int = 5, seed: int = 0):
        self.features, self.label, self.c, self.kernel, self.gamma, self.degree, self.most, self.passes, self.seed = features, label, c, kernel, gamma, degree, most, passes, seed

    def _gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return a @ b.T
        if self.kernel == "poly":
            return (a @ b.T + 1) ** max(self.degree, 1)
        return np.exp(-self.gamma * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))

    def fit(self, df: DataFrame, id_column: str) -> KernelSVC:
        rows = df.orderBy(F.xxhash64(id_column), id_column).limit(self.most).select(self.features, self.label).collect()
        x = np.array([r[0] for r in rows], float)
        y = np.where(np.array([r[1] for r in rows], float) > 0.5, 1.0, -1.0)
        k, a, b, rng = self._gram(x, x), np.zeros(len(y)), 0.0, np.random.RandomState(self.seed)
        quiet = 0
        while quiet < self.passes:
            moved = 0
            for i in range(len(y)):
                ei = (a * y) @ k[:, i] + b - y[i]
                if not ((y[i] * ei < -1e-3 and a[i] < self.c) or (y[i] * ei > 1e-3 and a[i] > 0)):
                    continue
                j = rng.randint(len(y) - 1)
                j += j >= i
                ej = (a * y) @ k[:, j] + b - y[j]
                ai, aj = a[i], a[j]
                lo, hi = (max(0, aj - ai), min(self.c, self.c + aj - ai)) if y[i] != y[j] else (max(0, ai + aj - self.c), min(self.c, ai + aj))
                eta = 2 * k[i, j] - k[i, i] - k[j, j]
                if lo == hi or eta >= 0:
                    continue
                a[j] = min(max(aj - y[j] * (ei - ej) / eta, lo), hi)
                if abs(a[j] - aj) < 1e-6:
                    continue
                a[i] = ai + y[i] * y[j] * (aj - a[j])
                b1 = b - ei - y[i] * (a[i] - ai) * k[i, i] - y[j] * (a[j] - aj) * k[i, j]
                b2 = b - ej - y[i] * (a[i] - ai) * k[i, j] - y[j] * (a[j] - aj) * k[j, j]
                b = b1 if 0 < a[i] < self.c else b2 if 0 < a[j] < self.c else (b1 + b2) / 2
                moved += 1
            quiet = quiet + 1 if not moved else 0
        keep = a > 1e-8
        self.vectors, self.weights, self.bias = x[keep], (a * y)[keep], b
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        v, w, b, gram = self.vectors, self.weights, self.bias, self._gram

        @F.pandas_udf("int")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(((gram(np.stack(s.to_numpy()), v) @ w + b) >= 0).astype(int))

        return df.withColumn(name, run(F.col(self.features).cast("array<double>")))


KERNELS = {"linear": linear_kernel, "poly": polynomial_kernel, "rbf": rbf_kernel}
