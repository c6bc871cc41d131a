"""Known values, closed forms and invariants of the statistics operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.errors import EmptyData, FeatureMismatch, InvalidParameter, NotFitted, SingularMatrix
from statloom.functions import scalar, special
from statloom.operators import gram, hypothesis, metrics, preprocess, resample, select, stats


@pytest.fixture(scope="module")
def vec5(spark):
    return spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(1, 6)], "id long, x double, y double")


def one(df):
    return df.first().asDict()


def test_moments(vec5):
    r = one(vec5.agg(stats.mean("x").alias("m"), stats.variance("x").alias("v"), stats.variance("x", 5).alias("none"), stats.median("x").alias("med"), stats.quantile("x", 0.3).alias("q"), stats.correlation("x", "y").alias("c"), stats.covariance("x", "y").alias("cov")))
    assert r == {"m": 3.0, "v": 2.5, "none": None, "med": 3.0, "q": pytest.approx(2.2), "c": pytest.approx(1.0), "cov": 5.0}


def test_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (float("nan"), None), (None, 4.0)], "a double, b double")
    r = one(df.agg(stats.mean("a").alias("m"), stats.correlation("a", "b").alias("c"), stats.skewness("a").alias("s"), stats.variance("a").alias("v")))
    assert r == {"m": 1.0, "c": None, "s": None, "v": 0.0}
    assert {(x.i, x.j): x.value for x in stats.corr_matrix(df, ["a", "b"]).collect()}["a", "a"] == 0
    with pytest.raises(FeatureMismatch):
        stats.describe(df, "missing")


def test_special_values():
    assert special.gamma(5) == 24
    assert special.normal_cdf(1.96) == pytest.approx(0.9750021, abs=1e-7)
    assert special.normal_pdf(0) == pytest.approx(0.3989422804014327)
    assert special.f_test_p_value(3, 2, 10) == pytest.approx(0.0953674, abs=1e-6)
    assert special.t_cdf(2, 10) == pytest.approx(0.963306, abs=1e-6) and special.t_cdf(0, 1) == 0.5
    assert special.t_cdf(1, 1) == pytest.approx(0.75)
    assert special.chi_squared_cdf(1, 2) == pytest.approx(1 - math.exp(-0.5))
    assert special.incomplete_beta(0.3, 2, 5) == pytest.approx(1 - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2)))
    assert special.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    x = np.linspace(0.01, 8, 400)
    for pdf, cdf in ((lambda v: special.t_pdf(v, 5), lambda v: special.t_cdf(v, 5)), (lambda v: special.chi_squared_pdf(v, 3), lambda v: special.chi_squared_cdf(v, 3)), (lambda v: special.f_pdf(v, 4, 9), lambda v: special.f_cdf(v, 4, 9))):
        assert np.trapezoid([pdf(v) for v in x], x) == pytest.approx(cdf(8) - cdf(0.01), abs=1e-3)


def test_special_columns(spark):
    df = spark.createDataFrame([(0.5,), (None,), (-2.0,)], "x double")
    got = df.select(special.column(special.normal_cdf, "x").alias("p"), special.normal_cdf_expr(F.col("x")).alias("e")).collect()
    assert got[1].p is None and all(abs(r.p - r.e) < 2e-7 for r in got if r.p is not None)


def test_hypotheses(spark, vec5):
    t = one(hypothesis.ttest_1samp(vec5, "x", 3.0))
    assert t["t"] == 0 and t["p_value"] == pytest.approx(1)
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (3, 5, 9, 11)], "g string, x double")
    f = one(hypothesis.f_test(df, "x", F.col("g") == "a", F.col("g") == "b"))
    assert f["f"] == pytest.approx(np.var([3, 5, 9, 11]) / np.var([1, 2, 3, 4])) and f["df1"] == 3
    e = spark.createDataFrame(list(enumerate([0.1, 0.2, 0.15, 0.18, 0.22])), "t long, e double")
    assert one(hypothesis.durbin_watson(e, "e", "t"))["dw"] == pytest.approx(0.09785, abs=1e-4)
    p = one(hypothesis.permutation_test(df.withColumn("id", F.monotonically_increasing_id()), "x", F.col("g") == "a", "id", 100))
    assert p["observed"] == pytest.approx(-4.5) and 0 <= p["p_value"] <= 0.4


def test_anova_two_groups_is_t_squared(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 7.0)], "g string, x double")
    t = one(hypothesis.ttest_ind(df, "x", F.col("g") == "a", F.col("g") == "b"))
    f = one(stats.anova(df, "x", "g"))
    assert f["f"] == pytest.approx(t["t"] ** 2) and f["p_value"] == pytest.approx(t["p_value"])


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1), (3.0, 2.9), (4.0, 4.1), (5.0, 4.9)], "y double, p double")
    r = one(metrics.regression_report(df, "y", "p"))
    assert r["mse"] == pytest.approx(0.01) and r["r2"] == pytest.approx(0.995)
    c = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)], "y double, p double")
    assert one(metrics.classification_report(c, "y", "p")) == {"accuracy": 0.75, "precision": 1.0, "recall": 0.5, "f1": pytest.approx(2 / 3)}
    assert {(r.truth, r.prediction): r.n for r in metrics.confusion_matrix(c, "y", "p").collect()} == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}


def test_preprocessing(spark):
    df = spark.createDataFrame([(1.0, 2.0, "b"), (3.0, 2.0, "a"), (5.0, 2.0, "b")], "a double, k double, s string")
    s = preprocess.StandardScaler(["a", "k"])
    with pytest.raises(NotFitted):
        s.transform(df)
    out = s.fit_transform(df).collect()
    assert [r.k for r in out] == [0, 0, 0] and sum(r.a for r in out) == pytest.approx(0) and out[0].a == pytest.approx(-math.sqrt(1.5))
    assert [r.a for r in s.inverse_transform(s.transform(df)).collect()] == pytest.approx([1, 3, 5])
    assert [(r.a, r.k) for r in preprocess.MinMaxScaler(["a", "k"], 1, 2).fit_transform(df).collect()] == [(1, 1), (1.5, 1), (2, 1)]
    enc = preprocess.OneHotEncoder(["s"]).fit(df)
    assert enc.n_features_out == 2 and [(r.s_0, r.s_1) for r in enc.transform(df.withColumn("s", F.lit("z"))).collect()] == [(0, 0)] * 3
    with pytest.raises(EmptyData):
        s.fit(df.limit(0))
    gap = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,), (float("nan"),)], "x double")
    for kind, want in (("mean", 2.0), ("median", 1.0), ("mode", 1.0), ("constant", 9.0)):
        assert [r.x for r in preprocess.SimpleImputer(["x"], kind, 9.0).fit_transform(gap).collect()][3:] == [want] * 2


def test_regression(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(200, 3)) * [1, 100, 0.01] + [0, 1e4, 5]
    y = x @ [2, -0.5, 30] + 7 + rng.normal(size=200)
    df = spark.createDataFrame([(int(i), *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")  # noqa: B905
    fit = gram.least_squares(df, ["a", "b", "c"], "y")
    z = np.column_stack([np.ones(200), x])
    beta, rss, *_ = np.linalg.lstsq(z, y, rcond=None)
    assert [fit.coef[c] for c in ("intercept", "a", "b", "c")] == pytest.approx(beta.tolist(), rel=1e-6)
    assert fit.rss == pytest.approx(rss[0], rel=1e-6)
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * rss[0] / 196)
    assert [fit.std_errors[c] for c in ("intercept", "a", "b", "c")] == pytest.approx(se.tolist(), rel=1e-5)
    assert fit.score(df) == pytest.approx(fit.r2)
    with pytest.raises(SingularMatrix):
        gram.least_squares(df.withColumn("d", F.col("a") * 2), ["a", "d"], "y")
    w = gram.lasso(df, ["a"], "y", 0.0)["a"]
    assert w == pytest.approx(float(x[:, 0] @ y / (x[:, 0] @ x[:, 0])))
    assert select.rfe(df, ["a", "b", "c"], "y", 1) == ["c"]
    lab = df.withColumn("t", (F.col("a") + F.sin("id") > 0).cast("double"))
    b = gram.logistic(lab, ["a"], "t")
    p = lab.withColumn("p", gram.logistic_probability(b))
    assert abs(one(p.agg(F.sum(F.col("p") - F.col("t")).alias("g")))["g"]) < 1e-5 and b["a"] > 1


def test_splits_and_samplers(spark):
    df = spark.range(103).withColumn("label", (F.col("id") % 3).cast("int")).repartition(7)
    folds = {r.fold: r["count"] for r in resample.kfold(df, "id", 5).groupBy("fold").count().collect()}
    assert folds == {0: 20, 1: 20, 2: 20, 3: 20, 4: 23}
    parts = resample.train_test_split(df, "id", 0.2).collect()
    assert sum(r.is_test for r in parts) == 21 and min(r.id for r in parts if r.is_test) == 82
    drawn = resample.bootstrap(df, "id", 4, seed=3)
    assert drawn.count() == 412 and sorted(drawn.collect()) == sorted(resample.bootstrap(df.repartition(2), "id", 4, seed=3).collect())
    oob = resample.out_of_bag(df, "id", drawn, 4)
    assert oob.join(drawn, ["iteration", "id"]).count() == 0 and 100 < oob.count() < 200
    assert {r["count"] for r in resample.balanced_bootstrap(df, "id", 3).groupBy("id").count().collect()} == {3}
    strata = resample.stratified_bootstrap(df, "id", "label", 2).groupBy("iteration", "label").count().collect()
    assert sorted((r.label, r["count"]) for r in strata) == [(0, 35), (0, 35), (1, 34), (1, 34), (2, 34), (2, 34)]
    blocks = resample.block_bootstrap(df, "id", 2, 10).orderBy("iteration", "draw").collect()
    assert len(blocks) == 206 and sum(b.id == a.id + 1 for a, b in zip(blocks, blocks[1:])) >= 180  # noqa: B905
    assert resample.reservoir_sample(df, "id", 20).count() == 20
    w = resample.weighted_sample(df.withColumn("w", F.when(F.col("id") < 10, 1.0).otherwise(0.0)), "id", "w", 500)
    assert w.count() == 500 and w.agg(F.max("id")).first()[0] < 10
    assert [r.estimate for r in resample.jackknife_mean(spark.range(3), "id", "id").orderBy("id").collect()] == [1.5, 1.0, 0.5]
    ci = one(resample.bootstrap_ci(df, "id", "id", 100))
    assert ci["lower"] <= ci["estimate"] <= ci["upper"]
    with pytest.raises(InvalidParameter):
        resample.kfold(df, "id", 1)


def test_smote(spark):
    pts = [(i, [1.0 + i / 10, 1.0], 0) for i in range(8)] + [(10 + i, [5.0, 5.0 + i / 10], 1) for i in range(3)]
    df = spark.createDataFrame(pts, "id long, features array<double>, label int")
    out = resample.smote(df, "id", "features", "label", 2).collect()
    assert sum(r.label == 1 for r in out) == 8 and all(5 <= r.features[1] <= 5.2 for r in out if r.synthetic)


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    m = F.array(a, b)
    r = df.select(scalar.dot(a, b).alias("dot"), scalar.add(a, b).alias("add"), scalar.divide(a, b).alias("div"), scalar.matmul(m, scalar.transpose(m)).alias("mm"), scalar.trace(scalar.eye(3)).alias("tr"), scalar.softmax(a).alias("sm"), scalar.argmax(a).alias("am"), scalar.reshape(a, 3, 1).alias("rs"), scalar.polynomial_kernel(a, b, 2, 1.0).alias("pk")).first()
    assert r.dot == 32 and r["add"] == [5, 7, 9] and r.div == [0.25, 0.4, 0.5] and r.mm == [[14, 32], [32, 77]]
    assert r.tr == 3 and sum(r.sm) == pytest.approx(1) and r.am == 2 and r.rs == [[1], [2], [3]] and r.pk == 33**2


def test_pipeline_of_steps(spark):
    from statloom.operators.models import GaussianNB

    df = spark.createDataFrame([(float(i), i % 2 * 10.0 + i % 3, i % 2) for i in range(30)] + [(None, 11.0, 1)], "a double, b double, y int")
    p = preprocess.Pipeline([("fill", preprocess.SimpleImputer(["a"])), ("scale", preprocess.StandardScaler(["a", "b"])), ("model", GaussianNB(["b"], "y"))])
    with pytest.raises(NotFitted):
        p.transform(df)
    out = p.fit(df).predict(df)
    assert out.where("prediction <> y").count() == 0 and out.where("a is null").count() == 0


def oversampled(f, df, k):
    """Synthetic points, each of which lies between a row of its class and one of the k nearest rows of its class or of all."""
    out = f(df, "id", "features", "label", k)
    assert "NOT (" not in out._jdf.queryExecution().toString()  # no join of every row with every other
    return [r for r in out.collect() if r.synthetic]


def test_smote_without_pairs(spark):
    rng = np.random.RandomState(4)
    rows = [(i, rng.normal(size=3), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame([(i, x.tolist(), c) for i, x, c in rows], "id long, features array<double>, label int").repartition(3)
    made = oversampled(resample.smote, df, 3)
    assert len(made) == 100
    segments = []
    for i, x, c in rows:
        near = sorted((float(((x - y) ** 2).sum()), j) for j, y, d in rows if j != i and d == c)[:3]
        segments += [(x, rows[j][1]) for _, j in near if c == rows[j][2] == 1]
    for r in made:
        p = np.array(r.features)
        assert r.label == 1 and min(abs(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)) for a, b in segments) < 1e-9


def test_adasyn_without_pairs(spark):
    rng = np.random.RandomState(4)
    rows = [(i, rng.normal(size=3), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame([(i, x.tolist(), c) for i, x, c in rows], "id long, features array<double>, label int").repartition(3)
    made = oversampled(resample.adasyn, df, 3)
    assert len(made) > 30
    segments = []
    for i, x, c in rows:
        near = sorted((float(((x - y) ** 2).sum()), j) for j, y, d in rows if j != i)[:3]
        segments += [(x, rows[j][1]) for _, j in near if c == rows[j][2] == 1]
    for r in made:
        p = np.array(r.features)
        assert r.label == 1 and min(abs(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)) for a, b in segments) < 1e-9
