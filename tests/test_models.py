"""Models, clustering, series, panels, space, processes, networks, streams: fixtures and cross-checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.errors import InvalidData, InvalidParameter
from statloom.operators import breaks, cluster, decomposition, econometrics, linalg, models, nn, optimize, rl, spatial, stochastic, timeseries
from statloom.operators.gram import least_squares
from statloom.sources import datasets, io
from statloom.streaming import events

BLOBS = [(0, [1.0, 2.0], 0), (1, [1.5, 1.8], 0), (2, [5.0, 8.0], 1), (3, [8.0, 8.0], 1), (4, [1.0, 0.6], 0), (5, [9.0, 11.0], 1)]


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame(BLOBS, "id long, features array<double>, label int")


def test_neighbours(spark, blobs):
    q = spark.createDataFrame([(100, [0.0, 0.0]), (101, [9.0, 9.0])], "query_id long, features array<double>")
    options = {"train_id": "id"}
    assert {r.query_id: r.prediction for r in models.knn_classify(q, blobs, "label", 3, **options).collect()} == {100: 0, 101: 1}
    near = models.nearest(q, blobs, 2, metric="manhattan", **options).where("query_id = 100").orderBy("rank").collect()
    assert [r.train_id for r in near] == [4, 0]
    tie = spark.createDataFrame([(7, [1.0]), (3, [-1.0]), (9, [1.0])], "id long, features array<double>")
    got = models.nearest(spark.createDataFrame([(1, [0.0])], "query_id long, features array<double>"), tie, 2, train_id="id").orderBy("rank").collect()
    assert [r.train_id for r in got] == [3, 7]


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.RandomState(0)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(120)], "id long, features array<double>")
    o = {"query_id": "id", "train_id": "id", "exclude_same": True}
    whole = sorted(map(tuple, models.nearest(df, df, 3, **o).collect()))
    monkeypatch.setattr(models, "BROADCAST_ROWS", 25)
    assert sorted(map(tuple, models.nearest(df, df, 3, **o).collect())) == whole


def test_bayes_trees_votes(spark):
    df = spark.createDataFrame([(float(i % 7), float(i), i % 2) for i in range(100)], "a double, b double, y int").withColumn("c", F.col("y") * 5 + F.col("a"))
    nb = models.GaussianNB(["c"], "y").fit(df)
    p = nb.predict_proba(df).select("proba").first().proba
    assert sum(p) == pytest.approx(1) and nb.score(df) > 0.7
    assert models.TreeModel("decision_tree_classifier", ["a", "c"], "y").fit(df).score(df) > 0.9
    s = models.best_split(df.withColumn("t", (F.col("b") > 40).cast("double")), "b", "t").first()
    assert s.threshold == 40.5 and s.gain == pytest.approx(0.41 * 0.59)
    v = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 1), (2, "a", 2), (2, "b", 1)], "id long, model string, pred int")
    assert {r.id: r.prediction for r in models.voting_hard(v).collect()} == {1: 1, 2: 1}
    assert {r.id: r.prediction for r in models.voting_hard(v, {"a": 5, "b": 1, "c": 1}).collect()} == {1: 0, 2: 2}


def test_kernel_machine(spark):
    rng = np.random.RandomState(1)
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(i, v.tolist(), int((v**2).sum() < 1.2)) for i, v in enumerate(x)], "id long, x array<double>, y int")
    out = models.KernelSVC("x", "y", c=5.0).fit(df, "id").predict(df)
    assert out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.9


def test_clusters(spark, blobs):
    k = cluster.kmeans(blobs, "features", "id", 2, n_init=2)
    got = {r.id: r.cluster for r in cluster.kmeans_assign(blobs, "features", k["centres"]).collect()}
    assert len({got[i] for i in (0, 1, 4)}) == 1 and got[0] != got[2]
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1, 2), (2, 2), (2, 3), (8, 7), (8, 8), (25, 80)])], "id long, x array<double>")
    d = {r.id: r.cluster for r in cluster.dbscan(pts, "id", "x", 3.0, 1).collect()}
    assert d == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: -1}
    for link in ("single", "complete", "average", "ward"):
        h = {r.id: r.cluster for r in cluster.hierarchical(pts, "id", "x", 3, link).collect()}
        assert h[0] == h[1] == h[2] and h[3] == h[4] and len(set(h.values())) == 3
    assert len({r.cluster for r in cluster.mean_shift(pts, "id", "x", 3.0).collect()}) == 3
    s = {r.id: r.cluster for r in cluster.spectral(pts, "id", "x", 2, 0.05).collect()}
    assert s[0] == s[1] == s[2]
    with pytest.raises(InvalidParameter):
        cluster.hierarchical(pts, "id", "x", 2, "other")


def test_components_of_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)], "i long, j long")
    n = spark.range(33)
    assert {r.id: r.root for r in cluster.components(e, n).collect()} == {**dict.fromkeys(range(31), 0), 31: 31, 32: 32}


def test_pca(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(80, 40)) @ rng.normal(size=(40, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    m = decomposition.PCA(3, "x").fit(df)
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert m.explained == pytest.approx((s**2 / 79)[:3]) and m.ratio.sum() < 1
    assert np.abs(np.abs(m.components @ vt[:3].T) - np.eye(3)).max() < 1e-6
    full = decomposition.PCA(40, "x").fit(df)
    back = full.inverse_transform(full.transform(df)).orderBy("id").first()
    assert back.restored == pytest.approx(x[0].tolist(), abs=1e-6)
    assert decomposition.tsne(df, "id", "x", steps=20).count() == decomposition.umap(df, "id", "x", epochs=5).count() == 80


def ar_series(spark, n=400):
    rng, y = np.random.RandomState(2), [0.0, 0.0]
    for _ in range(n):
        y.append(0.5 * y[-1] + 0.2 * y[-2] + rng.normal())
    return spark.createDataFrame([(i, float(v), float(np.sin(i))) for i, v in enumerate(y)], "t long, y double, x double")


def test_series(spark):
    df = ar_series(spark)
    m = timeseries.ARIMA(2).fit(df, "y", "t")
    assert m.ar == pytest.approx([0.5, 0.2], abs=0.12) and len(m.forecast(df, 4)) == 4
    ramp = spark.createDataFrame([(i, 3.0 * i) for i in range(50)], "t long, y double")
    assert timeseries.ARIMA(0, 1).fit(ramp, "y", "t").forecast(ramp, 3) == pytest.approx([150, 153, 156])
    v = timeseries.VAR(1).fit(df, ["y", "x"], "t")
    assert len(v.forecast(df, 2)) == 2 and v.irf(2)[0] == [[1, 0], [0, 1]]
    g = timeseries.granger_causality(df, "x", "y", "t", 2)
    assert g["p_value"] > 0.01
    assert timeseries.ljung_box(df, "y", "t", 5).first().p_value < 1e-6
    r = timeseries.GARCH().fit(df, "y", "t").first()
    assert r.omega > 0 and r.alpha + r.beta < 1
    assert timeseries.value_at_risk(4.0, 0.95, 4) == pytest.approx(-1.6448536 * 4, abs=1e-5)


def test_breaks(spark):
    y = [1, 2, 3, 4, 10, 11, 12, 13]
    df = spark.createDataFrame([(i, float(v), float(i)) for i, v in enumerate(y)], "t long, y double, x double")
    assert breaks.chow_test(df.withColumn("y", F.col("y") + F.sin("t")), "y", ["x"], "t", 4)["f"] > 0
    rng = np.random.RandomState(0)
    jump = spark.createDataFrame([(i, (10.0 if i < 60 else 15.0) + float(rng.normal())) for i in range(120)], "t long, y double")
    b = breaks.bai_perron(jump, "y", [], "t").first()
    assert 60 in b.breaks
    assert breaks.cusum_test(jump, "y", [], "t").first().breaks
    x = np.column_stack([np.ones(30), np.arange(30.0)])
    t = rng.normal(size=30)
    w = breaks.recursive_residuals(x, t)
    beta = np.linalg.lstsq(x, t, rcond=None)[0]
    assert (w**2).sum() == pytest.approx(((t - x @ beta) ** 2).sum())


def test_panels(spark):
    rng = np.random.RandomState(3)
    rows = []
    for u in range(12):
        for t in range(6):
            x = rng.normal() + u
            rows.append((u, t, 2 * x + 10 * u + 0.1 * rng.normal(), x))
    p = econometrics.PanelData(spark.createDataFrame([(u, t, float(y), float(x)) for u, t, y, x in rows], "u long, t long, y double, x double"), "u", "t", "y", ["x"]).require_balanced()
    assert econometrics.fixed_effects(p).coef["x"] == pytest.approx(2, abs=0.05)
    assert econometrics.first_differences(p).coef["x"] == pytest.approx(2, abs=0.1)
    assert econometrics.pooled_ols(p).coef["x"] > 5
    re = econometrics.random_effects(p)
    assert set(econometrics.hausman(econometrics.fixed_effects(p), re)) == {"h", "df", "p_value"}
    eff = {r.u: r.effect for r in econometrics.unit_effects(p, econometrics.fixed_effects(p)).collect()}
    assert eff[3] == pytest.approx(30, abs=1)
    with pytest.raises(InvalidData):
        econometrics.PanelData(p.df.where("not (u = 1 and t = 1)"), "u", "t", "y", ["x"]).require_balanced()


def test_instruments_and_covariances(spark):
    rng = np.random.RandomState(4)
    z, e = rng.normal(size=(500, 2)), rng.normal(size=500)
    x = z @ [1, 0.5] + e + rng.normal(size=500)
    y = 3 * x + 2 * e + 1
    df = spark.createDataFrame([(i, i % 20, *map(float, r)) for i, r in enumerate(np.column_stack([y, x, z]))], "id long, g long, y double, x double, z1 double, z2 double")
    iv = econometrics.TwoStageLeastSquares("y", ["x"], ["z1", "z2"]).fit(df)
    assert iv.coef["x"] == pytest.approx(3, abs=0.25) and not iv.has_weak_instruments() and iv.sargan()["p_value"] > 0.001
    assert econometrics.gmm(df, "y", ["x"], ["z1", "z2"])["coef"]["x"] == pytest.approx(iv.coef["x"], abs=0.1)
    assert econometrics.anderson_rubin(df, "y", ["x"], ["z1", "z2"], [3.0])["p_value"] > 0.001
    fit = least_squares(df, ["x"], "y")
    m = np.column_stack([np.ones(500), x])
    r = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    bread = np.linalg.inv(m.T @ m)
    h = (m @ bread * m).sum(1)
    assert econometrics.robust_covariance(df, fit, "HC3") == pytest.approx(bread @ (m.T * (r / (1 - h)) ** 2) @ m @ bread, rel=1e-6)
    nw0 = econometrics.robust_covariance(df, fit, "NeweyWest", lags=0, order="id")
    assert nw0 == pytest.approx(econometrics.robust_covariance(df, fit, "White"), rel=1e-9)
    assert econometrics.clustered_covariance(df, fit, "g").shape == (2, 2)
    with pytest.raises(InvalidParameter):
        econometrics.TwoStageLeastSquares("y", ["x"], [])


def test_space(spark):
    pts = spark.createDataFrame([(i, [float(i), 0.0], float(i + 1)) for i in range(5)], "id long, p array<double>, x double")
    w = spatial.weights_within(pts, "id", "p", 1.0)
    assert w.count() == 8
    x, n = np.arange(1.0, 6), np.zeros((5, 5))
    for i in range(4):
        n[i, i + 1] = n[i + 1, i] = 1
    z = x - x.mean()
    assert spatial.morans_i(pts, w, "id", "x").first().i == pytest.approx(5 / n.sum() * (z @ n @ z) / (z @ z))
    assert spatial.gearys_c(pts, w, "id", "x").first().c == pytest.approx(4 / (2 * n.sum()) * (n * (x[:, None] - x[None]) ** 2).sum() / (z @ z))
    k = spatial.weights_knn(pts, "id", "p", 2)
    assert k.count() == 10 and {r.s for r in spatial.row_standardize(k).groupBy("i").agg(F.sum("w").alias("s")).collect()} == {1.0}
    q = {r.id: r.quadrant for r in spatial.local_morans_i(pts, spatial.row_standardize(w), "id", "x", permutations=20).collect()}
    assert q[4] == "HH" and q[0] == "LL"


def test_processes(spark):
    b = stochastic.brownian_motion(spark, 400, 1.0, 100, seed=5)
    assert b.count() == 400 * 101
    end = b.where("step = 100").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).first()
    assert abs(end.m) < 0.2 and 0.8 < end.v < 1.25
    g = stochastic.geometric_brownian_motion(spark, 300, 1.0, 12, 100.0, 0.03, 0.2)
    price = stochastic.monte_carlo_price(g, 12, F.greatest(F.col("value") - 100, F.lit(0.0)), 0.03, 1.0).first()
    exact = spark.range(1).select(stochastic.black_scholes_call(F.lit(100.0), F.lit(100.0), F.lit(0.03), F.lit(0.2), F.lit(1.0)).alias("c")).first().c
    assert abs(price.price - exact) < 5 * price.std_error and exact == pytest.approx(9.4134, abs=1e-3)
    n = stochastic.poisson_process(spark, 200, 3.0, 10.0).groupBy("path").count().agg(F.avg("count")).first()[0]
    assert 27 < n < 33
    assert stochastic.ornstein_uhlenbeck(spark, 2, 1.0, 10, 1.0, 5.0, 0.0, x0=5.0).agg(F.min("value"), F.max("value")).first() == (5.0, 5.0)
    assert stochastic.heston(spark, 2, 1.0, 10, 100.0, 0.04, 0.0, 1.0, 0.04, 0.1, 0.0).count() == 22


def test_algebra_and_optimizers():
    assert linalg.det([[1, 2], [3, 4]]) == pytest.approx(-2) and linalg.solve([[3, 1], [1, 2]], [9, 8]).tolist() == pytest.approx([2, 3])
    q, r = linalg.qr([[1, 2], [3, 4], [5, 6]])
    assert np.allclose(q @ r, [[1, 2], [3, 4], [5, 6]]) and (np.diag(r) > 0).all()
    f = lambda x: float((x**2).sum())
    for solve in (optimize.gradient_descent, optimize.adam, optimize.lbfgs):
        assert f(solve(f, [5, 5])) < (0.01 if solve is optimize.adam else 0.001)  # it stops where a step changes little
    for kind in "sgd adam adamw radam lamb rmsprop adagrad adadelta nadam amsgrad".split():
        o, x = nn.Optimizer(kind, rate=0.05), np.array([3.0, -2.0])
        for _ in range(400):
            x = o.step(x, 2 * x)
        assert f(x) < 13, kind


def test_networks(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(200, 2))
    net = nn.Sequential([nn.Dense(2, 16, "tanh"), nn.Dense(16, 1)])
    losses = net.fit(x, x[:, 0] * x[:, 1], epochs=60)
    assert losses[-1] < losses[0] / 2
    assert nn.MultiHeadAttention(8, 2).forward(rng.normal(size=(4, 8)), mask=np.tril(np.ones((4, 4)))).shape == (4, 8)
    assert nn.TransformerLayer(8, 2, 16).forward(rng.normal(size=(4, 8)), memory=rng.normal(size=(3, 8))).shape == (4, 8)
    assert nn.Recurrent("lstm", 3, 5).forward_sequence(rng.normal(size=(7, 3))).shape == nn.Recurrent("gru", 3, 5).forward_sequence(rng.normal(size=(7, 3))).shape == (7, 5)
    assert nn.VAE(6, 5, 2).loss(rng.rand(3, 6)) > 0 and nn.GAN(3, [4, 8], 6).judge(nn.GAN(3, [4, 8], 6).generate(rng.normal(size=(2, 3)))).shape == (2, 1)
    a, b = nn.Tensor([[1.0, 2.0]]), nn.Tensor([[3.0], [-4.0]])
    ((a @ b).sigmoid() * 2.0 + a.relu().sum()).sum().backward()
    s = 1 / (1 + np.exp(5.0))
    assert a.grad == pytest.approx(np.array([[1 + 6 * s * (1 - s), 1 - 8 * s * (1 - s)]]))
    p = spark.createDataFrame([([1.0, 0.9, 0.9, 0.9, 0.9, 0.5],)], "m array<double>").select(nn.plateau(F.col("m"), 1.0, 0.5, 2).alias("lr")).first().lr
    assert p == [1, 1, 1, 1, 0.5, 0.5]
    c = spark.range(7).select(nn.cosine_annealing(F.col("id"), 1.0, 2, restarts=True).alias("lr")).collect()
    assert [round(r.lr, 6) for r in c][:3] == [1, 0.5, 1] and c[6].lr == pytest.approx(1)


def test_reinforcement(spark):
    df = spark.createDataFrame([("u", i, 1.0, 0.5, i == 1) for i in range(4)], "u string, t long, r double, v double, done boolean")
    got = [r.ret for r in rl.discounted_returns(df, "u", "t", "r", 0.5, "done").orderBy("t").collect()]
    assert got == [1.5, 1.0, 1.5, 1.0]
    adv = [r.advantage for r in rl.generalized_advantage(df, "u", "t", "r", "v", 0.5, 1.0).orderBy("t").collect()]
    assert adv[-1] == 0.5 and adv[-2] == pytest.approx(1 + 0.25 - 0.5 + 0.5 * 0.5)
    q = rl.QLearning(2, 2, alpha=0.5)
    q.update(0, 1, 1.0, 1, True)
    assert q.greedy(0) == 1 and q.q[0, 1] == 0.5
    d = rl.DQN(2, 2)
    d.remember([1, 0], 0, 1.0, [0, 1], True)
    d.train()
    d.update_target()
    assert d.q_values([1, 0])[0] > 0
    assert rl.Policy(2, 3, "td3").select_action([1, 1]).max() <= 1


def test_sources(spark, tmp_path):
    assert datasets.load_iris(spark).count() == 15
    df, coef = datasets.make_regression(spark, 200, 3, 0.01)
    assert [least_squares(df, ["f0", "f1", "f2"], "y").coef[f"f{j}"] for j in range(3)] == pytest.approx(coef, abs=0.01)
    with pytest.raises(InvalidParameter):
        datasets.make_classification(spark, 10, 2, 3)
    for kind in ("parquet", "json", "csv", "orc"):
        io.write(spark.range(5), f"file://{tmp_path}/{kind}", kind, header="true")
        assert io.read(spark, f"file://{tmp_path}/{kind}", kind, "id long", header="true").count() == 5
    io.save_model(spark, {"a": 1}, f"file://{tmp_path}/m")
    assert io.load_model(spark, f"file://{tmp_path}/m") == {"a": 1}


def test_streams(spark, tmp_path):
    rows = spark.range(600).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id * 60) as ts", "id % 5 as user_id", "concat('k', id % 2) as event_type", "cast(id as double) as value")
    rows.repartition(4).write.parquet(f"{tmp_path}/e")
    s = events.read_events(spark, f"{tmp_path}/e", rows.schema)
    out = events.run_available(events.tumbling(s, "1 hour", ["event_type"]), spark, "w1", f"{tmp_path}/c1")
    want = events.tumbling(rows, "1 hour", ["event_type"])
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    got = events.run_available(events.reservoir(s, 10, "event_type"), spark, "w2", f"{tmp_path}/c2", "update")
    last = got.groupBy("key").agg(F.max_by("sample", "n").alias("s"), F.max("n").alias("n")).collect()
    assert [(len(r.s), r.n) for r in last] == [(10, 300), (10, 300)]
    m = events.run_available(events.running_moments(s, "event_type"), spark, "w3", f"{tmp_path}/c3")
    assert {r.n for r in m.collect()} == {300}


def test_network_learns_from_all_rows(spark):
    """Steps over a frame are steps over all its rows, the last ones too, whatever the partitions."""
    rows = [(i, [float(i % 7), 1.0 if i >= 300 else 0.0], 1.0 if i >= 300 else 0.0) for i in range(400)]
    df = spark.createDataFrame([*rows, (400, None, 1.0), (401, [0.0, 0.0], None)], "id long, x array<double>, y double")
    make = lambda: nn.Sequential([nn.Dense(2, 4, "tanh"), nn.Dense(4, 1)], {"kind": "adam", "rate": 0.05})
    one, two, local = make(), make(), make()
    one.fit_frame(df.repartition(1), "x", "y", epochs=12)
    two.fit_frame(df.repartition(5), "x", "y", epochs=12)
    local.fit(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), epochs=12, batch=400)
    for a, b, c in zip(one.layers, two.layers, local.layers, strict=True):
        assert np.allclose(a.w, b.w) and np.allclose(a.w, c.w) and np.allclose(a.b, c.b)


def test_network_query_reads_every_row(spark, tmp_path):
    """Rows beyond the first 200 ids change the model."""
    from statloom.plans import catalogue

    out = []
    for late in (0, 9):
        rows = [(i, [float((i * j) % 5) for j in range(64)], 1 if i < 200 else late) for i in range(260)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{late}/embeddings.parquet")
        out.append({r.vec_id: r.prediction[0] for r in catalogue.queries()["networks"](spark, f"{tmp_path}/{late}").collect()})
    assert len(out[0]) == 260 and max(abs(out[0][i] - out[1][i]) for i in out[0]) > 1e-3


@pytest.mark.parametrize("name", ["hierarchical", "mean_shift", "spectral", "tsne", "umap"])
def test_small_methods_take_all_embeddings(spark, name):
    """Every row of the table has a result."""
    from statloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    ids = sorted(r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect())
    assert sorted(r.id for r in catalogue.queries()[name](spark, sf).collect()) == ids


def test_arima_forecast_with_moving_average(spark):
    """MA(1) with known parameters: the first forecast holds the last innovation, later ones are the mean; and an ARMA by hand."""
    rng = np.random.RandomState(1)
    e = rng.normal(size=400)
    y = 5 + e[1:] + 0.6 * e[:-1]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double").repartition(3)
    m = timeseries.ARIMA(0, 0, 1).fit(df, "y", "t")
    assert 0.4 < m.ma[0] < 0.8
    last = 0.0
    for v in y:
        last = v - m.mean - m.ma[0] * last
    assert m.forecast(df, 3) == pytest.approx([m.mean + m.ma[0] * last, m.mean, m.mean])
    m = timeseries.ARIMA(1, 1, 1)
    m.column, m.order, m.mean, m.ar, m.ma = "y", "t", 0.5, np.array([0.3]), np.array([-0.2])
    z, inno = list(np.diff(y) - 0.5), []
    for k, v in enumerate(z):
        inno.append(v - 0.3 * z[k - 1] + 0.2 * inno[k - 1] if k else 0.0)
    one = 0.3 * z[-1] - 0.2 * inno[-1]
    two = 0.3 * one
    assert m.forecast(df, 2) == pytest.approx([y[-1] + 0.5 + one, y[-1] + 1.0 + one + two])


def test_spatial_impacts(spark):
    """Against the inverse matrix, exactly and by hashed signs."""
    rng = np.random.RandomState(2)
    n = 60
    pairs = [(i, int(j)) for i in range(n) for j in rng.choice([k for k in range(n) if k != i], 3, replace=False)]
    w = spark.createDataFrame([(i, j, 1 / 3) for i, j in pairs], "i long, j long, w double")
    df = spark.createDataFrame([(i,) for i in range(n)], "id long")
    sar = spatial.SpatialLag("y", ["x"], "id")
    sar.rho, sar.coef, sar.w, sar.ids = 0.5, {"x": 2.0}, w, df
    dense = np.zeros((n, n))
    for i, j in pairs:
        dense[i, j] += 1 / 3
    s = 2.0 * np.linalg.inv(np.eye(n) - 0.5 * dense)
    got = sar.impacts()["x"]
    assert got["direct"] == pytest.approx(np.trace(s) / n) and got["total"] == pytest.approx(s.sum() / n) and got["indirect"] == pytest.approx(s.sum() / n - np.trace(s) / n)
    about = sar.impacts(exact=0, draws=8, orders=6)["x"]
    assert about["direct"] == pytest.approx(got["direct"], rel=0.1) and about["total"] == pytest.approx(got["total"], rel=0.02)


def test_discounted_returns_of_long_episodes(spark):
    """Batches of few rows, resets, several users, against the plain recursion."""
    rng = np.random.RandomState(3)
    rows = [(u, t, float(rng.normal()), bool(rng.rand() < 0.02)) for u, n in ((1, 700), (2, 1), (None, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, "u long, t long, r double, d boolean").repartition(4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(x.u, x.t): x.ret for x in rl.discounted_returns(df, "u", "t", "r", 0.97, "d").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(rows)
    for user in (1, 2, None):
        g = 0.0
        for _, t, r, d in sorted((x for x in rows if x[0] == user), key=lambda x: -x[1]):
            g = r + (0.0 if d else 0.97 * g)
            assert got[(user, t)] == pytest.approx(g, abs=1e-9)


@pytest.mark.parametrize("values", ["0.0, 1.0, 2.5", "0.0, 0.0", "NULL, 1.0, 2.0", "NULL", "-1.0, 2.0", "3.0, 0.5, 0.5"])
def test_priorities_of_zero(spark, values, tmp_path):
    """As DuckDB: events of value 0, of none, and below 0."""
    duckdb = pytest.importorskip("duckdb")
    from statloom.plans import catalogue

    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT row_number() OVER () AS event_id, v::DOUBLE AS value FROM (SELECT unnest([{values}]) AS v)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    got = catalogue.queries()["prioritized_replay"](spark, str(tmp_path)).collect()
    assert plain(got) == plain(con.execute(catalogue.oracle_sql()["prioritized_replay"]).fetchall())


def test_neighbours_leave_no_pairs(spark):
    """Against brute force over ties, equal rows, missing and odd vectors; no join makes rows of pairs, only neighbours leave a task."""
    rng = np.random.RandomState(5)
    for width in (2, 12):
        x = [rng.randint(0, 4, width).astype(float).tolist() for _ in range(150)] + rng.normal(size=(150, width)).tolist()
        rows = [(i, v, i % 2) for i, v in enumerate(x)] + [(300, None, 0), (301, [1.0], 1), (302, [float("nan")] * width, 0), (303, [None] * width, 1)]
        df = spark.createDataFrame(rows, "id long, p array<double>, g int").repartition(5)
        for by in (None, "g"):
            out = models.nearest(df, df, 4, query_id="id", train_id="id", features="p", exclude_same=True, by=by)
            got = {}
            for r in out.collect():
                got.setdefault(r.query_id, {})[r["rank"]] = r.train_id

            def far(a, b):
                if a is None or b is None or len(a) != len(b) or None in a or None in b:
                    return float("inf")
                d = 0.0
                for u, v in zip(a, b, strict=True):
                    d += (u - v) * (u - v)
                return float("inf") if d != d else math.sqrt(d)

            for i, v, g in rows:
                near = sorted((far(v, w), j) for j, w, h in rows if j != i and (by is None or g == h))
                assert [got[i][k] for k in (1, 2, 3, 4)] == [j for _, j in near[:4]]
        assert "Join" not in spatial.weights_knn(df, "id", "p", 3)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["umap"])
def test_whole_table_beyond_one_block(spark, monkeypatch, name):
    """More rows than one task compares: every row has a finite result, and near rows stay together."""
    monkeypatch.setattr(cluster, "SMALL", 60)
    rng = np.random.RandomState(9)
    x = np.concatenate([rng.normal(c, 0.1, (50, 6)) for c in (0.0, 3.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    out = {r.id: r.embedding for r in getattr(decomposition, name)(df, "id", "x").collect()}
    y = np.array([out[i] for i in range(100)])
    assert np.isfinite(y).all() and y.shape == (100, 2)
    d = np.linalg.norm(y[:, None] - y[None], axis=2) + 1e9 * np.eye(100)
    assert (d.argmin(1) // 50 == np.arange(100) // 50).mean() > 0.9


def test_tsne_by_blocks(spark, monkeypatch):
    """The steps over blocks are those of one task, floor of the probabilities included, while rounding has not grown."""
    rng = np.random.RandomState(12)
    x = np.concatenate([rng.normal(c, 0.3, (40, 4)) for c in (0.0, 2.0, 9.0)])
    df = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    whole = {r.id: r.embedding for r in decomposition.tsne(df, "id", "x", perplexity=5, rate=20.0, steps=12).collect()}
    monkeypatch.setattr(cluster, "SMALL", 50)
    got = {r.id: r.embedding for r in decomposition.tsne(df, "id", "x", perplexity=5, rate=20.0, steps=12).collect()}
    assert sorted(got) == sorted(whole)
    size = max(abs(v) for y in whole.values() for v in y)
    assert size > 1e-3 and all(got[i] == pytest.approx(whole[i], abs=1e-4 * size) for i in whole)


@pytest.mark.parametrize("components", [1, 2, 3])
def test_tsne_compares_vectors_once(spark, monkeypatch, components):
    """No step goes over the vectors again (before, every one did); the first steps are those of one task, equal rows included."""
    rng = np.random.RandomState(13)
    x = np.concatenate([rng.normal(c, 0.3, (60, 5)) for c in (0.0, 2.0)] + [np.ones((12, 5))])
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    options = {"n_components": components, "perplexity": 15, "rate": 20.0, "steps": 9}
    whole = {r.id: r.embedding for r in decomposition.tsne(df, "id", "x", **options).collect()}
    monkeypatch.setattr(cluster, "SMALL", 50)
    passes, blocks = [], cluster._Rows.blocks
    monkeypatch.setattr(cluster._Rows, "blocks", lambda self, f, *a: (passes.append(f.__name__), blocks(self, f, *a))[1])
    got = {r.id: r.embedding for r in decomposition.tsne(df, "id", "x", **options).collect()}
    assert [f for f in passes if f != "_pair_sums"] == [] and len(passes) == (9 if components == 3 else 0)
    size = max(abs(v) for y in whole.values() for v in y)
    assert sorted(got) == sorted(whole) and all(got[i] == pytest.approx(whole[i], abs=1e-4 * size) for i in whole)


def test_tsne_sums():
    """Probabilities and their sums against every pair, also with more equal rows than the perplexity; sums over the embedding against every pair."""
    rng = np.random.RandomState(14)
    x = np.concatenate((rng.normal(size=(3000, 8)), np.ones((40, 8))))
    goal, n = np.log(5), len(x)
    for lo, hi in ((0, 70), (3000, 3040)):
        i, j, p, rest = decomposition._conditionals(x, goal, lo, hi)
        exact = np.zeros((hi - lo, n))
        for a in range(lo, hi):
            d = ((x - x[a]) ** 2).sum(1)
            d -= np.delete(d, a).min()
            b, low, high = 1.0, 0.0, math.inf
            for _ in range(60):
                e = np.exp(-d * b)
                e[a] = 0
                h = np.log(e.sum()) + b * (d * e).sum() / e.sum()
                if abs(h - goal) < 1e-7:
                    break
                low, high = (b, high) if h > goal else (low, b)
                b = b * 2 if math.isinf(high) else (low + high) / 2
            exact[a - lo] = e / e.sum() / (2 * n)
        kept = np.zeros_like(exact, bool)
        kept[i - lo, j] = True
        assert (kept | (exact < decomposition.NEAR / 2 * 1.001)).all() and p == pytest.approx(exact[i - lo, j], rel=1e-3, abs=1e-9 / n)
        lifted = np.maximum(exact, decomposition.FLOOR / 2)
        lifted[np.arange(hi - lo), np.arange(lo, hi)] = 0
        assert rest == pytest.approx(np.where(kept, 0, lifted).sum(1), rel=2e-2, abs=1e-9 / n)
    for span in (1e-3, 1.0, 12.0):
        y = rng.normal(size=(700, 2)) * span
        charges = np.concatenate((np.ones((700, 1)), y, rng.rand(700, 1)), 1)
        exact = decomposition._pair_sums(y, (y, charges, 3), 0, 700)[0][0]
        got = decomposition._kernel_sums(y, charges, 3)
        assert (np.abs(got - exact).max(0) <= 1e-5 * np.abs(charges).sum(0)[[0, 1, 2, 3, 0, 1, 2]]).all()


@pytest.mark.parametrize("name, options", [("hierarchical", (4, "ward")), ("mean_shift", (1.2, 50)), ("spectral", (3, 0.3))])
def test_blocks_give_the_same_clusters(spark, monkeypatch, name, options):
    """Beyond SMALL rows the work goes by blocks; the clusters are those of one task, with equal rows among them."""
    rng = np.random.RandomState(11)
    x = np.concatenate([rng.normal(c, 0.5, (60, 3)) for c in (0.0, 1.5, 4.0, 4.5)] + [np.ones((5, 3))])
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    whole = {r.id: r.cluster for r in getattr(cluster, name)(df, "id", "x", *options).collect()}
    monkeypatch.setattr(cluster, "SMALL", 50)
    monkeypatch.setattr(cluster, "TILE", 37)
    assert {r.id: r.cluster for r in getattr(cluster, name)(df, "id", "x", *options).collect()} == whole
    assert 1 < len(set(whole.values())) < 100
