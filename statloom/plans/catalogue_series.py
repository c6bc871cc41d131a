"""Time series, breaks, panels, instruments, robust covariances, spatial statistics, schedules, reinforcement learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import load
from ..operators import breaks, econometrics, hypothesis, nn, rl, spatial, stochastic, timeseries
from ..operators.gram import least_squares
from .catalogue import one_row, query, rounded


def daily(spark, sf):
    """t, y: total order price per day (in thousands)."""
    o = load(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("t")).agg((F.sum("o_totalprice") / 1000).alias("y"))


_D = "d AS (SELECT o_orderdate::DATE AS t, sum(o_totalprice) / 1000 AS y FROM orders GROUP BY 1)"
_LAG = ", ".join(f"lag(e, {k}) OVER (ORDER BY t) AS l{k}" for k in range(1, 6))
_ACF = f"WITH {_D}, c AS (SELECT t, y - (SELECT avg(y) FROM d) AS e FROM d), l AS (SELECT *, {_LAG} FROM c), r AS (SELECT k::INT AS lag, (SELECT count(*) FROM c) AS n, (SELECT sum(e * CASE k WHEN 1 THEN l1 WHEN 2 THEN l2 WHEN 3 THEN l3 WHEN 4 THEN l4 ELSE l5 END) FROM l) / (SELECT sum(e * e) FROM c) AS rho FROM range(1, 6) r(k))"


@query(_ACF + " SELECT n::BIGINT AS n, lag, round(rho, 8) AS rho FROM r")
def acf(spark, sf):
    return rounded(timeseries.acf(daily(spark, sf), "y", "t", 5), 8)


@query(_ACF + " SELECT round(max(n) * (max(n) + 2) * sum(rho * rho / (n - lag)), 6) AS q FROM r")
def ljung_box_q(spark, sf):
    return rounded(timeseries.ljung_box(daily(spark, sf), "y", "t", 5, p_value=False))


@query(f"WITH {_D}, c AS (SELECT t, y - (SELECT avg(y) FROM d) AS e FROM d), l AS (SELECT e, e - lag(e) OVER (ORDER BY t) AS d FROM c), s AS (SELECT sum(d * d) / sum(e * e) AS dw FROM l) SELECT round(dw, 6) AS dw, dw < 1.5 AS positive, dw > 2.5 AS negative FROM s")
def durbin_watson(spark, sf):
    d = daily(spark, sf)
    mean = d.agg(F.avg("y")).first()[0]
    return rounded(hypothesis.durbin_watson(d.withColumn("e", F.col("y") - mean), "e", "t"))


@query(f"WITH {_D}, a AS (SELECT t, y - lag(y) OVER (ORDER BY t) AS y FROM d), b AS (SELECT t, y - lag(y) OVER (ORDER BY t) AS y FROM a) SELECT t::VARCHAR AS t, round(y, 6) AS y FROM b WHERE y IS NOT NULL")
def difference_d2(spark, sf):
    return rounded(timeseries.difference(daily(spark, sf), "y", "t", 2).withColumn("t", F.col("t").cast("string")), 6)


@query(f"WITH {_D} SELECT t::VARCHAR AS t, round(y, 6) AS y, round(lag(y, 1) OVER (ORDER BY t), 6) AS y_lag1, round(lag(y, 2) OVER (ORDER BY t), 6) AS y_lag2 FROM d")
def lag_matrix(spark, sf):
    return rounded(timeseries.lagged(daily(spark, sf), "y", "t", 2).withColumn("t", F.col("t").cast("string")), 6)


@query(_ACF.replace("range(1, 6) r(k)", "range(1, 2) r(k)") + " SELECT round(rho, 8) AS ar1 FROM r")
def arima_ar1(spark, sf):
    return one_row(spark, {"ar1": round(float(timeseries.ARIMA(1).fit(daily(spark, sf), "y", "t").ar[0]), 8)})


@query()
def arima_forecast(spark, sf):
    d = daily(spark, sf)
    return spark.createDataFrame(list(enumerate(timeseries.ARIMA(2, 1, 1).fit(d, "y", "t").forecast(d, 5))), "step int, y double")


def _pair(spark, sf):
    return load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("t")).agg((F.sum("o_totalprice") / 1000).alias("y"), F.count("*").cast("double").alias("n"))


@query()
def var_forecast(spark, sf):
    d = _pair(spark, sf)
    rows = timeseries.VAR(2).fit(d, ["y", "n"], "t").forecast(d, 4)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "step int, y double, n double")


@query()
def var_irf(spark, sf):
    m = timeseries.VAR(1).fit(_pair(spark, sf), ["y", "n"], "t").irf(3)
    return spark.createDataFrame([(h, i, j, m[h][i][j]) for h in range(4) for i in range(2) for j in range(2)], "h int, i int, j int, response double")


@query()
def granger(spark, sf):
    return one_row(spark, timeseries.granger_causality(_pair(spark, sf), "n", "y", "t", 2))


@query()
def garch(spark, sf):
    return timeseries.GARCH().fit(daily(spark, sf), "y", "t")


@query("""WITH RECURSIVE g(h, v) AS (SELECT 1, 4.0::DOUBLE UNION ALL SELECT h + 1, 0.5 + 0.95 * v FROM g WHERE h < 10) SELECT h::INT AS h, round(v, 8) AS variance FROM g""")
def garch_forecast(spark, sf):
    v = timeseries.garch_forecast(0.5, 0.1, 0.85, 4.0, 10)
    return rounded(spark.createDataFrame([(i + 1, x) for i, x in enumerate(v)], "h int, variance double"), 8)


@query(f"""WITH {_D}, x AS (SELECT y, (t - DATE '1995-01-01')::DOUBLE AS x, t >= DATE '1998-01-01' AS late FROM d),
f AS (SELECT 2 AS s, regr_syy(y, x) - regr_sxy(y, x)**2 / regr_sxx(y, x) AS rss, count(*) AS n FROM x UNION ALL SELECT late::INT, regr_syy(y, x) - regr_sxy(y, x)**2 / regr_sxx(y, x), count(*) FROM x GROUP BY late)
SELECT round(((max(rss) FILTER (s = 2) - sum(rss) FILTER (s < 2)) / 2) / (sum(rss) FILTER (s < 2) / (max(n) FILTER (s = 2) - 4)), 5) AS f FROM f""")
def chow_f(spark, sf):
    import datetime

    d = daily(spark, sf).withColumn("x", F.datediff("t", F.lit("1995-01-01")).cast("double"))
    return one_row(spark, {"f": round(breaks.chow_test(d, "y", ["x"], "t", datetime.date(1998, 1, 1))["f"], 5)})


def _monthly(spark, sf):
    return load(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("t")).agg((F.sum("o_totalprice") / 1000).alias("y"))


@query()
def cusum(spark, sf):
    return breaks.cusum_test(_monthly(spark, sf), "y", [], "t")


@query()
def bai_perron(spark, sf):
    return breaks.bai_perron(_monthly(spark, sf), "y", [], "t", 3)


# panels: nation by year


def panel(spark, sf) -> econometrics.PanelData:
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("time"))
    return econometrics.PanelData(rows.agg((F.sum("o_totalprice") / 1000).alias("y"), F.avg("c_acctbal").alias("x")), "unit", "time", "y", ["x"])


_P = "p AS (SELECT c_nationkey AS unit, year(o_orderdate) AS time, sum(o_totalprice) / 1000 AS y, avg(c_acctbal) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"WITH {_P} SELECT round(regr_slope(y, x), 6) AS slope FROM p")
def pooled_ols(spark, sf):
    return one_row(spark, {"slope": round(econometrics.pooled_ols(panel(spark, sf)).coef["x"], 6)})


@query(f"WITH {_P}, w AS (SELECT y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x FROM p) SELECT round(sum(x * y) / sum(x * x), 6) AS slope FROM w")
def fixed_effects_slope(spark, sf):
    return one_row(spark, {"slope": round(econometrics.fixed_effects(panel(spark, sf)).coef["x"], 6)})


@query(f"WITH {_P}, w AS (SELECT y - lag(y) OVER (PARTITION BY unit ORDER BY time) AS y, x - lag(x) OVER (PARTITION BY unit ORDER BY time) AS x FROM p) SELECT round(sum(x * y) / sum(x * x), 6) AS slope FROM w")
def first_diff_slope(spark, sf):
    return one_row(spark, {"slope": round(econometrics.first_differences(panel(spark, sf)).coef["x"], 6)})


@query(f"WITH {_P}, b AS (SELECT avg(y) AS y, avg(x) AS x FROM p GROUP BY unit) SELECT round(regr_slope(y, x), 6) AS slope FROM b")
def between_slope(spark, sf):
    return one_row(spark, {"slope": round(econometrics.between(panel(spark, sf)).coef["x"], 6)})


@query()
def random_effects(spark, sf):
    p = panel(spark, sf)
    re = econometrics.random_effects(p)
    return one_row(spark, {"slope": re.coef["x"], **econometrics.hausman(econometrics.fixed_effects(p), re)})


@query("""WITH d AS (SELECT o_totalprice AS y, n_regionkey = 1 AS t, o_orderdate >= TIMESTAMP '1998-01-01' AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT round((avg(y) FILTER (t AND p) - avg(y) FILTER (t AND NOT p)) - (avg(y) FILTER (NOT t AND p) - avg(y) FILTER (NOT t AND NOT p)), 3) AS effect FROM d""")
def did(spark, sf):
    o, c, n = load(spark, sf, "orders"), load(spark, sf, "customer"), load(spark, sf, "nation")
    d = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    d = d.select(F.col("o_totalprice").alias("y"), (F.col("n_regionkey") == 1).alias("t"), (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("p"))
    return rounded(econometrics.difference_in_differences(d, "y", "t", "p").select("effect"), 3)


@query("""WITH m AS (SELECT avg(l_quantity) AS x, avg(l_extendedprice) AS y, avg(l_linenumber) AS z FROM lineitem)
SELECT round(sum((l_linenumber - z) * (l_extendedprice - y)) / sum((l_linenumber - z) * (l_quantity - x)), 2) AS beta FROM lineitem, m""")
def iv_2sls_simple(spark, sf):
    return one_row(spark, {"beta": round(econometrics.TwoStageLeastSquares("l_extendedprice", ["l_quantity"], ["l_linenumber"]).fit(load(spark, sf, "lineitem")).coef["l_quantity"], 2)})


@query()
def iv_tests(spark, sf):
    df = load(spark, sf, "lineitem")
    m = econometrics.TwoStageLeastSquares("l_extendedprice", ["l_quantity"], ["l_linenumber", "l_discount"]).fit(df)
    g = econometrics.gmm(df, "l_extendedprice", ["l_quantity"], ["l_linenumber", "l_discount"])
    ar = econometrics.anderson_rubin(df, "l_extendedprice", ["l_quantity"], ["l_linenumber", "l_discount"], [1500.0])
    return one_row(spark, {"beta": m.coef["l_quantity"], "weak": m.has_weak_instruments(), "sargan_p": m.sargan()["p_value"], "gmm_beta": g["coef"]["l_quantity"], "j": g["j"], "ar_p": ar["p_value"]})


_OLS = """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem),
e AS (SELECT l_suppkey, l_quantity, l_quantity - mx AS x, l_extendedprice - my - b * (l_quantity - mx) AS e FROM lineitem, m)"""


@query(_OLS + " SELECT round(sum(x * x * e * e) / sum(x * x)**2, 5) AS hc0, round(count(*) / (count(*) - 2)::DOUBLE * sum(x * x * e * e) / sum(x * x)**2, 5) AS hc1, round(sum(x * x * e * e / (1 - 1.0::DOUBLE / (SELECT count(*) FROM e) - x * x / (SELECT sum(x * x) FROM e))**2) / sum(x * x)**2, 5) AS hc3 FROM e")
def robust_hc(spark, sf):
    df = load(spark, sf, "lineitem")
    fit = least_squares(df, ["l_quantity"], "l_extendedprice")
    return one_row(spark, {k: round(float(econometrics.robust_covariance(df, fit, k.upper())[1, 1]), 5) for k in ("hc0", "hc1", "hc3")})


@query(_OLS + ", g AS (SELECT sum(x * e) AS s FROM e GROUP BY l_suppkey) SELECT round((SELECT count(*) / (count(*) - 1)::DOUBLE * sum(s * s) FROM g) * (count(*) - 1) / (count(*) - 2)::DOUBLE / sum(x * x)**2, 5) AS clustered FROM e")
def clustered_se_simple(spark, sf):
    df = load(spark, sf, "lineitem")
    fit = least_squares(df, ["l_quantity"], "l_extendedprice")
    return one_row(spark, {"clustered": round(float(econometrics.clustered_covariance(df, fit, "l_suppkey")[1, 1]), 5)})


@query(_OLS + " SELECT round(count(*) * regr_r2(e * e, l_quantity), 3) AS lm FROM e")
def breusch_pagan_simple(spark, sf):
    df = load(spark, sf, "lineitem")
    return one_row(spark, {"lm": round(econometrics.breusch_pagan(df, least_squares(df, ["l_quantity"], "l_extendedprice"))["lm"], 3)})


@query()
def residual_tests(spark, sf):
    df = load(spark, sf, "lineitem")
    fit = least_squares(df, ["l_quantity", "l_discount"], "l_extendedprice")
    d = daily(spark, sf)
    ofit = least_squares(d.withColumn("x", F.datediff("t", F.lit("1995-01-01")).cast("double")), ["x"], "y")
    nw = econometrics.robust_covariance(d.withColumn("x", F.datediff("t", F.lit("1995-01-01")).cast("double")), ofit, "NeweyWest", lags=5, order="t")
    return one_row(spark, {"white_p": econometrics.white_test(df, fit)["p_value"], "reset_p": econometrics.ramsey_reset(df, fit)["p_value"], "arch_p": econometrics.arch_test(d, "y", "t", 3)["p_value"], "newey_west": float(nw[1, 1])})


# spatial: nations of one region are neighbours


def _regions(spark, sf):
    n = load(spark, sf, "nation")
    c = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("x"), F.avg("c_acctbal").alias("z"))
    pts = n.join(c, n["n_nationkey"] == c["c_nationkey"]).select(F.col("n_nationkey").cast("long").alias("id"), "x", "z", "n_regionkey")
    a, b = n.select(F.col("n_nationkey").cast("long").alias("i"), "n_regionkey"), n.select(F.col("n_nationkey").cast("long").alias("j"), "n_regionkey")
    w = a.join(b, "n_regionkey").where("i <> j").select("i", "j", F.lit(1.0).alias("w"))
    return pts, w


_W = """x AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS r, sum(c_acctbal) AS x FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
w AS (SELECT a.id AS i, b.id AS j, 1.0::DOUBLE / (SELECT count(*) - 1 FROM x c WHERE c.r = a.r) AS w FROM x a JOIN x b ON a.r = b.r AND a.id <> b.id),
m AS (SELECT avg(x) AS mu, count(*) AS n, sum((x - (SELECT avg(x) FROM x))**2) AS ss FROM x), s AS (SELECT sum(w) AS s0 FROM w)"""


@query(f"WITH {_W} SELECT x.id, round(sum(w.w * b.x), 4) AS lag FROM x JOIN w ON w.i = x.id JOIN x b ON b.id = w.j GROUP BY x.id")
def spatial_lag(spark, sf):
    pts, w = _regions(spark, sf)
    return rounded(spatial.spatial_lag(pts, spatial.row_standardize(w), "id", "x").select("id", "lag"), 4)


@query(f"WITH {_W} SELECT round(max(n) / max(s0) * sum(w.w * (a.x - mu) * (b.x - mu)) / max(ss), 8) AS i FROM w JOIN x a ON a.id = w.i JOIN x b ON b.id = w.j, m, s")
def morans_i(spark, sf):
    pts, w = _regions(spark, sf)
    return rounded(spatial.morans_i(pts, spatial.row_standardize(w), "id", "x").select("i"), 8)


@query(f"WITH {_W} SELECT round((max(n) - 1) / (2 * max(s0)) * sum(w.w * (a.x - b.x)**2) / max(ss), 8) AS c FROM w JOIN x a ON a.id = w.i JOIN x b ON b.id = w.j, m, s")
def gearys_c(spark, sf):
    pts, w = _regions(spark, sf)
    return rounded(spatial.gearys_c(pts, spatial.row_standardize(w), "id", "x").select("c"), 8)


@query(f"WITH {_W}, l AS (SELECT a.id, max(a.x) AS x, sum(w.w * b.x) AS lag FROM x a JOIN w ON w.i = a.id JOIN x b ON b.id = w.j GROUP BY a.id) SELECT id, CASE WHEN x > mu THEN 'H' ELSE 'L' END || CASE WHEN lag > mu THEN 'H' ELSE 'L' END AS quadrant FROM l, m")
def lisa_class(spark, sf):
    pts, w = _regions(spark, sf)
    return spatial.local_morans_i(pts, spatial.row_standardize(w), "id", "x").select("id", "quadrant")


@query()
def lisa_permutation(spark, sf):
    pts, w = _regions(spark, sf)
    return spatial.local_morans_i(pts, spatial.row_standardize(w), "id", "x", permutations=99)


@query()
def spatial_models(spark, sf):
    pts, w = _regions(spark, sf)
    w = spatial.row_standardize(w)
    sar = spatial.SpatialLag("x", ["z"], "id").fit(pts, w)
    err = spatial.spatial_error(pts, w, "id", "x", ["z"])
    return one_row(spark, {"rho": sar.rho, "beta": sar.coef["z"], **{k: v for k, v in sar.impacts()["z"].items()}, "lambda": err["lambda"], "error_beta": err["coef"]["z"]})


@query()
def gwr(spark, sf):
    e = F.col("embedding").cast("array<double>")
    d = load(spark, sf, "embeddings").select("vec_id", F.slice(e, 1, 2).alias("p"), F.get(e, F.lit(2)).alias("x"), F.get(e, F.lit(3)).alias("y"))
    return spatial.gwr(d, "vec_id", "p", "y", "x", 0.1)


# processes and schedules


@query()
def simulated_paths(spark, sf):
    b = stochastic.brownian_motion(spark, 20, 1.0, 100).select(F.lit("bm").alias("kind"), "path", "step", "value")
    g = stochastic.geometric_brownian_motion(spark, 20, 1.0, 252, 100.0, 0.05, 0.2).select(F.lit("gbm").alias("kind"), "path", "step", "value")
    p = stochastic.poisson_process(spark, 20, 3.0, 10.0).select(F.lit("poisson").alias("kind"), "path", "step", F.col("arrival").alias("value"))
    o = stochastic.ornstein_uhlenbeck(spark, 20, 1.0, 50, 2.0, 1.0, 0.3).select(F.lit("ou").alias("kind"), "path", "step", "value")
    h = stochastic.heston(spark, 5, 1.0, 50, 100.0, 0.04, 0.05, 2.0, 0.04, 0.3, -0.7).select(F.lit("heston").alias("kind"), "path", "step", "value")
    return b.unionByName(g).unionByName(p).unionByName(o).unionByName(h)


@query("""SELECT s::BIGINT AS step, round(0.0 + 0.1 * (1 + cos(pi() * least(s, 100) / 100)) / 2, 8) AS cosine, round(0.1 * 0.5 ** (s // 30), 8) AS step_decay, round(0.1 * 0.97 ** s, 8) AS exponential,
round(0.1 * (1 - least(s, 100) / 100.0::DOUBLE) ** 2, 8) AS polynomial, round(CASE WHEN s < 10 THEN 0.1 * (s + 1) / 10.0::DOUBLE ELSE 0.1 END, 8) AS warmup FROM range(0, 120) r(s)""")
def lr_schedules(spark, sf):
    s = F.col("id")
    return rounded(spark.range(120).select(s.alias("step"), nn.cosine_annealing(s, 0.1, 100).alias("cosine"), nn.step_decay(s, 0.1, 30, 0.5).alias("step_decay"), nn.exponential_decay(s, 0.1, 0.97).alias("exponential"), nn.polynomial_decay(s, 0.1, 100, 2.0).alias("polynomial"), nn.warmup(s, 0.1, 10).alias("warmup")), 8)


@query("SELECT i::BIGINT AS i, j::BIGINT AS j, (j <= i)::INT::DOUBLE AS mask FROM range(0, 8) a(i), range(0, 8) b(j)")
def causal_mask(spark, sf):
    return nn.causal_mask(spark, 8)


@query("SELECT p::BIGINT AS pos, d::INT AS dim, round(CASE WHEN d % 2 = 0 THEN sin(p / 10000.0::DOUBLE ** (2 * (d // 2) / 16.0::DOUBLE)) ELSE cos(p / 10000.0::DOUBLE ** (2 * (d // 2) / 16.0::DOUBLE)) END, 8) AS value FROM range(0, 10) a(p), range(0, 16) b(d)")
def positional_encoding(spark, sf):
    return rounded(nn.positional_encoding(spark, 10, 16), 8)


@query("SELECT event_id, event_type, round((value - avg(value) OVER (PARTITION BY event_type)) / sqrt(var_pop(value) OVER (PARTITION BY event_type) + 1e-5), 6) AS normed FROM events")
def batch_norm(spark, sf):
    return rounded(nn.batch_norm(load(spark, sf, "events"), "value", ["event_type"]).select("event_id", "event_type", "normed"))


def _ordered(spark, sf):
    return load(spark, sf, "events").select("user_id", "event_id", "value")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
g AS (SELECT user_id, event_id, r, value AS ret FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, e.value + 0.9 * g.ret FROM g JOIN e ON e.user_id = g.user_id AND e.r = g.r + 1)
SELECT user_id, event_id, round(ret, 9) AS ret FROM g""")
def discounted_returns(spark, sf):
    return rounded(rl.discounted_returns(_ordered(spark, sf), "user_id", "event_id", "value", 0.9), 9)


@query("""WITH RECURSIVE d AS (SELECT user_id, event_id, value + 0.9 * coalesce(lead(value / 2) OVER (PARTITION BY user_id ORDER BY event_id), 0) - value / 2 AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
g AS (SELECT user_id, event_id, r, delta AS a FROM d WHERE r = 1 UNION ALL SELECT d.user_id, d.event_id, d.r, d.delta + 0.9 * 0.8 * g.a FROM g JOIN d ON d.user_id = g.user_id AND d.r = g.r + 1)
SELECT user_id, event_id, round(a * 0.7310585786::DOUBLE, 6) AS advantage FROM g""")
def gae(spark, sf):
    out = rl.generalized_advantage(_ordered(spark, sf).withColumn("v", F.col("value") / 2), "user_id", "event_id", "value", "v", 0.9, 0.8)
    return rounded(out.withColumn("advantage", F.col("advantage") * 0.7310585786))  # away from ties of exact decimals


@query("""SELECT user_id, event_id, event_type AS s, value AS r, lead(event_type) OVER w AS s2, lead(event_type) OVER w IS NULL AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id, event_type)""")
def transitions(spark, sf):
    return rl.transitions(load(spark, sf, "events"), "user_id", "event_id", "event_type", "value")


@query("""WITH p AS (SELECT event_id, value ** 0.6 AS p FROM events), t AS (SELECT sum(p) AS s, count(*) AS n, min(p) AS l FROM p)
SELECT event_id, round(p / s, 10) AS prob, round((n * p / s) ** -0.4 / (n * l / s) ** -0.4, 6) AS weight FROM p, t""")
def prioritized_replay(spark, sf):
    return rounded(rl.prioritized_weights(load(spark, sf, "events").select("event_id", "value"), "value").select("event_id", "prob", "weight"), 6, prob=10)


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 100")
def replay_buffer(spark, sf):
    return rl.replay_buffer(load(spark, sf, "events").select("event_id", "user_id", "value"), "event_id", 100)


@query()
def q_learning(spark, sf):
    code = {t: i for i, t in enumerate(["click", "error", "purchase", "signup", "view"])}
    num = lambda c: F.element_at(F.create_map(*[x for t, i in code.items() for x in (F.lit(t), F.lit(i))]), F.col(c))
    t = rl.transitions(load(spark, sf, "events"), "user_id", "event_id", "event_type", "value")
    t = t.select("user_id", "event_id", num("s").alias("s"), F.coalesce(num("s2"), F.lit(0)).alias("a"), "r", F.coalesce(num("s2"), F.lit(0)).alias("s2"), "done")
    return rl.QLearning(5, 5).fold(t, "user_id", "event_id").groupBy("s", "a").agg(F.avg("q").alias("q"))
