"""Tensors, kernels, penalties, derivatives, weighted fits, votes, blends, feature elimination, weights of places, files and pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import load, shared_path
from ..functions import scalar
from ..operators import econometrics, gram, models, preprocess, select, spatial, timeseries
from ..sources import io
from .catalogue import one_row, query, rounded
from .catalogue_series import _D, daily

_VECTORS = """WITH d AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS a FROM embeddings), q AS (SELECT a AS b FROM d WHERE vec_id = (SELECT min(vec_id) FROM d)),
k AS (SELECT vec_id, a, b, list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) AS ab, list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i])**2)) AS dd FROM d, q)"""


def _vectors(spark, sf):
    """vec_id, a: every vector; b: the first of them."""
    d = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return d.join(F.broadcast(d.agg(F.min_by("a", "vec_id").alias("b"))))


@query(_VECTORS + " SELECT vec_id, round(ab, 5) AS linear, round((ab + 1)**3, 4) AS poly, round(exp(-0.5 * dd), 6) AS rbf, round(exp(-ab * ab / 2) / sqrt(2 * pi()), 6) AS gaussian FROM k")
def kernels(spark, sf):
    a, b = F.col("a"), F.col("b")
    out = _vectors(spark, sf).select("vec_id", scalar.linear_kernel(a, b).alias("linear"), scalar.polynomial_kernel(a, b).alias("poly"), scalar.rbf_kernel(a, b, 0.5).alias("rbf"), scalar.gaussian_kernel(scalar.dot(a, b)).alias("gaussian"))
    return rounded(out, 5, poly=4, rbf=6, gaussian=6)


@query(_VECTORS + """ SELECT vec_id, round(a[1] + b[1], 6) AS sum0, round(a[1] - b[1], 6) AS difference0, round(a[2] * b[2], 6) AS product1, round(a[3] / b[3], 4) AS quotient2, round(a[4] * 2.5, 6) AS scaled3,
round(a[1] + a[4], 6) AS trace, round(a[3], 6) AS transposed01, round(a[1] * b[1] + a[2] * b[2], 6) AS matvec0, round(a[1] * b[2] + a[2] * b[4], 6) AS matmul01, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, 2.0::DOUBLE AS eye_trace FROM k""")
def tensors(spark, sf):
    a, b = F.col("a"), F.col("b")
    m, n = (scalar.reshape(F.slice(x, 1, 4), 2, 2) for x in (a, b))
    at = lambda x, *path: at(F.get(x, F.lit(path[0])), *path[1:]) if path else x
    out = _vectors(spark, sf).select(
        "vec_id", at(scalar.add(a, b), 0).alias("sum0"), at(scalar.subtract(a, b), 0).alias("difference0"), at(scalar.multiply(a, b), 1).alias("product1"), at(scalar.divide(a, b), 2).alias("quotient2"), at(scalar.scale(a, 2.5), 3).alias("scaled3"),
        scalar.trace(m).alias("trace"), at(scalar.transpose(m), 0, 1).alias("transposed01"), at(scalar.matvec(m, F.slice(b, 1, 2)), 0).alias("matvec0"), at(scalar.matmul(m, n), 0, 1).alias("matmul01"),
        at(scalar.zeros(3), 1).cast("double").alias("zero"), at(scalar.ones(3), 1).cast("double").alias("one"), scalar.trace(scalar.eye(2)).cast("double").alias("eye_trace"),
    )
    return rounded(out, 6, quotient2=4)


@query("""WITH d AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: v::DOUBLE) AS a FROM embeddings),
m AS (SELECT vec_id, a, list_sum(list_transform(a, lambda x: exp(x))) AS z, list_avg(a) AS mu, list_var_pop(a) AS v, list_max(a) AS hi FROM d)
SELECT vec_id, round(exp(a[1]) / z, 6) AS softmax0, round(exp(a[8]) / z, 6) AS softmax7, round((a[1] - mu) / sqrt(v + 1e-5), 4) AS normed0, round((a[8] - mu) / sqrt(v + 1e-5), 4) AS normed7, (list_position(a, hi) - 1)::INT AS argmax FROM m""")
def softmax_values(spark, sf):
    a = F.slice(F.col("embedding").cast("array<double>"), 1, 8)
    d = load(spark, sf, "embeddings").select("vec_id", scalar.softmax(a).alias("s"), scalar.layer_norm(a).alias("n"), scalar.argmax(a).cast("int").alias("argmax"))
    get = lambda c, i: F.get(c, F.lit(i))
    return rounded(d.select("vec_id", get("s", 0).alias("softmax0"), get("s", 7).alias("softmax7"), get("n", 0).alias("normed0"), get("n", 7).alias("normed7"), "argmax"), 6, normed0=4, normed7=4)


@query("""WITH d AS (SELECT event_id, (value - 100) / 40 AS x FROM events) SELECT event_id, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS relu, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 8) AS sigmoid,
round(1 - tanh(x) * tanh(x), 8) AS tanh, round(CASE WHEN x > 0 THEN x ELSE 0.2 * x END, 8) AS by_name, round(x, 8) AS same FROM d""")
def derivatives(spark, sf):
    x = F.col("x")
    d = load(spark, sf, "events").select("event_id", ((F.col("value") - 100) / 40).alias("x"))
    out = d.select("event_id", scalar.relu_derivative(x).alias("relu"), scalar.sigmoid_derivative(x).alias("sigmoid"), scalar.tanh_derivative(x).alias("tanh"), scalar.activate("leaky_relu", x, alpha=0.2).alias("by_name"), scalar.identity(x).alias("same"))
    return rounded(out, 8)


@query("SELECT round(0.3 * sum(abs(l_discount - 0.05)), 4) AS l1, round(0.2 * sum((l_discount - 0.05)**2), 4) AS l2, round(0.3 * sum(abs(l_discount - 0.05)) + 0.2 * sum((l_discount - 0.05)**2), 4) AS elastic FROM lineitem")
def penalties(spark, sf):
    w = F.col("l_discount") - 0.05
    return rounded(load(spark, sf, "lineitem").agg(scalar.l1_penalty(w, 0.3).alias("l1"), scalar.l2_penalty(w, 0.4).alias("l2"), scalar.elastic_net_penalty(w, 0.3, 0.4).alias("elastic")), 4)


@query("WITH d AS (SELECT l_linestatus = 'F' AS y, 0.05 + 0.9 * (l_quantity / 51)::DOUBLE AS q FROM lineitem) SELECT round(avg(CASE WHEN y THEN -ln(q + 1e-10) ELSE -ln(1 - q + 1e-10) END), 6) AS cross_entropy FROM d")
def cross_entropy(spark, sf):
    q = 0.05 + 0.9 * (F.col("l_quantity") / 51)
    y = F.when(F.col("l_linestatus") == "F", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    return rounded(load(spark, sf, "lineitem").agg(scalar.cross_entropy_loss(y, F.array(q, 1 - q)).alias("cross_entropy")))


@query("""WITH p AS (SELECT o_orderkey AS id, label, avg(CASE WHEN label = 1 THEN p ELSE 1 - p END) AS p FROM
(SELECT o_orderkey, (o_orderkey % 7) / 6.0::DOUBLE AS p FROM orders UNION ALL SELECT o_orderkey, (o_custkey % 11) / 10.0::DOUBLE FROM orders), (SELECT unnest([0, 1]) AS label) GROUP BY ALL)
SELECT id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, label) AS r FROM p) WHERE r = 1""")
def voting_soft(spark, sf):
    o = load(spark, sf, "orders")
    one = o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.struct(F.lit("a").alias("model"), ((F.col("o_orderkey") % 7) / 6.0).alias("q")), F.struct(F.lit("b").alias("model"), ((F.col("o_custkey") % 11) / 10.0).alias("q")))).alias("m"))
    both = one.select("id", "m.model", F.explode(F.array(F.struct(F.lit(0).alias("label"), (1 - F.col("m.q")).alias("p")), F.struct(F.lit(1).alias("label"), F.col("m.q").alias("p")))).alias("x"))
    return models.voting_soft(both.select("id", "model", "x.label", F.round("x.p", 12).alias("p")))


_XY = "d AS (SELECT o_orderkey, o_totalprice AS y, o_custkey::DOUBLE AS x, o_orderkey % 4 = 0 AS h FROM orders)"


@query(f"WITH {_XY} SELECT o_orderkey, round(x * (SELECT regr_slope(y, x) FROM d WHERE h) + (SELECT regr_intercept(y, x) FROM d WHERE h), 2) AS prediction FROM d WHERE h")
def blending(spark, sf):
    """One linear base model and a linear meta model: the blend is the regression over the held-out rows."""
    d = load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"))

    def fit(train, features=("x",)):
        f = gram.least_squares(train, list(features), "y")
        return lambda rows: f.predict(rows)

    hold = F.col("o_orderkey") % 4 == 0
    return rounded(models.blended(d.where(~hold), d.where(hold), [fit], fit, "y").select("o_orderkey", "prediction"), 2)


@query("""WITH w AS (SELECT l_quantity AS x, l_extendedprice AS y, 1 / (1 + 10 * l_tax) AS w FROM lineitem), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w)
SELECT round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx)**2), 4) AS slope FROM w, m""")
def gls(spark, sf):
    d = load(spark, sf, "lineitem").withColumn("v", 1 + 10 * F.col("l_tax"))
    return rounded(one_row(spark, {"slope": gram.gls(d, ["l_quantity"], "l_extendedprice", "v").coef["l_quantity"]}), 4)


@query("""WITH c AS (SELECT 'l_quantity' AS feature, abs(regr_slope(l_extendedprice, l_quantity)) AS a FROM lineitem),
s AS (SELECT covar_pop(l_discount, l_extendedprice) AS s1, covar_pop(l_tax, l_extendedprice) AS s2, covar_pop(l_discount, l_tax) AS s12, var_pop(l_discount) AS v1, var_pop(l_tax) AS v2 FROM lineitem)
SELECT CASE WHEN abs(s1 * v2 - s2 * s12) >= abs(s2 * v1 - s1 * s12) THEN 'l_discount' ELSE 'l_tax' END AS feature FROM s""")
def rfe(spark, sf):
    left = select.rfe(load(spark, sf, "lineitem"), ["l_discount", "l_tax"], "l_extendedprice", 1)
    return spark.createDataFrame([(c,) for c in left], "feature string")


@query("""WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem), r AS (SELECT count(*) AS n, regr_syy(y, x) AS tss, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_avgx(y, x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),
f AS (SELECT *, tss - sxy * sxy / sxx AS rss FROM r), s AS (SELECT *, rss / (n - 2) AS s2 FROM f)
SELECT term, round(coef, 3) AS coef, round(se, 4) AS std_error, round(coef / se, 3) AS t, round(1 - rss / tss, 8) AS r2, round(1 - (rss / tss) * (n - 1) / (n - 2), 8) AS adjusted_r2
FROM (SELECT 'l_quantity' AS term, b AS coef, sqrt(s2 / sxx) AS se, * FROM s UNION ALL SELECT 'intercept', a, sqrt(s2 * (1.0::DOUBLE / n + mx * mx / sxx)), * FROM s)""")
def ols_t_values(spark, sf):
    fit = gram.least_squares(load(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    rows = [(c, fit.coef[c], fit.std_errors[c], fit.t_statistics()[c], fit.r2, fit.adjusted_r2) for c in fit.coef]
    return rounded(spark.createDataFrame(rows, "term string, coef double, std_error double, t double, r2 double, adjusted_r2 double"), 8, coef=3, std_error=4, t=3)


@query("""WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem), r AS (SELECT count(*) AS n, regr_syy(y, x) AS tss, regr_syy(y, x) - regr_sxy(y, x)**2 / regr_sxx(y, x) AS rss FROM d)
SELECT round(n * ln(tss / rss), 2) AS lr, 1 AS df FROM r""")
def likelihood_ratio(spark, sf):
    """Regression against its mean, from Gaussian log-likelihoods."""
    import math

    df = load(spark, sf, "lineitem")
    full = gram.least_squares(df, ["l_quantity"], "l_extendedprice")
    n, tss = df.agg(F.count("*"), F.var_pop("l_extendedprice") * F.count("*")).first()
    got = econometrics.likelihood_ratio(-n / 2 * math.log(tss / n), -n / 2 * math.log(full.rss / n), 1)
    return rounded(one_row(spark, {"lr": got["lr"], "df": got["df"]}), 2)


@query(f"WITH {_D} SELECT round(3 * avg(y) - 1.6448536269514722 * sqrt(var_samp(y) * 3), 4) AS var FROM d")
def value_at_risk(spark, sf):
    mean, variance = daily(spark, sf).agg(F.avg("y"), F.var_samp("y")).first()
    return rounded(one_row(spark, {"var": timeseries.value_at_risk(variance, 0.95, 3, mean)}), 4)


@query(f"""WITH {_D}, c AS (SELECT t, y - (SELECT avg(y) FROM d) AS e FROM d), l AS (SELECT e, lag(e) OVER (ORDER BY t) AS p FROM c),
r AS (SELECT sum(e * p) / (SELECT sum(e * e) FROM c) AS phi FROM l), z AS (SELECT e FROM c ORDER BY t DESC LIMIT 1)
SELECT (h - 1)::INT AS step, round((SELECT avg(y) FROM d) + phi**h * e, 5) AS y FROM r, z, range(1, 5) x(h)""")
def arima_ar_forecast(spark, sf):
    d = daily(spark, sf)
    return rounded(spark.createDataFrame(list(enumerate(timeseries.ARIMA(1).fit(d, "y", "t").forecast(d, 4))), "step int, y double"), 5)


_PLACES = "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)"


def _places(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("p"))


@query(_PLACES + " SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM p WHERE d <= 0.02")
def weights_within(spark, sf):
    return spatial.row_standardize(spatial.weights_within(_places(spark, sf), "vec_id", "p", 0.02))


@query(_PLACES + " SELECT i, j, 1.0::DOUBLE AS w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p) WHERE r <= 3")
def weights_nearest(spark, sf):
    return spatial.weights_knn(_places(spark, sf), "vec_id", "p", 3)


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) + 0.0 AS o_totalprice FROM orders")
def saved_model(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    path = shared_path(spark, "model")
    io.save_model(spark, preprocess.StandardScaler(["o_totalprice"]).fit(o), path)
    return rounded(io.load_model(spark, path).transform(o))


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, c_nationkey::INT AS c_nationkey FROM customer")
def connectors(spark, sf):
    """A table through CSV, JSON, ORC and partitioned Parquet, one format after the other."""
    df, schema = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("int").alias("c_nationkey")), "c_custkey long, c_mktsegment string, c_acctbal double, c_nationkey int"
    for kind, options in (("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("parquet", {})):
        path = shared_path(spark, f"copy-{kind}")
        io.write(df, path, kind, partition_by=["c_nationkey"] if kind == "parquet" else None, **options)
        df = io.read(spark, path, kind, schema, **options).select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    return rounded(df, 2)


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders), f AS (SELECT o_orderkey, coalesce(x, (SELECT avg(x) FROM d)) AS x FROM d)
SELECT o_orderkey, round((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) + 0.0 AS x FROM f""")
def pipeline_of_steps(spark, sf):
    d = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("x"))
    return rounded(preprocess.Pipeline([("fill", preprocess.SimpleImputer(["x"])), ("scale", preprocess.StandardScaler(["x"]))]).fit(d).transform(d))
