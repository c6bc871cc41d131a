"""Descriptive statistics, tests, metrics, preprocessing, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import load
from ..functions import scalar, special
from ..operators import hypothesis, metrics, preprocess, select, stats
from .catalogue import query, rounded


@query("""SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice), 1) AS var_pop,
round(var_samp(l_extendedprice), 1) AS var_samp, round(stddev_pop(l_extendedprice), 4) AS std_pop, round(stddev_samp(l_extendedprice), 4) AS std_samp,
round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max FROM lineitem GROUP BY l_returnflag""")
def describe_by_flag(spark, sf):
    return rounded(stats.describe(load(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4, var_pop=1, var_samp=1)


@query("""SELECT l_returnflag, round(median(l_quantity), 6) AS median, round(quantile_cont(l_extendedprice, 0.3), 4) AS q30, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90
FROM lineitem GROUP BY l_returnflag""")
def median_quantile(spark, sf):
    df = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(stats.median("l_quantity").alias("median"), stats.quantile("l_extendedprice", 0.3).alias("q30"), stats.quantile("l_extendedprice", 0.9).alias("q90"))
    return rounded(df, 4, median=6)


@query("""WITH m AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS mu FROM customer GROUP BY 1),
c AS (SELECT c_mktsegment AS s, count(*)::DOUBLE AS n, avg((c_acctbal - mu)**2) AS m2, avg((c_acctbal - mu)**3) AS m3, avg((c_acctbal - mu)**4) AS m4
      FROM customer JOIN m ON c_mktsegment = m.s GROUP BY 1)
SELECT s AS c_mktsegment, round(m3 / m2**1.5 * sqrt(n * (n - 1)) / (n - 2), 6) AS skew, round(((n - 1) / n)**2 * m4 / m2**2 - 3, 6) AS kurt FROM c""")
def skew_kurt(spark, sf):
    return rounded(load(spark, sf, "customer").groupBy("c_mktsegment").agg(stats.skewness("c_acctbal").alias("skew"), stats.kurtosis("c_acctbal").alias("kurt")))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long(f: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round({f.format(a=a, b=b)}, {digits}) + 0.0 AS value FROM lineitem" for a in _COLS for b in _COLS)


@query(_long("covar_samp({a}, {b})", 2))
def cov_matrix(spark, sf):
    return rounded(stats.cov_matrix(load(spark, sf, "lineitem"), _COLS), 2)


@query(_long("corr({a}, {b})", 6))
def corr_matrix(spark, sf):
    return rounded(stats.corr_matrix(load(spark, sf, "lineitem"), _COLS), 6)




@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM c) WHERE r = 1""")
def majority_segment(spark, sf):
    return stats.majority(load(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def group_counts(spark, sf):
    return stats.group_counts(load(spark, sf, "customer"), "c_mktsegment")


@query("SELECT round(sqrt(sum(l_discount * l_discount)), 6) AS l2, round(sum(abs(l_discount)), 4) AS l1, round(sum(l_discount * l_tax), 4) AS dot FROM lineitem")
def norms(spark, sf):
    return rounded(load(spark, sf, "lineitem").agg(stats.l2_norm("l_discount").alias("l2"), stats.l1_norm("l_discount").alias("l1"), stats.dot("l_discount", "l_tax").alias("dot")), 4, l2=6)


_ANOVA = """WITH g AS (SELECT {g} AS g, count(*) AS n, avg({x}) AS m, var_pop({x}) * count(*) AS ss FROM {t} GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(ss) AS ssw, sum(n * m) / sum(n) AS gm FROM g),
b AS (SELECT sum(g.n * (g.m - t.gm)**2) AS ssb FROM g, t)"""


@query(_ANOVA.format(g="c_mktsegment", x="c_acctbal", t="customer") + " SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f, (k - 1)::BIGINT AS df_between, (n - k)::BIGINT AS df_within FROM t, b")
def anova_f(spark, sf):
    return rounded(stats.anova(load(spark, sf, "customer"), "c_acctbal", "c_mktsegment", p_value=False))


@query()
def anova_p_value(spark, sf):
    return stats.anova(load(spark, sf, "customer"), "c_acctbal", "c_mktsegment")


@query("SELECT round((avg(o_totalprice) - 150000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 6) AS t, (count(*) - 1)::BIGINT AS df FROM orders")
def ttest_1samp_stat(spark, sf):
    return rounded(hypothesis.ttest_1samp(load(spark, sf, "orders"), "o_totalprice", 150000.0, p_value=False))


@query("""WITH a AS (SELECT avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ma, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mb, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va,
var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS vb, count(*) FILTER (o_orderstatus = 'F') AS na, count(*) FILTER (o_orderstatus = 'O') AS nb FROM orders)
SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)), 6) AS t, (na + nb - 2)::BIGINT AS df FROM a""")
def ttest_ind_stat(spark, sf):
    return rounded(hypothesis.ttest_ind(load(spark, sf, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", p_value=False))


@query("""WITH a AS (SELECT var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS vb,
count(*) FILTER (o_orderstatus = 'F') AS na, count(*) FILTER (o_orderstatus = 'O') AS nb FROM orders)
SELECT round(greatest(va, vb) / least(va, vb), 6) AS f, (CASE WHEN vb > va THEN nb ELSE na END - 1)::BIGINT AS df1, (CASE WHEN vb > va THEN na ELSE nb END - 1)::BIGINT AS df2 FROM a""")
def f_test_stat(spark, sf):
    return rounded(hypothesis.f_test(load(spark, sf, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", p_value=False))


@query()
def test_p_values(spark, sf):
    o = load(spark, sf, "orders")
    a, b = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    one = hypothesis.ttest_1samp(o, "o_totalprice", 150000.0).select(F.lit("1samp").alias("test"), "p_value")
    return one.unionByName(hypothesis.ttest_ind(o, "o_totalprice", a, b).select(F.lit("ind").alias("test"), "p_value")).unionByName(hypothesis.f_test(o, "o_totalprice", a, b).select(F.lit("f").alias("test"), "p_value"))


@query()
def permutation_test(spark, sf):
    return hypothesis.permutation_test(load(spark, sf, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING", "c_custkey", 50)


@query("""WITH m AS (SELECT avg(c_acctbal) AS mu FROM customer), c AS (SELECT count(*) AS n, avg((c_acctbal - mu)**2) AS m2, avg((c_acctbal - mu)**3) AS m3, avg((c_acctbal - mu)**4) AS m4 FROM customer, m),
j AS (SELECT n / 6 * ((m3 / m2**1.5)**2 + (m4 / m2**2 - 3)**2 / 4) AS jb FROM c) SELECT round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS p_value FROM j""")
def jarque_bera(spark, sf):
    return rounded(hypothesis.jarque_bera(load(spark, sf, "customer"), "c_acctbal"), 4, p_value=6)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(-(((l_quantity - 25) / 15)**2) / 2) / (15 * sqrt(2 * pi())), 8) AS pdf FROM lineitem")
def normal_pdf(spark, sf):
    df = load(spark, sf, "lineitem")
    z = (F.col("l_quantity") - 25) / 15
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.exp(-z * z / 2) / (15 * F.sqrt(2 * F.pi())), 8).alias("pdf"))


@query()
def distribution_tails(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") % 50) / 10.0).alias("x"))
    return df.select("o_orderkey", special.column(special.normal_cdf, "x").alias("normal"), special.column(special.t_cdf, "x", 7.0).alias("t7"), special.column(special.chi_squared_cdf, "x", 4.0).alias("chi4"), special.column(special.f_cdf, "x", 3.0, 10.0).alias("f3_10"), special.normal_cdf_expr(F.col("x")).alias("normal_expr"))


# metrics: predictions are rules, so that both engines see the same

_PRED = "l_extendedprice AS y, 1800.0::DOUBLE * l_quantity - 6000 AS p"


@query(f"""WITH d AS (SELECT {_PRED} FROM lineitem), m AS (SELECT avg(y) AS mu FROM d)
SELECT round(avg((y - p)**2), 1) AS mse, round(sqrt(avg((y - p)**2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p)**2) / sum((y - mu)**2), 6) AS r2 FROM d, m""")
def regression_report(spark, sf):
    df = load(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (1800.0 * F.col("l_quantity") - 6000).alias("p"))
    return rounded(metrics.regression_report(df, "y", "p"), 4, mse=1, r2=6)


@query(f"""WITH d AS (SELECT {_PRED} FROM lineitem), m AS (SELECT avg(y) AS mu, count(*) AS n FROM d)
SELECT round(1 - (sum((y - p)**2) / sum((y - mu)**2)) * (max(n) - 1) / (max(n) - 4), 6) AS adj FROM d, m""")
def adjusted_r2(spark, sf):
    df = load(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (1800.0 * F.col("l_quantity") - 6000).alias("p"))
    return rounded(df.agg(metrics.adjusted_r2_score("y", "p", 3).alias("adj")))


_CLASS = "SELECT CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS y, CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END AS p, 0.05 + 0.9 * (l_quantity / 51)::DOUBLE AS q FROM lineitem"


def _classes(spark, sf):
    return load(spark, sf, "lineitem").select(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("y"), F.when(F.col("l_returnflag") != "N", 1.0).otherwise(0.0).alias("p"), (0.05 + 0.9 * (F.col("l_quantity") / 51)).alias("q"))


@query(f"""WITH d AS ({_CLASS}), c AS (SELECT count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn FROM d)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def classification_report(spark, sf):
    return rounded(metrics.classification_report(_classes(spark, sf), "y", "p"))


@query(f"""WITH d AS ({_CLASS}), c AS (SELECT count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS ll FROM d)
SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(ll, 6) AS log_loss FROM c""")
def mcc_log_loss(spark, sf):
    return rounded(_classes(spark, sf).agg(metrics.matthews_corrcoef("y", "p").alias("mcc"), metrics.log_loss("y", "q").alias("log_loss")))


@query("""WITH d AS (SELECT (l_linenumber % 4)::BIGINT AS truth, ((l_quantity::BIGINT) % 4)::BIGINT AS prediction FROM lineitem),
g AS (SELECT a.truth, b.prediction FROM range(0, 4) a(truth), range(0, 4) b(prediction))
SELECT g.truth, g.prediction, count(d.truth)::BIGINT AS n FROM g LEFT JOIN d USING (truth, prediction) GROUP BY ALL""")
def confusion_matrix(spark, sf):
    df = load(spark, sf, "lineitem").select((F.col("l_linenumber") % 4).alias("y"), (F.col("l_quantity").cast("long") % 4).alias("p"))
    return metrics.confusion_matrix(df, "y", "p")


# preprocessing


@query("""WITH m AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, round((o_totalprice - mu) / sd, 6) AS standard, round((o_totalprice - lo) / (hi - lo), 6) AS minmax FROM orders, m""")
def scalers(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("standard"), F.col("o_totalprice").alias("minmax"))
    return rounded(preprocess.MinMaxScaler(["minmax"]).fit_transform(preprocess.StandardScaler(["standard"]).fit_transform(df)))


@query("SELECT o_orderkey, round(o_totalprice, 3) AS o_totalprice FROM orders")
def scaler_round_trip(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    s = preprocess.StandardScaler(["o_totalprice"]).fit(df)
    return rounded(s.inverse_transform(s.transform(df)), 3)


def _normalizer(norm: str) -> str:
    return f"""WITH d AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
n AS (SELECT *, {norm} AS n FROM d) SELECT vec_id, round(a / n, 6) AS a, round(b / n, 6) AS b, round(c / n, 6) AS c FROM n"""


def _three(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return load(spark, sf, "embeddings").select("vec_id", *[F.get(e, F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query(_normalizer("abs(a) + abs(b) + abs(c)"))
def normalizer_l1(spark, sf):
    return rounded(preprocess.Normalizer(["a", "b", "c"], "l1").transform(_three(spark, sf)))


@query(_normalizer("sqrt(a * a + b * b + c * c)"))
def normalizer_l2(spark, sf):
    return rounded(preprocess.Normalizer(["a", "b", "c"], "l2").transform(_three(spark, sf)))


@query(_normalizer("greatest(abs(a), abs(b), abs(c))"))
def normalizer_max(spark, sf):
    return rounded(preprocess.Normalizer(["a", "b", "c"], "max").transform(_three(spark, sf)))


@query("""SELECT o_orderkey, o_orderstatus, (o_orderstatus = 'F')::INT::DOUBLE AS o_orderstatus_0, (o_orderstatus = 'O')::INT::DOUBLE AS o_orderstatus_1, (o_orderstatus = 'P')::INT::DOUBLE AS o_orderstatus_2 FROM orders""")
def one_hot(spark, sf):
    return preprocess.OneHotEncoder(["o_orderstatus"]).fit_transform(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


def _imputed(fill: str) -> str:
    return f"""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 11 END::DOUBLE AS x FROM orders)
SELECT o_orderkey, round(coalesce(x, {fill}), 6) AS x FROM d"""


def _missing(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("nan")))).otherwise((F.col("o_orderkey") % 11).cast("double")).alias("x"))


@query(_imputed("(SELECT avg(x) FROM d)"))
def imputer_mean(spark, sf):
    return rounded(preprocess.SimpleImputer(["x"]).fit_transform(_missing(spark, sf)))


@query(_imputed("(SELECT median(x) FROM d)"))
def imputer_median(spark, sf):
    return rounded(preprocess.SimpleImputer(["x"], "median").fit_transform(_missing(spark, sf)))


@query(_imputed("(SELECT x FROM d WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)"))
def imputer_mode(spark, sf):
    return rounded(preprocess.SimpleImputer(["x"], "mode").fit_transform(_missing(spark, sf)))


@query(_imputed("-1"))
def imputer_constant(spark, sf):
    return rounded(preprocess.SimpleImputer(["x"], "constant", -1.0).fit_transform(_missing(spark, sf)))


# selection

_FC = "SELECT '{c}' AS feature, (sum(n * (m - gm)**2) / (max(k) - 1)) / (max(ssw) / (max(tn) - max(k))) AS score FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS gm, sum(ss) OVER () AS ssw, sum(n) OVER () AS tn, count(*) OVER () AS k FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS ss FROM lineitem GROUP BY 1))"
_F_CLASSIF = " UNION ALL ".join(_FC.format(c=c) for c in _COLS)


@query(f"SELECT feature, round(score, 6) AS score FROM ({_F_CLASSIF})")
def f_classif(spark, sf):
    return rounded(select.f_classif(load(spark, sf, "lineitem"), _COLS, "l_returnflag"))


@query(f"SELECT feature, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC) AS rank FROM ({_F_CLASSIF})) WHERE rank <= 2")
def select_k_best(spark, sf):
    return rounded(select.select_k_best(load(spark, sf, "lineitem"), _COLS, "l_returnflag", 2))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice)**2 * (count(*) - 2) / (1 - corr({c}, l_extendedprice)**2), 4) AS score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def f_regression(spark, sf):
    return rounded(select.f_regression(load(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 4)


_MI = """SELECT '{c}' AS feature, round(sum(n / tn * ln(n * tn / (nb * nl))), 6) AS score FROM (SELECT n::DOUBLE AS n, sum(n) OVER () AS tn, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY l_returnflag) AS nl FROM
(SELECT l_returnflag, least(floor(({c}::DOUBLE - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS n FROM lineitem, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem) GROUP BY ALL))"""


@query(" UNION ALL ".join(_MI.format(c=c) for c in _COLS))
def mutual_info(spark, sf):
    return rounded(select.mutual_info_classif(load(spark, sf, "lineitem"), _COLS, "l_returnflag"))


# scalar functions

_X = "SELECT event_id, (value - 100) / 40 AS x FROM events"


@query(f"""WITH d AS ({_X}) SELECT event_id, round(greatest(x, 0), 8) AS relu, round(CASE WHEN x > 0 THEN x ELSE 0.01 * x END, 8) AS leaky, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 8) AS elu,
round(1 / (1 + exp(-x)), 8) AS sigmoid, round(x / (1 + exp(-x)), 8) AS swish, round(tanh(x), 8) AS tanh, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 8) AS gelu FROM d""")
def activations(spark, sf):
    x = F.col("x")
    df = load(spark, sf, "events").select("event_id", ((F.col("value") - 100) / 40).alias("x"))
    return rounded(df.select("event_id", scalar.relu(x).alias("relu"), scalar.leaky_relu(x).alias("leaky"), scalar.elu(x).alias("elu"), scalar.sigmoid(x).alias("sigmoid"), scalar.swish(x).alias("swish"), scalar.tanh(x).alias("tanh"), scalar.gelu(x).alias("gelu")), 8)


@query(f"""WITH d AS ({_CLASS}) SELECT round(avg((y - q)**2), 6) AS mse, round(avg(abs(y - q)), 6) AS mae, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS bce,
round(avg(CASE WHEN abs(y - q) <= 0.5 THEN 0.5 * (y - q)**2 ELSE 0.5 * (abs(y - q) - 0.25) END), 6) AS huber,
round(avg(-(CASE WHEN y > 0.5 THEN 0.25 ELSE 0.75 END) * (1 - CASE WHEN y > 0.5 THEN q ELSE 1 - q END)**2 * ln(CASE WHEN y > 0.5 THEN q ELSE 1 - q END)), 6) AS focal FROM d""")
def losses(spark, sf):
    y, q = F.col("y"), F.col("q")
    return rounded(_classes(spark, sf).agg(scalar.mse_loss(y, q).alias("mse"), scalar.mae_loss(y, q).alias("mae"), scalar.bce_loss(y, q).alias("bce"), scalar.huber_loss(y, q, 0.5).alias("huber"), scalar.focal_loss(y, q).alias("focal")))


@query("""WITH d AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS a FROM embeddings), q AS (SELECT a AS b FROM d WHERE vec_id = (SELECT min(vec_id) FROM d))
SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i])**2))), 5) AS euclidean, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 5) AS manhattan,
round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])**3)) ** (1.0 / 3), 5) AS minkowski, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])), 5) AS dot FROM d, q""")
def distances(spark, sf):
    d = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    q = d.agg(F.min_by("a", "vec_id").alias("b"))
    both = d.join(F.broadcast(q))
    a, b = F.col("a"), F.col("b")
    return rounded(both.select("vec_id", scalar.euclidean(a, b).alias("euclidean"), scalar.manhattan(a, b).alias("manhattan"), scalar.minkowski(a, b, 3).alias("minkowski"), scalar.dot(a, b).alias("dot")), 5)


@query()
def softmax_layernorm(spark, sf):
    a = F.slice(F.col("embedding").cast("array<double>"), 1, 8)
    return load(spark, sf, "embeddings").select("vec_id", scalar.softmax(a).alias("softmax"), scalar.layer_norm(a).alias("normed"), scalar.argmax(a).alias("argmax"))


@query()
def black_scholes(spark, sf):
    o = load(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("s"))
    args = (F.col("s"), F.lit(1200.0), F.lit(0.03), F.lit(0.25), F.lit(1.0))
    return o.select("p_partkey", scalar.black_scholes(*args).alias("call"), scalar.black_scholes(*args, call=False).alias("put"))
