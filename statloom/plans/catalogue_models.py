"""Regression, classification, clustering, decomposition, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import load
from ..operators import cluster, decomposition, gram, models, resample
from .catalogue import one_row, query, rounded

_X = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_simple(spark, sf):
    fit = gram.least_squares(load(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return one_row(spark, {"slope": round(fit.coef["l_quantity"], 4), "intercept": round(fit.coef["intercept"], 3), "r2": round(fit.r2, 6)})


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY 1""")
def ols_by_group(spark, sf):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    df = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return rounded(df, 4, intercept=3, r2=6)


_CENTRED = """WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem),
c AS (SELECT sum((l_quantity - a)**2) AS aa, sum((l_discount - b)**2) AS bb, sum((l_quantity - a) * (l_discount - b)) AS ab,
sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_discount - b) * (l_extendedprice - y)) AS yb FROM lineitem, m)"""


@query(_CENTRED + " SELECT round((ay * bb - yb * ab) / (aa * bb - ab * ab), 3) AS b1, round((yb * aa - ay * ab) / (aa * bb - ab * ab), 1) AS b2 FROM c")
def ols_multi(spark, sf):
    fit = gram.least_squares(load(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return one_row(spark, {"b1": round(fit.coef["l_quantity"], 3), "b2": round(fit.coef["l_discount"], 1)})


@query()
def ols_report(spark, sf):
    fit = gram.least_squares(load(spark, sf, "lineitem"), _X, "l_extendedprice")
    rows = [(c, fit.coef[c], fit.std_errors[c], fit.t_statistics()[c], fit.p_values()[c], fit.r2, fit.adjusted_r2, fit.f) for c in fit.coef]
    return spark.createDataFrame(rows, "term string, coef double, std_error double, t double, p_value double, r2 double, adjusted_r2 double, f double")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem), 2) AS prediction FROM lineitem")
def ols_predict(spark, sf):
    df = load(spark, sf, "lineitem")
    fit = gram.least_squares(df, ["l_quantity"], "l_extendedprice")
    return rounded(fit.predict(df).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prediction"), 2)


@query("""WITH w AS (SELECT l_quantity AS x, l_extendedprice AS y, 1 + l_tax AS w FROM lineitem), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w)
SELECT round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx)**2), 4) AS slope FROM w, m""")
def wls(spark, sf):
    fit = gram.least_squares(load(spark, sf, "lineitem").withColumn("w", 1 + F.col("l_tax")), ["l_quantity"], "l_extendedprice", weight="w")
    return one_row(spark, {"slope": round(fit.coef["l_quantity"], 4)})


@query("SELECT round(sum(l_quantity * l_extendedprice) / (sum(l_quantity * l_quantity) + 10), 4) AS beta FROM lineitem")
def ridge_1(spark, sf):
    return one_row(spark, {"beta": round(gram.ridge(load(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", 10.0)["l_quantity"], 4)})


@query("SELECT round((sum(l_quantity * l_extendedprice) - 1000000) / sum(l_quantity * l_quantity), 4) AS beta FROM lineitem")
def lasso_1(spark, sf):
    return one_row(spark, {"beta": round(gram.lasso(load(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", 1e6)["l_quantity"], 4)})


@query()
def lasso(spark, sf):
    b = gram.lasso(load(spark, sf, "lineitem"), _X, "l_extendedprice", 1000.0)
    return spark.createDataFrame(list(b.items()), "term string, coef double")


def _binary(spark, sf):
    return load(spark, sf, "lineitem").select("*", (F.col("l_linestatus") == "F").cast("double").alias("y"))


@query()
def logistic(spark, sf):
    b = gram.logistic(_binary(spark, sf), ["l_discount", "l_tax"], "y")
    return spark.createDataFrame(list(b.items()), "term string, coef double")


@query()
def elastic_net(spark, sf):
    b = gram.elastic_net(load(spark, sf, "lineitem"), _X, "l_extendedprice", 100.0, 10.0)
    return spark.createDataFrame(list(b.items()), "term string, coef double")


@query("""WITH s AS (SELECT l_returnflag AS c, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS p, avg(l_quantity) AS m1, var_pop(l_quantity) + 1e-9 AS v1, avg(l_discount) AS m2, var_pop(l_discount) + 1e-9 AS v2 FROM lineitem GROUP BY 1),
li AS (SELECT *, row_number() OVER () AS rid FROM lineitem), q AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, c, round(ln(p) - 0.5 * ln(2 * pi() * v1) - (l_quantity - m1)**2 / (2 * v1) - 0.5 * ln(2 * pi() * v2) - (l_discount - m2)**2 / (2 * v2), 10) AS s FROM li, s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s DESC, c) AS r FROM q) WHERE r = 1""")
def gaussian_nb_predict(spark, sf):
    df = load(spark, sf, "lineitem")
    return models.GaussianNB(["l_quantity", "l_discount"], "l_returnflag").fit(df).predict(df).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prediction")


def _counts(spark, sf):
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "quality", F.length("text").cast("double").alias("c0"), F.regexp_count("text", F.lit("[.]")).cast("double").alias("c1"), F.regexp_count("text", F.lit("!")).cast("double").alias("c2"))


@query("""WITH d AS (SELECT quality, length(text)::DOUBLE AS c0, len(regexp_extract_all(text, '[.]'))::DOUBLE AS c1, len(regexp_extract_all(text, '!'))::DOUBLE AS c2 FROM documents JOIN labels USING (doc_id)),
s AS (SELECT quality, sum(c0) AS a, sum(c1) AS b, sum(c2) AS c FROM d GROUP BY 1)
SELECT quality::BIGINT AS quality, f::BIGINT AS feature, round(ln((CASE f WHEN 0 THEN a WHEN 1 THEN b ELSE c END + 1) / (a + b + c + 3)), 6) AS log_prob FROM s, range(0, 3) r(f)""")
def multinomial_nb_params(spark, sf):
    m = models.MultinomialNB(["c0", "c1", "c2"], "quality").fit(_counts(spark, sf))
    return spark.createDataFrame([(c, j, round(w, 6)) for c, _, ws in m.classes for j, w in enumerate(ws)], "quality long, feature long, log_prob double")


_NEAR = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS a FROM embeddings),
p AS (SELECT q.vec_id AS query_id, t.vec_id AS train_id, t.label, sqrt(list_sum(list_transform(range(1, len(q.a) + 1), lambda i: (q.a[i] - t.a[i])**2))) AS d FROM e q JOIN e t ON q.vec_id % 50 = 0 AND t.vec_id <> q.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, train_id) AS rank FROM p) WHERE rank <= 5)"""


def _queries(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.where("vec_id % 50 = 0"), e


_OPT = {"query_id": "vec_id", "train_id": "vec_id", "features": "embedding", "exclude_same": True}


@query(_NEAR + " SELECT query_id, train_id, round(d, 5) AS distance, rank::INT AS rank FROM k")
def knn_top5(spark, sf):
    q, e = _queries(spark, sf)
    return rounded(models.nearest(q, e, 5, **_OPT), 5)


@query(_NEAR + ", v AS (SELECT query_id, label, count(*) AS n FROM k GROUP BY ALL) SELECT query_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS r FROM v) WHERE r = 1")
def knn_classify(spark, sf):
    q, e = _queries(spark, sf)
    return models.knn_classify(q, e, "label", 5, **_OPT)


@query(_NEAR + " SELECT query_id, round(sum(label / d) / sum(1 / d), 5) AS prediction FROM k GROUP BY 1")
def knn_regress(spark, sf):
    q, e = _queries(spark, sf)
    return rounded(models.knn_regress(q, e, "label", 5, "distance", **_OPT), 5)


@query()
def decision_tree(spark, sf):
    df = _binary(spark, sf)
    return models.TreeModel("decision_tree_classifier", _X, "y").fit(df).predict(df).groupBy("y", "prediction").count()


@query()
def random_forest(spark, sf):
    df = load(spark, sf, "lineitem")
    m = models.TreeModel("random_forest_regressor", _X, "l_extendedprice", numTrees=5, maxDepth=4).fit(df)
    return spark.createDataFrame(list(m.feature_importances().items()), "feature string, importance double")


@query()
def gradient_boosting(spark, sf):
    df = load(spark, sf, "lineitem")
    m = models.TreeModel("gradient_boosting_regressor", _X, "l_extendedprice", maxIter=3).fit(df)
    return one_row(spark, {"r2": m.score(df)})


@query()
def linear_svc(spark, sf):
    df = _binary(spark, sf)
    return models.TreeModel("linear_svc", ["l_discount", "l_tax"], "y", maxIter=5).fit(df).predict(df).groupBy("prediction").count()


@query()
def kernel_svc(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return models.KernelSVC("embedding", "y", gamma=0.5).fit(e, "vec_id").predict(e).select("vec_id", "y", "prediction")


@query("""WITH c AS (SELECT l_quantity AS v, count(*) AS n, sum(l_extendedprice) AS s, sum(l_extendedprice**2) AS q FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(s) AS ts, sum(q) AS tq FROM c),
p AS (SELECT v, lead(v) OVER (ORDER BY v) AS nv, sum(n) OVER w AS n, sum(s) OVER w AS s FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
g AS (SELECT (v + nv) / 2 AS threshold, (s * s / n + (ts - s)**2 / (tn - n) - ts * ts / tn) / tn AS gain FROM p, t WHERE nv IS NOT NULL)
SELECT threshold, round(gain / 1000, 1) AS gain FROM g ORDER BY g.gain DESC, threshold LIMIT 1""")
def tree_best_split(spark, sf):
    df = models.best_split(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(df.withColumn("gain", F.col("gain") / 1000), 1)


def _votes(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).cast("int").alias("a"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("b"), (F.col("o_custkey") % 2).cast("int").alias("c"))
    return o.unpivot("o_orderkey", ["a", "b", "c"], "model", "pred").withColumnRenamed("o_orderkey", "id")


_V = "SELECT o_orderkey AS id, (o_totalprice > 150000)::INT AS a, (o_orderkey % 3 = 0)::INT AS b, (o_custkey % 2)::INT AS c FROM orders"


@query(f"SELECT id, (a + b + c >= 2)::INT AS prediction FROM ({_V})")
def voting_hard(spark, sf):
    return models.voting_hard(_votes(spark, sf))


@query(f"SELECT id, round((a + b + c) / 3.0::DOUBLE, 6) AS prediction FROM ({_V})")
def bagging_mean(spark, sf):
    return rounded(models.bagging_mean(_votes(spark, sf)))


@query()
def stacking(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"))

    def base(train):
        fit = gram.least_squares(train, ["x"], "y")
        return lambda d: fit.predict(d)

    def meta(train, features):
        fit = gram.least_squares(train, features, "y")
        return lambda d: fit.predict(d)

    return models.stacked(df, "o_orderkey", [base], meta, "y", folds=3).select("o_orderkey", "prediction")


# clustering and decomposition

_CENTRES = [[0.3] * 64, [-0.3] * 64, [0.0] * 64]
_KM = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS a FROM embeddings),
d AS (SELECT vec_id, list_transform([0.3, -0.3, 0.0]::DOUBLE[], lambda c: sqrt(list_sum(list_transform(a, lambda v: (v - c)**2)))) AS ds FROM e)"""


@query(_KM + " SELECT vec_id, (list_position(ds, list_min(ds)) - 1)::INT AS cluster, round(list_min(ds), 5) AS distance FROM d")
def kmeans_assign(spark, sf):
    return rounded(cluster.kmeans_assign(load(spark, sf, "embeddings"), "embedding", _CENTRES).select("vec_id", "cluster", "distance"), 5)


@query(_KM + " SELECT round(sum(list_min(ds)**2), 3) AS inertia FROM d")
def kmeans_inertia(spark, sf):
    return one_row(spark, {"inertia": round(cluster.kmeans_step(load(spark, sf, "embeddings"), "embedding", _CENTRES)[1], 3)})


@query()
def kmeans(spark, sf):
    e = load(spark, sf, "embeddings")
    fit = cluster.kmeans(e, "embedding", "vec_id", 4, max_iter=8)
    return cluster.kmeans_assign(e, "embedding", fit["centres"]).select("vec_id", "cluster")


def _points(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return load(spark, sf, "embeddings").select("vec_id", "label", F.slice(e, 1, 2).alias("p"))


_NB = "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.vec_id <> b.vec_id AND sqrt((a.x - b.x)**2 + (a.y - b.y)**2) <= {eps})"


@query(_NB.format(eps="0.03::DOUBLE") + ", c AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 4) SELECT (SELECT count(*) FROM c)::BIGINT AS cores, (SELECT count(*) FROM e WHERE vec_id NOT IN (SELECT i FROM c) AND vec_id NOT IN (SELECT i FROM n WHERE j IN (SELECT i FROM c)))::BIGINT AS noise")
def dbscan_counts(spark, sf):
    out = cluster.dbscan(_points(spark, sf), "vec_id", "p", 0.03, 4)
    return out.agg(F.count_if("is_core").alias("cores"), F.count_if(F.col("cluster") == -1).alias("noise"))


@query()
def hierarchical(spark, sf):
    return cluster.hierarchical(load(spark, sf, "embeddings"), "vec_id", "embedding", 5, "ward")


@query()
def mean_shift(spark, sf):
    return cluster.mean_shift(load(spark, sf, "embeddings"), "vec_id", "embedding", 0.5, 50)


@query()
def spectral(spark, sf):
    return cluster.spectral(load(spark, sf, "embeddings"), "vec_id", "embedding", 4)


@query()
def pca(spark, sf):
    e = load(spark, sf, "embeddings")
    return decomposition.PCA(3, "embedding").fit(e).transform(e).select("vec_id", "components")


@query()
def tsne(spark, sf):
    return decomposition.tsne(load(spark, sf, "embeddings"), "vec_id", "embedding", perplexity=5, steps=200)


@query()
def umap(spark, sf):
    return decomposition.umap(load(spark, sf, "embeddings"), "vec_id", "embedding", neighbours=5)


# resampling

_N = "(SELECT count(*) FROM orders)"


@query(f"SELECT o_orderkey, least((row_number() OVER (ORDER BY o_orderkey) - 1) // ({_N} // 5), 4)::INT AS fold FROM orders")
def kfold_assign(spark, sf):
    return resample.kfold(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 >= {_N} - floor({_N} * 0.2 + 0.5) AS is_test FROM orders")
def train_test_split(spark, sf):
    return resample.train_test_split(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query(f"SELECT o_orderkey, round(((SELECT sum(o_totalprice) FROM orders) - o_totalprice) / ({_N} - 1), 4) AS estimate FROM orders")
def jackknife_mean(spark, sf):
    return rounded(resample.jackknife_mean(load(spark, sf, "orders"), "o_orderkey", "o_totalprice"), 4)


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, round((SELECT count(*) FROM customer) / ((SELECT count(DISTINCT c_mktsegment) FROM customer) * count(*))::DOUBLE, 6) AS weight FROM customer GROUP BY 1")
def class_weights(spark, sf):
    return rounded(resample.class_weights(load(spark, sf, "customer"), "c_mktsegment"))


@query("SELECT c_mktsegment, greatest(round(100 * count(*) / (SELECT count(*) FROM customer)::DOUBLE), 1)::BIGINT AS n FROM customer GROUP BY 1")
def stratified_sizes(spark, sf):
    return resample.stratified_sample(load(spark, sf, "customer"), "c_custkey", "c_mktsegment", 100).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT iteration::BIGINT AS iteration, count(*)::BIGINT AS n FROM orders, range(0, 3) r(iteration) GROUP BY 1")
def bootstrap_sizes(spark, sf):
    return resample.bootstrap(load(spark, sf, "orders"), "o_orderkey", 3).groupBy("iteration").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 3::BIGINT AS n FROM customer")
def balanced_bootstrap(spark, sf):
    return resample.balanced_bootstrap(load(spark, sf, "customer"), "c_custkey", 3).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query()
def bootstrap_variants(spark, sf):
    c = load(spark, sf, "customer")
    drawn = resample.bootstrap(c, "c_custkey", 2)
    parts = {"oob": resample.out_of_bag(c, "c_custkey", drawn, 2), "strata": resample.stratified_bootstrap(c, "c_custkey", "c_mktsegment", 2), "block": resample.block_bootstrap(c, "c_custkey", 2, 20), "weighted": resample.weighted_sample(c.withColumn("w", F.abs("c_acctbal")), "c_custkey", "w", 100), "reservoir": resample.reservoir_sample(c, "c_custkey", 50)}
    out = None
    for k, d in parts.items():
        one = d.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def bootstrap_ci(spark, sf):
    return resample.bootstrap_ci(load(spark, sf, "customer"), "c_custkey", "c_acctbal", 100)


_SM = "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)"


@query(_SM + " SELECT label, (SELECT max(n) FROM n)::BIGINT AS n FROM n")
def smote_sizes(spark, sf):
    e = load(spark, sf, "embeddings")
    return resample.smote(e, "vec_id", "embedding", "label", 3).groupBy("label").agg(F.count("*").alias("n"))


@query()
def adasyn(spark, sf):
    e = load(spark, sf, "embeddings")
    return resample.adasyn(e, "vec_id", "embedding", "label", 5).groupBy("label", "synthetic").count()


@query()
def grid_search(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"))

    def score(train, test, params):
        b = gram.ridge(train, ["x"], "y", params["alpha"])["x"]
        return -test.agg(F.avg(F.pow(F.col("y") - b * F.col("x"), F.lit(2)))).first()[0]

    best = resample.grid_search(df, "o_orderkey", 3, {"alpha": [0.0, 1e6]}, score)
    return one_row(spark, {"alpha": best["best_params"]["alpha"], "score": best["best_score"]})
