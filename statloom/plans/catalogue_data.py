"""Relational patterns, sources, algebra, optimizers, networks, event windows."""

from __future__ import annotations



import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frames import load, shared_path
from ..operators import linalg, nn, optimize
from ..sources import datasets, io
from ..streaming import events
from .catalogue import one_row, query, rounded


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 5")
def topk_per_group(spark, sf):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return load(spark, sf, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 5").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "r")


@query("SELECT c_custkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def union_append(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("src")).unionByName(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("src")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_oob(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def row_gather(spark, sf):
    c = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


_EV = "SELECT {w} AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def _events(spark, sf):
    return load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(_EV.format(w="epoch(date_trunc('hour', ts))::BIGINT"))
def tumbling_events(spark, sf):
    w = events.tumbling(_events(spark, sf), "1 hour", ["event_type"])
    return rounded(w.withColumn("window_start", F.unix_timestamp("window_start")), 4)


@query("WITH e AS (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) " + _EV.format(w="epoch(w)::BIGINT").replace("FROM events", "FROM e"))
def sliding_events(spark, sf):
    w = events.sliding(_events(spark, sf), "2 hours", "1 hour", ["event_type"])
    return rounded(w.withColumn("window_start", F.unix_timestamp("window_start")), 4)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT (epoch_us(min(ts)) // 1000000)::BIGINT AS session_start, (epoch_us(max(ts) + INTERVAL 6 HOUR) // 1000000)::BIGINT AS session_end, user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_events(spark, sf):
    s = events.sessions(_events(spark, sf), "6 hours", ["user_id"])
    return rounded(s.withColumns({"session_start": F.unix_timestamp("session_start"), "session_end": F.unix_timestamp("session_end")}), 4)


def _stream(spark, sf):
    """The events table as a stream; a single file or a folder of files."""
    batch = load(spark, sf, "events")
    reader = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet")
    path = f"{sf}/events.parquet"
    single = len(batch.inputFiles()) == 1 and batch.inputFiles()[0].endswith("events.parquet")
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf) if single else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(_EV.format(w="epoch(date_trunc('hour', ts))::BIGINT"))
def streaming_tumbling(spark, sf):
    s = events.tumbling(_stream(spark, sf), "1 hour", ["event_type"])
    base = shared_path(spark, "streams")
    import uuid

    name = f"w{uuid.uuid4().hex[:10]}"
    out = events.run_available(s, spark, name, f"{base}/stream-{name}")
    return rounded(out.withColumn("window_start", F.unix_timestamp("window_start")), 4)


@query("SELECT unnest(['regression', 'classification', 'iris']) AS name, unnest([100, 90, 15])::BIGINT AS n")
def generated_tables(spark, sf):
    reg, _ = datasets.make_regression(spark, 100, 5, 0.1)
    cls = datasets.make_classification(spark, 90, 4, 3)
    return reg.agg(F.lit("regression").alias("name"), F.count("*").alias("n")).unionByName(cls.agg(F.lit("classification").alias("name"), F.count("*").alias("n"))).unionByName(datasets.load_iris(spark).agg(F.lit("iris").alias("name"), F.count("*").alias("n")))


@query("WITH a AS (SELECT c_nationkey AS i, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS j, sum(c_acctbal) AS v FROM customer GROUP BY ALL) SELECT x.i::BIGINT AS i, y.i::BIGINT AS j, round(sum(x.v * y.v) / 1000000, 3) AS v FROM a x JOIN a y ON x.j = y.j GROUP BY ALL")
def sparse_matmul(spark, sf):
    seg = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    a = load(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i"), seg.alias("j")).agg(F.sum("c_acctbal").alias("v"))
    return rounded(linalg.matmul(a, linalg.transpose(a)).withColumn("v", F.col("v") / 1e6), 3)


@query("SELECT -2.0::DOUBLE AS det, 2.0::DOUBLE AS x0, 3.0::DOUBLE AS x1, round(1 / 1.0, 8) AS chol, 0.0::DOUBLE AS qr_error, round((7 + sqrt(17)) / 2, 8) AS s0")
def dense_algebra(spark, sf):
    a = np.array([[4.0, 2.0], [2.0, 3.0]])
    q, r = linalg.qr(a)
    x = linalg.solve([[3, 1], [1, 2]], [9, 8])
    return rounded(one_row(spark, {"det": linalg.det([[1, 2], [3, 4]]), "x0": float(x[0]), "x1": float(x[1]), "chol": float(linalg.cholesky(a)[1, 0]), "qr_error": float(np.abs(q @ r - a).max()), "s0": float(linalg.svd(a)[1][0])}), 8)


@query()
def optimizers(spark, sf):
    f = lambda x: float((x**2).sum())
    rows = [(n, float(f(g))) for n, g in (("gd", optimize.gradient_descent(f, [5, 5])), ("nesterov", optimize.gradient_descent(f, [5, 5], momentum=0.5, nesterov=True)), ("adam", optimize.adam(f, [5, 5])), ("lbfgs", optimize.lbfgs(f, [5, 5])), ("cd", optimize.coordinate_descent(f, [5, 5])))]
    df = load(spark, sf, "orders")
    g = optimize.frame_objective(df, lambda x: F.avg(F.pow(F.col("o_totalprice") / 1e5 - x[0], F.lit(2))))
    rows.append(("frame_lbfgs", float(optimize.lbfgs(g, [0.0], steps=5)[0])))
    return spark.createDataFrame(rows, "name string, value double")


@query()
def networks(spark, sf):
    e = load(spark, sf, "embeddings")
    net = nn.Sequential([nn.Dense(64, 8, "tanh"), nn.Dense(8, 1)])
    net.fit_frame(e.withColumn("y", F.col("label") / 10), "embedding", "y", epochs=35)
    return net.predict(e.select("vec_id", "embedding"), "embedding").select("vec_id", "prediction")
