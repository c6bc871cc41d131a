"""Hypothesis tests: aggregates for the statistics, distribution tails on the one row that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import clean, ratio
from ..functions import special


def _tail(df: DataFrame, f, *args: str) -> DataFrame:
    return df.withColumn("p_value", special.column(f, *[F.col(a).cast("double") for a in args]))


def ttest_1samp(df: DataFrame, column: str, mu: float, p_value: bool = True) -> DataFrame:
    x = clean(column)
    n = F.count(x)
    out = df.agg(ratio(F.avg(x) - mu, F.stddev_samp(x) / F.sqrt(n)).alias("t"), (n - 1).alias("df"))
    return _tail(out, special.t_test_p_value, "t", "df") if p_value else out


def _two(column: str, first: Column, second: Column) -> tuple[Column, Column]:
    x = clean(column)
    return F.when(first, x), F.when(second, x)


def ttest_ind(df: DataFrame, column: str, first: Column, second: Column, p_value: bool = True) -> DataFrame:
    """Pooled variance."""
    a, b = _two(column, first, second)
    na, nb = F.count(a), F.count(b)
    pooled = ratio(F.var_samp(a) * (na - 1) + F.var_samp(b) * (nb - 1), na + nb - 2)
    out = df.agg(ratio(F.avg(a) - F.avg(b), F.sqrt(pooled * (1 / na + 1 / nb))).alias("t"), (na + nb - 2).alias("df"))
    return _tail(out, special.t_test_p_value, "t", "df") if p_value else out


def f_test(df: DataFrame, column: str, first: Column, second: Column, p_value: bool = True) -> DataFrame:
    """Larger over smaller variance; degrees of freedom go with their variance."""
    a, b = _two(column, first, second)
    va, vb = F.var_samp(a), F.var_samp(b)
    swap = vb > va
    out = df.agg(
        F.when(swap, ratio(vb, va)).otherwise(ratio(va, vb)).alias("f"),
        F.when(swap, F.count(b) - 1).otherwise(F.count(a) - 1).alias("df1"),
        F.when(swap, F.count(a) - 1).otherwise(F.count(b) - 1).alias("df2"),
    )
    return _tail(out, special.f_test_p_value, "f", "df1", "df2") if p_value else out


def permutation_test(df: DataFrame, column: str, first: Column, id_column: str, permutations: int = 200, seed: int = 0) -> DataFrame:
    """Difference of means: observed, and the share of relabellings at least as far from 0.

    Rows where ``first`` holds are the first group. Each permutation orders all rows by a hash of (id, permutation);
    the share of rows that get the first label is the group's size. Rows are summed by permutation and leading bits of the hash;
    only those of the one bucket in which the group ends, one in 4096 or so, are ranked.
    """
    x = df.select(F.col(id_column).alias("id"), clean(column).alias("x"), first.alias("g")).where("x is not null and g is not null")
    base = x.agg(F.count_if("g").alias("na"), F.count("*").alias("n"), (F.avg(F.when(F.col("g"), F.col("x"))) - F.avg(F.when(~F.col("g"), F.col("x")))).alias("observed"), F.sum("x").alias("total")).first()
    reps = x.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    reps = reps.withColumn("h", F.xxhash64("id", "perm", F.lit(seed))).withColumn("b", F.shiftright("h", 52))
    upto = Window.partitionBy("perm").orderBy("b")
    cells = reps.groupBy("perm", "b").agg(F.count("*").alias("n"), F.sum("x").alias("s")).withColumn("upto", F.sum("n").over(upto))
    whole = cells.where(F.col("upto") <= base["na"]).select("perm", "s")
    ends = cells.where((F.col("upto") > base["na"]) & (F.col("upto") - F.col("n") < base["na"])).select("perm", "b", (base["na"] - F.col("upto") + F.col("n")).alias("need"))
    last = reps.join(F.broadcast(ends), ["perm", "b"]).withColumn("r", F.row_number().over(Window.partitionBy("perm").orderBy("h", "id")))
    sums = whole.union(last.where("r <= need").select("perm", F.col("x").alias("s"))).groupBy("perm").agg(F.sum("s").alias("s"))
    na, nb = base["na"], base["n"] - base["na"]
    diff = F.col("s") / na - (F.lit(base["total"]) - F.col("s")) / nb
    return sums.agg(F.lit(base["observed"]).alias("observed"), F.avg(F.when(F.abs(diff) >= abs(base["observed"]), 1.0).otherwise(0.0)).alias("p_value"))


def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    x = clean(column)
    jb = F.count(x) / 6 * (F.pow(F.skewness(x), F.lit(2)) + F.pow(F.kurtosis(x), F.lit(2)) / 4)
    return df.agg(jb.alias("jb")).withColumn("p_value", F.exp(-F.col("jb") / 2))


def durbin_watson(df: DataFrame, column: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Statistic with flags for positive (< 1.5) and negative (> 2.5) autocorrelation. The order is global unless ``by`` splits it."""
    from pyspark.sql import Window

    e = clean(column)
    w = Window.partitionBy(*(by or [])).orderBy(order)
    d = df.withColumn("_e", e).withColumn("_d", e - F.lag(e).over(w))
    out = d.groupBy(*(by or [])).agg(ratio(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col("_e") * F.col("_e"))).alias("dw"))
    return out.withColumns({"positive": F.col("dw") < 1.5, "negative": F.col("dw") > 2.5})
