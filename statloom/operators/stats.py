"""Descriptive statistics as aggregate expressions and one-pass frames."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import check, clean, ratio
from ..functions.special import f_test_p_value


def mean(c: str) -> Column:
    return F.avg(clean(c))


def variance(c: str, ddof: int = 1) -> Column:
    """NULL where n <= ddof."""
    x = clean(c)
    n = F.count(x)
    return F.when(n > ddof, ratio(F.var_pop(x) * n, n - ddof))


def std(c: str, ddof: int = 1) -> Column:
    return F.sqrt(variance(c, ddof))


def median(c: str) -> Column:
    return F.percentile(clean(c), F.lit(0.5))


def quantile(c: str, q: float, exact: bool = True) -> Column:
    """Linear interpolation at q (n - 1); exact=False for very large groups."""
    if not 0 <= q <= 1:
        return F.lit(None).cast("double")
    return F.percentile(clean(c), F.lit(q)) if exact else F.percentile_approx(clean(c), q, 10_000)


def covariance(x: str, y: str, ddof: int = 1) -> Column:
    n = F.count(F.when(clean(x).isNotNull() & clean(y).isNotNull(), 1))
    return F.when(n > ddof, ratio(F.covar_pop(clean(x), clean(y)) * n, n - ddof))


def correlation(x: str, y: str) -> Column:
    """Pearson; NULL if a side is constant."""
    a, b = clean(x), clean(y)
    both = a.isNotNull() & b.isNotNull()
    return ratio(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def skewness(c: str) -> Column:
    """Adjusted Fisher-Pearson; 0 for a constant."""
    x = clean(c)
    n = F.count(x)
    return F.when(n > 2, F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: str) -> Column:
    """Excess, with the sample standard deviation in the denominator."""
    x = clean(c)
    n = F.count(x).cast("double")
    return F.when(n > 1, F.coalesce(F.pow((n - 1) / n, F.lit(2.0)) * (F.kurtosis(x) + 3) - 3, F.lit(0.0)))


def mode(c: str) -> Column:
    """Most frequent value, the smallest on a tie."""
    return F.mode(F.col(c), deterministic=True)


def l1_norm(c: str) -> Column:
    return F.sum(F.abs(clean(c)))


def l2_norm(c: str) -> Column:
    return F.sqrt(F.sum(clean(c) * clean(c)))


def dot(x: str, y: str) -> Column:
    return F.sum(clean(x) * clean(y))


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, variances, deviations, extremes in one pass."""
    check(df, [column])
    x = clean(column)
    aggs = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var_pop"), variance(column, 1).alias("var_samp"), F.stddev_pop(x).alias("std_pop"), std(column, 1).alias("std_samp"), F.min(x).alias("min"), F.max(x).alias("max")]
    return df.groupBy(*(by or [])).agg(*aggs)


def _matrix(df: DataFrame, columns: list[str], cell) -> DataFrame:
    """Long form (i, j, value), from one aggregate over all rows; both triangles."""
    check(df, columns)
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    one = df.agg(*[cell(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])
    rows = [F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("value")) for i in range(len(columns)) for j in range(len(columns))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cov_matrix(df: DataFrame, columns: list[str], ddof: int = 1) -> DataFrame:
    return _matrix(df, columns, lambda a, b: covariance(a, b, ddof))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """0 in the row and column of a constant, its diagonal included."""
    return _matrix(df, columns, lambda a, b: F.coalesce(correlation(a, b), F.lit(0.0)))


def anova(df: DataFrame, column: str, group: str, p_value: bool = True) -> DataFrame:
    """f, df_between, df_within (and p): two-level aggregation, one row per group in between."""
    check(df, [column])
    x = clean(column)
    groups = df.groupBy(F.col(group).alias("_group")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("ss")).where("n > 0")
    total = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    grand = groups.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_grand"))
    between = groups.join(F.broadcast(grand)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_grand"), F.lit(2))).alias("ssb"))  # grand is one row
    out = total.join(F.broadcast(between)).select((F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), "ssb", "ssw")
    msb, msw = ratio(F.col("ssb"), F.col("df_between")), ratio(F.col("ssw"), F.col("df_within"))
    out = out.select(F.when(msw == 0, F.lit(float("inf"))).otherwise(ratio(msb, msw)).alias("f"), "df_between", "df_within")
    if p_value:
        from ..functions.special import column as over

        out = out.withColumn("p_value", over(f_test_p_value, "f", F.col("df_between").cast("double"), F.col("df_within").cast("double")))
    return out


def group_counts(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def majority(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Most frequent value per group, the smallest on a tie."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))
