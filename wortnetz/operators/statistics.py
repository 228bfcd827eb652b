"""Correlation tests, relative increases and densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def correlation_tests(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, r, t, p_value, ci_lower, ci_upper) over the pairs that are complete, per group."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    base = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    low, high = stats.fisher_interval(F.col("r"), F.col("n"))
    out = base.withColumns({"t": stats.t_value(F.col("r"), F.col("n")), "ci_lower": low, "ci_upper": high})
    return out.withColumn("p_value", stats.t_p_value(F.col("t"), (F.col("n") - 2).cast("double")))


def predictor_tests(df: DataFrame, target: str, predictors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """correlation_tests of several predictors with one target, in one aggregation."""
    long = df.select(*by, F.col(target).alias("__y"), F.inline(F.array(*(F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("__x")) for p in predictors))))
    return correlation_tests(long, "__x", "__y", ["predictor", *by])


def absolute(tests: DataFrame) -> DataFrame:
    """|r| with the absolute bounds in order."""
    a, b = F.abs("ci_lower"), F.abs("ci_upper")
    return tests.withColumns({"r": F.abs("r"), "ci_lower": F.least(a, b), "ci_upper": F.greatest(a, b)})


def steiger_tests(df: DataFrame, shared: str, one: str, two: str, by: Sequence[str] = ()) -> DataFrame:
    """Do two predictors correlate differently with the shared variable? n counts rows in which that one is there."""
    base = df.groupBy(*by).agg(F.corr(shared, one).alias("r_jk"), F.corr(shared, two).alias("r_jh"), F.corr(one, two).alias("r_kh"), F.count(shared).alias("n"))
    out = base.withColumn("z", stats.steiger_z(F.col("r_jk"), F.col("r_jh"), F.col("r_kh"), F.col("n")))
    return out.withColumn("p_value", stats.normal_p_value(F.col("z")))


def fisher_mean(df: DataFrame, r: str = "r", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.tanh(F.avg(F.atanh(r))).alias("mean_r"))


def relative_increase(df: DataFrame, column: str, by: Sequence[str], name: str = "increase") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(column), F.min(column).over(Window.partitionBy(*by))) - 1)


def spread(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 - min / max of each metric over data sets, and the largest of these."""
    one = metrics.agg(*((1 - F.try_divide(F.min(c), F.max(c))).alias(c) for c in columns))
    return one.withColumn("largest", F.greatest(*map(F.col, columns)) if len(columns) > 1 else F.col(columns[0]))


def r2_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("rsq").alias("mean_rsq"), F.min("rsq").alias("min_rsq"), F.max("rsq").alias("max_rsq"))


def kernel_density(df: DataFrame, column: str, low: float, high: float, points: int = 64, bandwidth: float | None = None) -> DataFrame:
    """(x, density): a Gaussian kernel on a fixed grid. Values are counted per bin of an eighth of the bandwidth first, so
    the grid meets bins, not rows. Bandwidth: 0.9 * sd * n ** -0.2 unless given."""
    x = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    if bandwidth is None:
        s = x.agg(F.stddev_samp("v"), F.count("v")).first()
        bandwidth = 0.9 * (s[0] or 1.0) * max(s[1], 1) ** -0.2
    width = bandwidth / 8
    bins = x.groupBy(F.round(F.col("v") / width).alias("b")).agg(F.count("*").alias("n"))
    step = (high - low) / (points - 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * step)).alias("x")
    z = (F.col("x") - F.col("b") * width) / bandwidth
    total = bins.agg(F.sum("n").alias("t"))
    return bins.select("b", "n", grid).groupBy("x").agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("s")).join(F.broadcast(total)).select("x", (F.col("s") / (F.col("t") * bandwidth * 2.5066282746310002)).alias("density"))
