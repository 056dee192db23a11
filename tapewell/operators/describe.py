"""Descriptive statistics in long form: one aggregation for the moments, counting for the quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.operators.heavy_keys import compressed, key_percentiles


def _long(rows: DataFrame, columns: Sequence[str], stats) -> DataFrame:
    """One row per column with the named statistics: one aggregation over all columns, then a stack of its single row."""
    one = rows.agg(*[F.struct(*[v.alias(k) for k, v in stats(c).items()]).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.variable", "x.s.*")


def quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(variable, p{100*share}): exact quantiles with linear interpolation, by counting in two levels.

    The percentile aggregate would hold every distinct value of a column in one task; this never does.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return key_percentiles(compressed(long.where("v IS NOT NULL"), "variable", "v"), shares, interpolate=True).withColumnRenamed("key", "variable")


def summary(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max, n_missing, pct_missing per column; exact quartiles."""
    basic = _long(
        rows,
        columns,
        lambda c: {
            "count": F.count(c),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "min": F.min(c).cast("double"),
            "max": F.max(c).cast("double"),
            "n_missing": F.count_if(F.col(c).isNull()),
            "pct_missing": 100.0 * F.count_if(F.col(c).isNull()) / F.count(F.lit(1)),
        },
    )
    return basic.join(quantiles(rows, columns, (0.25, 0.5, 0.75)), "variable", "left")


def moments(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Observations, mean, median, deviation, extremes, skewness and excess kurtosis (both of the population) per column."""
    basic = _long(
        rows,
        columns,
        lambda c: {
            "obs": F.count(c),
            "mean": F.avg(c),
            "sd": F.stddev_samp(c),
            "min": F.min(c).cast("double"),
            "max": F.max(c).cast("double"),
            "skew": F.skewness(c),
            "kurt": F.kurtosis(c),
        },
    )
    return basic.join(quantiles(rows, columns, (0.5,)).withColumnRenamed("p50", "median"), "variable", "left")


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every pair of columns, each over the rows that have both; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def per_stock(rows: DataFrame, column: str) -> DataFrame:
    """n, mean, sd, var, min, max per ticker."""
    return rows.groupBy("ticker").agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.var_samp(column).alias("var"), F.min(column).alias("min"), F.max(column).alias("max")
    )


def mean_group(estimates: DataFrame, keys: Sequence[str] = ("exog",), value: str = "delta", se: str = "se") -> DataFrame:
    """Mean group estimator over stocks: mean, its error, t, spread, quantiles, share positive, share significant."""
    t = F.try_divide(F.col(value), F.col(se))
    usable = F.col(se).isNotNull() & (F.col(se) > 0)
    agg = estimates.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mg"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        *[F.percentile(value, q / 100).alias(f"q{q:02d}") for q in (5, 25, 50, 75, 95)],
        F.max(value).alias("max"),
        F.avg((F.col(value) > 0).cast("double")).alias("frac_positive"),
        F.avg(F.when(usable, (F.abs(t) > 1.96).cast("double"))).alias("frac_significant"),
    )
    error = F.col("sd") / F.sqrt("n")
    return agg.withColumn("se_mg", error).withColumn("t_mg", F.try_divide(F.col("mg"), F.col("se_mg")))
