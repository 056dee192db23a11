"""Daily sentiment by ticker and model, and its re-aggregation to trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.functions.scalars import approval_weight


def chosen_sentiment(targeted: Column, ticker: Column, overall: Column) -> Column:
    """The score for the ticker where there is one, else the score of the whole text."""
    return F.coalesce(F.try_element_at(targeted, ticker), overall)


def sums(scored: DataFrame, keys=("date", "ticker", "model")) -> DataFrame:
    """Six additive sums per key: the state of the daily aggregate. States of parts add up to the state of the whole.

    Columns of ``scored``: the keys, ``score``, ``sentiment``, ``is_submission``. Rows with NULL or NaN sentiment don't count.
    """
    usable = scored.where(F.col("sentiment").isNotNull() & ~F.isnan("sentiment")).withColumn("__w", approval_weight(F.col("score")))
    return usable.groupBy(*keys).agg(
        F.sum("__w").alias("weight_sum"),
        F.sum(F.col("__w") * F.col("sentiment")).alias("weighted"),
        F.sum(F.col("__w") * F.col("sentiment") * F.col("sentiment")).alias("weighted_squares"),
        F.count(F.lit(1)).alias("mention_count"),
        F.count_if(F.col("is_submission")).alias("submission_count"),
        F.count_if(~F.col("is_submission")).alias("comment_count"),
    )


def merged(*states: DataFrame, keys=("date", "ticker", "model")) -> DataFrame:
    """Sums of several data sets as one."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    names = [c for c in whole.columns if c not in keys]
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def finish(state: DataFrame, keys=("date", "ticker", "model")) -> DataFrame:
    """Weighted mean and dispersion from the sums; dispersion of a single mention is 0."""
    mean = F.try_divide(F.col("weighted"), F.col("weight_sum"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("weighted_squares"), F.col("weight_sum")) - mean * mean))
    return state.select(
        *keys,
        mean.alias("sentiment_avg"),
        F.when(F.col("mention_count") < 2, F.lit(0.0)).otherwise(spread).alias("sentiment_disp"),
        "mention_count",
        "weight_sum",
        "submission_count",
        "comment_count",
    )


def daily_sentiment(scored: DataFrame, keys=("date", "ticker", "model")) -> DataFrame:
    return finish(sums(scored, keys), keys)


def to_trading_days(daily: DataFrame, keys=("trading_date", "ticker")) -> DataFrame:
    """Calendar days that fall on one trading day become one row: sums, weighted mean, greatest dispersion."""
    weight = F.sum("weight_sum")
    return daily.groupBy(*keys).agg(
        F.sum("mention_count").alias("mention_count"),
        weight.alias("weight_sum"),
        (F.sum(F.col("sentiment_avg") * F.col("weight_sum")) / F.when(weight == 0, F.lit(1.0)).otherwise(weight)).alias("sentiment_avg"),
        F.max("sentiment_disp").alias("sentiment_disp"),
    )


def global_stats(daily: DataFrame) -> DataFrame:
    """One row: distinct days, tickers and models, first and last day, all mentions."""
    return daily.agg(
        F.countDistinct("date").alias("n_days"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.countDistinct("model").alias("n_models"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.sum("mention_count").alias("total_mentions"),
    )
