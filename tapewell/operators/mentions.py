"""Counts over mention records: daily counts, zero-filled ticker statistics, roll-ups, samples, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Widest pivot that is written; beyond it the long table is the result.
MOST_COLUMNS = 10_000


def daily_counts(mentions: DataFrame, keys=("date", "ticker")) -> DataFrame:
    """(date, ticker, n) of exploded mentions."""
    return mentions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def daily_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("date").agg(F.sum("n").alias("total_mentions"))


def ticker_stats(counts: DataFrame, shares=(0.9, 0.95)) -> DataFrame:
    """Per ticker over the grid of all days that occur, days without mentions counting as 0.

    The grid isn't built: a ticker with k of D days has D - k zeros in front of its sorted counts, so mean, median
    and percentiles (linear interpolation) follow from the k counts and the number of zeros.
    """
    days = counts.select("date").distinct().agg(F.count(F.lit(1)).alias("d"))
    per = counts.groupBy("date", "ticker").agg(F.sum("n").alias("n")).where("n > 0")
    each = per.groupBy("ticker").agg(
        F.sum("n").alias("total_mentions"),
        F.count(F.lit(1)).alias("active_days"),
        F.max("n").alias("max_per_day"),
        F.array_sort(F.collect_list("n")).alias("counts"),  # at most one entry per calendar day
    )
    grid = each.withColumn("total_days", days.scalar())

    def at(i):
        zeros = F.col("total_days") - F.col("active_days")
        return F.when(i < zeros, F.lit(0.0)).otherwise(F.coalesce(F.get("counts", (i - zeros).cast("int")).cast("double"), F.lit(0.0)))

    def percentile(p: float):
        place = F.lit(float(p)) * (F.col("total_days") - 1)
        low = F.floor(place)
        high = F.least(low + 1, F.col("total_days") - 1)
        return at(low) + (at(high) - at(low)) * (place - low)

    return grid.select(
        "ticker",
        "total_mentions",
        "active_days",
        "total_days",
        (F.col("total_mentions") / F.col("total_days")).alias("mean_per_day"),
        percentile(0.5).alias("median_per_day"),
        *[percentile(p).alias(f"p{100 * p:g}_per_day") for p in shares],
        "max_per_day",
    )


def global_ticker_stats(counts: DataFrame, datasets: int | None = None) -> DataFrame:
    """``ticker_stats`` over all data sets with the number of data sets that mention the ticker."""
    cover = counts.groupBy("ticker").agg(F.countDistinct("dataset").alias("dataset_coverage"))
    whole = counts.groupBy("date", "ticker").agg(F.sum("n").alias("n"))
    number = F.lit(datasets) if datasets is not None else counts.agg(F.countDistinct("dataset").alias("k")).scalar()
    return ticker_stats(whole).join(cover, "ticker").withColumn("num_datasets", number)


def match_counts(records: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, match_type, n) with a ``_global`` row per type, in one pass by grouping sets."""
    kinds = records.select(F.col(dataset).alias("dataset"), F.explode(F.map_values("match_types")).alias("match_type"))
    rolled = kinds.groupingSets([["dataset", "match_type"], ["match_type"]], "dataset", "match_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("dataset").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, F.lit("_global")).otherwise(F.col("dataset")).alias("dataset"), "match_type", "n")


def source_summary(mentions: DataFrame, source: str = "dataset") -> DataFrame:
    """Distinct tickers, first and last day and mentions per source."""
    return mentions.groupBy(source).agg(F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("mentions"))


def mentioned_tickers(counts: DataFrame) -> DataFrame:
    return counts.select("ticker").where("ticker IS NOT NULL").distinct()


def date_range(totals: DataFrame) -> DataFrame:
    """(first_day, last_day) of a table by day; one row, NULLs for an empty table."""
    return totals.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def top_tickers(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most mentioned tickers; equals in alphabetical order."""
    return counts.groupBy("ticker").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ticker").limit(k)


def coverage_curve(totals: DataFrame, key: str, n: str) -> DataFrame:
    """rank, key, n, share: cumulative share of the total by rank.

    Ranked in two levels, so that a long table isn't sorted by one task: values are counted first, the running
    sums run over the distinct values, and keys are ranked inside their value only.
    """
    by_value = totals.groupBy(F.col(n).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    before = Window.orderBy(F.desc("__v")).rowsBetween(Window.unboundedPreceding, -1)
    steps = by_value.select(
        "__v",
        F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__rank"),
        F.coalesce(F.sum(F.col("__v") * F.col("__k")).over(before), F.lit(0)).alias("__sum"),
    )
    whole = totals.agg(F.sum(n).alias("t"))
    inside = F.row_number().over(Window.partitionBy(n).orderBy(key))
    return (
        totals.withColumn("__i", inside)
        .join(steps, F.col(n).eqNullSafe(F.col("__v")))
        .select(
            (F.col("__rank") + F.col("__i")).alias("rank"),
            F.col(key),
            F.col(n),
            F.try_divide((F.col("__sum") + F.col("__i") * F.col(n)).cast("double"), whole.scalar()).alias("share"),
        )
    )


def sample_records(records: DataFrame, by, k: int = 20, seed: int = 0, identity: str = "id") -> DataFrame:
    """k records per group, the same ones for a seed: those with the smallest hashes.

    Each task keeps its k smallest per group first, so a group never gathers whole in one task.
    """
    by = [by] if isinstance(by, str) else list(by)
    keyed = records.withColumns({"__h": F.md5(F.concat(F.lit(f"{seed}:"), F.col(identity).cast("string"))), "__part": F.spark_partition_id()})
    mine = keyed.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__h", identity))).where(F.col("__i") <= k)
    final = F.row_number().over(Window.partitionBy(*by).orderBy("__h", identity))
    return mine.withColumn("__i", final).where(F.col("__i") <= k).drop("__h", "__part", "__i")


def pivot_counts(counts: DataFrame) -> DataFrame:
    """date and one column per ticker, by total (largest first) and name; missing is 0. The column list is read first."""
    order = [r[0] for r in counts.groupBy("ticker").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "ticker").limit(MOST_COLUMNS + 1).collect()]
    if len(order) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} tickers; write the long table")
    return counts.groupBy("date").pivot("ticker", order).agg(F.sum("n")).na.fill(0)


def unpivot_counts(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c != "date"]
    return wide.unpivot("date", names, "ticker", "n").where("n <> 0")
