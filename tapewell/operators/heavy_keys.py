"""Per-key results without the imbalance of per-key processing: value-frequency compression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least number of ranges into which the values are cut for percentiles, so that no task has all values of a key. A session
#: with many shuffle partitions (``spark.sql.shuffle.partitions``) gets four times as many ranges as partitions.
RANGES = 1024


def compressed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): how often each value occurs with each key, nulls included.

    The first aggregation is by key *and* value: it combines before the shuffle, and a hot key is
    spread over as many tasks as it has values. All later steps work on these rows only.
    """
    return rows.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def key_totals(counts: DataFrame) -> DataFrame:
    """Per key: rows, non-null rows, distinct values and exact sum, from weighted values.

    Null keys are a key of their own. The sum is a decimal sum for whole numbers, so it can't overflow.
    """
    whole = dict(counts.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint")
    weighted = F.col("value").cast("decimal(38,0)") * F.col("n") if whole else F.col("value") * F.col("n")
    return counts.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.sum(weighted).alias("total"),
    )


def key_modes(counts: DataFrame) -> DataFrame:
    """Per key: the most frequent non-null value (the smallest of equals) and its count. Values of any type that has an order."""
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("value").alias("value"))).alias("best")
    return counts.where(F.col("value").isNotNull()).groupBy("key").agg(best).select("key", F.col("best.value").alias("mode_value"), (-F.col("best.minus")).alias("mode_count"))


def key_percentiles(counts: DataFrame, shares: Sequence[float] = (0.5,), interpolate: bool = False) -> DataFrame:
    """Per key: exact percentiles ``p{100*share}`` of the non-null values.

    Without ``interpolate`` the least value with at least that share at or below it; with it the linear interpolation
    between the two values around the place share * (n - 1).

    Two levels, so that no task ever sorts all values of one key: the values are cut into ranges (``RANGES`` or more)
    at global approximate quantiles, weights are added up by key and range, and only the
    ranges that hold a wanted rank are put in order. The cuts decide the balance, never the result. A value finds its
    range by two looks, first among every w-th cut and then among the w cuts there.
    """
    some = counts.where(F.col("value").isNotNull())
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = math.ceil(math.sqrt(max(RANGES, 4 * partitions)))
    ranges = width * width
    cuts = some.agg(F.percentile_approx(F.col("value").cast("double"), [i / ranges for i in range(1, ranges)], 4 * ranges).alias("cuts"))
    number = F.col("value").cast("double")
    below = lambda some_cuts: F.size(F.filter(some_cuts, lambda c: c < number))
    placed = (
        some.withColumn("cuts", cuts.scalar())
        .withColumn("first", below(F.transform(F.sequence(F.lit(width), F.lit(ranges - width), F.lit(width)), lambda i: F.get("cuts", i - 1))))
        .withColumn("part", F.col("first") * width + below(F.slice("cuts", F.col("first") * width + 1, F.lit(width - 1))))
        .drop("cuts", "first")
    )
    by_part = placed.groupBy("key", "part").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wanted = by_part.select("key", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all"))

    def ranks(share: float):
        """Names and ranks (from 1) of the values that a percentile needs, with the weight of the upper one."""
        name = f"p{100 * share:g}"
        if not interpolate:
            return [F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * F.col("all"))).cast("bigint").alias("rank"), F.lit(1.0).alias("w"))]
        place = F.lit(float(share)) * (F.col("all") - 1)
        low = F.floor(place).cast("bigint")
        up = place - low
        return [
            F.struct(F.lit(name).alias("name"), (low + 1).alias("rank"), (1 - up).alias("w")),
            F.struct(F.lit(name).alias("name"), F.least(low + 2, F.col("all")).alias("rank"), up.alias("w")),
        ]

    targets = F.array(*[t for s in shares for t in ranks(s)])
    wanted = wanted.select("key", "part", "before", F.explode(targets).alias("t"), "n").where((F.col("t.rank") > F.col("before")) & (F.col("t.rank") <= F.col("before") + F.col("n")))
    wanted = wanted.groupBy("key", "part").agg(F.first("before").alias("before"), F.collect_list("t").alias("targets"))  # at most two entries per share
    wanted = wanted.select(F.col("key").alias("k"), F.col("part").alias("p"), "before", "targets")
    running = F.sum("n").over(Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    hits = (
        placed.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
        .select("key", "part", "value", "n", "before", "targets")
        .withColumn("upto", F.col("before") + running)
        .select("key", "value", F.explode(F.filter("targets", lambda t: (t["rank"] > F.col("upto") - F.col("n")) & (t["rank"] <= F.col("upto")))).alias("t"))
    )
    mine = lambda s: F.col("t.name") == f"p{100 * s:g}"
    value = lambda s: F.sum(F.when(mine(s), F.col("value") * F.col("t.w"))) if interpolate else F.max(F.when(mine(s), F.col("value")))
    return hits.groupBy("key").agg(*[value(s).alias(f"p{100 * s:g}") for s in shares])


def key_statistics(rows: DataFrame, key: str, value: str, shares: Sequence[float] = (0.5,)) -> DataFrame:
    """Totals, distinct counts, modes and percentiles per key, all from one compressed table."""
    counts = compressed(rows, key, value)
    modes, parts = key_modes(counts), key_percentiles(counts, shares)
    out = key_totals(counts)
    for more in (modes, parts):
        names = [c for c in more.columns if c != "key"]
        more = more.select(F.col("key").alias("__k"), *names)
        out = out.join(more, F.col("key").eqNullSafe(F.col("__k")), "left").drop("__k")
    return out


def dominant_keys(totals: DataFrame, weight: str, share: float, total: DataFrame) -> DataFrame:
    """Rows of ``totals`` whose weight is at least ``share`` of the single value of ``total``."""
    return totals.where(F.col(weight) >= F.lit(share) * total.scalar())
