"""Totals over trailing calendar windows by event-contribution deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewell.operators.records import once

#: Amounts are summed as decimals: a running sum that adds and subtracts the same decimal ends at
#: exactly zero, which doubles don't guarantee.
AMOUNT = "decimal(38,18)"


def trailing_totals(rows: DataFrame, entity: str, date: str, value: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Total, mean and number of values over the last ``w`` calendar days, for each ``w``.

    One row per entity and calendar day from the entity's first to its last date, with or without
    a row on that day. Columns: entity, date, ``total_{w}``, ``mean_{w}`` (total / w), ``values_{w}``
    (non-null values in the window).

    Each daily amount is an event that adds at its date and subtracts ``w`` days later; the running
    sum of the events is the total. Between two events nothing changes, so the calendar is filled in
    after the sums, not before: the shuffles carry one row per event, not per calendar day. Rows of an
    entity are first added up by day on the map side, so a hot entity costs one row per day and task.

    Exact copies of a row count once; other rows of the same day add up. Null, NaN and infinite
    values count as 0 and not as values, but their day still extends the entity's calendar. Rows
    without an entity or a date can't be placed and are left out. An empty table gives no rows.
    """
    spans = sorted(set(int(w) for w in windows))
    amount = F.when(F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf")), None).otherwise(F.col(value))
    daily = (
        once(rows.where(F.col(entity).isNotNull() & F.col(date).isNotNull()), [entity, date], [value])
        .select(F.col(entity).alias("__e"), F.col(date).cast("date").alias("__d"), amount.cast(AMOUNT).alias("__v"))
        .groupBy("__e", "__d")
        .agg(F.coalesce(F.sum("__v").cast(AMOUNT), F.lit(0).cast(AMOUNT)).alias("__v"), F.count("__v").alias("__n"))
    )
    zero, none = F.lit(0).cast(AMOUNT), F.lit(0).cast("bigint")
    arrive = F.struct(
        F.col("__d").alias("d"),
        F.lit(1).alias("row"),
        *[F.col("__v").alias(f"v{w}") for w in spans],
        *[F.col("__n").alias(f"n{w}") for w in spans],
    )
    leave = [
        F.struct(
            F.date_add("__d", w).alias("d"),
            F.lit(0).alias("row"),
            *[(-F.col("__v")).cast(AMOUNT).alias(f"v{x}") if x == w else zero.alias(f"v{x}") for x in spans],
            *[(-F.col("__n")).alias(f"n{x}") if x == w else none.alias(f"n{x}") for x in spans],
        )
        for w in spans
    ]
    # One shuffle by entity serves the sum of the events, the running sums and the last date.
    events = (
        daily.repartition("__e")
        .select("__e", F.explode(F.array(arrive, *leave)).alias("x"))
        .groupBy("__e", F.col("x.d").alias("__d"))
        .agg(F.max("x.row").alias("__row"), *[F.sum(f"x.{k}{w}").cast(AMOUNT if k == "v" else "bigint").alias(f"{k}{w}") for k in "vn" for w in spans])
    )
    by = Window.partitionBy("__e")
    so_far = by.orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    segments = (
        events.withColumn("__last", F.max(F.when(F.col("__row") == 1, F.col("__d"))).over(by))
        .withColumns({f"{k}{w}": F.sum(f"{k}{w}").over(so_far) for k in "vn" for w in spans})
        .withColumn("__next", F.lead("__d").over(by.orderBy("__d")))
        .where(F.col("__d") <= F.col("__last"))
    )
    until = F.least(F.coalesce(F.date_sub("__next", 1), F.col("__last")), F.col("__last"))
    return segments.select(
        F.col("__e").alias(entity),
        F.explode(F.sequence("__d", until)).alias(date),
        *[
            c
            for w in spans
            for c in (
                F.col(f"v{w}").cast("double").alias(f"total_{w}"),
                (F.col(f"v{w}").cast("double") / w).alias(f"mean_{w}"),
                F.col(f"n{w}").alias(f"values_{w}"),
            )
        ],
    )


def surges(rows: DataFrame, entity: str, date: str, value: str, short: int = 7, long: int = 30, factor: float = 1.8, least: int = 15) -> DataFrame:
    """Days whose short mean is at least ``factor`` times the long mean, with ``least`` values in the long window."""
    totals = trailing_totals(rows, entity, date, value, (short, long))
    return totals.where((F.col(f"values_{long}") >= least) & (F.col(f"mean_{short}") >= factor * F.col(f"mean_{long}")))
