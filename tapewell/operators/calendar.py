"""Trading calendar, gaps and the as-of map from calendar days to trading days.

A calendar holds one row per day, thousands in a lifetime; it is the one place where a window without a
partition is used, always behind a distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(returns: DataFrame) -> DataFrame:
    """(date, trading_day_index, gap_days): gap is the number of days to the next trading day less one, 0 for the last."""
    days = returns.select(F.col("date").cast("date").alias("date")).where("date IS NOT NULL").distinct()
    by = Window.orderBy("date")
    return days.select(
        "date",
        (F.row_number().over(by) - 1).alias("trading_day_index"),
        (F.coalesce(F.datediff(F.lead("date").over(by), F.col("date")), F.lit(1)) - 1).alias("gap_days"),
    )


def as_of_trading_day(rows: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """``rows`` with ``trading_date``: the latest trading day up to ``date``; rows before the first one leave.

    The calendar is small, so it becomes a spine of all days between its first day and the last of ``rows``,
    each with its trading day, and one equi join maps the rows; the planner broadcasts the spine where it is as small as days are.
    No range join, no sort of ``rows``.
    """
    wanted = rows.select(F.col(date).cast("date").alias("__day")).where("__day IS NOT NULL").distinct()
    marked = wanted.withColumn("__trade", F.lit(None).cast("date")).unionByName(calendar.select(F.col("date").alias("__day"), F.col("date").alias("__trade")))
    per_day = marked.groupBy("__day").agg(F.max("__trade").alias("__trade"))
    upto = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    spine = per_day.select("__day", F.last("__trade", ignorenulls=True).over(upto).alias("trading_date")).where("trading_date IS NOT NULL")
    return rows.join(spine, F.col(date).cast("date") == F.col("__day")).drop("__day")
