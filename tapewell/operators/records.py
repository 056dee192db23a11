"""Which delivered row counts, and exact copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_records(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``: ``columns`` of the row with the greatest ``order``.

    One aggregation: the newest row wins inside each map task already, so a key that is delivered
    very often moves one row per task. Rows with a null key cannot be attributed to a record and
    are left out. A null ``order`` is older than any other. Rows that tie in ``order`` are compared
    by ``columns``, so the result never depends on the order of arrival. Maps cannot be compared;
    name orderable columns only. An empty table gives an empty table.
    """
    newest = F.max(F.struct(F.col(order).alias("__order"), *[F.col(c) for c in columns])).alias("__row")
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(key))
        .agg(newest)
        .select(key, *[F.col("__row")[c].alias(c) for c in columns])
    )


def once(rows: DataFrame, key: Sequence[str], columns: Sequence[str], whole: Sequence[str] | None = None) -> DataFrame:
    """Exact copies of a row count once; gives ``key`` and ``columns``.

    Rows are the same when all columns (or ``key``, ``columns`` and those of ``whole``) are the same, null being the same as
    null, NaN as NaN and -0.0 as 0.0. The columns themselves are compared, maps included, so no two different rows are taken
    for one; copies are combined before the shuffle. Different rows with one key all stay.
    """
    names = list(dict.fromkeys([*key, *columns, *(whole or rows.columns)]))
    copies = rows.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.select(*key, *[c for c in columns if c not in key])


def clean_tickers(tickers: str | Column) -> Column:
    """Distinct tickers of an array: nulls dropped, trimmed, upper case, sorted. Null gives an empty array."""
    array = F.col(tickers) if isinstance(tickers, str) else tickers
    kept = F.filter(F.transform(array, lambda t: F.upper(F.trim(t))), lambda t: t.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))
