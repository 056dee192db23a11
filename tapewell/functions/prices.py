"""Returns, range variances and volatilities as column expressions. Missing stays NULL throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Measures in the order of the output columns.
MEASURES = ("ja_gk", "ja_rs", "ja_pk", "gk", "pk", "sqret")
_LN2 = math.log(2.0)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); NULL unless the ratio is positive."""
    ratio = F.try_divide(a, b)
    return F.when(ratio > 0, F.log(ratio))


def simple_return(price: Column, by: WindowSpec) -> Column:
    return F.try_divide(price, F.lag(price).over(by)) - 1


def log_return(price: Column, by: WindowSpec) -> Column:
    return log_ratio(price, F.lag(price).over(by))


def intraday(open_: Column, high: Column, low: Column, close: Column, previous: Column) -> dict[str, Column]:
    """Log ratios: overnight o, close c, up u, down d (the last three against the open)."""
    return {"o": log_ratio(open_, previous), "c": log_ratio(close, open_), "u": log_ratio(high, open_), "d": log_ratio(low, open_)}


def variances(o: Column, c: Column, u: Column, d: Column) -> dict[str, Column]:
    """Overnight, Garman-Klass, Rogers-Satchell and Parkinson variance of one bar."""
    return {
        "overnight": o * o,
        "gk": 0.5 * (u - d) * (u - d) - (2 * _LN2 - 1) * c * c,
        "rs": u * (u - c) + d * (d - c),
        "pk": (u - d) * (u - d) / (4 * _LN2),
    }


def root(v: Column) -> Column:
    """Square root of the non-negative part; ``greatest`` skips NULL, so NULL is kept by hand."""
    return F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))


def volatilities(overnight: Column, gk: Column, rs: Column, pk: Column, ret: Column) -> dict[str, Column]:
    return {
        "ja_gk": root(overnight + gk),
        "ja_rs": root(overnight + rs),
        "ja_pk": root(overnight + pk),
        "gk": root(gk),
        "pk": root(pk),
        "sqret": F.sqrt(ret * ret),
    }


def annualised(daily: Column, days: int = 252) -> Column:
    return daily * math.sqrt(days)
