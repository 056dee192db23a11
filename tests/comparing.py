"""Rows of two frames as comparable tuples."""

from __future__ import annotations

import decimal
import numbers

import pandas as pd


def value(v):
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
        return str(list(v))
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (numbers.Number, decimal.Decimal)):
        return repr(float(v) + 0.0)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def tuples(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(value, row)) for row in frame[columns].itertuples(index=False))
