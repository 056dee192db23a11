"""Trailing totals against brute force, and their defined cases."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tapewell.operators.rolling import surges, trailing_totals

DAY = dt.date(2024, 1, 1)
SHAPE = "e string, d date, v double, extra string"


def brute(rows, windows):
    """Totals by looking at every day and every row."""
    own = {r for r in rows if r[0] is not None and r[1] is not None}
    out = {}
    for e in {r[0] for r in own}:
        mine = [r for r in own if r[0] == e]
        day, last = min(r[1] for r in mine), max(r[1] for r in mine)
        while day <= last:
            for w in windows:
                seen = [r[2] for r in mine if r[2] is not None and day - dt.timedelta(w) < r[1] <= day]
                out[e, day, w] = (sum(seen), len(seen))
            day += dt.timedelta(1)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60), st.one_of(st.none(), st.integers(-50, 50)), st.sampled_from(["x", "y"])), max_size=25))
def test_against_brute_force(spark, raw):
    rows = [(e, DAY + dt.timedelta(d), None if v is None else v / 8, x) for e, d, v, x in raw]
    got = trailing_totals(spark.createDataFrame(rows + rows, SHAPE), "e", "d", "v", (7, 30)).collect()
    want = brute(rows, (7, 30))
    assert len(got) * 2 == len(want)
    for r in got:
        for w in (7, 30):
            total, n = want[r["e"], r["d"], w]
            assert r[f"total_{w}"] == pytest.approx(total, abs=1e-12)
            assert r[f"mean_{w}"] == pytest.approx(total / w, abs=1e-12)
            assert r[f"values_{w}"] == n


def test_empty_table(spark):
    assert trailing_totals(spark.createDataFrame([], SHAPE), "e", "d", "v").count() == 0


def test_null_nan_and_infinite_values_extend_the_calendar_only(spark):
    rows = [("a", DAY, 1.0, ""), ("a", DAY + dt.timedelta(3), float("nan"), ""), ("a", DAY + dt.timedelta(5), float("inf"), ""), ("a", DAY + dt.timedelta(6), None, "")]
    got = trailing_totals(spark.createDataFrame(rows, SHAPE), "e", "d", "v", (3,)).orderBy("d").collect()
    assert [r["total_3"] for r in got] == [1, 1, 1, 0, 0, 0, 0]
    assert [r["values_3"] for r in got] == [1, 1, 1, 0, 0, 0, 0]


def test_clashing_column_names(spark):
    rows = spark.createDataFrame([("a", DAY, 2.0, 1)], "date string, __d date, value double, __copy int")
    got = trailing_totals(rows, "date", "__d", "value", (7,)).collect()
    assert got[0]["total_7"] == 2.0


def test_a_surge_needs_values_and_a_high_short_mean(spark):
    rows = [("a", DAY + dt.timedelta(i), 1.0 if i < 30 else 9.0, "") for i in range(40)]
    days = {r["d"] for r in surges(spark.createDataFrame(rows, SHAPE), "e", "d", "v").collect()}
    frame = pd.Series([r[2] for r in rows])
    short, long = frame.rolling(7, min_periods=1).sum() / 7, frame.rolling(30, min_periods=1).sum() / 30
    assert days == {rows[i][1] for i in range(40) if i >= 14 and short[i] >= 1.8 * long[i]}
