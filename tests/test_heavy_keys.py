"""Statistics from weighted values against plain ones."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from tapewell.operators import heavy_keys as heavy

ROWS = [("hot", i % 97) for i in range(3000)] + [("hot", None)] * 5 + [("b", 4), ("b", 4), ("b", 2), (None, 1), (None, 7), ("only null", None)]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(ROWS, "key string, value long")
    return {r["key"]: r for r in heavy.key_statistics(df, "key", "value", (0.0, 0.5, 0.9, 1.0)).collect()}


def test_one_row_per_key_with_null_as_a_key(got):
    assert set(got) == {"hot", "b", None, "only null"}


@pytest.mark.parametrize("key", ["hot", "b", None, "only null"])
def test_against_plain_statistics(got, key):
    values = sorted(v for k, v in ROWS if k == key and v is not None)
    r = got[key]
    assert r["n_rows"] == sum(k == key for k, _ in ROWS)
    assert r["n_values"] == len(values)
    assert r["n_distinct"] == len(set(values))
    if not values:
        assert r["total"] is None and r["mode_value"] is None and r["p50"] is None
        return
    assert r["total"] == sum(values)
    most = max(Counter(values).values())
    assert (r["mode_value"], r["mode_count"]) == (min(v for v, n in Counter(values).items() if n == most), most)
    for share in (0.0, 0.5, 0.9, 1.0):
        assert r[f"p{100 * share:g}"] == values[max(1, math.ceil(share * len(values))) - 1]


def test_empty_table(spark):
    assert heavy.key_statistics(spark.createDataFrame([], "key string, value long"), "key", "value").count() == 0


def test_sums_of_doubles_and_dominant_keys(spark):
    df = spark.createDataFrame([("a", 0.5)] * 3 + [("b", 0.25)], "k string, v double")
    totals = heavy.key_totals(heavy.compressed(df, "k", "v"))
    whole = df.selectExpr("sum(v) AS n")
    assert {r["key"] for r in heavy.dominant_keys(totals, "total", 0.5, whole).collect()} == {"a"}


def test_modes_of_strings(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "x"), ("b", None), (None, "z")], "k string, v string")
    assert {r["key"]: (r["mode_value"], r["mode_count"]) for r in heavy.key_modes(heavy.compressed(df, "k", "v")).collect()} == {"a": ("x", 2), None: ("z", 1)}
