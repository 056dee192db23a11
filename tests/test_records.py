from __future__ import annotations

import datetime as dt

from tapewell.operators.records import clean_tickers, latest_records, once

T = dt.datetime


def test_newest_row_counts_and_null_keys_leave(spark):
    rows = [("a", T(2024, 1, 1), 1), ("a", T(2024, 1, 2), 2), ("a", T(2024, 1, 2), 2), ("b", None, 5), ("b", T(2024, 1, 1), None), (None, T(2024, 1, 1), 9)]
    got = latest_records(spark.createDataFrame(rows, "id string, at timestamp, v int"), "id", "at", ["v"]).collect()
    assert sorted((r["id"], r["v"]) for r in got) == [("a", 2), ("b", None)]


def test_ties_do_not_depend_on_order(spark):
    rows = [("a", T(2024, 1, 1), v) for v in (3, 7, 5)]
    for part in (rows, rows[::-1]):
        got = latest_records(spark.createDataFrame(part, "id string, at timestamp, v int").repartition(3), "id", "at", ["v"]).collect()
        assert [r["v"] for r in got] == [7]


def test_copies_count_once_different_rows_stay(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 2.0), ("a", 1, 3.0), ("b", None, None), ("b", None, None)], "k string, x int, y double")
    assert sorted((r["k"], r["x"] or 0) for r in once(df, ["k"], ["x"]).collect()) == [("a", 1), ("a", 1), ("b", 0)]


def test_clean_tickers(spark):
    df = spark.createDataFrame([(["b ", "A", None, "a"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in df.select(clean_tickers("t")).collect()] == [["A", "B"], [], []]


def test_rows_that_differ_in_where_the_null_stands_both_stay(spark):
    df = spark.createDataFrame([("a", None, 5.0), ("a", 5.0, None), ("a", 5.0, None)], "k string, x double, y double")
    assert sorted((str(r["x"]), str(r["y"])) for r in once(df, ["k"], ["x", "y"]).collect()) == [("5.0", "None"), ("None", "5.0")]


def test_rows_that_differ_only_in_a_map_both_stay(spark):
    df = spark.createDataFrame([("a", {"p": "1", "q": "2"}), ("a", {"q": "2", "p": "1"}), ("a", {"p": "2"}), ("a", None)], "k string, m map<string,string>")
    assert once(df, ["k"], ["m"]).count() == 3 and once(df, ["k"], []).count() == 3
