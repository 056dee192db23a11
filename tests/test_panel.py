from __future__ import annotations

import datetime as dt
import math

import pytest

from tapewell.operators import describe, panel
from tapewell.operators.panel import PanelConfig

D = dt.date


def test_z_scores_golden_and_flat(spark):
    rows = [("A", x) for x in (1.0, 2.0, 3.0, 6.0)] + [("B", 5.0), ("C", 2.0), ("C", 2.0)]
    got = panel.standardised(spark.createDataFrame(rows, "ticker string, x double"), {"z": "x"}).collect()
    assert sorted(round(r["z"], 5) for r in got if r["ticker"] == "A") == [-0.92582, -0.46291, 0.0, 1.38873]
    assert {r["z"] for r in got if r["ticker"] != "A"} == {0.0}
    whole = [r["z"] for r in panel.standardised(spark.createDataFrame(rows, "ticker string, x double"), {"z": "x"}, "global").collect()]
    assert sum(whole) == pytest.approx(0, abs=1e-12)


def test_rolling_volatility_golden_and_null_in_the_window(spark):
    values = [0.02, 0.03, 0.01, None, 0.01, 0.01, 0.01]
    df = spark.createDataFrame([("A", D(2024, 1, i + 1), v) for i, v in enumerate(values)], "ticker string, date date, volatility_ja_gk double")
    got = [r for r in panel.rolling_volatility(df, (3,), measures=("ja_gk",)).orderBy("date").collect()]
    assert [r["rolling_volatility_3d"] is None for r in got] == [True, True, False, True, True, True, False]
    assert got[2]["rolling_volatility_3d"] == pytest.approx(0.021602469, abs=1e-9)
    assert got[2]["log_volatility_3d"] == pytest.approx(-3.834947666, abs=1e-8)


def test_lags_count_rows(spark):
    df = spark.createDataFrame([("A", D(2024, 1, d), float(d)) for d in (1, 5, 9)], "ticker string, date date, lag_return double")
    got = [r["lag_return_lag1"] for r in panel.lagged_predictors(df, (1,), ("lag_return",)).orderBy("date").collect()]
    assert got == [None, 1.0, 5.0]
    plan = panel.lagged_predictors(df, (1, 3, 5), ("lag_return",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Window") + plan.count("Window [") <= 3  # one window for all lags


def test_quiet_days_have_no_sentiment(spark):
    df = spark.createDataFrame([("A", 5, 0.5, 0.1), ("A", 1, -0.5, None), ("A", None, 0.2, 0.2)], "ticker string, mention_count int, sentiment_avg double, sentiment_disp double")
    got = panel.sentiment_features(df, PanelConfig(min_posts=5)).collect()
    assert sorted((r["valid_sentiment"], r["sentiment"], r["sentiment_pos"]) for r in got) == [(0, 0.0, 0.0), (0, 0.0, 0.0), (1, 0.5, 0.5)]


def test_usable_rows_drop_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("inf"), 1.0), (1.0, float("nan")), (None, 1.0)], "a double, b double")
    assert panel.usable_rows(df, ["a", "b"]).count() == 1


def test_description(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (10.0, 9.0)], "a double, b double")
    got = {r["variable"]: r for r in describe.summary(df, ["a", "b"]).collect()}
    assert got["b"]["n_missing"] == 1 and got["a"]["p50"] == 2.5
    pairs = {(r["a"], r["b"]): r["corr"] for r in describe.correlations(df, ["a", "b"]).collect()}
    assert pairs["a", "a"] == pytest.approx(1.0)
    assert pairs["a", "b"] == pytest.approx(0.9839331, abs=1e-6)


def test_mean_group_golden(spark):
    df = spark.createDataFrame([("x", v, 0.05) for v in (0.1, 0.2, 0.4, -0.1)], "exog string, delta double, se double")
    r = describe.mean_group(df).first()
    assert (r["mg"], r["se_mg"], r["t_mg"]) == (pytest.approx(0.15), pytest.approx(0.104083, abs=1e-6), pytest.approx(1.441153, abs=1e-6))
    assert [round(r[f"q{q:02d}"], 2) for q in (5, 25, 50, 75, 95)] == [-0.07, 0.05, 0.15, 0.25, 0.37]
    assert math.isclose(r["frac_significant"], 1.0)
