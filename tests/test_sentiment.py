from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tapewell.operators import calendar, mentions, sentiment

D = dt.date
SHAPE = "date date, ticker string, model string, score long, sentiment double, is_submission boolean"


def test_golden_mean_and_dispersion(spark):
    rows = [(D(2024, 1, 1), "A", "m", s, v, i == 0) for i, (s, v) in enumerate([(0, 0.5), (99, -1.0), (-5, 0.25), (3, None), (3, float("nan"))])]
    r = sentiment.daily_sentiment(spark.createDataFrame(rows, SHAPE)).first()
    assert r["sentiment_avg"] == pytest.approx(-0.583659, abs=1e-6)
    assert r["sentiment_disp"] == pytest.approx(0.635500, abs=1e-6)
    assert r["weight_sum"] == pytest.approx(6.605170, abs=1e-6)
    assert (r["mention_count"], r["submission_count"], r["comment_count"]) == (3, 1, 2)


def test_single_mention_has_no_dispersion(spark):
    r = sentiment.daily_sentiment(spark.createDataFrame([(D(2024, 1, 1), "A", "m", None, 0.5, True)], SHAPE)).first()
    assert r["sentiment_disp"] == 0.0 and r["weight_sum"] == 1.0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(-5, 200), st.floats(-1, 1)), min_size=1, max_size=12), st.integers(0, 12))
def test_parts_add_up_to_the_whole(spark, raw, cut):
    rows = [(D(2024, 1, 1), t, "m", s, v, True) for t, s, v in raw]
    whole = sentiment.daily_sentiment(spark.createDataFrame(rows, SHAPE))
    parts = [sentiment.sums(spark.createDataFrame(p, SHAPE)) for p in (rows[:cut], rows[cut:])]
    got = {r["ticker"]: r for r in sentiment.finish(sentiment.merged(*parts)).collect()}
    for r in whole.collect():
        assert got[r["ticker"]]["sentiment_avg"] == pytest.approx(r["sentiment_avg"], abs=1e-12)
        assert got[r["ticker"]]["mention_count"] == r["mention_count"]


def test_as_of_weekend_holiday_and_before_the_first_day(spark):
    trading = [D(2024, 1, 4), D(2024, 1, 5), D(2024, 1, 9)]  # Thursday, Friday, Tuesday after a holiday
    days = calendar.trading_calendar(spark.createDataFrame([(d,) for d in trading], "date date"))
    assert [(r["trading_day_index"], r["gap_days"]) for r in days.orderBy("date").collect()] == [(0, 0), (1, 3), (2, 0)]
    rows = spark.createDataFrame([(D(2024, 1, i), i) for i in (3, 4, 6, 7, 8, 9, 12)] + [(None, 0)], "date date, x int")
    got = {r["x"]: r["trading_date"].day for r in calendar.as_of_trading_day(rows, days).collect()}
    assert got == {4: 4, 6: 5, 7: 5, 8: 5, 9: 9, 12: 9}


def test_trading_day_sums(spark):
    rows = [(D(2024, 1, 5), "A", 2, 2.0, 0.5, 0.1), (D(2024, 1, 5), "A", 1, 1.0, -1.0, 0.4)]
    r = sentiment.to_trading_days(spark.createDataFrame(rows, "trading_date date, ticker string, mention_count long, weight_sum double, sentiment_avg double, sentiment_disp double")).first()
    assert (r["mention_count"], r["weight_sum"], r["sentiment_avg"], r["sentiment_disp"]) == (3, 3.0, 0.0, 0.4)


def test_ticker_stats_use_linear_percentiles(spark):
    rows = [(D(2024, 1, i), "A", i) for i in range(1, 6)] + [(D(2024, 1, 1), "B", 4)]
    got = {r["ticker"]: r for r in mentions.ticker_stats(spark.createDataFrame(rows, "date date, ticker string, n long")).collect()}
    assert got["A"]["median_per_day"] == 3.0 and got["A"]["p90_per_day"] == pytest.approx(4.6)
    assert (got["B"]["active_days"], got["B"]["total_days"], got["B"]["median_per_day"], got["B"]["p90_per_day"]) == (1, 5, 0.0, pytest.approx(2.4))


def test_samples_are_stable_and_bounded(spark):
    df = spark.range(500).selectExpr("cast(id AS string) AS id", "id % 2 AS g")
    a = {r["id"] for r in mentions.sample_records(df.repartition(7), "g", 20).collect()}
    b = {r["id"] for r in mentions.sample_records(df.repartition(2), "g", 20).collect()}
    assert a == b and len(a) == 40
