from __future__ import annotations

import datetime as dt
import math

import pytest

from tapewell.operators.returns import benchmark_returns, calculate_returns, forward_returns

SHAPE = "date date, ticker string, open double, high double, low double, close double, adj_close double"


def test_golden_bar(spark):
    rows = [(dt.date(2024, 1, 2), "A", 100.0, 100.0, 100.0, 100.0, 50.0), (dt.date(2024, 1, 3), "A", 102.0, 110.0, 99.0, 105.0, 52.5)]
    got = calculate_returns(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(got) == 1
    want = {"ja_gk": 0.074953111, "ja_rs": 0.075241743, "ja_pk": 0.066301773, "gk": 0.072289866, "pk": 0.063275438, "sqret": 0.048790164}
    for k, v in want.items():
        assert got[0][f"volatility_{k}"] == pytest.approx(v, abs=5e-9)
    assert got[0]["simple_return"] == pytest.approx(0.05)
    if want["gk"] >= 0:
        assert got[0]["volatility_ja_gk"] ** 2 == pytest.approx(math.log(1.02) ** 2 + got[0]["volatility_gk"] ** 2)


def test_faulty_prices_give_null_not_errors(spark):
    rows = [(dt.date(2024, 1, d), "A", o, 1.0, 1.0, 1.0, a) for d, o, a in ((2, 1.0, 1.0), (3, 0.0, 0.0), (4, -1.0, 2.0), (5, None, float("nan")), (6, 1.0, 3.0))]
    got = {r["date"].day: r for r in calculate_returns(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got[3]["log_return"] is None and got[3]["volatility_gk"] is None
    assert set(got) == {3}


def test_empty_and_benchmark_and_forward(spark):
    assert calculate_returns(spark.createDataFrame([], SHAPE)).count() == 0
    rows = [(dt.date(2024, 1, 2 + i), "A", 1.0, 1.2, 0.9, 1.0 + i, 1.0 + i) for i in range(4)]
    df = spark.createDataFrame(rows, SHAPE)
    assert benchmark_returns(df.drop("ticker")).count() == 3
    ahead = [r["forward_return_3"] for r in forward_returns(df).orderBy("date").collect()]
    assert ahead[0] == pytest.approx(math.log(4)) and ahead[1:] == [None] * 3
