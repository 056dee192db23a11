"""Faulty bars: known faults are found, ordinary movement isn't."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tapewell.operators.spikes import extreme_deviates, faulty_bars, judge, student_quantile

SHAPE = "ticker string, date date, open double, high double, low double, close double, volume long"


def series(n=200, seed=1, move=0.01, start=50.0):
    r = np.random.default_rng(seed)
    close = start * np.exp(np.cumsum(r.normal(0, move, n)))
    open_ = close * np.exp(r.normal(0, move / 3, n))
    high = np.maximum(open_, close) * (1 + np.abs(r.normal(0, move / 2, n)))
    low = np.minimum(open_, close) * (1 - np.abs(r.normal(0, move / 2, n)))
    return np.round(np.stack([open_, high, low, close], 1), 4)


def flagged(bars):
    f = judge(bars, np.arange(len(bars)) % 5)
    return {k: set(np.flatnonzero(f[k])) for k in ("impossible", "spike", "stuck")}


def test_clean_series_has_no_faults():
    for seed in range(8):
        f = flagged(series(seed=seed))
        assert not f["impossible"] and not f["spike"] and not f["stuck"]


def test_impossible_bars():
    b = series()
    b[20, 1], b[40, 2], b[60, 3], b[80, 0] = 0.0, b[40, 1] * 2, -5.0, b[80, 1] * 3
    assert flagged(b)["impossible"] == {20, 40, 60, 80}


def test_spikes_in_one_field_and_in_the_whole_bar():
    b = series()
    b[30, 1] *= 1.4
    b[90, 2] /= 10
    b[150] *= 1.5
    assert flagged(b)["spike"] == {30, 90, 150}


def test_lasting_moves_splits_and_turbulence_are_not_spikes():
    b = series()
    b[100:] *= 1.6
    b[150:] /= 2
    assert not flagged(b)["spike"]
    calm, wild = series(150, 3), series(60, 4, move=0.05)
    assert not flagged(np.vstack([calm, wild / wild[0, 3] * calm[-1, 3], series(60, 5)]))["spike"]


def test_stuck_bars_from_five_repetitions_on():
    b = series()
    b[50:55] = b[49]
    b[100:104] = b[99]
    assert flagged(b)["stuck"] == {50, 51, 52, 53, 54}


def test_missing_prices_are_not_faults():
    b = series()
    b[10, 1] = b[11, 2] = np.nan
    b[12] = np.nan
    f = flagged(b)
    assert not f["impossible"] and not f["spike"] and not f["stuck"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_short_series(n):
    f = flagged(series(max(n, 1))[:n])
    assert not f["spike"]


def test_deviates_against_the_plain_procedure():
    """The running sums give what recomputing mean and deviation at every step gives."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, 80), [9.0, -8.0, 12.0]])
    left, removed, number = list(range(len(x))), [], 0
    for i in range(1, int(len(x) * 0.2) + 1):
        v = x[left]
        dev = np.abs(v - v.mean()) / v.std(ddof=1)
        k = int(dev.argmax())
        m = len(left)
        t = student_quantile(1 - 0.05 / (2 * m), m - 2)
        if dev[k] > (m - 1) * t / np.sqrt((m - 2 + t * t) * m):
            number = i
        removed.append(left.pop(k))
    assert set(np.flatnonzero(extreme_deviates(x, 0.05))) == set(removed[:number]) == {80, 81, 82}


def rows(name, bars, first=dt.date(2024, 1, 1)):
    return [(name, first + dt.timedelta(i), *map(float, b), i) for i, b in enumerate(bars)]


def test_table_with_copies_nulls_and_clashing_names(spark):
    b = series()
    b[30, 1] *= 1.4
    data = rows("A", b)
    data += data[20:60] + [(None, dt.date(2024, 1, 1), 1.0, 2.0, 0.0, 1.0, 0), ("A", None, 1.0, 2.0, -1.0, 1.0, 0), ("B", dt.date(2024, 1, 1), None, None, None, None, 0)]
    df = spark.createDataFrame(data, SHAPE).withColumnRenamed("volume", "field")
    got = faulty_bars(df, "ticker", "date").collect()
    assert [(r["ticker"], r["date"], r["spike"]) for r in got] == [("A", dt.date(2024, 1, 31), True)]


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    from tapewell.operators import spikes

    b = series(600, seed=9)
    for i in (100, 255, 257, 400):
        b[i, 1] *= 1.5
    b[250:258] = b[249]
    df = spark.createDataFrame(rows("A", b, dt.date(2020, 1, 1)), SHAPE)
    whole = {(r["date"], r["stuck"]) for r in faulty_bars(df, "ticker", "date").collect()}
    monkeypatch.setattr(spikes, "BLOCK_DAYS", 256)
    parts = {(r["date"], r["stuck"]) for r in faulty_bars(df, "ticker", "date").collect()}
    assert whole == parts and len(whole) >= 10


@pytest.mark.parametrize("days", [128, 300, 1000, 2048])
def test_the_length_of_blocks_changes_nothing(spark, monkeypatch, days):
    """Seasons, usual moves and the test concern the whole source; gaps and single bars in a block don't matter."""
    from tapewell.operators import spikes

    data = []
    for k, name in enumerate("ABC"):
        b = series(700, seed=20 + k, move=0.01 * (k + 1))
        for i in range(20, 700, 83):
            b[i, i % 4] *= 1 + 0.12 * (1 + i % 3)
        b[250:257] = b[249]
        first = dt.date(2018, 1, 1)
        data += [(name, first + dt.timedelta(i + (200 if i > 400 else 0)), *map(float, x), i) for i, x in enumerate(b)]
    df = spark.createDataFrame(data, SHAPE)
    monkeypatch.setattr(spikes, "BLOCK_DAYS", days)
    got = {(r["ticker"], (r["date"] - dt.date(2018, 1, 1)).days, r["impossible"], r["spike"], r["stuck"]) for r in faulty_bars(df, "ticker", "date").collect()}
    want = set()
    for name in "ABC":
        own = [r for r in data if r[0] == name]
        offset = np.array([(r[1] - dt.date(2018, 1, 1)).days for r in own])
        f = judge(np.array([r[2:6] for r in own]), offset % 7, days=offset)
        want |= {(name, int(d), bool(i), bool(s), bool(u)) for d, i, s, u in zip(offset, f["impossible"], f["spike"], f["stuck"]) if i or s or u}
    assert got == want and sum(w[3] for w in want) > 5


def test_a_short_source_is_judged_by_scales_alone(spark):
    b = series(7, seed=2)
    b[3] *= 3
    assert [r["spike"] for r in faulty_bars(spark.createDataFrame(rows("A", b), SHAPE), "ticker", "date").collect()] == [True]


def test_empty_table(spark):
    assert faulty_bars(spark.createDataFrame([], SHAPE), "ticker", "date").count() == 0
