from __future__ import annotations

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewell.llm.packing import BestFit, fill, pack, split

KINDS = [("small", 64), ("large", 256)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120), st.integers(1, 12))
def test_best_fit_against_a_plain_search(sizes, most):
    """The bitset gives the bin that a search over all open bins gives, and closes the fullest."""
    fit, open_, number = BestFit(50, most), {}, 0
    for s in sizes:
        fits = [(free - s) for free in open_.values() if free >= s]
        b = fit.put(s)
        if fits:
            assert open_[b] - s == min(fits)
            open_[b] -= s
        else:
            assert b == number
            number += 1
            open_[b] = 50 - s
        if open_[b] == 0 and s:
            del open_[b]
        while len(open_) > most:
            low = min(open_.values())
            gone = [k for k, v in open_.items() if v == low]
            # which of equally full bins closes is free: ask the packer
            still = {x for stack in fit.bins.values() for x in stack}
            del open_[next(k for k in gone if k not in still)]


def test_split():
    assert split(0, 10) == [(0, 0)] and split(10, 10) == [(0, 10)]
    assert split(25, 10) == [(0, 10), (10, 10), (20, 5)]


@pytest.fixture(scope="module")
def packed(spark):
    r = random.Random(0)
    rows = [(i, r.choice([r.randint(0, 80), r.randint(0, 300), 1, 64])) for i in range(3000)] + [(None, 5), (7, 9), (8, None), (9, -4), (10, 1000)]
    df = spark.createDataFrame(rows, "length long, n long")
    return rows, pack(df, "length", "n", KINDS).toDF("container", "k", "part", "start", "length", "bin").collect()


def test_every_item_once_whole_unless_too_long(packed):
    rows, got = packed
    for kind, capacity in KINDS:
        want = sorted((k is None, k or 0, start, n) for k, size in rows for start, n in split(max(size or 0, 0), capacity))
        assert sorted((r["k"] is None, r["k"] or 0, r["start"], r["length"]) for r in got if r["container"] == kind) == want


def test_no_bin_overflows_and_little_is_wasted(packed):
    _, got = packed
    for kind, capacity in KINDS:
        used = defaultdict(int)
        for r in got:
            if r["container"] == kind:
                used[r["bin"]] += r["length"]
        assert max(used.values()) <= capacity
        assert sum(used.values()) / (len(used) * capacity) > 0.95


def test_repeats_and_spreads_over_tasks(spark):
    df = spark.range(2000).selectExpr("id AS k", "id % 60 AS n")
    a = pack(df, "k", "n", KINDS, items_per_task=500)
    b = pack(df.repartition(9), "k", "n", KINDS, items_per_task=500)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.selectExpr("bin >> 40").distinct().count() == 4
    shares = {r["container"]: r["share"] for r in fill(a, KINDS).collect()}
    assert set(shares) == {"small", "large"} and min(shares.values()) > 0.8


def test_empty_table_and_bad_capacity(spark):
    assert pack(spark.createDataFrame([], "k long, n long"), "k", "n", KINDS).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "k long, n long"), "k", "n", [("none", 0)])
