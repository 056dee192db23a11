from __future__ import annotations

from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tapewell.llm import cooccurrence
from tapewell.llm.cooccurrence import collapse, pair_counts

SHAPE = "items array<string>"


def brute(baskets):
    n, one, two = len(baskets), Counter(), Counter()
    for b in baskets:
        own = sorted(set(b or []))
        one.update(own)
        two.update(combinations(own, 2))
    return {p: (c, one[p[0]], one[p[1]], c * n / (one[p[0]] * one[p[1]])) for p, c in two.items()}


def run(spark, baskets, **kw):
    df = spark.createDataFrame([(None if b is None else sorted(set(b)),) for b in baskets], SHAPE)
    return {(r["item_a"], r["item_b"]): r for r in pair_counts(collapse(df, "items"), **kw).collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from("abcdefg"), max_size=6)), max_size=30), st.sampled_from([0.0, 0.2]))
def test_against_brute_force(spark, baskets, share):
    want = {p: v for p, v in brute(baskets).items() if v[0] >= share * len(baskets)}
    got = run(spark, baskets, pair_share=share)
    assert set(got) == set(want)
    for p, (n, a, b, lift) in want.items():
        r = got[p]
        assert (r["n_ab"], r["n_a"], r["n_b"]) == (n, a, b)
        assert r["lift"] == pytest.approx(lift)
        assert (r["conviction"] is None) == (n == a)


def test_empty_table_and_long_basket(spark):
    assert not run(spark, [])
    got = run(spark, [[f"i{k:04d}" for k in range(300)]] * 2)
    assert len(got) == 300 * 299 // 2 and {r["n_ab"] for r in got.values()} == {2}


def test_one_basket_of_most_records(spark):
    got = run(spark, [["a", "b"]] * 500 + [["a", "c"]], pair_share=0.5)
    assert list(got) == [("a", "b")] and got["a", "b"]["n_ab"] == 500


def test_a_long_basket_is_spread_and_complete(spark):
    """One basket of 1,500 items: every pair once, in several pieces."""
    items = [f"i{k:05d}" for k in range(1500)]
    baskets = spark.createDataFrame([(items, 3), (items[:2], 4)], "basket array<string>, weight long")
    pairs = cooccurrence.pair_counts(baskets)
    assert pairs.count() == 1500 * 1499 // 2
    top = pairs.orderBy(F.desc("n_ab")).first()
    assert (top["item_a"], top["item_b"], top["n_ab"]) == (items[0], items[1], 7)
    frequent = cooccurrence.pair_counts(baskets, pair_share=0.9)
    assert [(r["item_a"], r["item_b"]) for r in frequent.collect()] == [(items[0], items[1])]


def test_too_many_frequent_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "MOST_FREQUENT", 3)
    baskets = spark.createDataFrame([(["a", "b", "c", "d", "e"], 1)], "basket array<string>, weight long")
    with pytest.raises(Exception, match="frequent items"):
        cooccurrence.pair_counts(baskets, pair_share=0.5).collect()
