"""Plans are the intended ones: pruned scans, no row-at-a-time Python, few exchanges."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tapewell.queries import general, reference

ARROW = {"scored_texts", "garch_filter", "garch_loglik", "p6_found", "p6_flags", "mention_extraction", "ols_twoway_fe", "ols_entity_fe", "ols_pooled", "garch_panel_fit", "lr_test_table", "regression_summary", "stream_daily_sentiment", "full_panel", "daily_counts_pivot", "daily_counts_unpivot"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted((set(general.QUERIES) | set(reference.QUERIES)) - ARROW))
def test_relational_queries_stay_in_the_jvm(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", text)
    assert "CartesianProduct" not in text


def test_scans_read_only_what_is_used(spark, folder):
    text = plan(entry.queries()["volatility_battery"](spark, folder))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert schemas and all("volatility" not in s for s in schemas)


def test_filters_reach_the_scan(spark, folder):
    text = plan(entry.queries()["p4_found"](spark, folder))
    assert "IsNotNull(ticker)" in text and "PushedFilters" in text


def test_one_exchange_for_the_battery_after_copies_are_out(spark, folder):
    text = plan(entry.queries()["volatility_battery"](spark, folder))
    assert text.count("Exchange hashpartitioning") <= 2
