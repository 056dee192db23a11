"""Pipelines from end to end on small made data."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapewell.estimators import garch
from tapewell.operators.extraction import Extractor
from tapewell.operators.panel import PanelConfig
from tapewell.operators.returns import calculate_returns
from tapewell.plans import pipelines
from tapewell.scoring import store

CONFIG = PanelConfig(horizons=(1,), min_posts=1, min_financial_days=10, min_mention_days=5, min_valid_days=5, start=None, end=None, alternatives=("other",))


def scorer(texts, targets):
    return [("positive" if len(t) % 3 else "negative", 0.5 + (len(t) % 5) / 10) for t in texts]


@pytest.fixture(scope="module")
def saved(spark):
    """A panel from raw comments and prices: extraction, scores, daily sentiment, panel."""
    r = random.Random(0)
    tickers, first = ["AAPL", "TSLA", "GMEX"], dt.date(2024, 1, 1)
    rows, prices = [], []
    for t in tickers:
        p = 100.0
        for d in range(60):
            day = first + dt.timedelta(d)
            if day.weekday() < 5:
                o, c = p * (1 + r.gauss(0, 0.004)), p * (1 + r.gauss(0, 0.01))
                prices.append((day, t, o, max(o, c) * (1 + r.random() / 100), min(o, c) * (1 - r.random() / 100), c, c))
                p = c
            for k in range(r.randint(0, 4)):
                at = int(dt.datetime(day.year, day.month, day.day, 12, tzinfo=dt.timezone.utc).timestamp())
                rows.append((f"{t}{d}-{k}", None, "s", "a", str(at), f"{r.choice(['$', ''])}{t} {'x' * r.randint(1, 30)}", r.randint(-3, 50), None, None))
    comments = spark.createDataFrame(rows, "id string, name string, subreddit string, author string, created_utc string, body string, score long, distinguished string, stickied boolean")
    records = pipelines.mentions(None, comments, Extractor(tickers, [])).persist()
    assert records.count() == len(rows)
    models = [store.Model("main", scorer), store.Model("other", scorer)]
    scores = store.updated(spark.createDataFrame([], store.SCHEMA), records, models)
    daily = pipelines.daily_from_mentions(records, scores, [("main", False), ("other", False)])
    assert daily.agg(F.sum("mention_count")).first()[0] == 2 * len(rows)
    returns = calculate_returns(spark.createDataFrame(prices, "date date, ticker string, open double, high double, low double, close double, adj_close double"))
    panel = pipelines.build_panel(returns, daily, "main", None, CONFIG).persist()
    assert panel.select("ticker").distinct().count() == 3
    return panel, daily


def test_all_families_of_regressions(saved):
    from tapewell.operators import calendar, sentiment

    panel, daily = saved
    days = calendar.trading_calendar(panel)
    by_model = sentiment.to_trading_days(calendar.as_of_trading_day(daily, days), ("trading_date", "ticker", "model"))
    results = pipelines.all_regressions(panel, CONFIG, by_model, effects="entity")
    # one horizon and one further model: baseline, extension, 1 sentiment, 5 volatility, 3 attention
    assert len(results) == 11 and len({r.spec.name for r in results}) == 11
    assert all(r.n_obs > 20 for r in results)
    base, other = results[0], next(r for r in results if r.spec.name == "sentiment_other_h1")
    assert set(base.coefficients) == set(other.coefficients)


def test_garch_variants(saved):
    spec = garch.GarchSpec(min_obs=20, alpha="stock")
    out = pipelines.garch_runs(saved[0], spec, {"attention": ["attention_std"]}, rounds=2)
    assert set(out) == {"baseline", "attention"}
    assert out["attention"].n_params == out["baseline"].n_params + 3
    assert "delta_attention_std" in out["attention"].stock_table().columns
