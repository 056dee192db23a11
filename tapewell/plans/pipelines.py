"""Whole pipelines: raw posts to mentions, mentions to daily sentiment, prices and sentiment to the panel, panel to estimates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.estimators import garch, ols
from tapewell.functions import scalars as sc
from tapewell.functions.prices import MEASURES
from tapewell.operators import calendar, extraction, panel, sentiment
from tapewell.scoring import store


def mentions(submissions: DataFrame | None, comments: DataFrame | None, find: extraction.Extractor, symbols_only: bool = False, least: int = 0) -> DataFrame:
    """Mention records of raw submissions and comments. Everything happens row by row: no shuffle."""
    parts = [extraction.prepared_posts(df, kind, least) for df, kind in ((submissions, "submission"), (comments, "comment")) if df is not None]
    posts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return extraction.stored(extraction.mention_records(posts, find, symbols_only=symbols_only))


def daily_from_mentions(records: DataFrame, scores: DataFrame, models: Sequence[tuple[str, bool]]) -> DataFrame:
    """Daily sentiment by ticker and model of mention records and a score table."""
    long = store.long_scores(store.attach(records, scores, models))
    rows = long.select(sc.epoch_date(F.col("created_utc")).alias("date"), "ticker", "model", "score", "sentiment", (F.col("type") == "submission").alias("is_submission"))
    return sentiment.daily_sentiment(rows)


def panel_columns(config: panel.PanelConfig) -> list[str]:
    """The panel's columns in order; those that exist are written."""
    measures = [f"volatility_{m}" for m in MEASURES]
    tails = ["" if m == "ja_gk" else f"_{m}" for m in MEASURES]
    base = [
        "date", "ticker", "adj_close", "log_return", *measures, "mention_count", "attention", "attention_std", "gap_days", "sentiment_avg", "sentiment", "valid_sentiment", "sentiment_std",
        "sentiment_pos", "sentiment_neg", "sentiment_pos_std", "sentiment_neg_std", "sentiment_disp", "sentiment_disp_std", "sentiment_intensity", "sentiment_intensity_std",
        "sentiment_x_attention", "sentiment_pos_x_attention", "sentiment_neg_x_attention",
    ]
    rolled = [f"{k}_volatility_{h}d{t}" for h in config.horizons for t in tails for k in ("rolling", "log")]
    lags = [f"{c}_lag{h}" for h in config.horizons for c in panel.LAGGED]
    market = ["market_return", "market_log_return", "market_volatility_ja_gk"]
    other = [f"sentiment_{s}_std_{m}" for m in config.alternatives for s in ("pos", "neg")] + [f"attention_std_{k}" for k in ("abs_global", "rel_within_stock", "rel_global")]
    return [*base, *rolled, *[f"log_variance_{m}" for m in MEASURES], "lag_return", *lags, *market, *other]


def build_panel(returns: DataFrame, daily: DataFrame, model: str, benchmark: DataFrame | None = None, config: panel.PanelConfig = panel.PanelConfig()) -> DataFrame:
    """The panel in the order of steps that the features depend on: calendar, trading-day sentiment, inclusion, merges,
    features, lags, and only then the rows without any target leave.

    Trading-day sentiment is aggregated before it meets the returns; all windows after the merge share the partition by
    ticker, the daily share of attention alone shuffles by date.
    """
    returns = panel.in_range(returns, config.start, config.end)
    days = calendar.trading_calendar(returns)
    mapped = calendar.as_of_trading_day(panel.in_range(daily, config.start, config.end), days)
    by_model = sentiment.to_trading_days(mapped, ("trading_date", "ticker", "model"))
    main = by_model.where(F.col("model") == model).drop("model")
    keep = panel.included_stocks(returns, main, config).select("ticker")
    some = returns.join(keep, "ticker", "left_semi")
    merged = panel.merge_panel(some, main.join(keep, "ticker", "left_semi"), days, benchmark)
    full = panel.attention(merged, config.attention, config.scope)
    full = panel.sentiment_features(full, config)
    full = panel.rolling_volatility(full, config.horizons, config.aggregation)
    full = panel.lagged_controls(full)
    full = panel.interactions(full)
    if config.alternatives:
        full = panel.alternative_sentiments(full, by_model, config.alternatives, config)
    full = panel.alternative_attention(full)
    full = panel.lagged_predictors(full, config.horizons)
    full = panel.drop_without_targets(full, panel.targets(config))
    return panel.output_columns(full, panel_columns(config))


def with_model(saved: DataFrame, daily: DataFrame, config: panel.PanelConfig) -> DataFrame:
    """The saved panel with another model's sentiment: features and all lags anew, attention as it was."""
    lags = [c for c in saved.columns if "_lag" in c and c != "lag_return"]
    old = [c for c in saved.columns if c.startswith("sentiment") and c not in ("sentiment_avg", "sentiment_disp")]
    base = panel.model_sentiment(saved.drop(*lags, *old, "valid_sentiment"), daily)
    return panel.lagged_predictors(panel.interactions(panel.sentiment_features(base, config)), config.horizons)


def with_attention(saved: DataFrame, column: str, config: panel.PanelConfig) -> DataFrame:
    """The saved panel with another attention measure: products and all lags anew."""
    lags = [c for c in saved.columns if "_lag" in c and c != "lag_return"]
    base = saved.drop(*lags).withColumn("attention_std", F.col(column))
    return panel.lagged_predictors(panel.interactions(base), config.horizons)


def all_regressions(saved: DataFrame, config: panel.PanelConfig = panel.PanelConfig(), by_model: DataFrame | None = None, robustness: bool = True, effects: str = "twoway", cluster: str = "entity") -> list[ols.RegressionResult]:
    """Baseline, extension and three families of robustness checks; with two further models 36 regressions.

    ``by_model``: trading-day sentiment of the further models (trading_date, ticker, model, ...). The panel is held in
    memory once for all of them.
    """
    e, t = effects in ("entity", "twoway"), effects in ("time", "twoway")
    held = saved.persist()
    jobs = [(held, ols.baseline_spec(h, True, "ja_gk", cluster, e, t)) for h in config.horizons]
    jobs += [(held, ols.extension_spec(h, cluster, e, t)) for h in config.horizons]
    if robustness:
        if by_model is not None:
            for m in config.alternatives:
                other = with_model(held, by_model.where(F.col("model") == m), config)
                jobs += [(other, replace(ols.baseline_spec(h, True, "ja_gk", cluster, e, t), name=f"sentiment_{m}_h{h}")) for h in config.horizons]
        jobs += [(held, ols.baseline_spec(h, True, m, cluster, e, t)) for m in MEASURES[1:] for h in config.horizons]
        for k in ("abs_global", "rel_within_stock", "rel_global"):
            other = with_attention(held, f"attention_std_{k}", config)
            jobs += [(other, replace(ols.baseline_spec(h, True, "ja_gk", cluster, e, t), name=f"attention_{k}_h{h}")) for h in config.horizons]
    out = [ols.run_panel_regression(df, spec) for df, spec in jobs]
    held.unpersist()
    return out


def garch_runs(saved: DataFrame, base: garch.GarchSpec, variants: dict[str, Sequence[str]], rounds: int = 60) -> dict[str, garch.PanelGarchResult]:
    """The base specification and one fit per variant of exogenous columns."""
    out = {"baseline": garch.fit_panel(garch.stock_arrays(saved, base), base, rounds)}
    for name, columns in variants.items():
        spec = replace(base, exog=tuple(columns))
        out[name] = garch.fit_panel(garch.stock_arrays(saved, spec), spec, rounds)
    return out
