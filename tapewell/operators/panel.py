"""The stock-by-day panel: merges, attention and sentiment features, rolling volatility, lags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewell.functions.prices import MEASURES, finite

HORIZONS = (1, 3, 5)


@dataclass(frozen=True)
class PanelConfig:
    horizons: Sequence[int] = HORIZONS
    min_posts: int = 5
    attention: str = "absolute"  # or "relative"
    scope: str = "within_stock"  # or "global"
    aggregation: str = "mean"  # or "sum"
    min_financial_days: int = 200
    min_mention_days: int = 30
    min_valid_days: int = 20
    start: str | None = "2018-01-01"
    end: str | None = "2024-12-31"
    alternatives: Sequence[str] = field(default_factory=tuple)


def in_range(rows: DataFrame, start: str | None, end: str | None, date: str = "date") -> DataFrame:
    if start:
        rows = rows.where(F.col(date) >= F.lit(start).cast("date"))
    return rows.where(F.col(date) <= F.lit(end).cast("date")) if end else rows


def included_stocks(returns: DataFrame, sentiment: DataFrame, config: PanelConfig) -> DataFrame:
    """(ticker, n_financial_days, n_mention_days, n_valid_days) of stocks with enough days of each kind."""
    financial = returns.groupBy("ticker").agg(F.countDistinct("date").alias("n_financial_days"))
    days = sentiment.groupBy("ticker").agg(
        F.countDistinct(F.when(F.col("mention_count") > 0, F.col("trading_date"))).alias("n_mention_days"),
        F.countDistinct(F.when(F.col("mention_count") >= config.min_posts, F.col("trading_date"))).alias("n_valid_days"),
    )
    return (
        financial.join(days, "ticker", "full")
        .na.fill(0)
        .where((F.col("n_financial_days") >= config.min_financial_days) & (F.col("n_mention_days") >= config.min_mention_days) & (F.col("n_valid_days") >= config.min_valid_days))
    )


def merge_panel(returns: DataFrame, sentiment: DataFrame, calendar: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Returns with sentiment of the trading day (0 where there is none), gap days and benchmark."""
    filled = ("mention_count", "sentiment_avg", "sentiment_disp", "weight_sum")
    s = sentiment.withColumnRenamed("trading_date", "date")
    panel = returns.join(s, ["date", "ticker"], "left").na.fill(0, [c for c in filled if c in s.columns])
    panel = panel.join(calendar.select("date", "gap_days"), "date", "left")
    return panel if benchmark is None else panel.join(benchmark, "date", "left")


def standardised(panel: DataFrame, columns: dict[str, str], scope: str = "within_stock") -> DataFrame:
    """Adds z-scores {new: source} with the sample deviation; no spread or a single row gives 0, NULL stays NULL.

    Within a stock all columns share one window without an order. Globally the moments are one row of a scalar
    subquery; no window without a partition.
    """
    if scope == "within_stock":
        by = Window.partitionBy("ticker")
        out = {}
        for new, old in columns.items():
            mean, sd, n = F.avg(old).over(by), F.stddev_samp(old).over(by), F.count(F.lit(1)).over(by)
            flat = (n <= 1) | sd.isNull() | F.isnan(sd) | (sd == 0)
            out[new] = F.when(F.col(old).isNull() & ~flat, None).when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col(old) - mean, sd))
        return panel.withColumns(out)
    olds = list(dict.fromkeys(columns.values()))
    moments = panel.agg(F.struct(*[x for o in olds for x in (F.avg(o).alias(f"m_{o}"), F.stddev_samp(o).alias(f"s_{o}"))]).alias("m"))
    wide = panel.withColumn("__m", moments.scalar())
    out = {}
    for new, old in columns.items():
        sd = F.col("__m")[f"s_{old}"]
        flat = sd.isNull() | F.isnan(sd) | (sd == 0)
        out[new] = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col(old) - F.col("__m")[f"m_{old}"], sd))
    return wide.withColumns(out).drop("__m")


def attention(panel: DataFrame, measure: str = "absolute", scope: str = "within_stock", name: str = "attention") -> DataFrame:
    """ln(1 + mentions) or the share of the day's mentions, and its z-score ``{name}_std``."""
    n = F.coalesce("mention_count", F.lit(0))
    if measure == "absolute":
        raw = F.log1p(n.cast("double"))
    elif measure == "relative":
        day = F.sum(n).over(Window.partitionBy("date"))
        raw = n / F.when(day == 0, F.lit(1)).otherwise(day)
    else:
        raise ValueError(f"unknown attention measure {measure!r}")
    return standardised(panel.withColumns({"mention_count": n, name: raw}), {f"{name}_std": name}, scope)


def sentiment_features(panel: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Validity, sentiment zeroed on quiet days, its parts, intensity, dispersion, and z-scores of all of them."""
    valid = (F.coalesce("mention_count", F.lit(0)) >= config.min_posts).cast("int")
    s = F.when(valid == 1, F.col("sentiment_avg")).otherwise(F.lit(0.0))
    parts = panel.withColumns({"valid_sentiment": valid, "sentiment": s, "sentiment_disp": F.coalesce("sentiment_disp", F.lit(0.0))})
    x = F.col("sentiment")
    keep = lambda c: F.when(x.isNotNull(), c)  # noqa: E731  greatest skips NULL
    parts = parts.withColumns({"sentiment_pos": keep(F.greatest(x, F.lit(0.0))), "sentiment_neg": keep(F.greatest(-x, F.lit(0.0))), "sentiment_intensity": F.abs(x)})
    names = ("sentiment", "sentiment_pos", "sentiment_neg", "sentiment_disp", "sentiment_intensity")
    return standardised(parts, {f"{n}_std": n for n in names}, config.scope)


def interactions(panel: DataFrame) -> DataFrame:
    a = F.col("attention_std")
    return panel.withColumns(
        {
            "sentiment_x_attention": F.col("sentiment_std") * a,
            "sentiment_pos_x_attention": F.col("sentiment_pos_std") * a,
            "sentiment_neg_x_attention": F.col("sentiment_neg_std") * a,
        }
    )


def _suffix(measure: str) -> str:
    return "" if measure == "ja_gk" else f"_{measure}"


def rolling_volatility(panel: DataFrame, horizons: Sequence[int] = HORIZONS, aggregation: str = "mean", measures: Sequence[str] = MEASURES) -> DataFrame:
    """Root of the mean (or sum) of squared volatility over the last h rows and its logarithm; NULL unless all h are there."""
    by = Window.partitionBy("ticker").orderBy("date")
    out = {}
    for m in measures:
        v = F.col(f"volatility_{m}")
        for h in horizons:
            rows = by.rowsBetween(-(h - 1), 0)
            total = F.avg(v * v).over(rows) if aggregation == "mean" else F.sum(v * v).over(rows)
            out[f"rolling_volatility_{h}d{_suffix(m)}"] = F.when(F.count(v).over(rows) == h, F.sqrt(total))
    panel = panel.withColumns(out)
    return panel.withColumns({name.replace("rolling", "log"): F.when(F.col(name) > 0, F.log(F.col(name))) for name in out})


def lagged_controls(panel: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    by = Window.partitionBy("ticker").orderBy("date")
    logs = {f"log_variance_{m}": F.when(F.col(f"volatility_{m}") != 0, F.log(F.col(f"volatility_{m}") * F.col(f"volatility_{m}"))) for m in measures}
    return panel.withColumns({**logs, "lag_return": F.lag("log_return").over(by)})


def with_day_series(panel: DataFrame, series: DataFrame, column: str, name: str) -> DataFrame:
    """``panel`` with ``name``: the z-score of a series by day (a volatility index, say), 0 where it is missing.

    ``series`` has one row per day (of several the greatest counts); its moments are a scalar subquery over its distinct days.
    """
    days = series.select(F.col("date").cast("date").alias("date"), finite(F.col(column).cast("double")).alias("__x")).where("__x IS NOT NULL").groupBy("date").agg(F.max("__x").alias("__x"))
    moments = days.agg(F.struct(F.avg("__x").alias("m"), F.stddev_samp("__x").alias("s")).alias("z")).scalar()
    scored = days.withColumn("__z", moments).select("date", F.try_divide(F.col("__x") - F.col("__z.m"), F.col("__z.s")).alias(name))
    return panel.drop(name).join(scored, "date", "left").na.fill(0.0, [name])


LAGGED = (
    "attention_std", "sentiment_std", "sentiment_pos_std", "sentiment_neg_std", "sentiment_x_attention", "sentiment_pos_x_attention", "sentiment_neg_x_attention",
    "valid_sentiment", "sentiment_intensity_std", "sentiment_disp_std", "lag_return", *[f"log_variance_{m}" for m in MEASURES],
)


def lagged_predictors(panel: DataFrame, horizons: Sequence[int] = HORIZONS, columns: Sequence[str] = LAGGED) -> DataFrame:
    """``{column}_lag{h}``: values h rows earlier; all lags share one window."""
    by = Window.partitionBy("ticker").orderBy("date")
    return panel.withColumns({f"{c}_lag{h}": F.lag(c, h).over(by) for h in horizons for c in columns if c in panel.columns})


def model_sentiment(panel: DataFrame, alternative: DataFrame) -> DataFrame:
    """``panel`` with another model's sentiment; its mention counts replace the old ones where it has them."""
    old = [c for c in ("sentiment_avg", "sentiment_disp", "weight_sum") if c in panel.columns]
    new = alternative.select(F.col("trading_date").alias("date"), "ticker", "sentiment_avg", "sentiment_disp", F.col("mention_count").alias("__n"))
    merged = panel.drop(*old).join(new, ["date", "ticker"], "left").na.fill(0.0, ["sentiment_avg", "sentiment_disp"])
    return merged.withColumn("mention_count", F.coalesce("__n", "mention_count")).drop("__n")


def alternative_sentiments(panel: DataFrame, daily: DataFrame, models: Sequence[str], config: PanelConfig = PanelConfig()) -> DataFrame:
    """``sentiment_{pos,neg}_std_{model}`` for further models: one pivot and one join for all of them."""
    pivoted = daily.groupBy(F.col("trading_date").alias("date"), "ticker").pivot("model", list(models)).agg(F.first("sentiment_avg").alias("avg"), F.first("mention_count").alias("n"))
    wide = panel.join(pivoted, ["date", "ticker"], "left")
    out, scores = {}, {}
    for m in models:
        s = F.when(F.coalesce(F.col(f"{m}_n"), F.lit(0)) >= config.min_posts, F.coalesce(F.col(f"{m}_avg"), F.lit(0.0))).otherwise(F.lit(0.0))
        out[f"__pos_{m}"], out[f"__neg_{m}"] = F.greatest(s, F.lit(0.0)), F.greatest(-s, F.lit(0.0))
        scores[f"sentiment_pos_std_{m}"], scores[f"sentiment_neg_std_{m}"] = f"__pos_{m}", f"__neg_{m}"
    done = standardised(wide.withColumns(out), scores, config.scope)
    return done.drop(*out, *[f"{m}_{k}" for m in models for k in ("avg", "n")])


def alternative_attention(panel: DataFrame) -> DataFrame:
    """The three further standardised attention measures: absolute global, relative within stock, relative global."""
    out = panel
    for measure, scope, name in (("absolute", "global", "abs_global"), ("relative", "within_stock", "rel_within_stock"), ("relative", "global", "rel_global")):
        out = attention(out, measure, scope, f"__a_{name}").withColumnRenamed(f"__a_{name}_std", f"attention_std_{name}").drop(f"__a_{name}")
    return out


def targets(config: PanelConfig = PanelConfig()) -> list[str]:
    return [f"log_volatility_{h}d" for h in config.horizons]


def drop_without_targets(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    return panel.na.drop(how="all", subset=list(names))


def usable_rows(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and NaN values become NULL, then rows with a NULL in ``columns`` leave."""
    clean = panel.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    return clean.na.drop(subset=list(columns))


def output_columns(panel: DataFrame, order: Sequence[str]) -> DataFrame:
    return panel.select(*[c for c in order if c in panel.columns])
