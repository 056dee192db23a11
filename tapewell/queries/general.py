"""Queries of the general data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewell.operators import heavy_keys as heavy
from tapewell.operators import rolling, spikes
from tapewell.operators.records import clean_tickers, latest_records, once
from tapewell.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    days = rolling.surges(table(spark, folder, "panel_data"), "ticker", "date", "volatility_ja_gk")
    return days.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"))


def p4_totals(spark: SparkSession, folder: str) -> DataFrame:
    days = rolling.trailing_totals(table(spark, folder, "panel_data"), "ticker", "date", "volatility_ja_gk")
    return days.select(
        "ticker",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[F.round(c, 9).alias(c) for c in ("total_7", "mean_7", "total_30", "mean_30")],
        "values_7",
        "values_30",
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    faults = spikes.faulty_bars(table(spark, folder, "stock_returns"), "ticker", "date")
    return faults.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date")).distinct()


def p6_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every faulty bar with the kind of fault, the field that deviates most and by how many scales."""
    faults = spikes.faulty_bars(table(spark, folder, "stock_returns"), "ticker", "date")
    return faults.withColumn("deviation", F.round("deviation", 3))


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return latest_records(table(spark, folder, "mention"), "id", "ingested_at", ["tickers", "score"])


def _mention_tickers(records: DataFrame) -> DataFrame:
    return records.select(F.explode(clean_tickers("tickers")).alias("ticker"), "score")


def _panel_counts(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "panel_data"), ["ticker", "date"], ["mention_count"])


def p7_found(spark: SparkSession, folder: str, share: float = 0.02) -> DataFrame:
    records = _mentions(spark, folder)
    named = heavy.key_totals(heavy.compressed(_mention_tickers(records), "ticker", "score"))
    panel = heavy.compressed(_panel_counts(spark, folder).where("mention_count IS NOT NULL"), "ticker", "mention_count")
    sums = heavy.key_totals(panel)
    hot = heavy.dominant_keys(named, "n_rows", share, records.agg(F.count(F.lit(1)).alias("n")))
    busy = heavy.dominant_keys(sums, "total", share, panel.agg(F.sum(F.col("value").cast("decimal(38,0)") * F.col("n")).alias("n")))
    pair = lambda df, name: df.where("key IS NOT NULL").select(F.lit(name).alias("source_table"), F.col("key").alias("ticker"))
    return pair(hot, "mention").unionByName(pair(busy, "panel_data"))


def p7_mention_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per ticker of the mention records: records, distinct, mode and median of score."""
    stats = heavy.key_statistics(_mention_tickers(_mentions(spark, folder)), "ticker", "score", (0.5, 0.9))
    return stats.select(F.col("key").alias("ticker"), "n_rows", "n_distinct", F.col("total").cast("bigint").alias("total_score"), "mode_value", F.col("p50").alias("median_score"), F.col("p90").alias("p90_score"))


def p7_panel_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per ticker of the panel: days, total and median mention count."""
    stats = heavy.key_statistics(_panel_counts(spark, folder), "ticker", "mention_count", (0.5, 0.9))
    return stats.select(F.col("key").alias("ticker"), "n_rows", "n_values", "n_distinct", F.col("total").cast("bigint").alias("total_mentions"), F.col("p50").alias("median_mentions"), F.col("p90").alias("p90_mentions"))


_RECORD = """
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM mention WHERE id IS NOT NULL) WHERE rn = 1),
tick AS (SELECT DISTINCT id, upper(trim(t)) AS ticker, score FROM (SELECT id, score, unnest(tickers) AS t FROM rec) WHERE t IS NOT NULL)
"""
_PANEL = "pan AS (SELECT DISTINCT * FROM panel_data)"

_ROLL = """
pan AS (SELECT DISTINCT * FROM panel_data WHERE ticker IS NOT NULL AND date IS NOT NULL),
span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM pan GROUP BY 1),
cal AS (SELECT ticker, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span),
day AS (SELECT ticker, date, sum(volatility_ja_gk) AS v, count(volatility_ja_gk) AS n FROM pan GROUP BY 1, 2),
full_day AS (SELECT cal.ticker, cal.date, coalesce(day.v, 0) AS v, coalesce(day.n, 0) AS n FROM cal LEFT JOIN day USING (ticker, date)),
roll AS (SELECT ticker, date,
  sum(v) OVER (PARTITION BY ticker ORDER BY date ROWS 6 PRECEDING) AS t7, CAST(sum(n) OVER (PARTITION BY ticker ORDER BY date ROWS 6 PRECEDING) AS BIGINT) AS n7,
  sum(v) OVER (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING) AS t30, CAST(sum(n) OVER (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING) AS BIGINT) AS n30
  FROM full_day)
"""

QUERIES = {
    "p4_found": p4_found,
    "p4_totals": p4_totals,
    "p6_found": p6_found,
    "p6_flags": p6_flags,
    "p7_found": p7_found,
    "p7_mention_stats": p7_mention_stats,
    "p7_panel_stats": p7_panel_stats,
}

SQL = {
    "p4_found": f"WITH {_ROLL} SELECT ticker, strftime(date, '%Y-%m-%d') AS date FROM roll WHERE n30 >= 15 AND t7 / 7 >= 1.8 * (t30 / 30)",
    "p4_totals": f"""WITH {_ROLL} SELECT ticker, strftime(date, '%Y-%m-%d') AS date, round(t7, 9) AS total_7, round(t7 / 7, 9) AS mean_7,
        round(t30, 9) AS total_30, round(t30 / 30, 9) AS mean_30, n7 AS values_7, n30 AS values_30 FROM roll""",
    "p7_found": f"""WITH {_RECORD}, {_PANEL}
        SELECT 'mention' AS source_table, ticker FROM tick GROUP BY ticker HAVING count(*) >= 0.02 * (SELECT count(*) FROM rec)
        UNION ALL
        SELECT 'panel_data', ticker FROM pan WHERE ticker IS NOT NULL GROUP BY ticker HAVING sum(mention_count) >= 0.02 * (SELECT sum(mention_count) FROM pan)""",
    "p7_mention_stats": f"""WITH {_RECORD},
        freq AS (SELECT ticker, score, count(*) AS n FROM tick WHERE score IS NOT NULL GROUP BY 1, 2),
        best AS (SELECT ticker, score AS mode_value FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, score) AS rn FROM freq) WHERE rn = 1)
        SELECT tick.ticker, count(*) AS n_rows, count(DISTINCT score) AS n_distinct, CAST(sum(score) AS BIGINT) AS total_score, any_value(mode_value) AS mode_value,
        quantile_disc(score, 0.5) AS median_score, quantile_disc(score, 0.9) AS p90_score
        FROM tick LEFT JOIN best ON tick.ticker = best.ticker GROUP BY tick.ticker""",
    "p7_panel_stats": f"""WITH {_PANEL}
        SELECT ticker, count(*) AS n_rows, count(mention_count) AS n_values, count(DISTINCT mention_count) AS n_distinct, CAST(sum(mention_count) AS BIGINT) AS total_mentions,
        quantile_disc(mention_count, 0.5) AS median_mentions, quantile_disc(mention_count, 0.9) AS p90_mentions FROM pan GROUP BY ticker""",
}
