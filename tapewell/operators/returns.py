"""Daily returns and the volatility battery of a price table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewell.functions import prices as px

OHLC = ("open", "high", "low", "close")


def calculate_returns(prices: DataFrame) -> DataFrame:
    """date, ticker, OHLC, adj_close, returns of the adjusted close and six volatilities; first rows of tickers leave.

    One window over (ticker, date) serves the previous close and both returns. NULL, NaN, zero and negative
    prices give NULL where a logarithm would need them. Rows with equal ticker and date follow their prices' order.
    """
    by = Window.partitionBy("ticker").orderBy("date", *OHLC, "adj_close")
    clean = prices.select("date", "ticker", *[px.finite(F.col(c).cast("double")).alias(c) for c in (*OHLC, "adj_close")])
    based = clean.withColumns(
        {"__previous": F.lag("close").over(by), "simple_return": px.simple_return(F.col("adj_close"), by), "log_return": px.log_return(F.col("adj_close"), by)}
    ).where(F.col("simple_return").isNotNull())
    parts = px.intraday(*[F.col(c) for c in OHLC], F.col("__previous"))
    named = based.withColumns({f"__{k}": v for k, v in parts.items()})
    var = px.variances(*[F.col(f"__{k}") for k in "ocud"])
    named = named.withColumns({f"__v_{k}": v for k, v in var.items()})
    vols = px.volatilities(*[F.col(f"__v_{k}") for k in ("overnight", "gk", "rs", "pk")], F.col("log_return"))
    return named.select("date", "ticker", *OHLC, "adj_close", "simple_return", "log_return", *[v.alias(f"volatility_{k}") for k, v in vols.items()])


def benchmark_returns(benchmark: DataFrame) -> DataFrame:
    """Returns and jump-adjusted Garman-Klass volatility of one benchmark series.

    The series is one market index, a few thousand rows however large the rest grows; it alone may be put
    in order by one task.
    """
    out = calculate_returns(benchmark.withColumn("ticker", F.lit("market")))
    return out.select(
        "date",
        *OHLC,
        "adj_close",
        F.col("simple_return").alias("market_return"),
        F.col("log_return").alias("market_log_return"),
        F.col("volatility_ja_gk").alias("market_volatility_ja_gk"),
    )


def forward_returns(prices: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """``forward_return_{h}``: log return of the adjusted close over the next h rows."""
    by = Window.partitionBy("ticker").orderBy("date")
    return prices.withColumns({f"forward_return_{h}": px.log_ratio(F.lead("adj_close", h).over(by), F.col("adj_close")) for h in horizons})
