"""Command line: ``python -m tapewell.cli mentions|sentiment|stats|returns|panel|regressions|garch|lr-tests ...``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from tapewell.estimators import garch
from tapewell.operators import calendar, extraction, mentions, panel, returns, sentiment, universe
from tapewell.plans import pipelines
from tapewell.sinks import files as sinks
from tapewell.sources import files as sources
from tapewell.state import State


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tapewell")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("mentions", help="raw submissions and comments (zstd JSON lines) to mention records")
    for name in ("raw", "universe", "output"):
        p.add_argument(name)
    p.add_argument("datasets", nargs="*", help="all in the folder if none is named")
    p.add_argument("--symbols-only", action="store_true")
    p.add_argument("--stop-words", help="a text file, one word a line")
    p.add_argument("--long-windows", action="store_true", help="files with windows beyond the JVM codec's limit")
    p.add_argument("--partitions", type=int)
    p = sub.add_parser("sentiment", help="mention records and a score table to daily sentiment")
    for name in ("mentions", "scores", "output"):
        p.add_argument(name)
    p.add_argument("--models", nargs="+", required=True, help="keys of models; a targeted one ends in ':targeted'")
    p = sub.add_parser("stats", help="mention records to daily counts, totals and ticker statistics")
    for name in ("mentions", "output"):
        p.add_argument(name)
    p = sub.add_parser("returns", help="prices to returns and volatilities")
    p.add_argument("prices")
    p.add_argument("output")
    p.add_argument("--limit", type=int, help="only the first so many tickers in alphabetical order")
    p = sub.add_parser("panel", help="returns and daily sentiment to the panel")
    for name in ("returns", "sentiment", "output"):
        p.add_argument(name)
    p.add_argument("--model", default="finbert")
    p.add_argument("--alternatives", nargs="*", default=[])
    p.add_argument("--benchmark")
    p.add_argument("--force", action="store_true")
    p.add_argument("--min-days", type=int, nargs=3, default=(200, 30, 20))
    p = sub.add_parser("regressions", help="panel to regression results")
    p.add_argument("panel")
    p.add_argument("output")
    p.add_argument("--fixed-effects", choices=("none", "entity", "time", "twoway"), default="twoway")
    p.add_argument("--cluster", choices=("entity", "time", "twoway"), default="entity")
    p.add_argument("--sentiment")
    p.add_argument("--alternatives", nargs="*", default=[])
    p.add_argument("--skip-robustness", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    for name in ("garch", "lr-tests"):
        p = sub.add_parser(name, help="panel to GARCH estimates")
        p.add_argument("panel")
        p.add_argument("output")
        p.add_argument("--exog", nargs="*", default=["attention_std", "sentiment_pos_std", "sentiment_neg_std"])
        p.add_argument("--min-obs", type=int, default=250)
        p.add_argument("--rounds", type=int, default=60)
        p.add_argument("--params", nargs="*", default=["alpha", "beta", "delta"])
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tapewell").getOrCreate()
    if args.command == "mentions":
        names = args.datasets or sources.discover(spark, args.raw)
        known = universe.usable(sources.universe_file(spark, args.universe))
        stop = extraction.stop_words(spark, args.stop_words)
        find = extraction.extractor(known, universe.names_of(known), stop)

        def read(part: str, schema):
            paths = [f"{args.raw}/{n}_{part}.zst" for n in names]
            if args.long_windows:
                return sources.long_window_lines(spark, paths, schema, args.partitions)
            return sources.json_lines(spark, paths, schema, args.partitions)

        found = pipelines.mentions(read("submissions", sources.SUBMISSION), read("comments", sources.COMMENT), find, args.symbols_only)
        sinks.parquet(found, args.output)
    elif args.command == "sentiment":
        models = [(m.removesuffix(":targeted"), m.endswith(":targeted")) for m in args.models]
        daily = pipelines.daily_from_mentions(spark.read.parquet(args.mentions), spark.read.parquet(args.scores), models)
        sinks.daily_sentiment_csv(daily, args.output)
    elif args.command == "stats":
        rows = spark.read.parquet(args.mentions).selectExpr("date_from_unix_date(cast(floor(created_utc / 86400) AS int)) AS date", "explode(tickers) AS ticker")
        counts = mentions.daily_counts(rows).persist()
        sinks.csv(mentions.daily_totals(counts), f"{args.output}/daily_totals", ("date",))
        sinks.csv(mentions.ticker_stats(counts), f"{args.output}/ticker_stats", ("ticker",))
        sinks.csv(mentions.pivot_counts(counts), f"{args.output}/daily_ticker_counts", ("date",))
        counts.unpersist()
    elif args.command == "returns":
        prices = spark.read.parquet(args.prices)
        if args.limit is not None:
            prices = universe.first_tickers(prices, args.limit)
        sinks.parquet(returns.calculate_returns(prices), args.output)
    elif args.command == "panel":
        config = panel.PanelConfig(alternatives=tuple(args.alternatives), min_financial_days=args.min_days[0], min_mention_days=args.min_days[1], min_valid_days=args.min_days[2])
        state, inputs = State(args.output.rstrip("/") + ".state.json"), {"returns": args.returns, "sentiment": args.sentiment}
        settings = asdict(config) | {"model": args.model, "benchmark": args.benchmark}
        if not args.force and state.valid(spark, "panel", inputs, args.output, settings):
            print("panel is up to date")
            return
        state.start("panel")
        market = returns.benchmark_returns(spark.read.parquet(args.benchmark)).select("date", "market_return", "market_log_return", "market_volatility_ja_gk") if args.benchmark else None
        daily = sources.daily_sentiment_file(spark, args.sentiment)
        sinks.parquet(pipelines.build_panel(spark.read.parquet(args.returns), daily, args.model, market, config), args.output)
        state.finish(spark, "panel", inputs, args.output, settings)
    elif args.command == "regressions":
        saved = spark.read.parquet(args.panel)
        config = panel.PanelConfig(alternatives=tuple(args.alternatives))
        if args.dry_run:
            print(json.dumps({"rows": saved.count(), "columns": len(saved.columns)}))
            return
        by_model = None
        if args.sentiment:
            days = calendar.trading_calendar(saved)
            by_model = sentiment.to_trading_days(calendar.as_of_trading_day(sources.daily_sentiment_file(spark, args.sentiment), days), ("trading_date", "ticker", "model"))
        results = pipelines.all_regressions(saved, config, by_model, not args.skip_robustness, args.fixed_effects, args.cluster)
        sinks.json_file([r.to_dict() for r in results], args.output + ".json")
        with open(args.output + ".tex", "w", encoding="utf-8") as file:
            file.write(sinks.document(sinks.regression_latex(results)))
    else:
        spec = garch.GarchSpec(exog=tuple(args.exog), min_obs=args.min_obs)
        stocks = garch.stock_arrays(spark.read.parquet(args.panel), spec)
        if args.command == "garch":
            result = garch.fit_panel(stocks, spec, args.rounds, errors=True)
            sinks.garch_tables(result, args.output)
        else:
            sinks.likelihood_ratio_tables(garch.pooling_tests(stocks, spec, args.params, args.rounds), args.output)


if __name__ == "__main__":
    main()
