"""Queries of the attention, sentiment and volatility operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewell.estimators import garch, ols
from tapewell.functions import prices as px
from tapewell.functions import scalars as sc
from tapewell.operators import calendar, describe, extraction, mentions, panel, returns, sentiment, universe
from tapewell.operators.records import clean_tickers, latest_records, once
from tapewell.plans import pipelines
from tapewell.scoring import store
from tapewell.session import ensure_checkpoint_dir, table
from tapewell.streaming import daily as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; negative zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(name: str, source: str | None = None, digits: int = 9) -> str:
    return f"round({source or name}, {digits}) + 0.0 AS {name}"


# ---------------------------------------------------------------- inputs
def _prices(spark, folder) -> DataFrame:
    cols = ["open", "high", "low", "close", "adj_close"]
    return once(table(spark, folder, "stock_returns"), ["date", "ticker"], cols, ["date", "ticker", *cols])


def _returns(spark, folder) -> DataFrame:
    return returns.calculate_returns(_prices(spark, folder))


def _records(spark, folder, *columns: str) -> DataFrame:
    """The newest rows with these columns: no other is read, and texts are shuffled only where a query looks at them."""
    return latest_records(table(spark, folder, "mention"), "id", "ingested_at", columns)


def _seconds() -> Column:
    return F.when(F.col("created_utc") > 100_000_000_000, F.floor(F.col("created_utc") / 1000)).otherwise(F.col("created_utc"))


MODELS = {"finbert": 7919, "bertweet": 104729, "fintwit": 15485863}


def _scored(spark, folder, models=("finbert",)) -> DataFrame:
    """Mentions by ticker and model with a made sentiment in [-1, 1]."""
    base = _records(spark, folder, "subreddit", "created_utc", "type", "score", "tickers").select(
        sc.epoch_date(_seconds()).alias("date"),
        F.explode(clean_tickers("tickers")).alias("ticker"),
        F.col("subreddit").alias("dataset"),
        "score",
        (F.col("type") == "submission").alias("is_submission"),
        "created_utc",
    )
    made = lambda k: ((F.abs(F.coalesce("score", F.lit(0))) * k + F.col("created_utc")) % 2001 - 1000) / 1000.0
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), made(MODELS[m]).alias("sentiment")) for m in models])
    return base.select("date", "ticker", "dataset", "score", "is_submission", F.explode(pairs).alias("m")).select("date", "ticker", "dataset", "score", "is_submission", "m.*")


def _trading_sentiment(spark, folder, models=("finbert",)) -> DataFrame:
    days = calendar.trading_calendar(_prices(spark, folder))
    daily = sentiment.daily_sentiment(_scored(spark, folder, models))
    return sentiment.to_trading_days(calendar.as_of_trading_day(daily, days), ("trading_date", "ticker", "model"))


def _panel(spark, folder) -> DataFrame:
    days = calendar.trading_calendar(_prices(spark, folder))
    return panel.merge_panel(_returns(spark, folder), _trading_sentiment(spark, folder).drop("model"), days)


PRICES = "px AS (SELECT DISTINCT date, ticker, open, high, low, close, adj_close FROM stock_returns)"
BATTERY = f"""{PRICES},
lagged AS (SELECT *, lag(close) OVER w AS pc, lag(adj_close) OVER w AS pa FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)),
ratio AS (SELECT *, adj_close / nullif(pa, 0) AS ra, open / nullif(pc, 0) AS ro, close / nullif(open, 0) AS rc, high / nullif(open, 0) AS ru, low / nullif(open, 0) AS rd FROM lagged),
logs AS (SELECT *, CASE WHEN ra > 0 THEN ln(ra) END AS lr, CASE WHEN ro > 0 THEN ln(ro) END AS o, CASE WHEN rc > 0 THEN ln(rc) END AS c,
  CASE WHEN ru > 0 THEN ln(ru) END AS u, CASE WHEN rd > 0 THEN ln(rd) END AS d FROM ratio WHERE ra IS NOT NULL),
var AS (SELECT *, o * o AS vo, 0.5 * (u - d) * (u - d) - (2 * ln(2.0) - 1) * c * c AS vgk, u * (u - c) + d * (d - c) AS vrs, (u - d) * (u - d) / (4 * ln(2.0)) AS vpk FROM logs),
ret AS (SELECT date, ticker, open, high, low, close, adj_close, ra - 1 AS simple_return, lr AS log_return,
  CASE WHEN vo + vgk IS NOT NULL THEN sqrt(greatest(vo + vgk, 0)) END AS volatility_ja_gk, CASE WHEN vo + vrs IS NOT NULL THEN sqrt(greatest(vo + vrs, 0)) END AS volatility_ja_rs,
  CASE WHEN vo + vpk IS NOT NULL THEN sqrt(greatest(vo + vpk, 0)) END AS volatility_ja_pk, CASE WHEN vgk IS NOT NULL THEN sqrt(greatest(vgk, 0)) END AS volatility_gk,
  CASE WHEN vpk IS NOT NULL THEN sqrt(greatest(vpk, 0)) END AS volatility_pk, abs(lr) AS volatility_sqret FROM var)"""
RECORDS = "rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM mention WHERE id IS NOT NULL) WHERE rn = 1)"
SECONDS = "(CASE WHEN created_utc > 100000000000 THEN created_utc // 1000 ELSE created_utc END)"
DAY = f"CASE WHEN {SECONDS} <= 0 THEN DATE '1970-01-01' ELSE DATE '1970-01-01' + CAST({SECONDS} // 86400 AS INTEGER) END"


def _scored_sql(models=("finbert",)) -> str:
    stack = " UNION ALL ".join(f"SELECT *, '{m}' AS model, ((abs(coalesce(score, 0)) * {MODELS[m]} + created_utc) % 2001 - 1000) / 1000.0 AS sentiment FROM tick" for m in models)
    return f"""{RECORDS},
tick AS (SELECT DISTINCT id, {DAY} AS date, upper(trim(t)) AS ticker, subreddit AS dataset, score, type = 'submission' AS is_submission, created_utc
  FROM (SELECT id, created_utc, subreddit, score, type, unnest(tickers) AS t FROM rec) WHERE t IS NOT NULL),
scored AS (SELECT *, greatest(1.0, ln(1 + greatest(0, coalesce(score, 0)))) AS w FROM ({stack})),
daily AS (SELECT date, ticker, model, sum(w * sentiment) / sum(w) AS sentiment_avg,
  CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(greatest(0, sum(w * sentiment * sentiment) / sum(w) - (sum(w * sentiment) / sum(w)) ** 2)) END AS sentiment_disp,
  count(*) AS mention_count, sum(w) AS weight_sum, count(*) FILTER (is_submission) AS submission_count, count(*) FILTER (NOT is_submission) AS comment_count FROM scored GROUP BY 1, 2, 3)"""


def _trading_sql(models=("finbert",)) -> str:
    return f"""{_scored_sql(models)}, {BATTERY},
caldays AS (SELECT DISTINCT date FROM px),
mapped AS (SELECT d.*, c.date AS trading_date FROM daily d ASOF JOIN caldays c ON d.date >= c.date),
td AS (SELECT trading_date, ticker, model, CAST(sum(mention_count) AS BIGINT) AS mention_count, sum(weight_sum) AS weight_sum,
  sum(sentiment_avg * weight_sum) / sum(weight_sum) AS sentiment_avg, max(sentiment_disp) AS sentiment_disp FROM mapped GROUP BY 1, 2, 3)"""


PANEL = f"""{_trading_sql()},
gaps AS (SELECT date, coalesce(date_diff('day', date, lead(date) OVER (ORDER BY date)), 1) - 1 AS gap_days FROM caldays),
pan AS (SELECT ret.*, coalesce(td.mention_count, 0) AS mention_count, coalesce(td.weight_sum, 0) AS weight_sum, coalesce(td.sentiment_avg, 0) AS sentiment_avg,
  coalesce(td.sentiment_disp, 0) AS sentiment_disp, CAST(gap_days AS INTEGER) AS gap_days FROM ret LEFT JOIN td ON td.trading_date = ret.date AND td.ticker = ret.ticker LEFT JOIN gaps ON gaps.date = ret.date)"""
RET_COLUMNS = ("simple_return", "log_return", *[f"volatility_{m}" for m in px.MEASURES])


# ---------------------------------------------------------------- prices
@query(f"WITH {BATTERY} SELECT date, ticker, {', '.join(r(c) for c in RET_COLUMNS)} FROM ret")
def volatility_battery(spark, folder):
    return rounded(_returns(spark, folder).select("date", "ticker", *RET_COLUMNS))


@query(
    f"""WITH src AS (SELECT DISTINCT date, ticker, open, high, low, close, adj_close FROM stock_returns),
    stock AS (SELECT date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, avg(adj_close) AS adj_close, 'market' AS ticker FROM src GROUP BY 1),
    {BATTERY.replace('FROM stock_returns)', 'FROM stock)')}
    SELECT date, {r('market_return', 'simple_return', 6)}, {r('market_log_return', 'log_return', 6)}, {r('market_volatility_ja_gk', 'volatility_ja_gk', 6)} FROM ret"""
)
def benchmark_returns(spark, folder):
    index = _prices(spark, folder).groupBy("date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close", "adj_close")])
    return rounded(returns.benchmark_returns(index).select("date", "market_return", "market_log_return", "market_volatility_ja_gk"), 6)


_FORWARD = ", ".join(f"CASE WHEN lead(adj_close, {h}) OVER w / nullif(adj_close, 0) > 0 THEN round(ln(lead(adj_close, {h}) OVER w / nullif(adj_close, 0)), 9) + 0.0 END AS forward_return_{h}" for h in (1, 3, 5))


@query(f"WITH {PRICES} SELECT date, ticker, {_FORWARD} FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def forward_returns(spark, folder):
    return rounded(returns.forward_returns(_prices(spark, folder)).select("date", "ticker", *[f"forward_return_{h}" for h in (1, 3, 5)]))


def _rolling(spark, folder, how):
    full = panel.rolling_volatility(_returns(spark, folder), aggregation=how)
    return rounded(full.select("date", "ticker", *[f"{k}_volatility_{h}d{t}" for k in ("rolling", "log") for h in (1, 3, 5) for t in ("", "_pk")]), 6)


def _rolling_sql(how: str) -> str:
    cols = []
    for m, t in (("ja_gk", ""), ("pk", "_pk")):
        for h in (1, 3, 5):
            v = f"CASE WHEN count(volatility_{m}) OVER w{h} = {h} THEN sqrt({how}(volatility_{m} * volatility_{m}) OVER w{h}) END"
            cols += [r(f"rolling_volatility_{h}d{t}", v, 6), f"CASE WHEN {v} > 0 THEN round(ln({v}), 6) + 0.0 END AS log_volatility_{h}d{t}"]
    frames = ", ".join(f"w{h} AS (PARTITION BY ticker ORDER BY date ROWS {h - 1} PRECEDING)" for h in (1, 3, 5))
    return f"WITH {BATTERY} SELECT date, ticker, {', '.join(cols)} FROM ret WINDOW {frames}"


@query(_rolling_sql("avg"))
def rolling_volatility(spark, folder):
    return _rolling(spark, folder, "mean")


@query(_rolling_sql("sum"))
def rolling_volatility_sum(spark, folder):
    return _rolling(spark, folder, "sum")


_LAG_COLS = ("lag_return", "log_variance_ja_gk", "log_variance_gk")


@query(
    f"""WITH {BATTERY}, con AS (SELECT date, ticker, CASE WHEN volatility_ja_gk <> 0 THEN ln(volatility_ja_gk ** 2) END AS log_variance_ja_gk,
    CASE WHEN volatility_gk <> 0 THEN ln(volatility_gk ** 2) END AS log_variance_gk, lag(log_return) OVER (PARTITION BY ticker ORDER BY date) AS lag_return FROM ret)
    SELECT date, ticker, {', '.join(r(c, digits=6) for c in _LAG_COLS)}, {', '.join(r(f'{c}_lag{h}', f'lag({c}, {h}) OVER w', 6) for c in _LAG_COLS for h in (1, 3, 5))}
    FROM con WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
)
def lagged_predictors(spark, folder):
    full = panel.lagged_predictors(panel.lagged_controls(_returns(spark, folder)), columns=_LAG_COLS)
    return rounded(full.select("date", "ticker", *_LAG_COLS, *[f"{c}_lag{h}" for c in _LAG_COLS for h in (1, 3, 5)]), 6)


# ---------------------------------------------------------------- mentions and sentiment
_DAILY = ("sentiment_avg", "sentiment_disp", "weight_sum")
_DAILY_SQL = f"SELECT date, ticker, model, {', '.join(r(c, digits=6) for c in _DAILY)}, mention_count, submission_count, comment_count FROM daily"


@query(f"WITH {_scored_sql()} {_DAILY_SQL}")
def daily_sentiment(spark, folder):
    return rounded(sentiment.daily_sentiment(_scored(spark, folder)), 6)


@query(f"WITH {_scored_sql()} {_DAILY_SQL}")
def daily_sentiment_multi_dataset(spark, folder):
    """Sums per data set, merged: the same as one pass."""
    keys = ("dataset", "date", "ticker", "model")
    parts = sentiment.sums(_scored(spark, folder).withColumn("dataset", F.coalesce("dataset", F.lit(""))), keys)
    return rounded(sentiment.finish(sentiment.merged(parts.drop("dataset"))), 6)


@query(f"WITH {_scored_sql()} {_DAILY_SQL.replace('FROM daily', 'FROM daily')}")
def stream_daily_sentiment(spark, folder):
    """The streaming form over the same mentions, read once as a stream of files."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{spark.sparkContext.applicationId}-{abs(hash(folder)) % 10**9}-{spark._jvm.System.nanoTime()}"
    source, out, log = f"{base}/source", f"{base}/out", f"{base}/log"
    rows = _scored(spark, folder).withColumn("ts", F.col("date").cast("timestamp")).drop("date")
    last = F.lit("2999-01-01").cast("timestamp")  # a far mark closes the last days
    rows.write.parquet(source)
    mark = {"ts": last, "ticker": F.lit(""), "sentiment": F.lit(0.0)}
    closing = spark.range(1).select(*[mark.get(c, F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
    closing.write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    streaming.write_states(streaming.daily_states(stream), out, log).awaitTermination()
    return rounded(sentiment.finish(spark.read.parquet(out)), 6)


@query(f"WITH {_scored_sql()} SELECT date, ticker, count(*) AS n FROM scored GROUP BY 1, 2")
def mention_daily_counts(spark, folder):
    return mentions.daily_counts(_scored(spark, folder))


@query(f"WITH {_scored_sql()} SELECT date, count(*) AS total_mentions FROM scored GROUP BY 1")
def daily_totals(spark, folder):
    return mentions.daily_totals(mentions.daily_counts(_scored(spark, folder)))


_GRID = f"""WITH {_scored_sql()}, cnt AS (SELECT date, ticker, count(*) AS n FROM scored GROUP BY 1, 2),
grid AS (SELECT d.date, t.ticker, coalesce(n, 0) AS n FROM (SELECT DISTINCT date FROM cnt) d CROSS JOIN (SELECT DISTINCT ticker FROM cnt) t LEFT JOIN cnt USING (date, ticker)),
st AS (SELECT ticker, CAST(sum(n) AS BIGINT) AS total_mentions, count(*) FILTER (n > 0) AS active_days, count(*) AS total_days, {r('mean_per_day', 'avg(n)', 6)},
  {r('median_per_day', 'quantile_cont(n, 0.5)', 6)}, {r('p90_per_day', 'quantile_cont(n, 0.9)', 6)}, {r('p95_per_day', 'quantile_cont(n, 0.95)', 6)}, max(n) AS max_per_day FROM grid GROUP BY 1)"""


@query(f"{_GRID} SELECT * FROM st")
def ticker_stats_zero_filled(spark, folder):
    return rounded(mentions.ticker_stats(mentions.daily_counts(_scored(spark, folder))), 6)


@query(f"{_GRID} SELECT st.*, dataset_coverage, (SELECT count(DISTINCT dataset) FROM scored) AS num_datasets FROM st JOIN (SELECT ticker, count(DISTINCT dataset) AS dataset_coverage FROM scored GROUP BY 1) USING (ticker)")
def global_ticker_stats(spark, folder):
    return rounded(mentions.global_ticker_stats(mentions.daily_counts(_scored(spark, folder), ("dataset", "date", "ticker"))), 6)


@query(
    """WITH one AS (SELECT DISTINCT id, subreddit AS dataset, match_types FROM mention WHERE id IS NOT NULL), kind AS (SELECT dataset, unnest(map_values(match_types)) AS match_type FROM one)
    SELECT coalesce(dataset, 'unknown') AS dataset, match_type, count(*) AS n FROM kind GROUP BY 1, 2 UNION ALL SELECT '_global', match_type, count(*) FROM kind GROUP BY 2"""
)
def match_counts_rollup(spark, folder):
    rows = table(spark, folder, "mention").where("id IS NOT NULL")
    one = rows.select("id", F.coalesce("subreddit", F.lit("unknown")).alias("dataset"), F.array_sort(F.map_entries("match_types")).alias("e")).distinct()
    return mentions.match_counts(one.withColumn("match_types", F.map_from_entries("e")))


@query(f"WITH {_scored_sql()} SELECT date, count(*) FILTER (is_submission) AS submission, count(*) FILTER (NOT is_submission) AS comment FROM scored GROUP BY 1")
def daily_counts_pivot(spark, folder):
    by_type = _scored(spark, folder).withColumn("ticker", F.when(F.col("is_submission"), "submission").otherwise("comment"))
    return mentions.pivot_counts(mentions.daily_counts(by_type)).select("date", "submission", "comment")


@query(f"WITH {_scored_sql()} SELECT date, CASE WHEN is_submission THEN 'submission' ELSE 'comment' END AS ticker, count(*) AS n FROM scored GROUP BY 1, 2")
def daily_counts_unpivot(spark, folder):
    return mentions.unpivot_counts(daily_counts_pivot(spark, folder))


@query(f"WITH {_scored_sql()} SELECT ticker, count(*) AS n FROM scored GROUP BY 1 ORDER BY n DESC, ticker LIMIT 20")
def top_tickers(spark, folder):
    return mentions.top_tickers(mentions.daily_counts(_scored(spark, folder)))


@query(
    f"""WITH {_scored_sql()}, tot AS (SELECT ticker, count(*) AS n FROM scored GROUP BY 1)
    SELECT row_number() OVER w AS rank, ticker, n, round(CAST(sum(n) OVER w AS DOUBLE) / (SELECT sum(n) FROM tot), 9) + 0.0 AS share FROM tot WINDOW w AS (ORDER BY n DESC, ticker ROWS UNBOUNDED PRECEDING)"""
)
def coverage_curve(spark, folder):
    totals = mentions.daily_counts(_scored(spark, folder), ("ticker",))
    return rounded(mentions.coverage_curve(totals, "ticker", "n").withColumn("rank", F.col("rank").cast("bigint")))


@query(f"WITH {_scored_sql()} SELECT dataset, count(DISTINCT ticker) AS n_tickers, min(date) AS first_day, max(date) AS last_day, count(*) AS mentions FROM scored GROUP BY 1")
def source_summary(spark, folder):
    return mentions.source_summary(_scored(spark, folder))


@query(f"WITH {_scored_sql(tuple(MODELS))} SELECT count(DISTINCT date) AS n_days, count(DISTINCT ticker) AS n_tickers, count(DISTINCT model) AS n_models, min(date) AS first_day, max(date) AS last_day, CAST(sum(mention_count) AS BIGINT) AS total_mentions FROM daily")
def sentiment_global_stats(spark, folder):
    return sentiment.global_stats(sentiment.daily_sentiment(_scored(spark, folder, tuple(MODELS))))


@query(f"WITH {RECORDS} SELECT id, subreddit, type FROM (SELECT *, row_number() OVER (PARTITION BY subreddit, type ORDER BY md5('0:' || id), id) AS place FROM rec) WHERE place <= 20")
def sample_of_records(spark, folder):
    """Twenty records per subreddit and type, the same for a seed."""
    return mentions.sample_records(_records(spark, folder, "subreddit", "type"), ("subreddit", "type"))


# ---------------------------------------------------------------- calendar and panel
@query(f"WITH {PRICES}, d AS (SELECT DISTINCT date FROM px) SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS trading_day_index, CAST(coalesce(date_diff('day', date, lead(date) OVER (ORDER BY date)), 1) - 1 AS INTEGER) AS gap_days FROM d")
def trading_calendar_gap(spark, folder):
    return calendar.trading_calendar(_prices(spark, folder))


@query(f"WITH {_trading_sql()} SELECT date, ticker, trading_date, mention_count FROM mapped")
def asof_trading_day(spark, folder):
    days = calendar.trading_calendar(_prices(spark, folder))
    return calendar.as_of_trading_day(sentiment.daily_sentiment(_scored(spark, folder)), days).select("date", "ticker", "trading_date", "mention_count")


@query(f"WITH {_trading_sql()} SELECT trading_date, ticker, model, mention_count, {', '.join(r(c, digits=6) for c in _DAILY)} FROM td")
def trading_day_sentiment(spark, folder):
    return rounded(_trading_sentiment(spark, folder), 6)


_SMALL = panel.PanelConfig(min_posts=1, min_financial_days=20, min_mention_days=3, min_valid_days=2, start=None, end=None)


@query(
    f"""WITH {_trading_sql()}, f AS (SELECT ticker, count(DISTINCT date) AS n_financial_days FROM ret GROUP BY 1),
    m AS (SELECT ticker, count(DISTINCT CASE WHEN mention_count > 0 THEN trading_date END) AS n_mention_days, count(DISTINCT CASE WHEN mention_count >= 1 THEN trading_date END) AS n_valid_days FROM td GROUP BY 1)
    SELECT ticker, coalesce(n_financial_days, 0) AS n_financial_days, coalesce(n_mention_days, 0) AS n_mention_days, coalesce(n_valid_days, 0) AS n_valid_days FROM f FULL JOIN m USING (ticker)
    WHERE n_financial_days >= 20 AND n_mention_days >= 3 AND n_valid_days >= 2"""
)
def stock_inclusion(spark, folder):
    return panel.included_stocks(_returns(spark, folder), _trading_sentiment(spark, folder), _SMALL)


@query(f"WITH {PANEL} SELECT date, ticker, {r('log_return', digits=6)}, mention_count, {', '.join(r(c, digits=6) for c in _DAILY)}, gap_days FROM pan")
def panel_merge(spark, folder):
    return rounded(_panel(spark, folder).select("date", "ticker", "log_return", "mention_count", *_DAILY, "gap_days"), 6)


def _z(source: str, scope: str) -> str:
    w = "(PARTITION BY ticker)" if scope == "within_stock" else "()"
    flat = f"coalesce(stddev_samp({source}) OVER {w}, 0) = 0"
    return f"CASE WHEN count(*) OVER {w} <= 1 OR {flat} THEN 0 ELSE ({source} - avg({source}) OVER {w}) / stddev_samp({source}) OVER {w} END"


def _attention_sql(measure: str, scope: str) -> str:
    raw = "ln(1.0 + mention_count)" if measure == "absolute" else "mention_count / CASE WHEN sum(mention_count) OVER (PARTITION BY date) = 0 THEN 1 ELSE sum(mention_count) OVER (PARTITION BY date) END"
    return f"WITH {PANEL}, att AS (SELECT date, ticker, mention_count, {raw} AS attention FROM pan) SELECT date, ticker, mention_count, {r('attention', digits=6)}, {r('attention_std', _z('attention', scope), 6)} FROM att"


def _attention(measure, scope):
    return lambda spark, folder: rounded(panel.attention(_panel(spark, folder), measure, scope).select("date", "ticker", "mention_count", "attention", "attention_std"), 6)


for _m, _short in (("absolute", "abs"), ("relative", "rel")):
    for _s, _tail in (("within_stock", "within"), ("global", "global")):
        QUERIES[f"attention_{_short}_{_tail}"] = _attention(_m, _s)
        SQL[f"attention_{_short}_{_tail}"] = _attention_sql(_m, _s)

_FEATURES = ("sentiment", "sentiment_pos", "sentiment_neg", "sentiment_disp", "sentiment_intensity")


@query(
    f"""WITH {PANEL}, s AS (SELECT *, CAST(mention_count >= 1 AS INTEGER) AS valid_sentiment, CASE WHEN mention_count >= 1 THEN sentiment_avg ELSE 0 END AS sentiment FROM pan),
    f AS (SELECT *, greatest(sentiment, 0) AS sentiment_pos, greatest(-sentiment, 0) AS sentiment_neg, abs(sentiment) AS sentiment_intensity, ln(1.0 + mention_count) AS attention FROM s),
    z AS (SELECT *, {', '.join(f"{_z(c, 'within_stock')} AS {c}_std" for c in (*_FEATURES, 'attention'))} FROM f)
    SELECT date, ticker, valid_sentiment, {', '.join(r(c, digits=6) for c in _FEATURES)}, {', '.join(r(f'{c}_std', digits=6) for c in _FEATURES)},
    {r('sentiment_x_attention', 'sentiment_std * attention_std', 6)}, {r('sentiment_pos_x_attention', 'sentiment_pos_std * attention_std', 6)}, {r('sentiment_neg_x_attention', 'sentiment_neg_std * attention_std', 6)} FROM z"""
)
def sentiment_features(spark, folder):
    full = panel.interactions(panel.sentiment_features(panel.attention(_panel(spark, folder)), _SMALL))
    return rounded(full.select("date", "ticker", "valid_sentiment", *_FEATURES, *[f"{c}_std" for c in _FEATURES], "sentiment_x_attention", "sentiment_pos_x_attention", "sentiment_neg_x_attention"), 6)


_TWO = ("bertweet", "fintwit")


@query(
    f"""WITH {PANEL.replace(_scored_sql(), _scored_sql(tuple(MODELS))).replace('LEFT JOIN td ON', "LEFT JOIN (SELECT * FROM td WHERE model = 'finbert') td ON")},
    w AS (SELECT pan.date, pan.ticker, {', '.join(f"CASE WHEN coalesce({m}.mention_count, 0) >= 1 THEN coalesce({m}.sentiment_avg, 0) ELSE 0 END AS {m}" for m in _TWO)} FROM pan
      {' '.join(f"LEFT JOIN (SELECT * FROM td WHERE model = '{m}') {m} ON {m}.trading_date = pan.date AND {m}.ticker = pan.ticker" for m in _TWO)}),
    p AS (SELECT *, {', '.join(f"greatest({m}, 0) AS pos_{m}, greatest(-{m}, 0) AS neg_{m}" for m in _TWO)} FROM w)
    SELECT date, ticker, {', '.join(r(f'sentiment_{s}_std_{m}', _z(f'{s}_{m}', 'within_stock'), 6) for m in _TWO for s in ('pos', 'neg'))} FROM p"""
)
def alt_model_merge(spark, folder):
    by_model = _trading_sentiment(spark, folder, tuple(MODELS))
    full = panel.alternative_sentiments(_panel(spark, folder), by_model, _TWO, _SMALL)
    return rounded(full.select("date", "ticker", *[f"sentiment_{s}_std_{m}" for m in _TWO for s in ("pos", "neg")]), 6)


@query(
    f"""WITH {_trading_sql(('finbert', 'bertweet'))}, pan AS (SELECT ret.date, ret.ticker, coalesce(a.mention_count, 0) AS mention_count FROM ret LEFT JOIN (SELECT * FROM td WHERE model = 'finbert') a ON a.trading_date = ret.date AND a.ticker = ret.ticker)
    SELECT pan.date, pan.ticker, coalesce(b.mention_count, pan.mention_count) AS mention_count, {r('sentiment_avg', 'coalesce(b.sentiment_avg, 0)', 6)} FROM pan LEFT JOIN (SELECT * FROM td WHERE model = 'bertweet') b ON b.trading_date = pan.date AND b.ticker = pan.ticker"""
)
def model_panel_rebuild(spark, folder):
    other = _trading_sentiment(spark, folder, ("bertweet",))
    return rounded(panel.model_sentiment(_panel(spark, folder), other).select("date", "ticker", "mention_count", "sentiment_avg"), 6)


@query(
    f"""WITH {BATTERY}, x AS (SELECT date, avg(volatility_pk) AS v FROM ret WHERE date_part('day', date) <> 13 GROUP BY 1), z AS (SELECT date, (v - (SELECT avg(v) FROM x)) / (SELECT stddev_samp(v) FROM x) AS z FROM x)
    SELECT ret.date, ticker, round(coalesce(z, 0), 6) + 0.0 AS vix_std FROM ret LEFT JOIN z ON z.date = ret.date"""
)
def day_series_join(spark, folder):
    """A z-scored series by day on the panel; days without a value (the 13th here) get 0."""
    full = _returns(spark, folder)
    series = full.where(F.dayofmonth("date") != 13).groupBy("date").agg(F.avg("volatility_pk").alias("vix"))
    return rounded(panel.with_day_series(full, series, "vix", "vix_std").select("date", "ticker", "vix_std"), 6)


@query(f"WITH {_scored_sql()} SELECT min(date) AS first_day, max(date) AS last_day FROM daily")
def mention_date_range(spark, folder):
    return mentions.date_range(mentions.daily_totals(mentions.daily_counts(_scored(spark, folder))))


@query(f"WITH {_scored_sql()} SELECT DISTINCT ticker FROM daily")
def mentioned_tickers(spark, folder):
    return mentions.mentioned_tickers(mentions.daily_counts(_scored(spark, folder)))


@query()
def full_panel(spark, folder):
    """The whole panel with all features and lags; 130 columns, so rows only. Its parts have SQL of their own."""
    config = panel.PanelConfig(min_posts=1, min_financial_days=20, min_mention_days=3, min_valid_days=2, start=None, end=None, alternatives=_TWO)
    market = QUERIES["benchmark_returns"](spark, folder)
    return pipelines.build_panel(_returns(spark, folder), sentiment.daily_sentiment(_scored(spark, folder, tuple(MODELS))), "finbert", market, config)


# ---------------------------------------------------------------- text
@query("SELECT id, author, stickied FROM (SELECT id, author, score > 50 AS stickied, type FROM mention) WHERE NOT (coalesce(stickied, false) OR lower(coalesce(author, '')) IN ('automoderator', 'auto-moderator', 'mod_team', 'qualityvote', 'superstonk_qv') OR regexp_matches(lower(coalesce(author, '')), '(bot|_qv)$'))")
def bot_filter(spark, folder):
    rows = table(spark, folder, "mention").select("id", "author", (F.col("score") > 50).alias("stickied"))
    return rows.where(~extraction.is_bot(F.col("author"), F.lit(None).cast("string"), F.col("stickied")))


@query(r"SELECT id, md5(regexp_replace(text, 'https?://[^\s\)\]>]+|www\.[^\s\)\]>]+', ' ', 'gi')) AS stripped FROM mention")
def url_strip(spark, folder):
    return table(spark, folder, "mention").select("id", F.md5(extraction.without_urls(F.col("text"))).alias("stripped"))


_TEXTS = f"{RECORDS}, t AS (SELECT id, regexp_replace(text, 'https?://[^\\s\\)\\]>]+|www\\.[^\\s\\)\\]>]+', ' ', 'gi') AS x FROM rec), sym AS (SELECT DISTINCT upper(trim(ticker)) AS ticker FROM universe)"


@query(
    rf"""WITH {_TEXTS}, stop AS (SELECT 'DRAVO' AS w UNION ALL SELECT 'ZUVEX'),
    bare AS (SELECT DISTINCT id, w AS ticker, 1 AS phase FROM (SELECT id, unnest(regexp_extract_all(x, '[A-Za-z0-9]+')) AS w FROM t) WHERE regexp_full_match(w, '[A-Z]{{3,5}}') AND w NOT IN (SELECT w FROM stop)),
    cash AS (SELECT DISTINCT id, upper(trim(w, '$')) AS ticker, 0 AS phase FROM (SELECT id, unnest(regexp_extract_all(x, '[A-Za-z0-9$]+')) AS w FROM t) WHERE regexp_full_match(w, '\$+[A-Za-z]{{1,5}}\$*'))
    SELECT id, ticker, CAST(min(phase) AS INTEGER) AS phase FROM (SELECT * FROM bare UNION ALL SELECT * FROM cash) WHERE ticker IN (SELECT ticker FROM sym) GROUP BY 1, 2"""
)
def token_mentions(spark, folder):
    """Cashtags and bare capitals; two symbols stand in for the stop words."""
    stop = spark.createDataFrame([("DRAVO",), ("ZUVEX",)], "word string")
    symbols = table(spark, folder, "universe").select(F.upper(F.trim("ticker")).alias("ticker"))
    return extraction.token_mentions(_records(spark, folder, "text"), symbols, stop).select("id", "ticker", "phase")


@query()
def mention_extraction(spark, folder):
    """All four phases over every record's text, names by automaton; checked against brute force in the tests."""
    known = universe.usable(table(spark, folder, "universe"))
    find = extraction.extractor(known, universe.names_of(known))
    hit = extraction.mention_records(_records(spark, folder, "text"), find)
    return hit.select("id", "tickers", F.map_entries("match_types").alias("match_types"))


@query(
    """WITH n AS (SELECT DISTINCT t AS raw FROM (SELECT unnest(tickers) AS t FROM mention)),
    a AS (SELECT raw, regexp_replace(upper(regexp_replace(coalesce(raw, ''), '^\\s+|\\s+$', '', 'g')), '^\\$', '') AS x FROM n),
    b AS (SELECT raw, regexp_replace(regexp_replace(x, '^[ \\t\\n\\r".,;:''()\\[\\]{}<>]+|[ \\t\\n\\r".,;:''()\\[\\]{}<>]+$', '', 'g'), '^([^.]*)\\.([^.])$', '\\1-\\2') AS y FROM a)
    SELECT raw, regexp_replace(y, '[^A-Z0-9^\\-.]', '', 'g') AS symbol FROM b""".replace("\\\\", "\\")
)
def symbol_normalise(spark, folder):
    raw = table(spark, folder, "mention").select(F.explode("tickers").alias("raw")).distinct()
    return raw.select("raw", sc.quote_symbol(F.col("raw")).alias("symbol"))


_USABLE = """use AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, name FROM universe WHERE regexp_full_match(upper(trim(ticker)), '[A-Z]+') AND upper(trim(coalesce(is_etf, 'N'))) <> 'Y'
    AND NOT regexp_matches(coalesce(raw_name, ''), '\\b(CLOSED[- ]?END|CEF|FUND|INVESTMENT TRUST)\\b', 'i') AND upper(trim(ticker)) NOT IN (""" + ", ".join(f"'{c}'" for c in universe.COINS) + "))"


@query(f"WITH {_USABLE} SELECT ticker FROM use")
def universe_usable(spark, folder):
    return universe.usable(table(spark, folder, "universe")).select("ticker")


@query(rf"WITH {_USABLE}, v AS (SELECT ticker, upper(regexp_replace(trim(n), '\s+', ' ', 'g')) AS name FROM (SELECT ticker, unnest(string_split(name, '|')) AS n FROM use)) SELECT name, min(ticker) AS ticker FROM v WHERE length(name) >= 3 GROUP BY 1")
def universe_names(spark, folder):
    return universe.names_of(universe.usable(table(spark, folder, "universe")))


def _variants_sql() -> str:
    avoid, keep = universe.name_words()
    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))
    bare = lambda x: rf"regexp_replace({x}, '^[ ,.\-]+|[ ,.\-]+$', '', 'g')"
    kinds, endings = "|".join(universe._STOCK_KINDS), "|".join(universe._ENDINGS)
    return rf"""WITH a AS (SELECT ticker, raw_name, {bare(r"regexp_replace(split_part(raw_name, ' - ', 1), '\(.*?\)', '', 'g')")} AS head FROM universe),
    b AS (SELECT *, {bare(f"regexp_replace(head, '{kinds}', '', 'gi')")} AS nk FROM a),
    c AS (SELECT *, trim(regexp_replace({bare(rf"regexp_replace(nk, '(?:[ ,.\-]*\s(?:{endings})[ ,.\-]*)+$', '', 'i')")}, '^the ', '', 'i')) AS core FROM b),
    d AS (SELECT ticker, raw_name, unnest([head, trim(split_part(head, ',', 1)), core, CASE WHEN contains(core, '.') AND NOT contains(core, ' ') THEN split_part(core, '.', 1) END]) AS n FROM c),
    e AS (SELECT ticker, min(n) AS n, length(n) AS size FROM d WHERE n IS NOT NULL AND length(n) > 1 AND lower(n) NOT IN ({quoted(avoid)}) AND (contains(n, ' ') OR length(n) >= 6 OR lower(n) IN ({quoted(keep)})) GROUP BY ticker, lower(n), length(n)),
    f AS (SELECT ticker, string_agg(n, '|' ORDER BY size, lower(n)) AS name FROM e GROUP BY 1)
    SELECT universe.ticker, raw_name, coalesce(f.name, '') AS name FROM universe LEFT JOIN f ON f.ticker = universe.ticker"""


@query(_variants_sql())
def universe_name_variants(spark, folder):
    return universe.with_variants(table(spark, folder, "universe").select("ticker", "raw_name"))


@query(
    """WITH base AS (SELECT upper(trim(r_name)) AS symbol, r_name AS security_name, 0 AS source FROM region), more AS (SELECT upper(trim(n_name)) AS symbol, n_name AS security_name, 1 AS source FROM nation),
    third AS (SELECT ticker AS symbol, raw_name AS security_name, 2 AS source FROM universe), u AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE regexp_matches(symbol, '^[A-Z]{1,6}(-[A-Z])?$')
    UNION ALL SELECT symbol, coalesce(security_name, symbol), source FROM third WHERE regexp_matches(symbol, '^[A-Z]{1,6}(-[A-Z])?$'))
    SELECT symbol, security_name FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY source, security_name) AS rn FROM u) WHERE rn = 1"""
)
def universe_union_dedup(spark, folder):
    name = lambda t, k, n: table(spark, folder, t).select(F.col(k).alias("symbol"), F.col(n).alias("security_name"))
    return universe.union_of_listings(name("region", "r_name", "r_name"), [name("nation", "n_name", "n_name"), name("universe", "ticker", "raw_name")])


@query("SELECT DISTINCT upper(trim(t)) AS ticker FROM (SELECT unnest(tickers) AS t FROM mention) WHERE t IS NOT NULL AND upper(trim(t)) NOT IN (SELECT ticker FROM universe WHERE upper(trim(is_etf)) = 'Y')")
def without_etfs(spark, folder):
    named = table(spark, folder, "mention").select(F.explode(clean_tickers("tickers")).alias("ticker")).distinct()
    return universe.without_etfs(named, table(spark, folder, "universe"))


@query(f"SELECT id, {DAY} AS day, round(greatest(1.0, ln(1 + greatest(0, coalesce(score, 0)))), 9) AS weight, sha256(substr(text, 1, 4000)) AS text_key FROM mention")
def scalar_functions(spark, folder):
    rows = table(spark, folder, "mention")
    return rows.select("id", sc.epoch_date(_seconds()).alias("day"), F.round(sc.approval_weight(F.col("score")), 9).alias("weight"), sc.text_key(F.col("text")).alias("text_key"))


# ---------------------------------------------------------------- scores
@query("SELECT event_id, 'LABEL_' || (event_id % 5) AS label, CASE WHEN event_id % 5 IN (2, 3) THEN value WHEN event_id % 5 = 0 THEN -value ELSE 0 END AS score FROM events")
def label_to_score(spark, folder):
    label = F.concat(F.lit("LABEL_"), (F.col("event_id") % 5).cast("string"))
    return table(spark, folder, "events").select("event_id", label.alias("label"), sc.label_score(label, F.col("value")).alias("score"))


def _score_table(spark, folder) -> DataFrame:
    """A made score table: every second distinct text of the records, by the first hex digit of its key."""
    keys = _records(spark, folder, "text").select(sc.text_key(F.col("text")).alias("text_hash")).distinct().where(F.substring("text_hash", 1, 1) < "8")
    score = F.conv(F.substring("text_hash", 1, 4), 16, 10).cast("bigint") / 65536.0
    return keys.select("text_hash", F.lit("finbert").alias("model"), F.lit("").alias("target"), F.lit("positive").alias("label"), score.alias("confidence"), score.alias("score"))


@query(
    f"""WITH {RECORDS}, k AS (SELECT id, sha256(substr(text, 1, 4000)) AS h FROM rec)
    SELECT id, CASE WHEN substr(h, 1, 1) < '8' THEN CAST(CAST('0x' || substr(h, 1, 4) AS INTEGER) AS DOUBLE) / 65536.0 END AS score FROM k"""
)
def score_lookup_join(spark, folder):
    rows = _records(spark, folder, "text").select("id", "text", F.create_map(F.lit("a"), F.lit("b")).alias("matched_on"))
    return store.attach(rows, _score_table(spark, folder), [("finbert", False)]).select("id", F.col("scores")["finbert"]["score"].alias("score"))


@query(f"WITH {RECORDS} SELECT DISTINCT sha256(substr(text, 1, 4000)) AS text_hash FROM rec WHERE length(trim(text)) > 0 AND substr(sha256(substr(text, 1, 4000)), 1, 1) >= '8'")
def dedup_uncached(spark, folder):
    model = store.Model("finbert", len)
    wanted = store.requests(_records(spark, folder, "text").select("text"), model)
    return store.uncached(wanted, _score_table(spark, folder), "finbert").select("text_hash")


@query("SELECT id, t AS ticker, CASE WHEN t IS NOT NULL AND length(t) % 2 = 0 THEN 0.25 ELSE score END AS sentiment FROM (SELECT id, CAST(score AS DOUBLE) AS score, unnest(tickers) AS t FROM mention)")
def targeted_choice(spark, folder):
    """The score for the ticker where there is one (symbols of even length here), else the score of the text."""
    rows = table(spark, folder, "mention").select("id", F.col("score").cast("double").alias("score"), "tickers")
    even = F.array_distinct(F.filter("tickers", lambda t: t.isNotNull() & (F.length(t) % 2 == 0)))
    targeted = F.map_from_arrays(even, F.transform(even, lambda t: F.lit(0.25)))
    each = rows.select("id", "score", targeted.alias("targeted"), F.explode("tickers").alias("ticker"))
    return each.select("id", "ticker", sentiment.chosen_sentiment(F.col("targeted"), F.coalesce("ticker", F.lit("")), F.col("score")).alias("sentiment"))


# ---------------------------------------------------------------- description
_VARS = ("log_return", "volatility_ja_gk", "volatility_pk", "simple_return")


def _stack(template: str) -> str:
    return " UNION ALL ".join(template.replace("@", v) for v in _VARS)


@query(
    f"WITH {BATTERY} "
    + _stack(
        f"SELECT '@' AS variable, count(@) AS count, {r('mean', 'avg(@)', 6)}, {r('std', 'stddev_samp(@)', 6)}, {r('min', 'min(@)', 6)}, {r('p25', 'quantile_cont(@, 0.25)', 6)}, {r('p50', 'quantile_cont(@, 0.5)', 6)}, {r('p75', 'quantile_cont(@, 0.75)', 6)}, {r('max', 'max(@)', 6)}, count(*) - count(@) AS n_missing, {r('pct_missing', '100.0 * (count(*) - count(@)) / count(*)', 6)} FROM ret"
    )
)
def summary_stats(spark, folder):
    return rounded(describe.summary(_returns(spark, folder), _VARS), 6)


_SKEW = "(avg(@ ** 3) - 3 * avg(@) * avg(@ ** 2) + 2 * avg(@) ** 3) / var_pop(@) ** 1.5"


@query(f"WITH {BATTERY} " + _stack(f"SELECT '@' AS variable, count(@) AS obs, {r('mean', 'avg(@)', 6)}, {r('median', 'median(@)', 6)}, {r('sd', 'stddev_samp(@)', 6)}, {r('skew', _SKEW, 4)}, {r('kurt', 'kurtosis_pop(@)', 4)} FROM ret"))
def skew_kurt(spark, folder):
    out = describe.moments(_returns(spark, folder), _VARS).select("variable", "obs", "mean", "median", "sd", "skew", "kurt")
    return rounded(out, 6).withColumns({c: F.round(c, 4) for c in ("skew", "kurt")})


_PAIRS = [(a, b) for i, a in enumerate(_VARS) for b in _VARS[i:]]


@query(f"WITH {BATTERY} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r('corr', f'corr({a}, {b})', 6)} FROM ret" for a, b in _PAIRS))
def corr_matrix(spark, folder):
    return rounded(describe.correlations(_returns(spark, folder), _VARS), 6)


@query(f"WITH {BATTERY} SELECT ticker, count(log_return) AS n, {r('mean', 'avg(log_return)', 6)}, {r('sd', 'stddev_samp(log_return)', 6)}, {r('var', 'var_samp(log_return)', 6)}, {r('min', 'min(log_return)', 6)}, {r('max', 'max(log_return)', 6)} FROM ret GROUP BY 1")
def per_stock_summary(spark, folder):
    return rounded(describe.per_stock(_returns(spark, folder), "log_return"), 6)


_SLOPES = "slopes AS (SELECT 'volatility' AS exog, ticker, regr_slope(abs(log_return), volatility_ja_gk) AS delta, stddev_samp(log_return) AS se FROM ret GROUP BY ticker)"
_QUANTILES = ", ".join(r(f"q{q:02d}", f"quantile_cont(delta, {q / 100})", 6) for q in (5, 25, 50, 75, 95))


@query(
    f"""WITH {BATTERY}, {_SLOPES} SELECT exog, count(delta) AS n, {r('mg', 'avg(delta)', 6)}, {r('sd', 'stddev_samp(delta)', 6)}, {r('min', 'min(delta)', 6)}, {_QUANTILES}, {r('max', 'max(delta)', 6)},
    {r('frac_positive', 'avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END)', 6)}, {r('frac_significant', 'avg(CASE WHEN se > 0 THEN CASE WHEN abs(delta / se) > 1.96 THEN 1.0 ELSE 0 END END)', 6)},
    {r('se_mg', 'stddev_samp(delta) / sqrt(count(delta))', 6)}, {r('t_mg', 'avg(delta) / (stddev_samp(delta) / sqrt(count(delta)))', 6)} FROM slopes WHERE delta IS NOT NULL GROUP BY 1"""
)
def mean_group(spark, folder):
    slopes = _returns(spark, folder).groupBy("ticker").agg(F.regr_slope(F.abs("log_return"), F.col("volatility_ja_gk")).alias("delta"), F.stddev_samp("log_return").alias("se"))
    return rounded(describe.mean_group(slopes.withColumn("exog", F.lit("volatility"))), 6)


@query("SELECT DISTINCT volatility_ja_gk, adj_close, open FROM stock_returns")
def exact_copies(spark, folder):
    """Rows that are the same in three columns with nulls, once."""
    names = ["volatility_ja_gk", "adj_close", "open"]
    return once(table(spark, folder, "stock_returns"), [], names, names)


@query(f"WITH {BATTERY} SELECT ticker, date, {r('annualised', 'volatility_ja_gk * sqrt(252.0)')} FROM ret")
def annualised_volatility(spark, folder):
    return rounded(_returns(spark, folder).select("ticker", "date", px.annualised(F.col("volatility_ja_gk")).alias("annualised")))


@query(
    """WITH t AS (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM t"""
)
def duration_text(spark, folder):
    return table(spark, folder, "events").select("event_id", sc.duration_text(F.floor(F.abs("value") * 100)).alias("duration"))


@query(
    """WITH a AS (SELECT DISTINCT upper(trim(ticker)) AS s FROM universe WHERE ticker IS NOT NULL), b AS (SELECT DISTINCT upper(trim(t)) AS s FROM (SELECT unnest(tickers) AS t FROM mention) WHERE t IS NOT NULL)
    SELECT (SELECT count(*) FROM a) AS in_first, (SELECT count(*) FROM b) AS in_second, (SELECT count(*) FROM a WHERE s IN (SELECT s FROM b)) AS in_both, (SELECT count(*) FROM (SELECT s FROM a UNION SELECT s FROM b)) AS in_either"""
)
def listing_spot_check(spark, folder):
    known = table(spark, folder, "universe").select(F.upper(F.trim("ticker")).alias("symbol"))
    named = table(spark, folder, "mention").select(F.explode("tickers").alias("symbol")).select(F.upper(F.trim("symbol")).alias("symbol"))
    return universe.spot_check(known, named)


@query("SELECT ticker, CAST(count(*) AS BIGINT) AS n FROM stock_returns WHERE ticker IN (SELECT DISTINCT ticker FROM stock_returns WHERE ticker IS NOT NULL ORDER BY 1 LIMIT 5) GROUP BY 1")
def first_tickers(spark, folder):
    """--limit: the first five tickers in alphabetical order."""
    return universe.first_tickers(table(spark, folder, "stock_returns"), 5).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


def _parity(texts, targets):
    """A made scorer: the label follows from the length of the text."""
    return [(("bullish", "bearish", "neutral")[len(t) % 3], (len(t) % 100) / 100) for t in texts]


@query(
    f"""WITH {RECORDS}, x AS (SELECT DISTINCT substr(text, 1, 4000) AS t FROM rec WHERE length(trim(text)) > 0)
    SELECT sha256(t) AS text_hash, CASE length(t) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END * (length(t) % 100) / 100.0 + 0.0 AS score FROM x"""
)
def scored_texts(spark, folder):
    """Every distinct text of the records scored once by an injected scorer, in batches."""
    empty = spark.createDataFrame([], store.SCHEMA)
    got = store.updated(empty, _records(spark, folder, "text").select("text"), [store.Model("parity", _parity)])
    return got.select("text_hash", (F.col("score") + F.lit(0.0)).alias("score"))


# ---------------------------------------------------------------- estimators
_GARCH_SQL = f"""WITH RECURSIVE {BATTERY},
e AS (SELECT ticker, log_return AS y, row_number() OVER (PARTITION BY ticker ORDER BY date) AS t FROM ret WHERE log_return IS NOT NULL),
v AS (SELECT ticker, var_samp(y) AS v0 FROM e GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT e.ticker, t, y, v0 AS s, v0 FROM e JOIN v USING (ticker) WHERE t = 1
  UNION ALL SELECT e.ticker, e.t, e.y, greatest(0.05 * v0 + 0.05 * f.y * f.y + 0.9 * f.s, 1e-12), v0 FROM f JOIN e ON e.ticker = f.ticker AND e.t = f.t + 1)"""


def _filtered(spark, folder) -> DataFrame:
    rows = _returns(spark, folder).where("log_return IS NOT NULL")
    packed = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "log_return"))).alias("s"), F.var_samp("log_return").alias("v0")).where(F.size("s") >= 2)
    y = F.transform("s", lambda x: x["log_return"])
    fold = garch.filter_column(y, F.col("v0") * 0.05, F.lit(0.05), F.lit(0.9), F.col("v0"))
    return packed.select("ticker", y.alias("y"), fold.alias("sigma2"))


@query(f"{_GARCH_SQL} SELECT ticker, CAST(t AS INTEGER) AS t, {r('sigma2', 's', 12)} FROM f")
def garch_filter(spark, folder):
    out = _filtered(spark, folder).select("ticker", F.posexplode("sigma2").alias("t", "sigma2"))
    return rounded(out.withColumn("t", F.col("t") + 1), 12)


@query(f"{_GARCH_SQL} SELECT ticker, {r('loglik', 'sum(-0.5 * (ln(s) + y * y / s))', 6)} FROM f WHERE t > 1 GROUP BY 1")
def garch_loglik(spark, folder):
    each = _filtered(spark, folder).select("ticker", F.posexplode(F.arrays_zip("y", "sigma2")).alias("t", "z")).where("t > 0")
    term = -0.5 * (F.log("z.sigma2") + F.col("z.y") * F.col("z.y") / F.col("z.sigma2"))
    return rounded(each.groupBy("ticker").agg(F.sum(term).alias("loglik")), 6)


def _fit(spark, folder, entity: bool, time: bool, cluster: str = "entity") -> DataFrame:
    spec = ols.RegressionSpec("one", "volatility_sqret", ["volatility_ja_gk"], entity, time, cluster)
    result = ols.run_panel_regression(_returns(spark, folder), spec)
    row = (result.n_obs, float(result.coefficients["volatility_ja_gk"]), float(result.std_errors["volatility_ja_gk"]))
    return rounded(spark.createDataFrame([row], "n_obs bigint, beta double, se double"), 6)


def _ols_sql(demeaned: str, constant: bool) -> str:
    k = 2 if constant else 1
    return f"""WITH {BATTERY}, u0 AS (SELECT ticker, date, volatility_sqret AS y, volatility_ja_gk AS x FROM ret WHERE volatility_sqret IS NOT NULL AND volatility_ja_gk IS NOT NULL),
    d AS (SELECT ticker, {demeaned} FROM u0), b AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, count(*) AS n, count(DISTINCT ticker) AS g FROM d),
    m AS (SELECT sum(s * s) AS meat FROM (SELECT ticker, sum(x * (y - beta * x)) AS s FROM d, b GROUP BY 1))
    SELECT n AS n_obs, {r('beta', digits=6)}, {r('se', f'sqrt(meat) / xx * sqrt(g / (g - 1.0) * (n - 1.0) / (n - {k}.0))', 6)} FROM b, m"""


@query(_ols_sql("y - avg(y) OVER () AS y, x - avg(x) OVER () AS x", True))
def ols_pooled(spark, folder):
    return _fit(spark, folder, False, False)


@query(_ols_sql("y - avg(y) OVER (PARTITION BY ticker) AS y, x - avg(x) OVER (PARTITION BY ticker) AS x", False))
def ols_entity_fe(spark, folder):
    return _fit(spark, folder, True, False)


@query()
def ols_twoway_fe(spark, folder):
    """Entity and day effects of an unbalanced panel have no closed form in SQL; tested against dummies with numpy."""
    return _fit(spark, folder, True, True)


@query()
def regression_summary(spark, folder):
    """The three baseline regressions over the panel, one row per term."""
    saved = full_panel(spark, folder).persist()
    rows = [x for h in (1, 3, 5) for x in ols.run_panel_regression(saved, ols.baseline_spec(h)).rows()]
    saved.unpersist()
    out = spark.createDataFrame(rows, "spec string, term string, coefficient double, std_error double, t double, p double")
    return out.withColumns({"mark": sc.stars(F.col("p")), "term": sc.without_lag(F.col("term"))})


_SPEC = garch.GarchSpec(exog=(), min_obs=30)
_SPEC_X = garch.GarchSpec(exog=("attention_std", "sentiment_pos_std", "sentiment_neg_std"), min_obs=30)


def _garch_table(spark, fit: garch.PanelGarchResult) -> DataFrame:
    out = fit.stock_table().assign(rounds=fit.rounds, converged=fit.converged)
    kinds = {"ticker": "string", "n_obs": "bigint", "rounds": "bigint", "converged": "boolean"}
    return spark.createDataFrame(out.values.tolist(), ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in out.columns))


@query()
def garch_panel_fit(spark, folder):
    """Panel GARCH with a pooled alpha: every stock's parameters, likelihood and persistence, and whether the fit converged."""
    return _garch_table(spark, garch.fit_panel(garch.stock_arrays(_returns(spark, folder), _SPEC), _SPEC))


@query()
def garch_x_panel_fit(spark, folder):
    """The same with attention and sentiment of the panel in the variance (GARCH-X), their effects by stock."""
    return _garch_table(spark, garch.fit_panel(garch.stock_arrays(full_panel(spark, folder), _SPEC_X), _SPEC_X))


@query()
def lr_test_table(spark, folder):
    """Likelihood-ratio tests of one alpha, one beta and one effect of each exogenous column for all stocks."""
    tests = garch.pooling_tests(garch.stock_arrays(full_panel(spark, folder), _SPEC_X), _SPEC_X)
    rows = [(t.parameter, t.restricted, t.unrestricted, t.lr, t.df, t.p_value, t.converged) for t in tests]
    return spark.createDataFrame(rows, "parameter string, restricted double, unrestricted double, lr double, df bigint, p_value double, converged boolean")
