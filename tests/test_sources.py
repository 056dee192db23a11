from __future__ import annotations

import json
import pickle

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewell.scoring import store
from tapewell.sinks import files as sinks
from tapewell.sources import files as sources
from tapewell.state import State


def lines():
    good = [{"id": str(i), "author": "a", "created_utc": i if i % 2 else str(i), "title": f"t{i}", "selftext": "x", "score": i, "num_comments": 1, "stickied": False, "other": [1]} for i in range(20)]
    text = "\n".join(json.dumps(g) for g in good[:10]) + "\n\n{broken\n" + "\n".join(json.dumps(g) for g in good[10:])
    return text.encode()


@pytest.mark.parametrize("window", [20, 31])
def test_zstd_lines_in_tasks(spark, tmp_path, window):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(3, window_log=window, enable_ldm=window > 27)
    path = tmp_path / "big_submissions.zst"
    path.write_bytes(zstandard.ZstdCompressor(compression_params=params).compress(lines()))
    got = sources.long_window_lines(spark, [str(path)], sources.SUBMISSION)
    assert sorted(int(r["id"]) for r in got.collect()) == list(range(20))
    assert sources.discover(spark, str(tmp_path)) == ["big"]


def test_spark_reads_zstd_lines(spark, tmp_path):
    import zstandard

    (tmp_path / "d_submissions.zst").write_bytes(zstandard.ZstdCompressor().compress(lines()))
    got = sources.datasets(sources.json_lines(spark, str(tmp_path / "d_submissions.zst"), sources.SUBMISSION, None)).collect()
    assert len(got) == 20 and {(r["dataset"], r["part"]) for r in got} == {("d", "submissions")}
    assert {r["created_utc"] for r in got} == {str(i) for i in range(20)}


def test_json_lines_round_trip(spark, tmp_path):
    import zstandard

    df = spark.range(50).selectExpr("cast(id AS string) AS id", "array(id) AS v")
    files = sinks.json_lines(df, str(tmp_path / "out"))
    back = [json.loads(x) for f in files for x in zstandard.ZstdDecompressor().stream_reader(open(f, "rb")).read().splitlines()]
    assert sorted(int(b["id"]) for b in back) == list(range(50))


def test_listing_and_optional_and_csv(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Symbol|Security Name|ETF\nA|Agilent|N\nB|Barnes|Y\n")
    assert sources.listing(spark, str(tmp_path / "l.txt")).count() == 2
    assert sources.optional_csv(spark, str(tmp_path / "none.csv"), "a int") is None
    daily = spark.sql("SELECT DATE'2024-01-01' AS date, 'A' AS ticker, 'm' AS model, 0.1234567D AS sentiment_avg, 0D AS sentiment_disp, 3L AS mention_count, 1.23456D AS weight_sum, 1L AS submission_count, 2L AS comment_count")
    sinks.daily_sentiment_csv(daily, str(tmp_path / "daily"))
    r = sources.daily_sentiment_file(spark, str(tmp_path / "daily"), "m", "2023-01-01", "2024-12-31").first()
    assert (r["sentiment_avg"], r["weight_sum"]) == (0.123457, 1.235)


def test_prices_hook_keeps_errors(spark):
    def fetch(ticker):
        if ticker == "BAD":
            raise RuntimeError("no data")
        return pd.DataFrame({"date": [pd.Timestamp("2024-01-02").date(), pd.Timestamp("2023-01-02").date()], "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "adj_close": 1.0, "volume": 1.0})

    prices, errors = sources.prices_from(spark, ["A", "BAD"], fetch, "2024-01-01", "2024-12-31")
    assert [r["ticker"] for r in prices.collect()] == ["A"]
    assert [(r["ticker"], r["error"]) for r in errors.collect()] == [("BAD", "no data")]


def test_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x").write_text("1")
    (tmp_path / "out").write_text("2")
    args = (spark, "stage", {"in": str(tmp_path / "in")}, str(tmp_path / "out"), {"a": 1})
    state = State(str(tmp_path / "state.json"))
    assert not state.valid(*args)
    state.finish(*args)
    again = State(str(tmp_path / "state.json"))
    assert again.valid(*args) and not again.valid(*args[:4], {"a": 2})
    (tmp_path / "in/y").write_text("more")
    assert not again.valid(*args)
    again.start("stage")
    assert not again.valid(*args)


def by_length(texts, targets):
    return [("positive" if len(t) % 2 else "negative", 0.5 if g is None else 0.25) for t, g in zip(texts, targets)]


def limited(texts, targets):
    if len(texts) > 2:
        raise MemoryError
    return by_length(texts, targets)


def test_scores_are_made_once_and_attached(spark):
    plain, topic = store.Model("plain", by_length), store.Model("topic", limited, targeted=True, batch=8)
    assert pickle.loads(pickle.dumps(plain)).key == "plain"
    records = spark.createDataFrame([("1", "abc", {"A": "$A"}), ("2", "abcd", {"A": "apple", "B": "$B"}), ("3", "abc", {"A": "$A"}), ("4", "  ", {"A": "A"}), ("5", None, {"A": "A"})], "id string, text string, matched_on map<string,string>")
    empty = spark.createDataFrame([], store.SCHEMA)
    table = store.updated(empty, records, [plain, topic]).persist()
    assert table.where("model = 'plain'").count() == 2 and table.where("model = 'topic'").count() == 3
    assert store.updated(table, records, [plain, topic]).count() == 0
    got = {r["id"]: r["scores"] for r in store.attach(records, table, [("plain", False), ("topic", True)]).collect()}
    assert got["1"]["plain"]["score"] == 0.5 and got["2"]["plain"]["score"] == -0.5 and got["4"]["plain"]["score"] is None
    assert got["2"]["topic"]["targeted"] == {"A": -0.25, "B": -0.25} and got["1"]["topic"]["score"] is None
    long = store.long_scores(store.attach(records.withColumn("tickers", F.map_keys("matched_on")), table, [("plain", False), ("topic", True)]))
    assert {(r["ticker"], r["model"], r["sentiment"]) for r in long.where("id = '2'").collect()} == {("A", "plain", -0.5), ("B", "plain", -0.5), ("A", "topic", -0.25), ("B", "topic", -0.25)}


def test_tables_for_papers():
    from tapewell.estimators.ols import RegressionResult, RegressionSpec

    spec = RegressionSpec("one", "y", ["x_lag1"])
    r = RegressionResult(spec, {"x_lag1": 1.5}, {"x_lag1": 0.5}, {"x_lag1": 3.0}, {"x_lag1": 0.004}, 10, 2, 5, 0.5, 0.4)
    text = sinks.document(sinks.regression_latex([r]), sinks.correlation_latex([("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 1.0)], ["a", "b"]))
    assert "1.5000**" in text and r"\begin{document}" in text and "0.50" in text
    assert sinks.summary_rows([r])[0]["x_lag1_p"] == 0.004
    assert sinks.average_fit([r]) == {"r2": 0.5, "r2_within": 0.4, "n_obs": 10.0}


def test_command_line_from_raw_posts_to_daily_sentiment(spark, tmp_path):
    import zstandard

    from tapewell import cli
    from tapewell.functions.scalars import text_key

    raw = tmp_path / "raw"
    raw.mkdir()
    posts = [{"id": str(i), "author": "a", "created_utc": 86400 * (i + 1), "title": "buy $AAPL", "selftext": f"x{i}", "score": i} for i in range(3)]
    comments = [{"id": "9", "author": "b", "created_utc": "86400", "body": "Apple Computer or GME", "score": 2}, {"id": "8", "author": "CatBot", "created_utc": 1, "body": "AAPL"}]
    for part, rows in (("submissions", posts), ("comments", comments)):
        (raw / f"d_{part}.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(map(json.dumps, rows)).encode()))
    (tmp_path / "u.csv").write_text("ticker,name,raw_name,is_etf\nAAPL,Apple Computer,Apple Computer Inc,N\nGME,Game Shop,Game Shop Inc,\nSPY,Index,Index,Y\n")
    (tmp_path / "stop.txt").write_text("GME\n")
    for more in ([], ["--long-windows"]):
        cli.main(["mentions", str(raw), str(tmp_path / "u.csv"), str(tmp_path / "m"), "--stop-words", str(tmp_path / "stop.txt"), *more], spark)
        found = spark.read.parquet(str(tmp_path / "m"))
        assert sorted((r["id"], tuple(r["tickers"])) for r in found.collect()) == [("t1_9", ("AAPL",)), ("t3_0", ("AAPL",)), ("t3_1", ("AAPL",)), ("t3_2", ("AAPL",))]
    found.select(text_key(F.col("text")).alias("text_hash"), F.lit("m").alias("model"), F.lit("").alias("target"), F.lit("positive").alias("label"), F.lit(0.5).alias("confidence"), F.lit(0.5).alias("score")).write.parquet(str(tmp_path / "s"))
    cli.main(["sentiment", str(tmp_path / "m"), str(tmp_path / "s"), str(tmp_path / "daily"), "--models", "m"], spark)
    assert sorted(r["mention_count"] for r in sources.daily_sentiment_file(spark, str(tmp_path / "daily")).collect()) == [1, 1, 2]
    cli.main(["stats", str(tmp_path / "m"), str(tmp_path / "stats")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "stats/ticker_stats")).first()["total_mentions"] == "4"


def test_command_line(spark, folder, tmp_path):
    from tapewell import cli

    cli.main(["returns", f"{folder}/stock_returns.parquet", str(tmp_path / "returns")], spark)
    assert spark.read.parquet(str(tmp_path / "returns")).count() > 0
