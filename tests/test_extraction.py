from __future__ import annotations

import pytest

from tapewell.functions import scalars as sc
from tapewell.operators import extraction, universe
from tapewell.operators.extraction import Extractor
from pyspark.sql import functions as F


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("x")).first()["x"]


def test_url_strip(spark):
    assert one(spark, "see HTTPS://x.com/a?GME=1) and www.AMC.com ok", extraction.without_urls) == "see  ) and   ok"


def test_cashtags_and_bare_capitals(spark):
    assert one(spark, "a $AAPL b$XX $gme, $TOOLONGG $A1", extraction.cashtags) == ["$AAPL", "$gme"]
    assert one(spark, "YOLO GME_X AAPL TSLA1 ABCDEF ZZZ", extraction.bare_caps) == ["YOLO", "GME", "AAPL", "ZZZ"]


def test_bots(spark):
    rows = [("FooBot", None, None), ("alice", "moderator", None), ("bob", None, True), ("x_qv", None, False), ("AutoModerator", None, None), ("carol", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "author string, d string, s boolean")
    assert [r[0] for r in df.select(extraction.is_bot(F.col("author"), F.col("d"), F.col("s"))).collect()] == [True] * 5 + [False] * 2


def test_phases_and_order():
    find = Extractor(["AAPL", "GME", "BRK"], [("APPLE INC", "AAPL"), ("GAME STOP", "GME")], ["YOLO"])
    assert find("buy $gme and GME then $GME") == [("GME", "ticker_dollar", "$GME")]
    assert find("Apple Inc is great, xApple Inc is not") == [("AAPL", "name", "Apple Inc")]
    assert find("YOLO on berkshire") == [("BRK.A", "alias", "berkshire"), ("BRK.B", "alias", "berkshire")]
    assert find("Apple Inc AAPL", True) == [("AAPL", "ticker", "AAPL")]
    assert find(None) == [] and find("") == []
    assert find("word " * 50_000 + "AAPL") == [("AAPL", "ticker", "AAPL")]


def test_table_agrees_with_the_single_text(spark):
    find = Extractor(["AAPL", "GME", "TSLA"], [("TESLA MOTORS", "TSLA")])
    texts = ["$AAPL GME", "Tesla Motors and $GME", "nothing", None, ""]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {r["id"]: (r["tickers"], r["match_types"]) for r in extraction.mention_records(df, find).collect()}
    assert got == {str(i): ([h[0] for h in find(t)], {h[0]: h[1] for h in find(t)}) for i, t in enumerate(texts) if find(t)}
    symbols = spark.createDataFrame([("AAPL",), ("GME",), ("TSLA",)], "ticker string")
    plain = extraction.as_record(extraction.token_mentions(df, symbols)).collect()
    assert {r["id"]: r["tickers"] for r in plain} == {"0": ["AAPL", "GME"], "1": ["GME"]}


def test_prepared_posts(spark):
    shape = "id string, name string, subreddit string, author string, created_utc string, title string, selftext string, score long, num_comments long, distinguished string, stickied boolean"
    rows = [("1", None, None, None, "1700000000.9", "T", "[removed]", None, 3, None, None), ("2", "t3_2", "s", "XBot", "1", "x", "y", 1, 1, None, None), ("3", None, "s", "a", "oops", " ", None, 1, None, None, None)]
    got = extraction.prepared_posts(spark.createDataFrame(rows, shape), "submission", 1).collect()
    assert [(r["id"], r["subreddit"], r["author"], r["created_utc"], r["text"], r["score"]) for r in got] == [("t3_1", "unknown", "[deleted]", 1700000000, "T", 0)]
    comments = spark.createDataFrame([("1", None, "s", "a", "5", "[deleted]", 1, None, None), ("2", None, "s", "a", "5", "hi", 1, None, None)], "id string, name string, subreddit string, author string, created_utc string, body string, score long, distinguished string, stickied boolean")
    assert [r["id"] for r in extraction.prepared_posts(comments, "comment").collect()] == ["t1_2"]


@pytest.mark.parametrize("raw,want", [("$brk.b,", "BRK-B"), ("^gspc", "^GSPC"), (None, ""), (" (aapl) ", "AAPL"), ("a.b.c", "A.B.C")])
def test_symbols_for_quotes(spark, raw, want):
    assert one(spark, raw, sc.quote_symbol) == want


def test_names(spark):
    def variants(name):
        return universe.with_variants(spark.createDataFrame([(name,)], "raw_name string")).first()["name"]

    assert variants("Block, Inc. - Class A Common Stock") == "Block, Inc"
    assert variants("The Walt Disney Company (DE)").startswith("Walt Disney")
    assert variants("Ford Motor Company") == "Ford Motor|Ford Motor Company"
    assert variants(None) == ""
    df = spark.createDataFrame([("A", "Amazon.com, Inc."), ("B", None)], "ticker string, raw_name string")
    assert {r["ticker"]: r["name"] for r in universe.with_variants(df).collect()} == {"A": "Amazon|Amazon.com|Amazon.com, Inc", "B": ""}


def test_labels_and_dates(spark):
    df = spark.createDataFrame([("Bearish", 0.8), ("LABEL_1", 0.9), ("LABEL_3", 0.7), (None, 0.5)], "l string, c double")
    assert [r[0] for r in df.select(sc.label_score(F.col("l"), F.col("c"))).collect()] == [-0.8, 0.0, 0.7, 0.0]
    days = spark.createDataFrame([(0,), (-5,), (86399,), (86400,)], "t long").select(sc.epoch_date(F.col("t")).cast("string")).collect()
    assert [r[0] for r in days] == ["1970-01-01", "1970-01-01", "1970-01-01", "1970-01-02"]


def test_a_missing_list_of_stop_words_is_refused(spark, tmp_path):
    (tmp_path / "none.txt").write_text("\n \n")
    for path in (None, str(tmp_path / "none.txt")):
        with pytest.raises(ValueError):
            extraction.stop_words(spark, path)
    (tmp_path / "some.txt").write_text("THE\n AND \n")
    assert extraction.stop_words(spark, str(tmp_path / "some.txt")) == ["THE", "AND"]


def test_durations(spark):
    df = spark.createDataFrame([(0,), (59,), (60,), (3725,), (-1,), (None,)], "s long")
    assert [r[0] for r in df.select(sc.duration_text(F.col("s"))).collect()] == ["0s", "59s", "1m 00s", "1h 02m 05s", "?", "?"]


def test_first_tickers_and_spot_checks(spark):
    df = spark.createDataFrame([("B", 1), ("A", 2), (None, 3), ("C", 4), ("A", 5)], "ticker string, x int")
    assert sorted(r["x"] for r in universe.first_tickers(df, 2).collect()) == [1, 2, 5]
    assert universe.first_tickers(df.where("false"), 2).count() == 0
    other = spark.createDataFrame([("A",), ("Z",), ("Z",)], "ticker string")
    assert tuple(universe.spot_check(df, other, "ticker").first()) == (3, 2, 1, 4)
