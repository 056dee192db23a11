"""Readers: compressed JSON lines, listings, tables, data sets by file name, price and benchmark hooks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = ("id", "name", "subreddit", "author", "created_utc", "distinguished")
SUBMISSION = T.StructType([T.StructField(c, T.StringType()) for c in (*_TEXT, "title", "selftext")] + [T.StructField("score", T.LongType()), T.StructField("num_comments", T.LongType()), T.StructField("stickied", T.BooleanType())])
COMMENT = T.StructType([T.StructField(c, T.StringType()) for c in (*_TEXT, "body")] + [T.StructField("score", T.LongType()), T.StructField("stickied", T.BooleanType())])
PRICES = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double"
DAILY_SENTIMENT = "date date, ticker string, model string, sentiment_avg double, sentiment_disp double, mention_count bigint, weight_sum double, submission_count bigint, comment_count bigint"


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """Compressed JSON lines with a fixed schema; malformed and blank lines leave. A compressed file is one split:
    give ``partitions`` to spread the rows right after the scan."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path if isinstance(path, str) else list(path))
    return rows.repartition(partitions) if partitions else rows


def long_window_lines(spark: SparkSession, paths: Sequence[str], schema: T.StructType, partitions: int | None = None, chunk: int = 1 << 16) -> DataFrame:
    """As ``json_lines`` for zstd files with windows up to 2^31 bytes, which the JVM codec refuses.

    Paths are spread over the tasks and streamed there; a file is never held in memory. Bad lines are skipped, the
    last line may lack its newline.
    """
    fields = [(f.name, f.dataType) for f in schema.fields]

    def value(x, kind):
        if x is None:
            return None
        if isinstance(kind, T.StringType):
            return x if isinstance(x, str) else json.dumps(x)
        if isinstance(kind, T.BooleanType):
            return x if isinstance(x, bool) else None
        return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for frame in frames:
            for path in frame["path"]:
                rows: list[tuple] = []
                with open(path, "rb") as file, zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(file, read_across_frames=True) as stream:
                    rest = b""
                    while True:
                        block = stream.read(chunk)
                        *lines, rest = (rest + block).split(b"\n") if block else (rest, b"")
                        for line in lines:
                            try:
                                item = json.loads(line)
                            except ValueError:
                                continue
                            if isinstance(item, dict):
                                rows.append(tuple(value(item.get(n), k) for n, k in fields))
                        if len(rows) >= 10_000 or not block:
                            yield pd.DataFrame(rows, columns=[n for n, _ in fields], dtype=object)
                            rows = []
                        if not block:
                            break

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    rows = names.mapInPandas(run, schema)
    return rows.repartition(partitions) if partitions else rows


def datasets(rows: DataFrame) -> DataFrame:
    """``rows`` with ``dataset`` and ``part`` from file names like ``name_submissions.zst``."""
    return rows.withColumns(
        {"dataset": F.regexp_extract(F.input_file_name(), r"([^/]+)_(submissions|comments)\.[^/]*$", 1), "part": F.regexp_extract(F.input_file_name(), r"([^/]+)_(submissions|comments)\.[^/]*$", 2)}
    )


def discover(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("_submissions.zst", "_comments.zst")) -> list[str]:
    """Distinct data-set names of a folder on any file system that Hadoop reads, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted({n[: -len(x)] for n in names for x in suffixes if n.endswith(x)})


def listing(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """A delimited listing with a header; malformed lines leave."""
    return spark.read.option("sep", separator).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def universe_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("ticker string, name string, raw_name string, is_etf string").csv(path)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*[c for c in columns if c in rows.columns]) if columns else rows


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table that may be absent."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.option("header", True).schema(schema).csv(path) if fs.exists(where) else None


def daily_sentiment_file(spark: SparkSession, path: str, model: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = spark.read.option("header", True).schema(DAILY_SENTIMENT).csv(path)
    if model:
        rows = rows.where(F.col("model") == model)
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    return rows.where(F.col("date") <= F.lit(end).cast("date")) if end else rows


def prices_from(spark: SparkSession, tickers: Sequence[str], fetch: Callable[[str], pd.DataFrame], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(prices, errors) by a given ``fetch(ticker) -> frame``, run in the tasks, one ticker each.

    No network client is bundled; ``fetch`` is the connector. Rows outside the range leave; a ticker that fails
    comes back in ``errors`` with its message.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ticker in frame["ticker"]:
                try:
                    got = fetch(ticker).assign(ticker=ticker, error=None)
                    yield got.reindex(columns=["date", "ticker", "open", "high", "low", "close", "adj_close", "volume", "error"])
                except Exception as problem:  # noqa: BLE001  the connector's own errors are data here
                    yield pd.DataFrame([(None, ticker, *[None] * 6, str(problem))], columns=["date", "ticker", "open", "high", "low", "close", "adj_close", "volume", "error"])

    names = spark.createDataFrame([(t,) for t in tickers], "ticker string").repartition(max(1, min(len(tickers), 200)))
    got = names.mapInPandas(run, PRICES + ", error string").persist()
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return got.where(F.col("error").isNull() & inside).drop("error"), got.where(F.col("error").isNotNull()).select("ticker", "error")
