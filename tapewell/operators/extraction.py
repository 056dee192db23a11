"""Ticker mentions in text: cashtags, bare capitals, company names, aliases."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.functions import scalars as sc

# Patterns and names of the pipeline.
URL = r"(?i)https?://[^\s\)\]>]+|www\.[^\s\)\]>]+"
CASHTAG = r"(?<![A-Za-z0-9])\$([A-Za-z]{1,5})(?![A-Za-z0-9])"
BARE_CAPS = r"(?<![A-Za-z0-9])([A-Z]{3,5})(?![A-Za-z0-9])"
BOT_NAMES = ("automoderator", "auto-moderator", "mod_team", "qualityvote", "superstonk_qv")
BOT_SUFFIXES = ("bot", "_bot", "-bot", "_qv")
ALIASES = {
    "GME": ("GAMESTONK", "GAME STONK"),
    "META": ("FACEBOOK", "FB"),
    "GOOGL": ("GOOGLE", "ALPHABET"),
    "XYZ": ("SQUARE", "SQ"),
    "BABA": ("ALIBABA", "ALI BABA"),
    "KO": ("COCA-COLA", "COCA COLA", "COKE"),
    "BRK.A": ("BERKSHIRE",),
    "BRK.B": ("BERKSHIRE",),
    "SNAP": ("SNAPCHAT",),
    "JNJ": ("J&J",),
}
#: Kinds of matches in order of priority.
KINDS = ("ticker_dollar", "ticker", "name", "alias")


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def is_bot(author: Column, distinguished: Column, stickied: Column) -> Column:
    """Moderators, stickied posts, known bots and bot-like names; never NULL."""
    name = F.lower(F.coalesce(author, F.lit("")))
    like = name.endswith(BOT_SUFFIXES[0])
    for suffix in BOT_SUFFIXES[1:]:
        like = like | name.endswith(suffix)
    return distinguished.eqNullSafe("moderator") | stickied.eqNullSafe(True) | name.isin(*BOT_NAMES) | like


def cashtags(text: Column) -> Column:
    """Array of cashtags with the dollar sign, in order."""
    return F.regexp_extract_all(text, F.lit(CASHTAG), 0)


def bare_caps(text: Column) -> Column:
    """Array of stand-alone words of three to five capitals, in order."""
    return F.regexp_extract_all(text, F.lit(BARE_CAPS), 1)


def token_mentions(posts: DataFrame, symbols: DataFrame, stop_words: DataFrame | None = None, text: str = "text", key: str = "id") -> DataFrame:
    """(key, ticker, phase, position, matched_on) of cashtags and bare capitals that are symbols.

    Symbol and stop-word tables are joined, broadcast by the planner where they are small; texts are never shuffled.
    Cashtags ignore the stop words. Of several cashtags of a symbol the last gives ``matched_on``, the first the position.
    """
    clean = posts.select(F.col(key), without_urls(F.col(text)).alias("__t"))
    dollars = clean.select(key, F.posexplode(cashtags(F.col("__t"))).alias("position", "matched_on"))
    dollars = dollars.select(key, F.upper(F.substring("matched_on", 2, 5)).alias("ticker"), F.lit(0).alias("phase"), "position", "matched_on")
    bare = clean.select(key, F.posexplode(bare_caps(F.col("__t"))).alias("position", "matched_on"))
    bare = bare.select(key, F.col("matched_on").alias("ticker"), F.lit(1).alias("phase"), "position", "matched_on")
    if stop_words is not None:
        bare = bare.join(stop_words.select(F.upper(F.col(stop_words.columns[0])).alias("ticker")).distinct(), "ticker", "left_anti")
    known = symbols.select(F.col(symbols.columns[0]).alias("ticker")).distinct()
    hits = dollars.unionByName(bare.select(*dollars.columns)).join(known, "ticker", "left_semi")
    best = F.min(F.struct("phase", "position")).alias("b")
    last = F.max_by("matched_on", F.when(F.col("phase") == 0, F.col("position")).otherwise(-1)).alias("matched_on")
    return hits.groupBy(key, "ticker").agg(best, last).select(key, "ticker", "b.phase", "b.position", "matched_on")


def as_record(hits: DataFrame, key: str = "id") -> DataFrame:
    """(key, tickers, match_types, matched_on): one row per text, tickers in order of phase and position."""
    kinds = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k))])
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("phase", "position", "ticker", "matched_on"))).alias("h"))
    tickers = F.transform("h", lambda x: x["ticker"])
    return listed.select(
        key,
        tickers.alias("tickers"),
        F.map_from_arrays(tickers, F.transform("h", lambda x: kinds[x["phase"]])).alias("match_types"),
        F.map_from_arrays(tickers, F.transform("h", lambda x: x["matched_on"])).alias("matched_on"),
    )


class Extractor:
    """All four phases for one text. The universe travels with the tasks: it is checked to stay small."""

    def __init__(self, symbols: Sequence[str], names: Sequence[tuple[str, str]], stop_words: Sequence[str] = (), aliases=None) -> None:
        self.symbols, self.stop = frozenset(symbols), frozenset(w.upper() for w in stop_words)
        self.names = tuple(names)
        self.aliases = [(t, re.compile(rf"\b{re.escape(a)}\b", re.IGNORECASE)) for t, words in (ALIASES if aliases is None else aliases).items() for a in words]
        self._automaton = None
        self._url, self._cash, self._caps = re.compile(URL), re.compile(CASHTAG), re.compile(BARE_CAPS)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _name_hits(self, upper: str) -> Iterator[tuple[int, int, str]]:
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for name, ticker in self.names:
                if not self._automaton.exists(name):
                    self._automaton.add_word(name, (len(name), ticker))
            self._automaton.make_automaton()
        if len(self._automaton):
            for last, (length, ticker) in self._automaton.iter(upper):
                yield last - length + 1, last + 1, ticker

    def __call__(self, text: str | None, symbols_only: bool = False) -> list[tuple[str, str, str]]:
        """(ticker, kind, matched text) in order; the first phase that finds a ticker names its kind."""
        found: dict[str, tuple[str, str]] = {}
        clean = self._url.sub(" ", text or "")
        for m in self._cash.finditer(clean):
            if m[1].upper() in self.symbols:
                found[m[1].upper()] = (KINDS[0], m[0])
        for m in self._caps.finditer(clean):
            if m[1] not in found and m[1] not in self.stop and m[1] in self.symbols:
                found[m[1]] = (KINDS[1], m[1])
        if not symbols_only:
            upper = clean.upper()
            edge = lambda i: not (0 <= i < len(upper)) or not (upper[i].isalnum() or upper[i] == "_")
            for start, end, ticker in self._name_hits(upper):
                if ticker not in found and len(ticker) > 2 and edge(start - 1) and edge(end):
                    found[ticker] = (KINDS[2], clean[start:end])
            for ticker, pattern in self.aliases:
                if ticker not in found and ticker not in self.stop and (m := pattern.search(clean)):
                    found[ticker] = (KINDS[3], m[0])
        return [(t, k, w) for t, (k, w) in found.items()]


#: Largest universe that is sent to the tasks.
MOST_NAMES = 500_000


def stop_words(spark, path: str | None) -> list[str]:
    """Words in capitals that are no symbols, one a line. Without such a list ordinary words in capitals would count as mentions, so
    a missing or empty one is refused; an empty list has to be passed on purpose."""
    words = [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()] if path else []
    if not words:
        raise ValueError("a list of stop words is needed: ordinary words in capitals would count as symbols")
    return words


def extractor(universe: DataFrame, names: DataFrame, stop_words: Sequence[str] = (), aliases=None) -> Extractor:
    """Reads symbols and name variants on the driver, behind a check of their number."""
    symbols = [r[0] for r in universe.select("ticker").distinct().limit(MOST_NAMES + 1).collect()]
    pairs = [(r[0], r[1]) for r in names.select("name", "ticker").limit(MOST_NAMES + 1).collect()]
    if max(len(symbols), len(pairs)) > MOST_NAMES:
        raise ValueError(f"a universe of more than {MOST_NAMES} entries isn't sent to tasks")
    return Extractor(symbols, sorted(pairs), stop_words, aliases)


@lru_cache(maxsize=4)
def _loaded(blob: bytes) -> Extractor:
    return pickle.loads(blob)


def mention_records(posts: DataFrame, find: Extractor, text: str = "text", symbols_only: bool = False) -> DataFrame:
    """``posts`` with tickers, match_types and matched_on; posts without a ticker leave. One Arrow pass, no shuffle."""
    blob = pickle.dumps(find)

    @F.pandas_udf("array<struct<ticker:string,kind:string,word:string>>")
    def run(texts: pd.Series) -> pd.Series:
        own = _loaded(blob)
        return pd.Series([[dict(zip(("ticker", "kind", "word"), x)) for x in own(t, symbols_only)] for t in texts])

    hit = posts.withColumn("__h", run(F.col(text))).where(F.size("__h") > 0)
    tickers = F.transform("__h", lambda x: x["ticker"])
    return hit.withColumns(
        {
            "tickers": tickers,
            "match_types": F.map_from_arrays(tickers, F.transform("__h", lambda x: x["kind"])),
            "matched_on": F.map_from_arrays(tickers, F.transform("__h", lambda x: x["word"])),
        }
    ).drop("__h")


def prepared_posts(raw: DataFrame, kind: str, least: int = 0) -> DataFrame:
    """Raw submissions or comments as posts: bots out, deleted bodies handled, defaults filled, whole text kept.

    ``kind`` is 'submission' or 'comment'. Absent and null fields get the same default. Stored text is cut by
    ``stored`` at the sink, not here: matching sees all of it.
    """
    gone = ("[deleted]", "[removed]")
    kept = raw.where(~is_bot(F.col("author"), F.col("distinguished"), F.col("stickied")))
    if kind == "submission":
        body = F.when(F.col("selftext").isin(*gone), "").otherwise(F.coalesce("selftext", F.lit("")))
        title = F.coalesce("title", F.lit(""))
        text = sc.python_strip(F.concat(title, F.lit(" "), body))
        comments, prefix = F.col("num_comments"), "t3_"
    else:
        kept = kept.where(~F.coalesce("body", F.lit("")).isin(*gone))
        title, comments, prefix = F.lit(None).cast("string"), F.lit(None).cast("bigint"), "t1_"
        text = sc.python_strip(F.coalesce("body", F.lit("")))
    return kept.select(
        F.coalesce("name", F.concat(F.lit(prefix), F.coalesce("id", F.lit("")))).alias("id"),
        F.coalesce("subreddit", F.lit("unknown")).alias("subreddit"),
        F.coalesce("author", F.lit("[deleted]")).alias("author"),
        sc.coerce_epoch(F.col("created_utc")).alias("created_utc"),
        F.lit(kind).alias("type"),
        text.alias("text"),
        title.alias("title"),
        F.coalesce("score", F.lit(0).cast("bigint")).alias("score"),
        comments.alias("num_comments"),
    ).where(F.length("text") >= least)


def stored(records: DataFrame) -> DataFrame:
    """Mention records as they are stored, with the text cut to the stored length."""
    return records.withColumn("text", F.substring("text", 1, sc.STORED_TEXT))
