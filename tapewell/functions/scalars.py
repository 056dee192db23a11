"""Scalar expressions of the mention and sentiment pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that count as positive and as negative.
POSITIVE = ("positive", "pos", "label_2", "label_3", "bullish", "bull")
NEGATIVE = ("negative", "neg", "label_0", "bearish", "bear")

#: Lengths at which texts are stored and scored.
STORED_TEXT, SCORED_TEXT = 10_000, 4_000


def approval_weight(score: Column) -> Column:
    """max(1, ln(1 + max(0, score)))."""
    return F.greatest(F.lit(1.0), F.log1p(F.greatest(F.lit(0), F.coalesce(score, F.lit(0))).cast("double")))


def coerce_epoch(raw: Column) -> Column:
    """Whole seconds from a number or a numeric string; anything else is 0."""
    return F.coalesce(raw.cast("string").try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def epoch_date(seconds: Column) -> Column:
    """UTC date of epoch seconds, 1970-01-01 for values up to 0; no time zone is involved."""
    day = F.floor(seconds / 86400).cast("int")
    return F.when(seconds <= 0, F.lit("1970-01-01").cast("date")).otherwise(F.date_from_unix_date(day))


def label_score(label: Column, confidence: Column) -> Column:
    """Signed score: +confidence, -confidence or 0 by the label."""
    name = F.lower(label)
    return F.when(name.isin(*POSITIVE), confidence).when(name.isin(*NEGATIVE), -confidence).otherwise(F.lit(0.0))


def text_key(text: Column, target: Column | None = None, limit: int = SCORED_TEXT) -> Column:
    """SHA-256 of the text as it is scored, with the target where there is one."""
    body = F.substring(text, 1, limit)
    return F.sha2(body if target is None else F.concat(body, F.lit("|||"), target), 256)


def python_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def model_key(name: Column) -> Column:
    """Last path part in lower case; everything but letters and digits becomes one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(name, "/"), -1)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stars(p: Column, weakest: bool = True) -> Column:
    """Significance marks at 0.001, 0.01, 0.05 and, if ``weakest``, 0.1."""
    marks = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
    return (marks.when(p < 0.1, ".") if weakest else marks).otherwise("")


def duration_text(seconds: Column) -> Column:
    """Whole seconds as hours, minutes and seconds ("1h 02m 05s", "2m 05s", "5s"); null and negative ones give "?"."""
    s = F.floor(seconds).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    long = F.when(hours > 0, F.format_string("%dh %02dm %02ds", hours, minutes, rest)).when(minutes > 0, F.format_string("%dm %02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))
    return F.when(s >= 0, long).otherwise("?")


def without_lag(name: Column) -> Column:
    return F.regexp_replace(name, r"_lag\d+$", "")


def quote_symbol(raw: Column) -> Column:
    """Symbol as quote services write it: upper case, no leading $, no stray punctuation, class after a dash.

    NULL gives ''. Leading ^ of an index stays.
    """
    t = F.regexp_replace(F.upper(python_strip(F.coalesce(raw, F.lit("")))), r"^\$", "")
    t = F.regexp_replace(t, r"""^[ \t\n\r"'.,;:()\[\]{}<>]+|[ \t\n\r"'.,;:()\[\]{}<>]+$""", "")
    t = F.regexp_replace(t, r"^([^.]*)\.([^.])$", "$1-$2")
    return F.regexp_replace(t, r"[^A-Z0-9^\-.]", "")
