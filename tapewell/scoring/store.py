"""Sentiment scores as a table keyed by text hash, model and target; injected scorers; attaching scores to mentions.

A scorer is any callable ``scorer(texts, targets) -> [(label, confidence), ...]``; no model is bundled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.functions.scalars import SCORED_TEXT, label_score, text_key

SCHEMA = "text_hash string, model string, target string, label string, confidence double, score double"


@dataclass(frozen=True)
class Model:
    key: str
    scorer: Callable[[Sequence[str], Sequence[str | None]], Sequence[tuple[str, float]]]
    targeted: bool = False
    batch: int = 32


def requests(records: DataFrame, model: Model) -> DataFrame:
    """(text_hash, target, text) to score, each once: blank texts leave, targets are the matched strings."""
    text = F.substring("text", 1, SCORED_TEXT)
    filled = records.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    if model.targeted:
        filled = filled.select("text", F.explode(F.array_distinct(F.map_values("matched_on"))).alias("target"))
    else:
        filled = filled.select("text", F.lit("").alias("target"))
    keyed = filled.select(text_key(F.col("text")).alias("text_hash"), "target", F.substring("text", 1, SCORED_TEXT).alias("text"))
    return keyed.dropDuplicates(["text_hash", "target"])


def uncached(wanted: DataFrame, store: DataFrame, model: str) -> DataFrame:
    return wanted.join(store.where(F.col("model") == model).select("text_hash", "target"), ["text_hash", "target"], "left_anti")


def score(wanted: DataFrame, model: Model) -> DataFrame:
    """Scores of ``wanted`` in the store's columns. A batch that runs out of memory is cut in half and tried again."""
    blob = pickle.dumps(model.scorer)
    targeted, size = model.targeted, model.batch

    def attempt(scorer, texts, targets):
        try:
            return list(scorer(texts, targets))
        except MemoryError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return attempt(scorer, texts[:half], targets[:half]) + attempt(scorer, texts[half:], targets[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = pickle.loads(blob)
        for frame in frames:
            got = []
            for i in range(0, len(frame), size):
                part = frame.iloc[i : i + size]
                got += attempt(scorer, part["text"].tolist(), part["target"].tolist() if targeted else [None] * len(part))
            yield pd.DataFrame({"text_hash": frame["text_hash"], "target": frame["target"], "label": [g[0] for g in got], "confidence": [float(g[1]) for g in got]})

    raw = wanted.select("text_hash", "target", "text").mapInPandas(run, "text_hash string, target string, label string, confidence double")
    return raw.select("text_hash", F.lit(model.key).alias("model"), "target", "label", "confidence", label_score(F.col("label"), F.col("confidence")).alias("score"))


def updated(store: DataFrame, records: DataFrame, models: Sequence[Model]) -> DataFrame:
    """New rows for the store: for each model what ``records`` need and the store lacks."""
    parts = [score(uncached(requests(records, m), store, m.key), m) for m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach(records: DataFrame, store: DataFrame, models: Sequence[tuple[str, bool]]) -> DataFrame:
    """``records`` with ``scores``: map model -> struct(score, label, targeted map ticker -> score), by one join on the text hash.

    ``models``: (key, targeted). Plain models have no targeted scores; targeted models no plain score.
    """
    per_text = store.where(F.col("model").isin([k for k, _ in models])).groupBy("text_hash").agg(F.collect_list(F.struct("model", "target", "score", "label")).alias("__s"))
    joined = records.withColumn("text_hash", text_key(F.col("text"))).join(per_text, "text_hash", "left")

    def one(key: str, targeted: bool):
        mine = F.filter(F.coalesce("__s", F.array().cast(per_text.schema["__s"].dataType)), lambda s: s["model"] == key)
        if not targeted:
            plain = F.get(F.filter(mine, lambda s: s["target"] == ""), 0)
            return F.struct(plain["score"].alias("score"), plain["label"].alias("label"), F.lit(None).cast("map<string,double>").alias("targeted"))
        by_word = F.map_from_entries(F.transform(mine, lambda s: F.struct(s["target"], s["score"])))
        scored = F.map_filter(F.transform_values("matched_on", lambda t, w: F.try_element_at(by_word, w)), lambda t, v: v.isNotNull())
        return F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("label"), scored.alias("targeted"))

    return joined.withColumn("scores", F.create_map(*[x for k, t in models for x in (F.lit(k), one(k, t))])).drop("__s", "text_hash")


def long_scores(scored: DataFrame) -> DataFrame:
    """(id, date parts untouched, ticker, model, sentiment): exploded tickers and models; the targeted score where there is one."""
    each = scored.select("*", F.explode("tickers").alias("ticker")).select("*", F.explode("scores").alias("model", "__v"))
    return each.withColumn("sentiment", F.coalesce(F.try_element_at("__v.targeted", F.col("ticker")), F.col("__v.score"))).drop("__v")
