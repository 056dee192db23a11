from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tapewell.llm.contributors import contributor_key, exponential_key, mark_capped

SHAPE = "id string, author string, score long, at long"


def ranked(df, cap, most=None):
    return mark_capped(
        df.withColumn("who", contributor_key("author")),
        "who",
        cap,
        levels=[[F.col("score").isNull(), F.bitwise_not("score")], [F.col("at").isNull(), F.shiftright("at", 3)], [F.col("at")], [F.substring("id", 1, 2)]],
        exact=[F.col("score").desc_nulls_last(), F.col("at").asc_nulls_last(), F.col("id")],
        most=most,
    )


def brute(rows, cap):
    kept, seen = set(), {}
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[3] is None, r[3] or 0, r[0]))
    for id_, author, _, _ in order:
        who = None if author is None else author.strip(" ").lower()
        if who in (None, "[deleted]"):
            kept.add(id_)
            continue
        seen[who] = seen.get(who, 0) + 1
        if seen[who] <= cap:
            kept.add(id_)
    return kept


@pytest.mark.parametrize("seed,cap", [(0, 0), (1, 1), (2, 5), (3, 40), (4, 1000)])
def test_against_brute_force(spark, seed, cap):
    r = random.Random(seed)
    rows = [(f"{i:04x}", r.choice(["Hot ", "hot", "HOT", "b", None, "[Deleted]", ""]), r.choice([None, 1, 1, 2, 5, -3]), r.choice([None, 0, 0, 7, 8, 100])) for i in range(400)]
    for most in (None, 10):
        got = ranked(spark.createDataFrame(rows, SHAPE), cap, most)
        assert got.count() == len(rows)
        assert {x["id"] for x in got.where("kept").collect()} == brute(rows, cap)


def test_ties_in_everything_but_the_id(spark):
    rows = [(f"{i:04d}", "hot", 1, 1) for i in range(300)]
    assert {x["id"] for x in ranked(spark.createDataFrame(rows, SHAPE), 7).where("kept").collect()} == {f"{i:04d}" for i in range(7)}


def test_clashing_names(spark):
    df = spark.createDataFrame([("1", "a", 1, 1), ("2", "a", 2, 1)], SHAPE).selectExpr("*", "'x' AS kept", "1 AS n")
    assert {r["id"] for r in ranked(df, 1).where("kept").collect()} == {"2"}


def test_empty_table(spark):
    assert ranked(spark.createDataFrame([], SHAPE), 3).count() == 0


def test_reservoir_prefers_quality_and_repeats(spark):
    rows = [(str(i), "hot", 100_000 if i < 100 else 0, 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SHAPE).withColumn("key", exponential_key(F.col("score"), [F.col("id")]))

    def kept(df):
        marked = mark_capped(df, "author", 100, [[F.floor(F.log2("key") * 64)], [F.col("key")]], [F.col("key"), F.col("id")])
        return {int(x["id"]) for x in marked.where("kept").collect()}

    once = kept(df)
    assert once == kept(df.repartition(5)) and len(once) == 100
    # weights are ln(100001) against 1: about 36 of the 100 places go to the 100 good records
    assert 25 <= sum(i < 100 for i in once) <= 55
    best = sorted(df.select("id", "key").collect(), key=lambda r: r["key"])[:100]
    assert once == {int(r["id"]) for r in best}
