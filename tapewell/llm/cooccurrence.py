"""Items that appear together: pair counts, lift and conviction by basket collapsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most items that may be frequent enough for a pair share (``pair_counts``); more raise an error.
MOST_FREQUENT = 100_000
#: First items of a basket whose pairs one row stands for; baskets of more are spread over the tasks in such pieces.
PIECE = 64


def collapse(records: DataFrame, items: str) -> DataFrame:
    """(basket, weight): each distinct item set once, with the number of records that have it.

    ``items`` is an array column of distinct items in order; null counts as the empty set. Equal sets are
    combined before the shuffle, so a set that a third of all records have costs one row per task. The
    empty basket stays: its records count for the total.
    """
    return records.groupBy(F.coalesce(F.col(items), F.array().cast(records.schema[items].dataType)).alias("basket")).agg(F.count(F.lit(1)).alias("weight"))


def pair_counts(baskets: DataFrame, item_share: float = 0.0, pair_share: float = 0.0) -> DataFrame:
    """item_a, item_b, n_ab, n_a, n_b, n_total, lift, conviction of every pair that occurs (item_a < item_b).

    Pairs are enumerated once per distinct basket and weighted with the basket's record count. The pairs of
    a basket stream out of two nested generators, so a long basket is never held as a list of pairs.
    With ``pair_share`` only pairs in at least that share of all records come out; the items of such a
    pair have at least that share themselves, so rarer items leave the baskets first, by comparing with the array of
    frequent items, and the shortened baskets collapse again. There are at most (mean basket size / share) such items; more than
    ``MOST_FREQUENT`` raise an error. The pairs of a basket longer than ``PIECE`` are made in pieces that are spread over the tasks.
    An empty table gives no rows. Conviction is that of a implying b, null
    where b always follows a.
    """
    total = baskets.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"))
    singles = baskets.select(F.explode("basket").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n"))
    least = max(item_share, pair_share)
    if least > 0:
        singles = singles.where(F.col("n") >= F.lit(least) * total.scalar())
        frequent = singles.agg(F.array_sort(F.collect_list("item")).alias("items")).select(
            F.when(F.size("items") <= MOST_FREQUENT, F.col("items")).otherwise(F.raise_error(F.lit(f"more than {MOST_FREQUENT} frequent items; give a larger share")).cast(baskets.schema["basket"].dataType)).alias("items")
        )
        short = baskets.where(F.size("basket") > 1).select(F.array_intersect("basket", frequent.scalar()).alias("basket"), "weight")
        usable = collapse_again(short.where(F.size("basket") > 1))
    else:
        usable = baskets
    usable = usable.where(F.size("basket") > 1)
    pieces = usable.where(F.size("basket") > PIECE).select("basket", "weight", F.explode(F.sequence(F.lit(0), F.size("basket") - 2, F.lit(PIECE))).alias("at"))
    rows = usable.where(F.size("basket") <= PIECE).withColumn("at", F.lit(0)).unionByName(pieces.repartition(F.xxhash64("basket", "at")))
    firsts = rows.select("basket", "weight", "at", F.posexplode(F.slice("basket", F.col("at") + 1, F.lit(PIECE))).alias("i", "item_a"))
    pairs = firsts.select("weight", "item_a", F.explode(F.slice("basket", F.col("at") + F.col("i") + 2, F.size("basket"))).alias("item_b"))
    counted = pairs.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab")).withColumn("n_total", total.scalar())
    if pair_share > 0:
        counted = counted.where(F.col("n_ab") >= F.lit(pair_share) * F.col("n_total"))
    a = singles.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = singles.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    n, d = F.col("n_total").cast("double"), lambda c: F.col(c).cast("double")
    missing = 1 - d("n_ab") / d("n_a")
    return (
        counted.join(a, "item_a")
        .join(b, "item_b")
        .select(
            "item_a",
            "item_b",
            "n_ab",
            "n_a",
            "n_b",
            "n_total",
            (d("n_ab") * n / (d("n_a") * d("n_b"))).alias("lift"),
            F.when(missing > 0, (1 - d("n_b") / n) / missing).alias("conviction"),
        )
    )


def collapse_again(baskets: DataFrame) -> DataFrame:
    """Add up the weights of baskets that have become equal."""
    return baskets.groupBy("basket").agg(F.sum("weight").alias("weight"))
