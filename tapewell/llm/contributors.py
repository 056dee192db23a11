"""Capping records per dominant contributor, without ever sorting one contributor in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most contributors whose cuts are broadcast.
BROADCAST = 100_000


def contributor_key(author: str | Column, unlimited: Sequence[str] = ("[deleted]",)) -> Column:
    """Trimmed, lower-case name; null for null and for names that stand for many people."""
    name = F.lower(F.trim(F.col(author) if isinstance(author, str) else author))
    return F.when(~name.isin(*unlimited), name)


def exponential_key(quality: Column, identity: Sequence[Column], seed: int = 0) -> Column:
    """Key of quality-weighted reservoir sampling: -ln(u) / weight; the smallest keys stay.

    This is the exponential form of weighted sampling without replacement. ``u`` comes from a hash of the
    identity, so a lost task draws the same number again. Weight: max(1, ln(1 + max(0, quality))); null counts as 1.
    """
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in identity])), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))
    weight = F.greatest(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), F.coalesce(quality.cast("double"), F.lit(0.0)))))
    return -F.log(u) / weight


def beginning(name: str, records: DataFrame, more: int = 3) -> Column:
    """The first letters of column ``name``, as many as all its values share and ``more``: a level that tells values apart even
    where they all begin alike."""
    both = records.agg(F.min(name).alias("a"), F.max(name).alias("b"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("a"), F.length("b"))))
    shared = F.size(F.filter(places, lambda i: F.substr("a", F.lit(1), i) == F.substr("b", F.lit(1), i)))
    return F.substr(F.col(name), F.lit(1), both.select(F.coalesce(shared, F.lit(0)).alias("n")).scalar() + more)


def mark_capped(records: DataFrame, contributor: str, cap: Column | int, levels: Sequence[Sequence[Column]], exact: Sequence[Column], most: int | None = None) -> DataFrame:
    """``records`` with a boolean ``kept``: the first ``cap`` records of each contributor stay.

    The order is that of ``exact``, ascending by ``levels`` first: each level is a list of columns that goes on where
    the level before ends (a score, then rounded time, then time, then the beginning of an id). Records with a null
    contributor all stay.

    A plain ranking would sort all records of a contributor in one task. Here the place of the cut is found by
    counting: records are counted by contributor and first level (combined before the shuffle), a running sum over
    the distinct values tells which of them the cap falls into, that group alone is counted by the next level, and
    so on; only the group at the cut of the last level is ranked. All other records are kept or dropped by
    comparing keys. Contributors within the cap leave after the first count. So a task sees the distinct values of
    one level of one contributor, never its records. ``most`` is a proven bound on the number of contributors beyond
    the cap (a cap of a share 1/s of all records is passed by fewer than s): up to ``BROADCAST`` their cuts, one short
    row each, are broadcast and records aren't shuffled at all; without it the planner joins by size, and AQE splits
    hot contributors. Ties that ``exact`` can't break are broken arbitrarily; give it
    a unique last column. An empty table gives an empty table. A column named ``kept`` is replaced.
    """
    records = records.drop("kept")
    who, number = F.col(contributor), range(len(levels))
    marked = records.withColumns({f"__l{i}": F.struct(*[c.alias(f"c{k}") for k, c in enumerate(level)]) for i, level in enumerate(levels)})
    narrow = marked.where(who.isNotNull()).select(who.alias("__who"), *[f"__l{i}" for i in number])
    by = Window.partitionBy("__who")
    small = F.broadcast if most is not None and most <= BROADCAST else lambda df: df
    cuts = None
    for i in number:
        earlier = [f"__cut{j}" for j in range(i)]
        if cuts is None:
            inside = narrow.withColumn("__cap", cap if isinstance(cap, Column) else F.lit(cap))
        else:
            known = cuts.withColumnRenamed("__who", "__w")
            same = F.col("__who") == F.col("__w")
            for j in range(i):
                same = same & (F.col(f"__l{j}") == F.col(f"__cut{j}"))
            inside = narrow.join(small(known), same)
        counted = inside.groupBy("__who", *earlier, f"__l{i}", "__cap").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(by.orderBy(f"__l{i}").rowsBetween(Window.unboundedPreceding, 0))
        cut = (F.col("__all") > F.col("__cap")) & (F.col("__upto") > F.col("__cap")) & (F.col("__upto") - F.col("n") <= F.col("__cap"))
        cuts = (
            counted.withColumns({"__upto": upto, "__all": F.sum("n").over(by)})
            .where(cut)
            .select("__who", *earlier, F.col(f"__l{i}").alias(f"__cut{i}"), (F.col("__cap") - (F.col("__upto") - F.col("n"))).alias("__cap"))
        )
    placed = marked.join(small(cuts), who == F.col("__who"), "left")
    decided = F.lit(None).cast("boolean")
    for i in reversed(number):
        decided = F.when(F.col(f"__l{i}") < F.col(f"__cut{i}"), True).when(F.col(f"__l{i}") > F.col(f"__cut{i}"), False).otherwise(decided)
    placed = placed.withColumn("kept", F.when(F.col("__who").isNull(), True).otherwise(decided))
    ranked = placed.where("kept IS NULL").withColumn("kept", F.row_number().over(by.orderBy(*exact)) <= F.col("__cap"))
    return placed.where("kept IS NOT NULL").unionByName(ranked).select(*records.columns, "kept")
