"""Filling containers of fixed capacity with whole items: bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs, on average; and the open bins it keeps for each kind of container.
ITEMS_PER_TASK, OPEN_BINS = 50_000, 1024


class BestFit:
    """Bins of one capacity, open ones keyed by their free space in a bitset.

    Bit f of the integer ``free`` is set while some open bin has f units left. The best bin for an item of
    size s is the lowest set bit from s on, found by one shift. When too many bins are open, the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.limit, self.free, self.count, self.next = capacity, open_bins, 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def put(self, size: int) -> int:
        """The number of the bin that takes an item of at most the capacity."""
        rest = self.free >> size
        if rest:
            space = size + (rest & -rest).bit_length() - 1
            stack = self.bins[space]
            number = stack.pop()
            if not stack:
                self.free ^= 1 << space
            self.count -= 1
        else:
            number, space = self.next, self.capacity
            self.next += 1
        left = space - size
        if left or not size:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.count += 1
            if self.count > self.limit:
                fullest = (self.free & -self.free).bit_length() - 1
                stack = self.bins[fullest]
                stack.pop()
                if not stack:
                    self.free ^= 1 << fullest
                self.count -= 1
        return number


def split(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of an item: one part unless it exceeds the capacity."""
    if size <= capacity:
        return [(0, size)]
    return [(at, min(capacity, size - at)) for at in range(0, size, capacity)]


def pack(items: DataFrame, key: str, size: str, containers: Sequence[tuple[str, int]], number: int | None = None, items_per_task: int = ITEMS_PER_TASK, open_bins: int = OPEN_BINS) -> DataFrame:
    """(container, key, part, start, length, bin): the bin of every item for every kind of container.

    An item stays whole (part 0) unless it exceeds the capacity; then it is cut into full parts and a rest.
    ``bin`` is unique within a kind of container. Null and negative sizes count as 0; items of size 0 get a
    bin as well and use no space. Equal keys are separate items. ``containers`` is a short list on the driver.

    Items are spread by a hash of their key over as many tasks as there are ``items_per_task``; each task packs
    its share for all capacities in one pass and holds ``open_bins`` bins per capacity, so memory doesn't grow
    with the data. The waste is at most that of the bins still open in a task at its end. The order within a
    task is fixed by the hash and the key: a repeated task gives the same bins. ``number`` is the number of
    items, where it is known more cheaply than by counting ``items``. An empty table gives no rows.
    """
    kinds = [(str(name), int(capacity)) for name, capacity in containers]
    if any(capacity < 1 for _, capacity in kinds):
        raise ValueError("a container needs a capacity of at least 1")
    tasks = max(1, -(-(items.count() if number is None else number) // items_per_task))
    slot = F.pmod(F.xxhash64(F.lit(7), key), F.lit(tasks)).cast("int")
    spread = items.select(F.col(key), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"), slot.alias("slot"))
    spread = spread.repartitionById(tasks, F.col("slot")).sortWithinPartitions("slot", F.xxhash64(F.lit(11), key), key, "size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits: dict[tuple[int, str], BestFit] = {}
        for frame in frames:
            rows: list[tuple] = []
            keys = frame.iloc[:, 0].tolist()
            for k, size, slot in zip(keys, frame["size"].tolist(), frame["slot"].tolist()):
                for name, capacity in kinds:
                    fit = fits.get((slot, name))
                    if fit is None:
                        fit = fits[slot, name] = BestFit(capacity, open_bins)
                    for part, (start, length) in enumerate(split(size, capacity)):
                        rows.append((name, k, part, start, length, (slot << 40) + fit.put(length)))
            yield pd.DataFrame(rows, columns=["container", "key", "part", "start", "length", "bin"])

    kind = items.schema[key].dataType.simpleString()
    return spread.mapInPandas(run, f"container string, key {kind}, part int, start bigint, length bigint, bin bigint").withColumnRenamed("key", key)


def fill(packed: DataFrame, containers: Sequence[tuple[str, int]]) -> DataFrame:
    """(container, capacity, items, bins, used, share): how well each kind of container is filled."""
    capacity = F.create_map(*[x for name, c in containers for x in (F.lit(str(name)), F.lit(int(c)))])
    return (
        packed.groupBy("container", "bin")
        .agg(F.count(F.lit(1)).alias("parts"), F.sum("length").alias("used"))
        .groupBy("container")
        .agg(F.sum("parts").alias("parts"), F.count(F.lit(1)).alias("bins"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
        .withColumn("capacity", capacity[F.col("container")])
        .withColumn("share", F.col("used") / (F.col("bins") * F.col("capacity")))
    )
