"""Daily sentiment over a stream of scored mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewell.operators import sentiment


def daily_states(scored: DataFrame, time: str = "ts", late: str = "2 days", keys: Sequence[str] = ("ticker", "model")) -> DataFrame:
    """Additive sums per day and key of a stream; a day closes once the watermark has passed it.

    The state of a day is six numbers per key. Mentions later than ``late`` are left out by the watermark; give a long one
    where late deliveries matter, or fold them in from a batch with ``sentiment.merged``.
    """
    windowed = scored.withWatermark(time, late).withColumn("date", F.window(time, "1 day"))
    return sentiment.sums(windowed, ("date", *keys)).withColumn("date", F.to_date("date.start"))


def deduplicated(deliveries: DataFrame, key: str = "id", time: str = "ingested_at", late: str = "31 days") -> DataFrame:
    """Exact re-deliveries leave while the watermark remembers their key."""
    return deliveries.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def write_states(states: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append closed days to parquet, exactly once: the file sink's log and the checkpoint decide what counts."""
    writer = states.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
