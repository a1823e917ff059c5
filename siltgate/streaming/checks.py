"""The row-local checks on streams, and per-window counts of findings. An addition; the batch checks define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PolicyConfig
from ..operators.messages import check_messages


def stream_findings(messages: DataFrame, cfg: PolicyConfig | None = None) -> DataFrame:
    """Findings of a stream of messages(path, text, content): no state, the same functions as in batch."""
    return check_messages(messages, cfg or PolicyConfig())


def windowed_counts(messages: DataFrame, cfg: PolicyConfig | None = None, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Per event-time window and check the number of findings; rows later than ``late`` are dropped.

    The time rides in the path column through the checks, which only carry it along.
    """
    tagged = messages.withColumn("path", F.to_json(F.struct(F.col("path"), F.col(time).alias("t"))))
    found = check_messages(tagged, cfg or PolicyConfig()).withColumn("t", F.from_json("path", "path string, t timestamp")["t"])
    return found.withWatermark("t", late).groupBy(F.window("t", width), "check").agg(F.count("*").alias("n"))


def deduplicated(messages: DataFrame, key: str = "path", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
