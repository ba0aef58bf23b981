"""Support counts kept up to date over a stream of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def support_counts(evidence: DataFrame) -> DataFrame:
    """(profile, left, support) of a streaming table (profile, article, left), each article counted once; for the complete output mode."""
    seen = evidence.dropDuplicates(["profile", "article", "left"])
    return seen.groupBy("profile", "left").agg(F.count("*").alias("support"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, key: str) -> DataFrame:
    """(window, key, n) of events, those later than the watermark dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def into_table(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Runs over all that is there, into a table in memory."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
