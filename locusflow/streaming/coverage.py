"""Depth by position over arriving observation files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.operators.pileup import BASES


def running_depth(stream: DataFrame) -> DataFrame:
    """Depth and base counts by contig and position of all that has arrived; for complete or update mode."""
    return stream.groupBy("contig", "pos").agg(F.count("*").alias("depth"), *[F.count_if(F.col("base") == b).alias(f"depth_{b}") for b in BASES])


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; windows close once the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
