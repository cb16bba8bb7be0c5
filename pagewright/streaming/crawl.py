"""Crawl results as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import crawl


def live_rollup(results: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A query in memory that holds the roll-up by site of all results so far."""
    rows = results.withColumn("breaks", F.col("breaks").cast("bigint"))
    return crawl.rollup(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def live_counts(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Results by window of arrival and verdict; late ones count up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "verdict").agg(F.count("*").alias("n"))
