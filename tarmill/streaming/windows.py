"""Streaming forms of batch operators: an extension, as the batch pipelines have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Rows and their value sums by tumbling window and group; rows later than the watermark are dropped by a stream."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    x = events.withWatermark(time, late) if events.isStreaming else events
    g = x.groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), group, "n", "total")


def sink(df: DataFrame, path: str, state: str) -> StreamingQuery:
    """Append finished windows to Parquet, exactly once, and stop when all that is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
