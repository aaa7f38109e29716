"""Token-usage stream: sums and averages per operation and event-time window.

Late rows older than the watermark are dropped; windows are emitted once,
when the watermark passes their end (append mode). The batch form of the
same aggregation (:func:`windowed`) is what the registered query and its
oracle compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _aggs():
    return [F.count(F.lit(1)).cast("bigint").alias("requests"),
            F.sum("tokens_in").cast("bigint").alias("tokens_in"),
            F.sum("tokens_out").cast("bigint").alias("tokens_out"),
            F.sum("tokens_total").cast("bigint").alias("tokens_total"),
            F.round(F.avg("tokens_total"), 6).alias("avg_tokens_total")]


def windowed(metrics: DataFrame, window: str = "1 hour") -> DataFrame:
    """Tumbling-window totals per operation (batch or streaming input)."""
    w = F.window("timestamp", window)
    return (metrics.groupBy(w.alias("w"), "operation").agg(*_aggs())
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "operation",
                    "requests", "tokens_in", "tokens_out", "tokens_total", "avg_tokens_total"))


def stream(metrics_stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Streaming form with a watermark on ``timestamp`` (a watermark needs
    TIMESTAMP, so wall-clock NTZ values are read as session-time-zone time)."""
    ts = metrics_stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return windowed(ts.withWatermark("timestamp", watermark), window)


def start_to_table(metrics_stream: DataFrame, path: str, checkpoint: str, window: str = "1 hour",
                   watermark: str = "10 minutes", available_now: bool = False) -> StreamingQuery:
    w = (stream(metrics_stream, window, watermark).writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
