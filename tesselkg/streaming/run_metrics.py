"""Run metrics over a stream of events: windowed counts and means with a watermark, as an extension of the batch windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, *, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and mean value per window and kind; works on streams and tables alike. Rows later than ``late`` are left out of a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "mean")
