"""The streaming extension as a batch query, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselkg.session import table
from tesselkg.streaming.run_metrics import windowed_usage


def stream_usage(spark, d):
    out = windowed_usage(table(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("mean", 4).alias("mean"))


QUERIES = {"stream_usage": stream_usage}
SQL = {"stream_usage": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2"}
