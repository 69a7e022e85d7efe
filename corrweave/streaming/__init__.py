"""Snapshots of a graph from a stream of dated edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_cells(stream: DataFrame, width: str = "30 days", late: str = "1 day") -> DataFrame:
    """(src, dst, start, w): edges of a stream or table (src, dst, ts) counted by tumbling windows; on a stream late rows go after the watermark."""
    seen = stream.withWatermark("ts", late) if stream.isStreaming else stream
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    grouped = seen.filter("src <> dst").groupBy(*ends, F.window("ts", width).alias("window")).agg(F.count(F.lit(1)).alias("w"))
    return grouped.select("src", "dst", F.col("window.start").alias("start"), "w")
