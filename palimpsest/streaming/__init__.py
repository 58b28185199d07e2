"""An extension: the operation log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kinds_by_window(log: DataFrame, ts: str = "ts", kind: str = "kind", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of operations by kind and event-time window; works on batches and streams."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
