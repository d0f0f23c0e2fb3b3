"""Streaming extensions: the crowd's aggregates over unbounded telemetry.

The engine's inputs are finite; these carry its windows over to streams. Late samples are bounded by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import column, geo


def cell_traffic(samples: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Samples, distinct trips (approximate), mean speed and mean lean of each cell and window. ``samples``: ts, trip, lat,
    lon, speed, lean."""
    cells = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("cell", column(geo.packed("lat", "lon")))
    grouped = cells.groupBy(F.window("ts", window), "cell")
    return grouped.agg(F.count("*").alias("n"), F.approx_count_distinct("trip").alias("trips"), F.avg(F.nullif("speed", F.lit(0.0))).alias("speed"), F.avg(F.abs("lean")).alias("lean")).select(F.col("window.start").alias("start"), "cell", "n", "trips", "speed", "lean")


def rides(samples: DataFrame, gap: str = "20 minutes", late: str = "10 minutes") -> DataFrame:
    """Rides of each trip id: sessions that end after a gap."""
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "trip").agg(F.count("*").alias("n"), F.max(F.abs("lean")).alias("max_lean")).select("trip", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "max_lean")
