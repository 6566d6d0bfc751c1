"""The dashboard's bucketed aggregates on a stream of readings.

The same expressions as in the batch jobs, per event-time bucket. A watermark
bounds the state to the buckets that may still receive late rows. Watermarks
need a zoned timestamp, so local times pass through the session zone (UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roomtide.functions.scalars import round_to, share


def _per_bucket(stream: DataFrame, zone: str, bucket: str, late: str):
    rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return rows.groupBy(F.window("timestamp", bucket), zone)


def live_occupancy(stream: DataFrame, bucket: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean and peak count per bucket and zone of ``timestamp, zone_id, occupancy_count`` rows."""
    found = _per_bucket(stream, "zone_id", bucket, late).agg(
        F.avg("occupancy_count").alias("avg_occ"), F.max("occupancy_count").alias("peak_occ"),
        F.count(F.lit(1)).alias("samples"),
    )
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("timestamp"), "zone_id", "avg_occ", "peak_occ", "samples")


def live_comfort(
    stream: DataFrame, comfort_low: float = 70.0, comfort_high: float = 76.0,
    bucket: str = "15 minutes", late: str = "30 minutes",
) -> DataFrame:
    """Mean temperature and share of readings outside the band per bucket and zone."""
    temp = F.col("zone_temp")
    outside = (temp < F.lit(float(comfort_low))) | (temp > F.lit(float(comfort_high)))
    found = _per_bucket(stream, "space_id", bucket, late).agg(
        round_to(F.avg("zone_temp")).alias("avg_temp"),
        round_to(F.lit(100.0) * share(outside)).alias("comfort_exceedance_pct"),
        F.count(F.lit(1)).alias("samples"),
    )
    return found.select(
        F.col("window.start").cast("timestamp_ntz").alias("timestamp"), "space_id", "avg_temp", "comfort_exceedance_pct", "samples"
    )
