"""Trailing outage counts per county from a stream of outage files.

A sliding event-time window ``[end - hours, end)`` with slide ``slide`` gives,
for every window end, the same value the batch W5 frame gives at
``t = end``: count and summed customers of the county's outages in the
trailing ``hours``. The watermark bounds state to the longest lookback, so
late files up to that age still update their windows and older state is
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import pad_fips, to_number


def outage_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of domain outage files (parquet, explicit schema) as (county_fips, event_time, max_customers)."""
    reader = spark.readStream.schema(schemas.OUTAGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(path)
    return raw.select(
        pad_fips("location.county_fips").alias("county_fips"),
        F.coalesce(F.col("event_began"), F.col("start_time")).alias("event_time"),
        to_number(F.col("max_customers")).alias("max_customers"),
    ).dropna(subset=["county_fips", "event_time"])


def trailing_counts(events: DataFrame, hours: int = 24, slide: str = "1 hour",
                    watermark_hours: int = 168) -> DataFrame:
    """Per (county, window end): outage count and summed customers over the trailing ``hours``."""
    w = F.window("event_time", f"{int(hours)} hours", slide)
    return (
        events.withWatermark("event_time", f"{int(watermark_hours)} hours")
        .groupBy("county_fips", w.alias("w"))
        .agg(F.count(F.lit(1)).alias(f"recent_outage_count_{hours}h"),
             F.sum("max_customers").alias(f"recent_customers_affected_{hours}h"))
        .select("county_fips", F.col("w.end").alias("prediction_time"),
                f"recent_outage_count_{hours}h", f"recent_customers_affected_{hours}h")
    )
