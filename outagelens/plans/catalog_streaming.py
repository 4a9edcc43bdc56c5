"""Catalog entry: the streaming trailing counts, run to completion over a file stream
derived from the given tables."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import fixtures as fx
from ..streaming import trailing as ST
from .registry import query

_RUN = itertools.count()


@query("st01_stream_trailing_24h", """
WITH e AS (SELECT county_fips, event_began AS t, max_customers FROM oev WHERE event_began IS NOT NULL),
x AS (SELECT county_fips, date_trunc('hour', t) + to_hours(CAST(i AS BIGINT)) AS prediction_time, max_customers
      FROM e, range(1, 25) AS r(i))
SELECT county_fips, prediction_time, count(*) AS recent_outage_count_24h,
       sum(max_customers) AS recent_customers_affected_24h
FROM x GROUP BY 1, 2""", dbl=("recent_customers_affected_24h:2",))
def st01(spark, sf):
    """Outage files -> readStream -> 24 h sliding window (1 h slide, 168 h watermark) -> updates in files, the last of each key.

    Update mode lets the watermark drop old state, and the result never passes through the driver.
    """
    src = scratch_path(spark, f"st01_outage_files_{next(_RUN)}")
    fx.outages_ev(spark, sf).write.mode("overwrite").parquet(src)
    # stream state and output live in the shared checkpoint dir; a fresh location per run so nothing is resumed
    base = scratch_path(spark, f"st01_stream/{uuid.uuid4().hex}")

    def write(batch, number):  # overwriting a batch's own folder makes a retried batch harmless
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = (ST.trailing_counts(ST.outage_stream(spark, src), hours=24, slide="1 hour", watermark_hours=168)
         .writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    updates = spark.read.parquet(f"{base}/out")
    keys, values = ["county_fips", "prediction_time"], ["recent_outage_count_24h", "recent_customers_affected_24h"]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return last.select(*keys, *[f"r.{v}" for v in values])
