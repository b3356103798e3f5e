"""The streaming monitor on a file source of exposure events (one trigger)."""
import os
import tempfile

from pyspark.sql import functions as F

from adlift.streaming.monitor import arm_counts, start_ab_monitor


def test_monitor_one_batch(spark, tables):
    d = tempfile.mkdtemp(prefix="adlift-stream-")
    src = os.path.join(d, "events")
    ev = (tables.exposures.join(tables.outcomes.select("customer_id", "campaign_id", "converted"),
                                ["customer_id", "campaign_id"])
          .select("campaign_id", "treatment_group", "converted",
                  F.to_timestamp(F.lit("2024-03-01 00:00:00")).alias("event_time")))
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    assert arm_counts(stream).isStreaming
    q = start_ab_monitor(stream, os.path.join(d, "out"), os.path.join(d, "ckpt"), trigger="1 second")
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(os.path.join(d, "out"))
    assert out.select("campaign_id").distinct().count() == 12
