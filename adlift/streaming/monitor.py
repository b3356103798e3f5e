"""Live A/B monitoring with Structured Streaming.

The reference recommends watching significance while a campaign runs; its
batch operators are reused unchanged: a watermarked, windowed count of
exposures and conversions per (campaign, arm) is kept as streaming state, and
each micro-batch's updated windows go through the same two-proportion test
(``ab_conversion``) and verdict (``ab_verdict``) as the batch pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.operators.abtest import ab_conversion, ab_verdict


def arm_counts(events: DataFrame, window: str = "1 day", watermark: str = "2 days") -> DataFrame:
    """Streaming state: per (campaign, event-time window) treated/control sizes
    and conversions. ``events`` needs campaign_id, treatment_group, converted
    and an event-time column ``event_time``; late rows beyond the watermark
    are dropped from state."""
    t, c = F.col("treatment_group") == 1, F.col("treatment_group") == 0
    return (events.withWatermark("event_time", watermark)
            .groupBy("campaign_id", F.window("event_time", window).alias("w"))
            .agg(F.count(F.when(t, 1)).alias("treatment_n"), F.count(F.when(c, 1)).alias("control_n"),
                 F.sum(F.when(t, F.col("converted")).otherwise(0)).alias("treatment_conversions"),
                 F.sum(F.when(c, F.col("converted")).otherwise(0)).alias("control_conversions")))


def start_ab_monitor(events: DataFrame, sink_path: str, checkpoint: str, window: str = "1 day",
                     watermark: str = "2 days", alpha: float = 0.05, trigger: str = "1 minute"):
    """Start the query; each micro-batch writes its updated windows to a folder of
    its own, ``sink_path/batch_id=N`` (parquet), and a batch run again after a
    failure replaces that folder. A window's latest batch holds its state. ``checkpoint`` must be a shared folder so the query restarts
    where it stopped after a failure."""
    counts = arm_counts(events, window, watermark)

    def test_batch(batch: DataFrame, batch_id: int) -> None:
        tested = ab_verdict(ab_conversion(batch.where((F.col("treatment_n") > 0) & (F.col("control_n") > 0)),
                                          alpha=alpha))
        (tested.select("campaign_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                        "treatment_n", "control_n", "treatment_rate", "control_rate", "relative_lift", "p_value",
                 "statistically_significant", "recommendation")
         .write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}"))

    return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(test_batch).trigger(processingTime=trigger).start())
