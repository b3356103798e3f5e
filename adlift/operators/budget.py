"""Budget allocation over channels.

Inputs are channel aggregates (one row per channel, a bounded handful), so the
share totals are a one-row aggregate cross-joined back and the largest-
remainder ranking may use an unpartitioned window on those few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlift.functions.numeric import div_or_zero

from adlift.functions.guards import require_columns


def allocate_budget(perf: DataFrame, total_budget: float, roi_col: str = "overall_roi") -> DataFrame:
    """ROI-proportional integer percentages summing to exactly 100
    (largest remainder), then the budget. Negative (or missing) ROI gets 0; if
    every weight is 0 the budget is split equally. Remainder ties go to the
    smaller channel name."""
    require_columns(perf, ["channel", roi_col], "channel_perf")
    w = perf.withColumn("roi_weight", F.greatest(F.coalesce(F.col(roi_col).cast("double"), F.lit(0.0)), F.lit(0.0)))
    tot = w.agg(F.sum("roi_weight").alias("_tw"), F.count(F.lit(1)).alias("_n"))
    w = w.crossJoin(F.broadcast(tot))
    all_zero = F.col("_tw") == 0
    w = (w.withColumn("roi_weight", F.when(all_zero, F.lit(1.0)).otherwise(F.col("roi_weight")))
         .withColumn("_raw", F.col("roi_weight") / F.when(all_zero, F.col("_n").cast("double"))
                     .otherwise(F.col("_tw")) * 100)
         .withColumn("_floor", F.floor("_raw").cast("double"))
         .withColumn("_rem", F.col("_raw") - F.col("_floor")))
    everything = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("_rem").desc(), F.col("channel"))
    left = (F.lit(100.0) - F.sum("_floor").over(everything))
    pct = F.col("_floor") + F.when(F.row_number().over(order) <= left, 1.0).otherwise(0.0)
    out_cols = [c for c in perf.columns]
    return (w.withColumn("recommended_pct", pct)
            .withColumn("recommended_budget", F.col("recommended_pct") / 100 * F.lit(float(total_budget)))
            .select(*out_cols, "roi_weight", "recommended_pct", "recommended_budget"))


def budget_reallocation(channel_perf: DataFrame) -> DataFrame:
    """Spend share, ROI-weight share and shift, rounded half-even to 1 dp
    (pandas ``round``); the shares need not sum to 100."""
    base = channel_perf.select("channel", "total_cost", "overall_roi")
    tot = base.agg(F.sum("total_cost").alias("_tc"),
                   F.sum(F.greatest(F.col("overall_roi"), F.lit(0.0))).alias("_tw"))
    j = base.crossJoin(F.broadcast(tot))
    cur = F.bround(div_or_zero("total_cost", "_tc") * 100, 1)
    wgt = F.greatest(F.col("overall_roi"), F.lit(0.0))
    rec = F.bround(div_or_zero(wgt, "_tw") * 100, 1)
    return j.select("channel", "total_cost", "overall_roi", cur.alias("current_pct"), wgt.alias("roi_weight"),
                    rec.alias("recommended_pct"), (rec - cur).alias("shift_pct"))
