"""Python-path ROI frames.

The reference loops over campaigns and re-filters the whole merged frame for
each one (O(campaigns x rows)); here one conditional aggregate per campaign
replaces the loop. Python rules are kept: 0 instead of null for empty arms and
zero cost; no control arm means incremental = treatment revenue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.functions.guards import require_columns
from adlift.functions.numeric import exact_sum, safe_div
from adlift.sources.mapped import CampaignTables

ROI_COLUMNS = ["campaign_id", "channel", "total_cost", "treatment_revenue", "incremental_revenue", "roi", "roi_pct",
               "treatment_conv_rate", "control_conv_rate", "conversion_lift", "n_treatment", "n_control"]


def campaign_roi(exposures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``calculate_campaign_roi`` - one row per campaign."""
    require_columns(exposures, ["customer_id", "campaign_id", "treatment_group", "cost_per_contact", "channel"],
                    "exposure_df")
    require_columns(outcomes, ["customer_id", "campaign_id", "converted", "revenue_generated"], "outcome_df")
    facts = exposures.join(outcomes.select("customer_id", "campaign_id", "converted", "revenue_generated"),
                           ["customer_id", "campaign_id"])
    t, c = F.col("treatment_group") == 1, F.col("treatment_group") == 0
    agg = facts.groupBy("campaign_id").agg(
        F.min("channel").alias("channel"),
        F.count(F.when(t, 1)).alias("n_treatment"), F.count(F.when(c, 1)).alias("n_control"),
        F.coalesce(F.sum(F.when(t, F.col("cost_per_contact"))), F.lit(0)).cast("double").alias("total_cost"),
        F.coalesce(F.sum(F.when(t, F.col("revenue_generated"))), F.lit(0)).cast("double").alias("treatment_revenue"),
        F.coalesce(F.sum(F.when(c, F.col("revenue_generated"))), F.lit(0)).cast("double").alias("_crev"),
        F.avg(F.when(t, F.col("converted"))).alias("_tcr"), F.avg(F.when(c, F.col("converted"))).alias("_ccr"))
    nt, nc = F.col("n_treatment"), F.col("n_control")
    tppu = F.when(nt > 0, F.col("treatment_revenue") / nt).otherwise(F.lit(0.0))
    inc = F.when(nc > 0, (tppu - F.col("_crev") / nc) * nt).otherwise(F.col("treatment_revenue"))
    cost = F.col("total_cost")
    roi = F.when(cost > 0, (F.col("incremental_revenue") - cost) / cost).otherwise(F.lit(0.0))
    tcr = F.when(nt > 0, F.col("_tcr")).otherwise(F.lit(0.0))
    ccr = F.when(nc > 0, F.col("_ccr")).otherwise(F.lit(0.0))
    return (agg.withColumn("incremental_revenue", inc).withColumn("roi", roi)
            .select("campaign_id", "channel", "total_cost", "treatment_revenue", "incremental_revenue", "roi",
                    (F.col("roi") * 100).alias("roi_pct"), tcr.alias("treatment_conv_rate"),
                    ccr.alias("control_conv_rate"), (tcr - ccr).alias("conversion_lift"), "n_treatment", "n_control"))


def channel_performance(roi: DataFrame) -> DataFrame:
    """Channel totals; overall ROI from totals (null when cost is 0),
    ``avg_roi`` is the plain mean of campaign ROIs."""
    agg = roi.groupBy("channel").agg(
        exact_sum("total_cost", 2).alias("total_cost"), exact_sum("treatment_revenue", 2).alias("treatment_revenue"),
        F.sum("incremental_revenue").alias("incremental_revenue"), F.avg("roi").alias("avg_roi"),
        F.avg("treatment_conv_rate").alias("treatment_conv_rate"), F.avg("conversion_lift").alias("conversion_lift"),
        F.count("campaign_id").alias("n_campaigns"))
    return agg.withColumn("overall_roi", safe_div(F.col("incremental_revenue") - F.col("total_cost"), "total_cost"))


def campaign_picks(roi: DataFrame, top: int = 5, bottom: int = 3) -> DataFrame:
    """Top and bottom campaigns by ROI (rank 1 is the best / worst pick).
    Ties go to the smaller campaign_id."""
    cols = ["campaign_id", "channel", "roi", "incremental_revenue"]
    best = roi.orderBy(F.col("roi").desc_nulls_last(), "campaign_id").limit(top).select(*cols)
    worst = roi.orderBy(F.col("roi").asc_nulls_last(), "campaign_id").limit(bottom).select(*cols)
    from pyspark.sql import Window as W
    # the two inputs are at most ``top`` / ``bottom`` rows: ranking them needs no partition key
    rank_top = F.row_number().over(W.orderBy(F.col("roi").desc(), "campaign_id"))
    rank_bottom = F.row_number().over(W.orderBy(F.col("roi").asc(), "campaign_id"))
    return (best.select(F.lit("top").alias("pick"), rank_top.alias("rank"), *cols)
            .unionByName(worst.select(F.lit("bottom").alias("pick"), rank_bottom.alias("rank"), *cols)))


def negative_roi_count(roi: DataFrame) -> DataFrame:
    return roi.agg(F.count_if(F.col("roi") < 0).alias("n_negative"), F.count(F.lit(1)).alias("n_campaigns"))


def modeling_base(tables: CampaignTables, treatment_only: bool = False) -> DataFrame:
    """Exposure + customer attributes + outcome, one row per exposure."""
    o = tables.outcomes.select("customer_id", "campaign_id", "converted", "revenue_generated")
    base = tables.exposures.join(tables.customers, "customer_id").join(o, ["customer_id", "campaign_id"])
    return base.where(F.col("treatment_group") == 1) if treatment_only else base
