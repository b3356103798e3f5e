"""Ad-hoc workbook roll-ups.

Each is one aggregate over the exposure-outcome join; campaign names are
attached after aggregation (one row per campaign meets the dimension).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.functions.numeric import exact_sum, round_half_away as R, safe_div
from adlift.operators.kpi import campaign_arm_totals, exposure_outcomes
from adlift.sources.mapped import CampaignTables


def _simple_roi(rev, cost):
    return R(safe_div(rev - cost, cost) * 100, 2)


def campaign_rollup(tables: CampaignTables) -> DataFrame:
    """Reach, conversions, rate, revenue, cost and simple ROI (both arms)."""
    facts = exposure_outcomes(tables)
    agg = facts.groupBy("campaign_id").agg(
        F.countDistinct("customer_id").alias("total_reached"),
        F.sum("converted").cast("bigint").alias("total_conversions"),
        F.avg("converted").alias("_rate"),
        F.sum("revenue_generated").cast("double").alias("_rev"),
        F.sum("cost_per_contact").cast("double").alias("_cost"),
    )
    dims = tables.campaigns.select("campaign_id", "campaign_name", "channel")
    return (dims.join(agg, "campaign_id").select(
        "campaign_id", "campaign_name", "channel", "total_reached", "total_conversions",
        R(F.col("_rate") * 100, 2).alias("conversion_rate_pct"),
        R("_rev", 2).alias("total_revenue"), R("_cost", 2).alias("total_cost"),
        _simple_roi(F.col("_rev"), F.col("_cost")).alias("roi_pct"))
        .orderBy(F.col("roi_pct").desc_nulls_last(), "campaign_id"))


def campaign_lift(tables: CampaignTables) -> DataFrame:
    """Arm sizes, conversions, rates in % and absolute lift."""
    facts = exposure_outcomes(tables).drop("channel")
    t, c = F.col("treatment_group") == 1, F.col("treatment_group") == 0
    agg = facts.groupBy("campaign_id").agg(
        F.count(F.when(t, 1)).alias("treatment_size"),
        F.sum(F.when(t, F.col("converted")).otherwise(0)).cast("bigint").alias("treatment_conversions"),
        F.count(F.when(c, 1)).alias("control_size"),
        F.sum(F.when(c, F.col("converted")).otherwise(0)).cast("bigint").alias("control_conversions"),
    )
    ts, tv, cs, cv = (F.col(x) for x in ("treatment_size", "treatment_conversions", "control_size",
                                         "control_conversions"))
    dims = tables.campaigns.select("campaign_id", "channel")
    return (agg.join(dims, "campaign_id").select(
        "campaign_id", "channel", "treatment_size", "treatment_conversions",
        R(safe_div(tv.cast("double") * 100.0, ts), 2).alias("treatment_conv_rate_pct"),
        "control_size", "control_conversions",
        R(safe_div(cv.cast("double") * 100.0, cs), 2).alias("control_conv_rate_pct"),
        R(safe_div(tv, ts) - safe_div(cv, cs), 4).alias("absolute_lift"))
        .orderBy(F.col("absolute_lift").desc_nulls_last(), "campaign_id"))


def channel_rollup(tables: CampaignTables) -> DataFrame:
    """Treatment arm only, per exposure channel. Campaigns are counted over the sums per (channel, campaign), so
    customers are the only distinct count over the facts and no row is expanded."""
    facts = exposure_outcomes(tables).where(F.col("treatment_group") == 1)
    cells = facts.groupBy("channel", "campaign_id").agg(
        F.sum("converted").alias("_won"), F.count("converted").alias("_known"),
        F.sum("revenue_generated").alias("_rev"), F.sum("cost_per_contact").alias("_cost"))
    agg = cells.groupBy("channel").agg(
        F.count("campaign_id").alias("num_campaigns"), F.sum("_won").cast("bigint").alias("total_conversions"),
        safe_div(F.sum("_won"), F.sum("_known")).alias("_rate"),
        F.sum("_rev").cast("double").alias("_rev"), F.sum("_cost").cast("double").alias("_cost"))
    heads = facts.groupBy("channel").agg(F.countDistinct("customer_id").alias("customers_reached"))
    same = F.col("s.channel").eqNullSafe(F.col("h.channel"))
    return (agg.alias("s").join(heads.alias("h"), same)
            .select("s.channel", "num_campaigns", "customers_reached", "total_conversions",
                    R(F.col("_rate") * 100, 2).alias("avg_conversion_rate"),
                    R("_rev", 2).alias("total_revenue"), R("_cost", 2).alias("total_cost"),
                    _simple_roi(F.col("_rev"), F.col("_cost")).alias("channel_roi_pct"))
            .orderBy(F.col("channel_roi_pct").desc_nulls_last(), "channel"))


def spend_tier(col="historical_spend", high: float = 2000, medium: float = 1000):
    c = F.col(col)
    return (F.when(c > high, "High Spender").when(c > medium, "Medium Spender").otherwise("Low Spender"))


def spend_tier_performance(tables: CampaignTables) -> DataFrame:
    """Customers (exposed or not) -> exposures -> outcomes, per spend tier.
    Averages are per joined row, as in the reference. Customers are counted before any join, campaigns over the sums
    per (tier, campaign)."""
    cust = tables.customers.select("customer_id", spend_tier().alias("customer_segment"))
    heads = cust.groupBy("customer_segment").agg(F.countDistinct("customer_id").alias("customers"))
    e = tables.exposures.select("customer_id", "campaign_id")
    o = tables.outcomes.select("customer_id", "campaign_id", "converted", "revenue_generated")
    facts = e.join(o, ["customer_id", "campaign_id"], "left")
    cells = cust.join(facts, "customer_id").groupBy("customer_segment", "campaign_id").agg(
        F.sum("converted").alias("_won"), F.count("converted").alias("_known"),
        F.sum("revenue_generated").alias("_rev"), F.count("revenue_generated").alias("_n_rev"))
    agg = cells.groupBy("customer_segment").agg(
        F.count("campaign_id").alias("_seen"), F.sum("_won").cast("bigint").alias("total_conversions"),
        safe_div(F.sum("_won"), F.sum("_known")).alias("_rate"),
        F.sum("_rev").cast("double").alias("_rev"), F.sum("_n_rev").alias("_n_rev"))
    return (heads.join(agg, "customer_segment", "left")
            .select("customer_segment", "customers", F.coalesce("_seen", F.lit(0)).alias("campaigns_exposed_to"),
                    "total_conversions", R(F.col("_rate") * 100, 2).alias("conversion_rate_pct"),
                    R("_rev", 2).alias("total_revenue"),
                    R(safe_div("_rev", "_n_rev"), 2).alias("avg_revenue_per_customer"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), "customer_segment"))


def campaign_incremental(tables: CampaignTables) -> DataFrame:
    """Revenue per user per arm, incremental revenue and ROI."""
    arms = campaign_arm_totals(exposure_outcomes(tables).drop("channel"), by=("campaign_id",))
    dims = tables.campaigns.select("campaign_id", "channel")
    tn, cn = F.col("treatment_size"), F.col("control_size")
    trev, crev = F.col("treatment_revenue").cast("double"), F.col("control_revenue").cast("double")
    cost = F.col("treatment_cost").cast("double")
    inc = (safe_div(trev, tn) - safe_div(crev, cn)) * tn
    return (arms.join(dims, "campaign_id").select(
        "campaign_id", "channel", tn.alias("treatment_n"), cn.alias("control_n"),
        R(safe_div(trev, tn), 2).alias("treatment_revenue_per_user"),
        R(safe_div(crev, cn), 2).alias("control_revenue_per_user"),
        R(inc, 2).alias("incremental_revenue"),
        R(safe_div(inc - cost, cost) * 100, 2).alias("roi_pct"))
        .orderBy(F.col("incremental_revenue").desc_nulls_last(), "campaign_id"))


def kill_list_simple_roi(tables: CampaignTables, threshold: float = 0.0) -> DataFrame:
    """Treatment rows, simple (non-incremental) ROI below ``threshold``."""
    facts = exposure_outcomes(tables).where(F.col("treatment_group") == 1)
    agg = facts.groupBy("campaign_id").agg(
        F.sum("revenue_generated").cast("double").alias("_rev"),
        F.sum("cost_per_contact").cast("double").alias("_cost"))
    dims = tables.campaigns.select("campaign_id", "campaign_name", "channel")
    out = dims.join(agg, "campaign_id").select(
        "campaign_id", "campaign_name", "channel", R("_rev", 2).alias("total_revenue"),
        R("_cost", 2).alias("total_cost"), _simple_roi(F.col("_rev"), F.col("_cost")).alias("roi_pct"),
        R(F.col("_rev") - F.col("_cost"), 2).alias("profit_loss"),
        F.lit("KILL - Negative ROI").alias("recommendation"))
    return out.where(F.col("roi_pct") < threshold).orderBy("profit_loss", "campaign_id")


def budget_by_simple_roi(tables: CampaignTables) -> DataFrame:
    """Spend share versus positive-ROI share per channel (treatment rows)."""
    facts = exposure_outcomes(tables).where(F.col("treatment_group") == 1)
    perf = facts.groupBy("channel").agg(
        F.sum("revenue_generated").cast("double").alias("_rev"),
        F.sum("cost_per_contact").cast("double").alias("_cost"),
    ).select("channel", R("_cost", 2).alias("current_spend"),
             R(safe_div(F.col("_rev") - F.col("_cost"), "_cost"), 4).alias("roi"))
    # One-row totals over the (small, per-channel) aggregate.
    totals = perf.agg(exact_sum("current_spend", 2).alias("_total"),
                      exact_sum(F.when(F.col("roi") > 0, F.col("roi")).otherwise(0.0), 4).alias("_pos"))
    j = perf.crossJoin(F.broadcast(totals))
    share = F.col("current_spend") / F.col("_total") * 100
    rec = F.when(F.col("roi") > 0, F.col("roi") / F.col("_pos") * 100).otherwise(F.lit(0.0))
    return (j.select("channel", "current_spend", R(share, 1).alias("current_pct"), "roi",
                     R(F.col("roi") * 100, 1).alias("roi_pct"), R(rec, 1).alias("recommended_pct"),
                     R(rec - share, 1).alias("shift_pct"))
            .orderBy(F.col("roi").desc_nulls_last(), "channel"))
