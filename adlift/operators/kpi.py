"""Treatment-versus-control KPIs per campaign and their roll-ups.

Plan shape: exposures and outcomes are joined on (customer_id, campaign_id)
and reduced by ONE conditional aggregate per campaign (map-side partial
aggregation, so a hot campaign never gathers its rows in one task). Only the
aggregated rows - one per campaign - meet the campaign dimension, so that join
is tiny and AQE turns it into a broadcast from measured sizes. Every division
goes through ``safe_div`` (ANSI mode raises on /0; SQL returns NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.functions.numeric import exact_avg, exact_sum, round_half_away as R, safe_div
from adlift.sources.mapped import CampaignTables

KPI_COLUMNS = [
    "campaign_id", "campaign_name", "channel", "campaign_type", "start_date", "end_date",
    "treatment_size", "control_size", "total_exposed", "treatment_cost", "control_cost", "total_cost",
    "cost_per_contact", "treatment_conversions", "control_conversions", "treatment_conv_rate",
    "control_conv_rate", "absolute_lift", "relative_lift_pct", "treatment_revenue", "control_revenue",
    "treatment_revenue_per_user", "control_revenue_per_user", "incremental_revenue_per_user",
    "total_incremental_revenue", "roi_percentage", "cac", "profit",
]


def exposure_outcomes(tables: CampaignTables, how: str = "inner") -> DataFrame:
    """Exposures joined to their outcome on (customer_id, campaign_id)."""
    o = tables.outcomes.select("customer_id", "campaign_id", "converted", "conversion_date",
                               "revenue_generated")
    return tables.exposures.join(o, ["customer_id", "campaign_id"], how)


def campaign_arm_totals(facts: DataFrame, by=("campaign_id", "channel")) -> DataFrame:
    """Per-arm sizes, costs, conversions and revenue in one pass (no arm split)."""
    t = F.col("treatment_group") == 1
    c = F.col("treatment_group") == 0
    conv = F.col("converted") == 1
    return facts.groupBy(*by).agg(
        F.count(F.when(t, 1)).alias("treatment_size"),
        F.sum(F.when(t, F.col("cost_per_contact")).otherwise(0)).alias("treatment_cost"),
        F.sum(F.when(t & conv, 1).otherwise(0)).cast("bigint").alias("treatment_conversions"),
        F.sum(F.when(t, F.col("revenue_generated")).otherwise(0)).alias("treatment_revenue"),
        F.count(F.when(c, 1)).alias("control_size"),
        F.sum(F.when(c, F.col("cost_per_contact")).otherwise(0)).alias("control_cost"),
        F.sum(F.when(c & conv, 1).otherwise(0)).cast("bigint").alias("control_conversions"),
        F.sum(F.when(c, F.col("revenue_generated")).otherwise(0)).alias("control_revenue"),
    )


def campaign_kpis(tables: CampaignTables) -> DataFrame:
    """The 28-column KPI table, one row per (campaign, channel)."""
    arms = campaign_arm_totals(exposure_outcomes(tables))
    dims = tables.campaigns.select("campaign_id", "campaign_name", "campaign_type", "start_date", "end_date")
    m = arms.join(dims, "campaign_id")
    ts, cs = F.col("treatment_size"), F.col("control_size")
    tc, cc = F.col("treatment_cost").cast("double"), F.col("control_cost").cast("double")
    trev, crev = F.col("treatment_revenue").cast("double"), F.col("control_revenue").cast("double")
    tconv, cconv = F.col("treatment_conversions"), F.col("control_conversions")
    trate, crate = safe_div(tconv, ts), safe_div(cconv, cs)
    tppu, cppu = safe_div(trev, ts), safe_div(crev, cs)
    incremental = (tppu - cppu) * ts
    return m.select(
        "campaign_id", "campaign_name", "channel", "campaign_type", "start_date", "end_date",
        ts.alias("treatment_size"), cs.alias("control_size"), (ts + cs).alias("total_exposed"),
        R(tc, 2).alias("treatment_cost"), R(cc, 2).alias("control_cost"), R(tc + cc, 2).alias("total_cost"),
        R(safe_div(tc, ts), 2).alias("cost_per_contact"),
        tconv.alias("treatment_conversions"), cconv.alias("control_conversions"),
        R(trate, 4).alias("treatment_conv_rate"), R(crate, 4).alias("control_conv_rate"),
        R(trate - crate, 4).alias("absolute_lift"),
        R(safe_div(trate - crate, crate) * 100, 2).alias("relative_lift_pct"),
        R(trev, 2).alias("treatment_revenue"), R(crev, 2).alias("control_revenue"),
        R(tppu, 2).alias("treatment_revenue_per_user"), R(cppu, 2).alias("control_revenue_per_user"),
        R(tppu - cppu, 2).alias("incremental_revenue_per_user"),
        R(incremental, 2).alias("total_incremental_revenue"),
        R(safe_div(incremental - tc, tc) * 100, 2).alias("roi_percentage"),
        R(safe_div(tc, tconv), 2).alias("cac"),
        R(incremental - tc, 2).alias("profit"),
    )


def top_performers(kpis: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` campaigns by ROI (ties by campaign_id)."""
    return (kpis.select("campaign_id", "campaign_name", "channel", "treatment_conv_rate", "control_conv_rate",
                        "relative_lift_pct", "total_incremental_revenue", "roi_percentage", "profit")
            .orderBy(F.col("roi_percentage").desc_nulls_last(), "campaign_id").limit(n))


def _roi_of_sums(inc, cost) -> F.Column:
    return R(safe_div(inc - cost, cost) * 100, 2)


def channel_kpis(kpis: DataFrame) -> DataFrame:
    """Channel roll-up of the (already rounded) campaign KPIs."""
    tir, tc = exact_sum("total_incremental_revenue", 2), exact_sum("treatment_cost", 2)
    return (kpis.groupBy("channel").agg(
        F.countDistinct("campaign_id").alias("n_campaigns"),
        F.sum("treatment_size").alias("total_treatment"),
        F.sum("control_size").alias("total_control"),
        F.sum("total_exposed").alias("total_exposed"),
        R(tc, 2).alias("total_cost"),
        R(exact_avg("cost_per_contact", 2), 2).alias("avg_cost_per_contact"),
        F.sum("treatment_conversions").alias("total_conversions"),
        R(safe_div(F.sum("treatment_conversions"), F.sum("treatment_size")), 4).alias("avg_conv_rate"),
        R(exact_avg("relative_lift_pct", 2), 2).alias("avg_lift_pct"),
        R(exact_sum("treatment_revenue", 2), 2).alias("total_revenue"),
        R(tir, 2).alias("total_incremental_revenue"),
        R(exact_avg("treatment_revenue_per_user", 2), 2).alias("avg_revenue_per_user"),
        _roi_of_sums(tir, tc).alias("channel_roi_pct"),
        R(safe_div(tc, F.sum("treatment_conversions")), 2).alias("avg_cac"),
        R(exact_sum("profit", 2), 2).alias("total_profit"),
    ).orderBy(F.col("channel_roi_pct").desc_nulls_last(), "channel"))


def weekly_kpis(kpis: DataFrame) -> DataFrame:
    """By SQLite ``%Y-%W`` week of the campaign start date."""
    from adlift.functions.dates import year_week_monday
    tir, tc = exact_sum("total_incremental_revenue", 2), exact_sum("treatment_cost", 2)
    return (kpis.groupBy(year_week_monday("start_date").alias("week")).agg(
        F.countDistinct("campaign_id").alias("campaigns_launched"),
        F.sum("treatment_size").alias("total_reached"),
        F.sum("treatment_conversions").alias("total_conversions"),
        R(exact_sum("treatment_revenue", 2), 2).alias("total_revenue"),
        R(tc, 2).alias("total_cost"),
        _roi_of_sums(tir, tc).alias("weekly_roi_pct"),
    ).orderBy("week"))


def kpis_by_campaign_type(kpis: DataFrame) -> DataFrame:
    """E5: performance per campaign type."""
    profitable = F.sum(F.when(F.col("roi_percentage") > 0, 1).otherwise(0))
    return (kpis.groupBy("campaign_type").agg(
        F.count(F.lit(1)).alias("n_campaigns"),
        R(exact_avg("treatment_conv_rate", 4), 4).alias("avg_conv_rate"),
        R(exact_avg("relative_lift_pct", 2), 2).alias("avg_lift_pct"),
        R(exact_sum("total_incremental_revenue", 2), 2).alias("total_incremental_revenue"),
        R(exact_avg("roi_percentage", 2), 2).alias("avg_roi_pct"),
        profitable.cast("bigint").alias("profitable_campaigns"),
        R(profitable.cast("double") * 100.0 / F.count(F.lit(1)), 1).alias("profitable_pct"),
    ).orderBy(F.col("avg_roi_pct").desc_nulls_last(), "campaign_type"))


def cac_by_channel(kpis: DataFrame) -> DataFrame:
    """Acquisition cost spread per channel, campaigns with a CAC only."""
    return (kpis.where(F.col("cac").isNotNull()).groupBy("channel").agg(
        R(exact_avg("cac", 2), 2).alias("avg_cac"),
        R(F.min("cac"), 2).alias("min_cac"),
        R(F.max("cac"), 2).alias("max_cac"),
        R(F.avg(safe_div("treatment_revenue_per_user", "cac")), 2).alias("revenue_to_cac_ratio"),
    ).orderBy(F.col("avg_cac").asc_nulls_first(), "channel"))


def efficiency_scores(kpis: DataFrame, n: int = 20, roi_weight: float = 0.6,
                      lift_weight: float = 0.4) -> DataFrame:
    """Composite score ``0.6 ROI + 0.4 relative lift``, top ``n``."""
    score = R(F.col("roi_percentage") * roi_weight + F.col("relative_lift_pct") * lift_weight, 2)
    return (kpis.select("campaign_id", "campaign_name", "channel", "roi_percentage", "relative_lift_pct",
                        score.alias("efficiency_score"))
            .orderBy(F.col("efficiency_score").desc_nulls_last(), "campaign_id").limit(n))


def campaigns_to_kill(kpis: DataFrame) -> DataFrame:
    """Negative ROI, largest loss first."""
    return (kpis.where(F.col("roi_percentage") < 0)
            .select("campaign_id", "campaign_name", "channel", "roi_percentage", "profit",
                    F.lit("KILL - Negative ROI").alias("recommendation"))
            .orderBy("profit", "campaign_id"))


def campaigns_to_scale(kpis: DataFrame, min_roi: float = 50, min_lift: float = 10,
                       min_treated: int = 1000) -> DataFrame:
    """High ROI, material lift and a sufficient treated sample."""
    return (kpis.where((F.col("roi_percentage") > min_roi) & (F.col("relative_lift_pct") > min_lift)
                       & (F.col("treatment_size") > min_treated))
            .select("campaign_id", "campaign_name", "channel", "roi_percentage", "relative_lift_pct",
                    "total_incremental_revenue", F.lit("SCALE - High Performance").alias("recommendation"))
            .orderBy(F.col("roi_percentage").desc(), "campaign_id"))


def campaigns_to_optimize(kpis: DataFrame, low: float = 0, high: float = 30) -> DataFrame:
    """Positive but low ROI (inclusive band), largest campaigns first."""
    return (kpis.where(F.col("roi_percentage").between(low, high))
            .select("campaign_id", "campaign_name", "channel", "roi_percentage", "relative_lift_pct",
                    F.lit("OPTIMIZE - Improve Efficiency").alias("recommendation"), "treatment_size")
            .orderBy(F.col("treatment_size").desc(), "campaign_id").drop("treatment_size"))


def executive_kpis(kpis: DataFrame) -> DataFrame:
    """One-row totals over all campaigns."""
    tir, tc = exact_sum("total_incremental_revenue", 2), exact_sum("treatment_cost", 2)
    roi = F.col("roi_percentage")
    return kpis.agg(
        F.countDistinct("campaign_id").alias("total_campaigns"),
        F.sum("total_exposed").alias("total_customers_reached"),
        R(tc, 2).alias("total_spend"),
        F.sum("treatment_conversions").alias("total_conversions"),
        R(exact_sum("treatment_revenue", 2), 2).alias("total_revenue"),
        R(tir, 2).alias("total_incremental_revenue"),
        _roi_of_sums(tir, tc).alias("overall_roi_pct"),
        R(exact_sum("profit", 2), 2).alias("total_profit"),
        F.sum(F.when(roi > 0, 1).otherwise(0)).cast("bigint").alias("profitable_campaigns"),
        F.sum(F.when(roi < 0, 1).otherwise(0)).cast("bigint").alias("unprofitable_campaigns"),
        R(exact_avg("treatment_conv_rate", 4), 4).alias("avg_conversion_rate"),
        R(exact_avg("relative_lift_pct", 2), 2).alias("avg_lift_pct"),
    )


def top_bottom(kpis: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` and bottom ``n`` by ROI, stacked."""
    cols = ["campaign_name", "channel", "roi_percentage"]
    top = (kpis.orderBy(F.col("roi_percentage").desc_nulls_last(), "campaign_id").limit(n)
           .select(F.lit(f"TOP {n} CAMPAIGNS").alias("category"), *cols))
    bottom = (kpis.orderBy(F.col("roi_percentage").asc_nulls_first(), "campaign_id").limit(n)
              .select(F.lit(f"BOTTOM {n} CAMPAIGNS").alias("category"), *cols))
    return top.unionByName(bottom)


def negative_roi_alerts(kpis: DataFrame, roi_threshold: float = 0.0, channel: str | None = None,
                        start_from=None, end_to=None, name_contains: str | None = None) -> DataFrame:
    """The dashboard's alert list as a parameterised filter over E1."""
    cond = F.col("roi_percentage") < roi_threshold
    if channel is not None:
        cond = cond & (F.col("channel") == channel)
    if start_from is not None:
        cond = cond & (F.col("start_date") >= F.lit(start_from).cast("date"))
    if end_to is not None:
        cond = cond & (F.col("end_date") <= F.lit(end_to).cast("date"))
    if name_contains:
        cond = cond & F.lower(F.col("campaign_name")).contains(name_contains.lower())
    return (kpis.where(cond)
            .select("campaign_id", "campaign_name", "channel", "start_date", "end_date", "roi_percentage",
                    "profit", F.format_string("ALERT: %s ROI %.2f%% below %.2f%%", F.col("campaign_id"),
                                              F.col("roi_percentage"), F.lit(float(roi_threshold))).alias("alert"))
            .orderBy("roi_percentage", "campaign_id"))
