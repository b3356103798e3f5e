"""Customer journey statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.functions.numeric import round_half_away as R
from adlift.sources.mapped import CampaignTables


def channel_paths(pairs: DataFrame, sep: str = " → ") -> DataFrame:
    """Per customer: the ordered channel path and its length.

    Order: exposure_date, campaign_id, conversion_date, revenue (a total order;
    the reference leaves ties to chance). The path is the feature itself, so it
    is built per customer with ``array_sort`` over collected structs.
    """
    touches = F.collect_list(F.struct("exposure_date", "campaign_id", "conversion_date", "revenue_generated",
                                      "channel"))
    return (pairs.groupBy("customer_id")
            .agg(F.array_join(F.transform(F.array_sort(touches), lambda s: s["channel"]), sep)
                 .alias("channel_sequence"), F.count(F.lit(1)).alias("touch_count")))


def journey_sequences(pairs: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent channel paths (top ``top``; ties by path)."""
    return (channel_paths(pairs).groupBy("channel_sequence")
            .agg(F.count(F.lit(1)).alias("frequency"), R(F.avg("touch_count"), 1).alias("avg_touches"))
            .orderBy(F.col("frequency").desc(), "channel_sequence").limit(top))


def _outcomes_per_customer(tables: CampaignTables) -> DataFrame:
    """The reference joins outcomes on customer only and keeps only MAX, so
    outcomes are reduced to one row per customer BEFORE the join (no fan-out)."""
    return tables.outcomes.groupBy("customer_id").agg(
        F.max("converted").alias("converted"), F.max("revenue_generated").alias("revenue"))


def touch_conversion_curve(tables: CampaignTables) -> DataFrame:
    """Conversion rate by number of distinct campaigns a customer saw."""
    per = (tables.exposures.groupBy("customer_id")
           .agg(F.countDistinct("campaign_id").alias("num_campaigns"))
           .join(_outcomes_per_customer(tables).select("customer_id", "converted"), "customer_id", "left"))
    conv = F.sum(F.when(F.col("converted") == 1, 1).otherwise(0))
    return (per.groupBy(F.col("num_campaigns").alias("touchpoints"))
            .agg(F.count(F.lit(1)).alias("num_customers"), conv.cast("bigint").alias("converters"),
                 R(conv.cast("double") * 100.0 / F.count(F.lit(1)), 2).alias("conversion_rate_pct"))
            .orderBy("touchpoints"))


def channel_mix(tables: CampaignTables, min_customers: int = 100, top: int = 10) -> DataFrame:
    """Customers on more than one channel, grouped by their (sorted) channel
    set; sets with more than ``min_customers`` customers, best rate first."""
    per = (tables.exposures.groupBy("customer_id")
           .agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channel_mix"),
                F.countDistinct("channel").alias("_n"))
           .where(F.col("_n") > 1)
           .join(_outcomes_per_customer(tables), "customer_id", "left"))
    rate = R(F.avg("converted") * 100, 2)
    return (per.groupBy("channel_mix")
            .agg(F.count(F.lit(1)).alias("customers"), F.sum("converted").cast("bigint").alias("conversions"),
                 rate.alias("conversion_rate_pct"), R(F.sum("revenue").cast("double"), 2).alias("total_revenue"))
            .where(F.col("customers") > min_customers)
            .orderBy(F.col("conversion_rate_pct").desc_nulls_last(), "channel_mix").limit(top))
