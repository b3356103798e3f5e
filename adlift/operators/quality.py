"""Data-quality checks over the four tables.

Every check is a distributed aggregate or anti join that returns a small
DataFrame; nothing is collected. Domain and NOT NULL checks of one table run
in a single pass (one ``agg`` of conditional counts, then unpivoted).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.sources.mapped import CampaignTables
from adlift.sources.schema import CAMPAIGN_TYPES, CHANNELS, GENDERS

_LABELS = {"customers": "Customers", "campaigns": "Campaigns", "exposures": "Exposures", "outcomes": "Outcomes"}


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: CampaignTables) -> DataFrame:
    """B1: rows per table."""
    return _stack([getattr(tables, t).agg(F.count(F.lit(1)).alias("row_count"))
                   .select(F.lit(label).alias("table_name"), "row_count")
                   for t, label in _LABELS.items()])


def null_keys(tables: CampaignTables) -> DataFrame:
    """B2: null primary keys and null treatment flags."""
    checks = [("NULL customer_id", tables.customers, "customer_id"),
              ("NULL campaign_id", tables.campaigns, "campaign_id"),
              ("NULL exposure treatment", tables.exposures, "treatment_group")]
    return _stack([df.agg(F.count_if(F.col(c).isNull()).alias("count")).select(F.lit(issue).alias("issue"), "count")
                   for issue, df, c in checks])


def orphan_exposures(tables: CampaignTables) -> DataFrame:
    """Exposures whose customer is missing (anti join)."""
    orphans = tables.exposures.select("customer_id").join(
        tables.customers.select("customer_id"), "customer_id", "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("count")).select(F.lit("Orphaned exposures").alias("issue"), "count")


def customer_profile(tables: CampaignTables, approximate: bool = False) -> DataFrame:
    """Distinct geographies and bands, age range, mean tenure."""
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.countDistinct(c))
    return tables.customers.agg(
        distinct("geography").alias("geographies"), distinct("income_band").alias("income_bands"),
        F.min("age").alias("min_age"), F.max("age").alias("max_age"),
        F.avg("customer_tenure").alias("avg_tenure"),
    ).select(F.lit("Customer Demographics").alias("metric"), "*")


def campaign_profile(tables: CampaignTables) -> DataFrame:
    """Campaign count, channels, earliest start, latest end."""
    return tables.campaigns.agg(
        F.count(F.lit(1)).alias("total_campaigns"), F.countDistinct("channel").alias("channels"),
        F.min("start_date").alias("earliest_campaign"), F.max("end_date").alias("latest_campaign"),
    ).select(F.lit("Campaign Summary").alias("metric"), "*")


# (table, check name, violation predicate) - CHECK constraints pass on NULL.
def _domain_checks():
    def out_of(c, values):
        return F.col(c).isNotNull() & ~F.col(c).isin(values)

    def null(c):
        return F.col(c).isNull()

    return {
        "customers": [("gender domain", out_of("gender", GENDERS))]
        + [(f"{c} not null", null(c)) for c in ("age", "geography", "income_band", "customer_tenure",
                                                 "historical_spend", "product_count")],
        "campaigns": [("channel domain", out_of("channel", CHANNELS)),
                      ("campaign_type domain", out_of("campaign_type", CAMPAIGN_TYPES))]
        + [(f"{c} not null", null(c)) for c in ("campaign_name", "channel", "start_date", "end_date")],
        "exposures": [("treatment_group domain", out_of("treatment_group", [0, 1]))]
        + [(f"{c} not null", null(c)) for c in ("customer_id", "campaign_id", "channel", "exposure_date",
                                                 "cost_per_contact", "treatment_group")],
        "outcomes": [("converted domain", out_of("converted", [0, 1]))]
        + [(f"{c} not null", null(c)) for c in ("customer_id", "campaign_id", "treatment_group", "converted",
                                                 "revenue_generated")],
    }


def domain_violations(tables: CampaignTables) -> DataFrame:
    """Rows breaking a domain or NOT NULL rule; one scan per table."""
    parts = []
    for table, checks in _domain_checks().items():
        counts = getattr(tables, table).agg(*[F.count_if(pred).alias(f"c{i}") for i, (_, pred) in enumerate(checks)])
        stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("violations"))
                                      for i, (name, _) in enumerate(checks)]))
        parts.append(counts.select(stacked.alias("s")).select(
            F.lit(table).alias("table_name"), "s.check_name", "s.violations"))
    return _stack(parts)


def duplicate_keys(tables: CampaignTables) -> DataFrame:
    """Keys that occur more than once, and the surplus rows they carry."""
    checks = [("customers", "customer_id", tables.customers, ["customer_id"]),
              ("campaigns", "campaign_id", tables.campaigns, ["campaign_id"]),
              ("exposures", "customer_id,campaign_id", tables.exposures, ["customer_id", "campaign_id"])]
    parts = []
    for table, label, df, keys in checks:
        dup = df.groupBy(*keys).count().where(F.col("count") > 1)
        parts.append(dup.agg(F.count(F.lit(1)).alias("duplicated_keys"),
                             F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"))
                     .select(F.lit(table).alias("table_name"), F.lit(label).alias("key_columns"),
                             "duplicated_keys", "surplus_rows"))
    return _stack(parts)


def orphan_refs(tables: CampaignTables) -> DataFrame:
    """The other foreign keys (exposure->campaign, outcome->customer, outcome->campaign)."""
    cust = tables.customers.select("customer_id")
    camp = tables.campaigns.select("campaign_id")
    edges = [("exposures.campaign_id", tables.exposures.select("campaign_id"), camp, "campaign_id"),
             ("outcomes.customer_id", tables.outcomes.select("customer_id"), cust, "customer_id"),
             ("outcomes.campaign_id", tables.outcomes.select("campaign_id"), camp, "campaign_id")]
    return _stack([child.join(parent, key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
                   .select(F.lit(label).alias("reference"), "orphans")
                   for label, child, parent, key in edges])
