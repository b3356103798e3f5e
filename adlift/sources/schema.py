"""Schemas of the four campaign tables and the fixed domains of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model (domains of the reference's CHECK constraints,
# the ordered income bands and the per-channel contact costs of its config).
CHANNELS = ["Email", "Push", "SMS", "Paid Social", "Search"]
CAMPAIGN_TYPES = ["Acquisition", "Retention", "Winback", "Cross-sell"]
GENDERS = ["M", "F", "Other"]
INCOME_BANDS = ["<30K", "30-50K", "50-75K", "75-100K", "100-150K", ">150K"]
CHANNEL_COSTS = {"Email": 0.10, "Push": 0.05, "SMS": 0.15, "Paid Social": 2.50, "Search": 3.00}

MONEY = T.DecimalType(18, 2)


def customers_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("customer_id", id_type, False),
        T.StructField("age", T.IntegerType(), False),
        T.StructField("gender", T.StringType(), True),
        T.StructField("geography", T.StringType(), False),
        T.StructField("income_band", T.StringType(), False),
        T.StructField("customer_tenure", T.IntegerType(), False),
        T.StructField("historical_spend", T.DoubleType(), False),
        T.StructField("product_count", T.IntegerType(), False),
    ])


CAMPAIGNS_SCHEMA = T.StructType([
    T.StructField("campaign_id", T.StringType(), False),
    T.StructField("campaign_name", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("campaign_type", T.StringType(), True),
    T.StructField("start_date", T.DateType(), False),
    T.StructField("end_date", T.DateType(), False),
])


def exposures_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("customer_id", id_type, False),
        T.StructField("campaign_id", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("exposure_date", T.DateType(), False),
        T.StructField("cost_per_contact", MONEY, False),
        T.StructField("treatment_group", T.IntegerType(), False),
    ])


def outcomes_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("customer_id", id_type, False),
        T.StructField("campaign_id", T.StringType(), False),
        T.StructField("treatment_group", T.IntegerType(), False),
        T.StructField("converted", T.IntegerType(), False),
        T.StructField("conversion_date", T.DateType(), True),
        T.StructField("revenue_generated", MONEY, False),
    ])


def schema_for(table: str, id_type: T.DataType = T.StringType()) -> T.StructType:
    return {
        "customers": customers_schema(id_type),
        "campaigns": CAMPAIGNS_SCHEMA,
        "exposures": exposures_schema(id_type),
        "outcomes": outcomes_schema(id_type),
    }[table]


def channel_costs_df(spark):
    """The channel-cost dimension as a 5-row DataFrame (fixed size, broadcastable)."""
    rows = [(ch, CHANNEL_COSTS[ch]) for ch in CHANNELS]
    return (spark.createDataFrame(rows, "channel string, cost double")
            .selectExpr("channel", "CAST(cost AS DECIMAL(18,2)) AS cost_per_contact"))
