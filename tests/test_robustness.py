"""Zero denominators, exact quotas, independent arms and hot customers."""

from pyspark.sql import functions as F

from adlift.operators import abtest, attribution, audience, budget, curves, features
from adlift.sources.mapped import CampaignTables


def test_empty_arm_gives_nulls_and_spares_other_rows(spark):
    counts = spark.createDataFrame([("a", 10, 100, 5, 100), ("b", 3, 50, 0, 0), ("c", 0, 1, 0, 1)],
                                   "campaign_id string, treatment_conversions long, treatment_n long, control_conversions long, control_n long")
    got = {r.campaign_id: r for r in abtest.ab_conversion(counts).collect()}
    assert got["b"].p_value is None and got["b"].control_rate is None and got["b"].treatment_rate == 0.06
    assert 0 < got["a"].p_value < 1 and got["c"].z_score == 0.0


def test_budget_without_positive_return_or_cost(spark):
    perf = spark.createDataFrame([("Email", 0.0, -0.5), ("SMS", 0.0, -1.0)], "channel string, total_cost double, overall_roi double")
    assert [tuple(r)[3:] for r in budget.budget_reallocation(perf).collect()] == [(0.0, 0.0, 0.0, 0.0)] * 2


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    assert curves.roc_auc(df).first()["roc_auc"] is None
    assert curves.average_precision(df.withColumn("label", F.lit(0))).first()[0] is None
    assert all(r.fpr is None for r in curves.roc_points(df).collect())


def test_features_without_spend(spark):
    df = spark.createDataFrame([(0.0, 1, 12)], "historical_spend double, product_count int, customer_tenure int")
    assert abs(features.add_features(df).first()["engagement_score"] - 0.1) < 1e-9


def test_quotas_are_exact(spark):
    df = spark.range(5003).select(F.col("id").alias("customer_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    for label, n, test in features.stratified_split(df, keys=["customer_id"]).groupBy("label").agg(
            F.count("*"), F.count_if(F.col("split") == "test")).collect():
        assert abs(test - 0.2 * n) < 1
    folds = features.stratified_folds(df, 5, keys=["customer_id"]).groupBy("label", "_fold").count().collect()
    assert len(folds) == 10
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.label == label]
        assert max(sizes) - min(sizes) <= 1


def test_arms_of_a_customer_are_independent(spark):
    df = spark.range(4000).select(F.col("id").alias("customer_id"), F.explode(F.array(
        *[F.lit(f"CAMP_{i:03d}") for i in range(1, 13)])).alias("campaign_id"))
    arms = audience.assign_arms(df).groupBy("customer_id").pivot("campaign_id").agg(F.first("assigned_group"))
    assert arms.drop("customer_id").distinct().count() > 500
    assert abs(arms.select(F.corr("CAMP_001", "CAMP_002")).first()[0]) < 0.06


def test_hot_customer(spark):
    """One customer with most rows: salted pairs are the plain pairs."""
    day = F.expr("date_add(date'2024-01-01', cast(id % 50 as int))")
    e = spark.range(400).select(F.when(F.col("id") < 360, 1).otherwise(F.col("id")).alias("customer_id"),
                                F.concat(F.lit("CAMP_"), (F.col("id") % 9).cast("string")).alias("campaign_id"),
                                F.lit("Email").alias("channel"), day.alias("exposure_date"), F.lit(1.0).alias("cost_per_contact"))
    o = spark.range(30).select(F.when(F.col("id") < 25, 1).otherwise(360 + F.col("id")).alias("customer_id"), F.lit(1).alias("converted"),
                               day.alias("conversion_date"), F.col("id").cast("double").alias("revenue_generated"))
    t = CampaignTables(customers=None, campaigns=None, exposures=e, outcomes=o)
    got = sorted(map(tuple, attribution.touchpoints(t).collect()))
    plain = e.join(attribution.conversions(t), "customer_id").where("exposure_date <= conversion_date")
    assert got == sorted(map(tuple, plain.select(*attribution.PAIR_COLUMNS).collect())) and len(got) > 2000
