"""The sweep against the pair table, and a journey too large for one."""
import datetime

from pyspark.sql import functions as F

from adlift.operators import attribution as A
from adlift.operators import sweep
from adlift.sources.mapped import CampaignTables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_touch_equals_pairs(tables):
    assert rows(sweep.last_touches(tables)) == rows(A.last_touch(A.touchpoints(tables)).select(*sweep.last_touches(tables).columns))


def test_credits_equal_pairs(tables):
    pairs = A.touchpoints(tables)
    for credited, swept in ((A.linear(pairs), sweep.linear_credits(tables, sweep.journeys(tables))),
                            (A.time_decay(pairs), sweep.decayed_rows(tables))):
        want = credited.groupBy(*sweep.JOURNEY).agg(
            F.count("*").alias("touches"), F.sum("cost_per_contact").cast("double").alias("cost"),
            F.sum(F.datediff("conversion_date", "exposure_date")).alias("days"),
            F.sum(F.col("attribution_credit").cast("decimal(38,4)")).cast("double").alias("credit"),
            F.sum(F.col("attributed_revenue").cast("decimal(38,2)")).cast("double").alias("revenue"))
        got = swept.select(*sweep.JOURNEY, "touches", F.col("cost").cast("double"), "days", F.col("credit").cast("double"),
                           F.col("revenue").cast("double"))
        assert rows(got) == rows(want)


def test_weights_equal_pairs(tables):
    """Half-lives of whole days, of parts of days, and so short that weights of long distances underflow."""
    for h in (7.0, 2.5, 0.25):
        t = A.time_decay(A.touchpoints(tables), half_life_days=h)
        want = {r[0]: r[1] for r in t.groupBy("customer_id").agg(F.sum("decay_weight")).collect()}
        got = {r[0]: r[1] for r in sweep.customer_totals(sweep.journeys(tables, h)).select("customer_id", "total_weight").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * want[k] for k in got)


def test_journey_of_many_touches(spark):
    """100,000 exposures and 100,000 conversions of one customer: ten billion pairs, none of them made."""
    n, first = 100_000, datetime.date(2015, 1, 1)
    start = F.lit(first)
    exposures = spark.range(n).select(
        F.lit(1).cast("long").alias("customer_id"), F.format_string("CAMP_%03d", F.col("id") % 5).alias("campaign_id"),
        F.lit("Email").alias("channel"), F.date_add(start, (F.col("id") % 3650).cast("int")).alias("exposure_date"),
        F.lit("0.10").cast("decimal(18,2)").alias("cost_per_contact"), F.lit(1).alias("treatment_group"))
    outcomes = spark.range(n).select(
        F.lit(1).cast("long").alias("customer_id"), F.lit("CAMP_001").alias("campaign_id"), F.lit(1).alias("treatment_group"),
        F.lit(1).alias("converted"), F.date_add(start, (F.col("id") % 3650).cast("int")).alias("conversion_date"),
        (F.col("id") / 100).cast("decimal(18,2)").alias("revenue_generated"))
    campaigns = spark.createDataFrame([(f"CAMP_{i:03d}", f"c{i}") for i in range(5)], "campaign_id string, campaign_name string")
    tables = CampaignTables(customers=None, campaigns=campaigns, exposures=exposures, outcomes=outcomes)
    per_day = [n // 3650 + (d < n % 3650) for d in range(3650)]
    ahead, pairs = 0, 0
    for d in range(3649, -1, -1):
        ahead += per_day[d]
        pairs += per_day[d] * ahead
    assert sweep.touch_stats(sweep.journeys(tables)).first()["max_touches"] == pairs
    plan = sweep.journeys(tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    linear = sweep.linear_summary(tables).collect()
    assert len(linear) == 5 and abs(sum(r.conversions_attributed for r in linear) - 1) < 0.03
    decay = sweep.time_decay_summary(tables).collect()
    assert len(decay) == 5 and abs(sum(r.conversions_attributed for r in decay) - 1) < 0.03
    # every share is far below the last kept digit, so all rounded credits are zero
    assert {r.total_conversions_credited for r in sweep.linear_by_campaign(tables).collect()} == {0.0}
