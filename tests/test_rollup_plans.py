"""Distinct counts of the roll-ups without multiplied rows."""
from adlift.operators import rollups
from adlift.sources.mapped import CampaignTables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_expand(tables):
    for f in (rollups.channel_rollup, rollups.spend_tier_performance):
        assert "Expand" not in _plan(f(tables)), f.__name__


def test_tier_without_exposures(spark, tables):
    shy = spark.createDataFrame([(1, 5000.0), (2, 10.0), (2, 10.0)], "customer_id long, historical_spend double")
    seen = spark.createDataFrame([(2, "c1"), (2, "c2")], "customer_id long, campaign_id string")
    won = spark.createDataFrame([(2, "c1", 1, 4.0)], "customer_id long, campaign_id string, converted int, revenue_generated double")
    got = {r.customer_segment: r for r in rollups.spend_tier_performance(CampaignTables(shy, tables.campaigns, seen, won)).collect()}
    assert tuple(got["High Spender"])[1:] == (1, 0, None, None, None, None)
    # a repeated customer row repeats its joined rows, but is one customer
    assert tuple(got["Low Spender"])[1:] == (1, 2, 2, 100.0, 8.0, 4.0)
