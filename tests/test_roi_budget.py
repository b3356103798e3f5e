"""ROI frame, channel roll-up and budget allocation (reference fixtures)."""
import pytest

from adlift.operators import budget, roi


def test_campaign_roi_fixture(spark):
    # 10 exposures, 7 treated; outcomes as in the reference's unit fixture
    tg = [1, 1, 1, 1, 1, 1, 1, 0, 0, 0]
    conv = [1, 1, 1, 0, 0, 0, 0, 1, 0, 0]
    rev = [100, 80, 120, 0, 0, 0, 0, 90, 0, 0]
    e = spark.createDataFrame([(f"C{i}", "CAMP_001", "Email", 0.10, tg[i]) for i in range(10)],
                              "customer_id string, campaign_id string, channel string, cost_per_contact double, "
                              "treatment_group int")
    o = spark.createDataFrame([(f"C{i}", "CAMP_001", conv[i], float(rev[i])) for i in range(10)],
                              "customer_id string, campaign_id string, converted int, revenue_generated double")
    r = roi.campaign_roi(e, o).first()
    assert r["incremental_revenue"] == pytest.approx((300 / 7 - 90 / 3) * 7)
    assert r["total_cost"] == pytest.approx(0.7)
    assert r["roi"] == pytest.approx(((300 / 7 - 90 / 3) * 7 - 0.7) / 0.7)


def test_missing_column_guard(spark):
    e = spark.createDataFrame([("C1", "X")], "customer_id string, campaign_id string")
    with pytest.raises(ValueError):
        roi.campaign_roi(e, e)


def test_budget_sums_to_100_and_negative_is_zero(spark):
    perf = spark.createDataFrame([("Email", 2.0), ("SMS", -0.2), ("Push", 4.0)], "channel string, overall_roi double")
    out = {r["channel"]: r for r in budget.allocate_budget(perf, 1000.0).collect()}
    assert sum(r["recommended_pct"] for r in out.values()) == 100
    assert out["SMS"]["recommended_pct"] == 0
    assert all(float(r["recommended_pct"]).is_integer() for r in out.values())


def test_budget_all_negative_equal_split(spark):
    perf = spark.createDataFrame([("Email", -0.5), ("SMS", -0.6)], "channel string, overall_roi double")
    out = [r["recommended_pct"] for r in budget.allocate_budget(perf, 100.0).collect()]
    assert sorted(out) == [50.0, 50.0]


def test_channel_roi_from_totals_not_mean(spark):
    r = spark.createDataFrame([("A", "Email", 100.0, 0.0, 300.0, 2.0, 0.1, 0.05),
                               ("B", "Email", 300.0, 0.0, 300.0, 0.0, 0.1, 0.05)],
                              "campaign_id string, channel string, total_cost double, treatment_revenue double, "
                              "incremental_revenue double, roi double, treatment_conv_rate double, "
                              "conversion_lift double")
    ch = roi.channel_performance(r).first()
    assert ch["overall_roi"] == pytest.approx((600 - 400) / 400)
    assert ch["avg_roi"] == pytest.approx(1.0)
