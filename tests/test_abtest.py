"""A/B statistics on the reference's literal cases."""
import pytest
from pyspark.sql import functions as F

from adlift.operators import abtest


def _counts(spark, rows):
    return spark.createDataFrame(rows, "treatment_conversions long, treatment_n long, control_conversions long, "
                                       "control_n long")


def test_conversion_lift_and_significance(spark):
    r = abtest.ab_conversion(_counts(spark, [(100, 1000, 50, 1000)])).first()
    assert r["treatment_rate"] == pytest.approx(0.10)
    assert r["relative_lift"] == pytest.approx(1.0)
    assert r["statistically_significant"]


def test_equal_arms_not_significant(spark):
    r = abtest.ab_conversion(_counts(spark, [(50, 1000, 50, 1000)])).first()
    assert not r["statistically_significant"]
    assert r["ci_lower"] < 0 < r["ci_upper"]


def test_bad_alpha_rejected(spark):
    with pytest.raises(ValueError):
        abtest.ab_conversion(_counts(spark, [(1, 10, 1, 10)]), alpha=1.5)


def test_incremental_and_roi(spark):
    df = spark.createDataFrame([(10000.0, 1000, 3000.0, 500, 2000.0), (3000.0, 1000, 4000.0, 500, 0.0),
                                (5000.0, 1000, 2500.0, 500, 0.0)], "tr double, tn long, cr double, cn long, cost double")
    inc = abtest.incremental_revenue("tr", "tn", "cr", "cn")
    rows = df.select(inc.alias("inc")).collect()
    assert [r["inc"] for r in rows] == pytest.approx([4000.0, -5000.0, 0.0])
    roi = abtest.roi_columns(F.lit(10000.0), F.lit(2000.0))
    r = spark.range(1).select(*[v.alias(k) for k, v in roi.items()]).first()
    assert r["roi"] == pytest.approx(4.0) and r["profit"] == pytest.approx(8000.0)
    zero = abtest.roi_columns(F.lit(5000.0), F.lit(0.0))["roi"]
    assert spark.range(1).select(zero).first()[0] == 0.0


def test_bonferroni(spark):
    df = spark.createDataFrame([(0.001,), (0.04,), (0.03,)], "p_value double")
    out = abtest.bonferroni(df).orderBy("p_value").collect()
    assert out[0]["adjusted_alpha"] == pytest.approx(0.05 / 3)
    assert [r["bonferroni_significant"] for r in out] == [True, False, False]
    capped = abtest.bonferroni(spark.createDataFrame([(0.9,), (0.8,)], "p_value double")).collect()
    assert all(r["adjusted_p_value"] == 1.0 for r in capped)


def test_min_sample_size_monotone(spark):
    df = spark.createDataFrame([(0.05,)], "p double")
    small = df.select(abtest.min_sample_size(F.col("p"), 0.10)).first()[0]
    large = df.select(abtest.min_sample_size(F.col("p"), 0.50)).first()[0]
    assert small > large > 0


def test_welch_zero_kept(spark):
    rows = [(1, 10.0), (1, 0.0), (1, 20.0), (1, 0.0), (0, 5.0), (0, 0.0), (0, 8.0), (0, 0.0)]
    df = spark.createDataFrame([("A", t, r) for t, r in rows], "campaign_id string, treatment_group int, "
                                                                 "revenue_generated double")
    r = abtest.ab_revenue(df).first()
    assert r["treatment_mean"] == pytest.approx(7.5) and r["control_mean"] == pytest.approx(3.25)
    assert 0 < r["p_value"] < 1 and r["ci_lower"] < r["absolute_lift"] < r["ci_upper"]


def test_verdict(spark):
    df = spark.createDataFrame([(True, 0.2, 0.001), (True, -0.2, 0.001), (False, 0.3, 0.4)],
                               "statistically_significant boolean, relative_lift double, p_value double")
    recs = [r["recommendation"] for r in abtest.ab_verdict(df).collect()]
    assert recs == ["SCALE", "KILL", "ITERATE"]
