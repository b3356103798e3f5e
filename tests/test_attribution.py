"""Attribution invariants and skew handling on the sf0.001 campaign tables."""
from pyspark.sql import functions as F

from adlift.operators import attribution as A


def test_fixture_counts(tables):
    assert tables.exposures.count() == 1644
    assert tables.outcomes.agg(F.sum("converted")).first()[0] == 332
    assert A.touchpoints(tables).count() == 3354


def test_linear_credit_sums_to_one(tables):
    lin = A.linear(A.touchpoints(tables))
    bad = lin.groupBy("customer_id").agg(F.sum("attribution_credit").alias("s")) \
             .where(F.abs(F.col("s") - 1) > 0.01 * F.lit(1)).count()
    assert bad == 0


def test_time_decay_shares_sum_to_one(tables):
    td = A.time_decay(A.touchpoints(tables))
    s = td.groupBy("customer_id").agg(F.sum(F.col("decay_weight") / F.col("total_weight")).alias("s"))
    assert s.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_last_touch_one_row_per_customer(tables):
    lt = A.last_touch(A.touchpoints(tables))
    assert lt.count() == lt.select("customer_id").distinct().count() == 131


def test_salted_pairs_equal_plain(tables):
    plain = A.touchpoints(tables)
    salted = A.touchpoints(tables, salt_buckets=7)
    assert plain.count() == salted.count()
    assert plain.exceptAll(salted).count() == 0


def test_conversion_scope(tables):
    lt = A.attribute(tables, "last_touch", scope="conversion")
    assert lt.count() == A.touchpoints(tables).select("customer_id", "conversion_date", "revenue_generated") \
        .distinct().count()
