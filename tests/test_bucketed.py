"""Facts loaded in buckets: joins of exposures and outcomes without a shuffle below them."""
import itertools

import pytest

from adlift.operators import abtest, kpi, roi
from adlift.sources.files import load_tables


def shuffles_below_join(df):
    """Exchanges in the subtree of the plan's fact join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = max(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "customer_id" in line)
    below = itertools.takewhile(lambda i: depth[i] > depth[at], range(at + 1, len(lines)))
    return sum("Exchange" in lines[i] for i in below)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_fact_joins_do_not_shuffle(spark, tables, no_broadcast):
    for query in (kpi.campaign_kpis(tables), roi.campaign_roi(tables.exposures, tables.outcomes), abtest.ab_all_campaigns(tables)):
        assert shuffles_below_join(query) == 0


def test_load_tables_round_trip(spark, tables, tmp_path, no_broadcast):
    loaded = load_tables(tables, str(tmp_path), buckets=4, prefix="roundtrip")
    for name in ("customers", "campaigns", "exposures", "outcomes"):
        a, b = getattr(tables, name), getattr(loaded, name)
        assert a.schema.names == b.schema.names and a.count() == b.count() and a.exceptAll(b).count() == 0
    assert shuffles_below_join(roi.campaign_roi(loaded.exposures, loaded.outcomes)) == 0
    plain = load_tables(tables, f"{tmp_path}/plain")
    assert plain.outcomes.exceptAll(tables.outcomes).count() == 0
    spark.sql("DROP TABLE roundtrip_exposures")
    spark.sql("DROP TABLE roundtrip_outcomes")
