"""Registered queries against their DuckDB oracle on sf0.001 (exact values,
doubles to 9 significant digits)."""
import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
KEYS = ["campaign_kpis", "channel_kpis", "kpi_weekly", "campaign_rollup", "spend_tier_performance",
        "budget_by_simple_roi", "dq_domain_violations", "attr_last_touch", "attr_linear_campaign",
        "attr_time_decay_campaign", "journey_sequences", "channel_mix", "campaign_roi", "ab_all_campaigns",
        "ab_min_sample_size", "ab_revenue", "ab_campaign_test", "ab_messages", "uplift_segments", "roc_auc", "audience_sample", "assign_arms", "modeling_base",
        "channel_rollup", "executive_report", "report_file", "load_csv_customers", "load_csv_outcomes", "load_bucketed_facts",
        "materialized_kpis", "view_type_totals", "export_channels"]


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["customer", "orders", "lineitem", "part"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    res = con.execute(entry.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert _canon(srows, scols) == _canon(orows, ocols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 12
    assert set(entry.queries()) >= set(entry.oracle_sql())
