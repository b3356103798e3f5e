"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query derives the campaign tables from the driver tables at ``sf_dir``
and runs the library operator on the whole tables. ``oracle_sql()`` holds the
DuckDB twin of every SQL-expressible query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DecimalType

from adlift.operators import attribution as A
from adlift.functions.numeric import safe_div
from adlift.operators import abtest, audience, budget, curves, features, journey, kpi, quality, roi, rollups
from adlift.operators import response, report, sweep, uplift
from adlift.session import scratch_path, written
from adlift.sources import files
from adlift.sources.mapped import campaign_tables

Query = Callable[[SparkSession, str], DataFrame]


def doubles(df: DataFrame) -> DataFrame:
    """Registered outputs carry money as DOUBLE (DECIMAL sums stay internal)."""
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                      else F.col(f.name) for f in df.schema.fields])


def _t(fn) -> Query:
    """Query over the four-table bundle."""
    return lambda spark, sf_dir: fn(campaign_tables(spark, sf_dir))


def _p(fn) -> Query:
    """Query over the attribution pair table."""
    return lambda spark, sf_dir: fn(A.touchpoints(campaign_tables(spark, sf_dir)))


def _k(fn) -> Query:
    """Query over the campaign KPI table."""
    return lambda spark, sf_dir: fn(kpi.campaign_kpis(campaign_tables(spark, sf_dir)))


def _campaign_roi(t):
    return roi.campaign_roi(t.exposures, t.outcomes)


def _ab_conversion(t):
    return abtest.ab_conversion(abtest.campaign_counts(t)).select(
        "campaign_id", "treatment_n", "control_n", "treatment_conversions", "control_conversions", "treatment_rate",
        "control_rate", "absolute_lift", "relative_lift", "z_score", "p_value", "statistically_significant",
        "ci_lower", "ci_upper", "effective_alpha")


def _ab_incremental_roi(t):
    c = abtest.campaign_counts(t)
    c = c.withColumn("incremental_revenue", abtest.incremental_revenue(
        "treatment_revenue", "treatment_n", "control_revenue", "control_n"))
    r = abtest.roi_columns("incremental_revenue", "total_cost")
    return c.select("campaign_id", "incremental_revenue", *[v.alias(k) for k, v in r.items()])


def _ab_min_sample_size(t, mde: float = 0.1):
    c = abtest.campaign_counts(t).withColumn(
        "baseline_rate", safe_div("control_conversions", "control_n"))
    p = F.col("baseline_rate")
    need = F.when((p > 0) & (p < 1), abtest.min_sample_size(p, mde)).cast("bigint")
    return c.select("campaign_id", "baseline_rate", need.alias("required_n_per_arm"), "treatment_n", "control_n")


def _ab_campaign_test(t):
    facts = kpi.exposure_outcomes(t, "left")
    cost = abtest.campaign_counts(t).select("campaign_id", "total_cost")
    return abtest.ab_test(facts, cost=cost)


def _split(t):
    base = roi.modeling_base(t, treatment_only=True)
    return features.stratified_split(base.select("customer_id", "campaign_id",
                                                 F.col("converted").cast("double").alias("label"))).select("customer_id", "campaign_id", "label", "split")


def _rule_scores(t):
    return audience.observed_uplift_scores(roi.modeling_base(t))


def _labelled(t):
    s = _rule_scores(t).where(F.col("treatment_group") == 1)
    return s.select(F.col("converted").alias("label"), F.col("treatment_prob").alias("score"))


def _segmented(t):
    return uplift.segment_customers(_rule_scores(t))


def _audience_sample(t):
    n = int(t.customers.count() * 0.2)
    return audience.audience_sample(t.customers, n, seed=42).select("customer_id", "sample_key")


def _fitted_scores(t):
    """Every row with the probabilities of the two fitted models, written: the readers below pass over it several times."""
    base = written(roi.modeling_base(t), "base")
    return written(uplift.score_uplift(uplift.fit_uplift(base, folds=0), base), "scores")


def _fitted_report(t):
    """The report with the fitted models' targeting, as the whole analysis runs it."""
    r = _campaign_roi(t).checkpoint()
    return report.executive_report(r, roi.channel_performance(r), uplift.compare_targeting(_fitted_scores(t)))


def _uplift_models(t):
    return uplift.segment_customers(_fitted_scores(t)).select(
        "customer_id", "campaign_id", "treatment_prob", "control_prob", "uplift_score", "segment")


def _uplift_model_metrics(t):
    return uplift.fit_uplift(roi.modeling_base(t)).metrics


def _report(t):
    r = _campaign_roi(t).checkpoint()   # a row per campaign, read by every section
    comparison = uplift.compare_targeting(_rule_scores(t))
    return report.executive_report(r, roi.channel_performance(r), comparison)


def _folder(t, name: str) -> str:
    """A folder of its own in the shared folder for every run of a registered sink: no run overwrites what another reads."""
    return scratch_path(t.exposures.sparkSession, f"sinks/{name}-{uuid.uuid4().hex}")


def _csv_load(table: str):
    """The whole table written as CSV files and read back, bound by header name."""
    def run(t):
        paths = files.export_results({table: getattr(t, table)}, _folder(t, "csv"), fmt="csv")
        return files.read_csv_table(t.exposures.sparkSession, paths[table], table, T.LongType())
    return run


def _bucketed_load(t):
    """A2: facts loaded in buckets and joined where they lie."""
    buckets = int(t.exposures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loaded = files.load_tables(t, _folder(t, "loaded"), buckets, prefix="loaded")
    return kpi.exposure_outcomes(loaded)


def _view_totals(t):
    """A5: the four tables and a result as views, read by SQL text."""
    t.register("marketing_")
    files.register_view(_campaign_roi(t), "marketing_campaign_roi")
    return t.exposures.sparkSession.sql("""
        SELECT k.campaign_type, COUNT(*) AS campaigns, SUM(r.n_treatment + r.n_control) AS contacts,
               CAST(SUM(CAST(r.total_cost AS DECIMAL(18,2))) AS DOUBLE) AS total_cost
        FROM marketing_campaign_roi r JOIN marketing_campaigns k ON r.campaign_id = k.campaign_id
        GROUP BY k.campaign_type""")


def _exported_channels(t):
    """Dashboard files; the channel file is read back."""
    r = _campaign_roi(t)
    paths = files.export_results({"campaign_performance": r, "channel_effectiveness": roi.channel_performance(r)},
                                 _folder(t, "dashboard"), single_file=("channel_effectiveness",))
    return t.exposures.sparkSession.read.parquet(paths["channel_effectiveness"])


def _report_file(t):
    """The report written as text and read back; its lines."""
    path = _folder(t, "report")
    files.write_report_text(_report(t), path)
    return t.exposures.sparkSession.read.text(path).select(F.col("value").alias("text"))


def queries() -> dict[str, Query]:
    reg: dict[str, Query] = {
        # A: loads and sinks, written and read back
        "load_csv_customers": _t(_csv_load("customers")),
        "load_csv_campaigns": _t(_csv_load("campaigns")),
        "load_csv_exposures": _t(_csv_load("exposures")),
        "load_csv_outcomes": _t(_csv_load("outcomes")),
        "load_bucketed_facts": _t(_bucketed_load),
        "materialized_kpis": _t(lambda t: files.materialize(kpi.campaign_kpis(t), f"campaign_kpis-{uuid.uuid4().hex}")),
        "view_type_totals": _t(_view_totals),
        "export_channels": _t(_exported_channels),
        "report_file": _t(_report_file),
        # B: data quality
        "dq_row_counts": _t(quality.row_counts),
        "dq_null_keys": _t(quality.null_keys),
        "dq_orphan_exposures": _t(quality.orphan_exposures),
        "dq_customer_profile": _t(quality.customer_profile),
        "dq_campaign_profile": _t(quality.campaign_profile),
        "dq_domain_violations": _t(quality.domain_violations),
        "dq_duplicate_keys": _t(quality.duplicate_keys),
        "dq_orphan_refs": _t(quality.orphan_refs),
        # KPIs
        "campaign_kpis": _t(kpi.campaign_kpis),
        "kpi_top_performers": _k(kpi.top_performers),
        "channel_kpis": _k(kpi.channel_kpis),
        "kpi_weekly": _k(kpi.weekly_kpis),
        "kpi_by_campaign_type": _k(kpi.kpis_by_campaign_type),
        "kpi_cac_by_channel": _k(kpi.cac_by_channel),
        "kpi_efficiency_score": _k(kpi.efficiency_scores),
        "campaigns_to_kill": _k(kpi.campaigns_to_kill),
        "campaigns_to_scale": _k(kpi.campaigns_to_scale),
        "campaigns_to_optimize": _k(kpi.campaigns_to_optimize),
        "executive_kpis": _k(kpi.executive_kpis),
        "kpi_top_bottom": _k(kpi.top_bottom),
        "negative_roi_alerts": _k(kpi.negative_roi_alerts),
        # Workbook roll-ups
        "campaign_rollup": _t(rollups.campaign_rollup),
        "campaign_lift": _t(rollups.campaign_lift),
        "channel_rollup": _t(rollups.channel_rollup),
        "spend_tier_performance": _t(rollups.spend_tier_performance),
        "campaign_incremental": _t(rollups.campaign_incremental),
        "kill_list_simple_roi": _t(rollups.kill_list_simple_roi),
        "budget_by_simple_roi": _t(rollups.budget_by_simple_roi),
        # D: attribution and journeys
        "conversions": _t(A.conversions),
        "touchpoints": _t(A.touchpoints),
        "attr_last_touch": _t(sweep.last_touches),
        "attr_last_touch_campaign": _t(lambda t: A.last_touch_by_campaign(sweep.last_touches(t), t.campaigns)),
        "attr_last_touch_channel": _t(lambda t: A.last_touch_by_channel(sweep.last_touches(t))),
        "attr_linear": _p(A.linear),
        "attr_linear_campaign": _t(sweep.linear_by_campaign),
        "attr_time_decay": _p(A.time_decay),
        "attr_time_decay_campaign": _t(sweep.time_decay_by_campaign),
        "attr_model_comparison": _t(sweep.model_comparison),
        "journey_touch_stats": _t(lambda t: sweep.touch_stats(sweep.journeys(t))),
        "journey_sequences": _p(journey.journey_sequences),
        "attr_budget_shift": _t(sweep.budget_shift),
        "attr_last_touch_summary": _t(lambda t: A.last_touch_summary(sweep.last_touches(t))),
        "attr_linear_summary": _t(sweep.linear_summary),
        "attr_time_decay_summary": _t(sweep.time_decay_summary),
        "touch_conversion_curve": _t(journey.touch_conversion_curve),
        "channel_mix": _t(journey.channel_mix),
        # Python-path ROI frames
        "campaign_roi": _t(_campaign_roi),
        "channel_performance": _t(lambda t: roi.channel_performance(_campaign_roi(t))),
        "allocate_budget": _t(lambda t: budget.allocate_budget(roi.channel_performance(_campaign_roi(t)),
                                                              100000.0)),
        "budget_reallocation": _t(lambda t: budget.budget_reallocation(roi.channel_performance(_campaign_roi(t)))),
        "campaign_picks": _t(lambda t: roi.campaign_picks(_campaign_roi(t))),
        "modeling_base": _t(roi.modeling_base),
        # F: A/B statistics
        "ab_conversion": _t(_ab_conversion),
        "ab_revenue": _t(lambda t: abtest.ab_revenue(kpi.exposure_outcomes(t, "left"))),
        "ab_incremental_roi": _t(_ab_incremental_roi),
        "ab_min_sample_size": _t(_ab_min_sample_size),
        "ab_bonferroni": _t(lambda t: abtest.bonferroni(abtest.ab_all_campaigns(t)).select(
            "campaign_id", "p_value", "n_tests", "adjusted_alpha", "adjusted_p_value", "bonferroni_significant")),
        "ab_verdicts": _t(abtest.ab_verdicts),
        "ab_messages": _t(abtest.ab_messages),
        "ab_campaign_test": _t(_ab_campaign_test),
        "ab_all_campaigns": _t(abtest.ab_all_campaigns),
        "ab_summary": _t(lambda t: abtest.ab_summary(abtest.ab_all_campaigns(t))),
        # G: features, models, metrics, segments
        "features": _t(lambda t: features.add_features(roi.modeling_base(t, treatment_only=True)).select(
            "customer_id", "campaign_id", "spend_per_product", "high_value", "engagement_score")),
        "training_frame": _t(lambda t: features.training_frame(roi.modeling_base(t, treatment_only=True))),
        "stratified_split": _t(_split),
        "response_model": _t(lambda t: response.fit_response(roi.modeling_base(t, treatment_only=True))[1]),
        "feature_importance": _t(lambda t: response.feature_importance(
            response.fit_response(roi.modeling_base(t, treatment_only=True), folds=0)[0])),
        "uplift_models": _t(_uplift_models),
        "fitted_segment_summary": _t(lambda t: uplift.segment_summary(uplift.segment_customers(_fitted_scores(t)))),
        "fitted_targeting": _t(lambda t: uplift.compare_targeting(_fitted_scores(t))),
        "fitted_report": _t(_fitted_report),
        "uplift_model_metrics": _t(_uplift_model_metrics),
        "uplift_stats": _t(lambda t: uplift.uplift_stats(_rule_scores(t))),
        "roc_auc": _t(lambda t: curves.roc_auc(_labelled(t))),
        "average_precision": _t(lambda t: curves.average_precision(_labelled(t))),
        "curve_summary": _t(lambda t: curves.curve_summary(_labelled(t))),
        "roc_points": _t(lambda t: curves.roc_points(_labelled(t))),
        "pr_points": _t(lambda t: curves.pr_points(_labelled(t))),
        "uplift_segments": _t(lambda t: _segmented(t).select(
            "customer_id", "campaign_id", "treatment_prob", "control_prob", "uplift_score", "segment",
            "recommendation")),
        "segment_distribution": _t(lambda t: uplift.segment_distribution(_segmented(t))),
        "segment_summary": _t(lambda t: uplift.segment_summary(_segmented(t))),
        "targeting_comparison": _t(lambda t: uplift.compare_targeting(_rule_scores(t))),
        "uplift_histogram": _t(lambda t: curves.histogram(_rule_scores(t))),
        # H: audience tools
        "audience_sample": _t(_audience_sample),
        "assign_arms": _t(lambda t: audience.assign_arms(t.exposures).select(
            "customer_id", "campaign_id", "assigned_group")),
        "rule_propensity": _t(lambda t: roi.modeling_base(t).select(
            "customer_id", "campaign_id", audience.rule_propensity(None).alias("propensity"))),
        "attach_contact_cost": _t(lambda t: audience.attach_contact_cost(t.exposures).select(
            "customer_id", "campaign_id", "channel", "cost_per_contact")),
        # Report lines
        "executive_report": _t(_report),
    }
    return {k: (lambda f: lambda spark, sf_dir: doubles(f(spark, sf_dir)))(f) for k, f in reg.items()}


def oracle_sql() -> dict[str, str]:
    from adlift.plans import oracle
    out: dict[str, str] = {}
    for part in (oracle.A, oracle.B, oracle.E, oracle.D, oracle.F_, oracle.G, oracle.H):
        out.update(part)
    return out
