"""A/B statistics per campaign.

The reference computes scalar statistics in a Python loop per campaign. Here
every campaign is tested in one job: a conditional aggregate produces the arm
counts (one row per campaign) and the statistics are Column arithmetic on that
small frame. Only the Student-t functions of the Welch test need Python; they
run in an Arrow UDF over the aggregated rows (one per campaign), never per
exposure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlift.functions.guards import require_columns
from adlift.functions.numeric import round_half_away as R, safe_div
from adlift.functions.stats import two_sided_p, z_quantile
from adlift.functions.student import t_critical, two_sided_t
from adlift.sources.mapped import CampaignTables


def _check_alpha(alpha: float) -> None:
    if not (0 < alpha < 1):
        raise ValueError(f"alpha must be between 0 and 1, got {alpha}")


def ab_conversion(counts: DataFrame, alpha: float = 0.05, n_tests: int = 1, bonferroni: bool = False,
                  strict: bool = False) -> DataFrame:
    """two-proportion test over columns ``treatment_conversions, treatment_n,
    control_conversions, control_n``; one output row per input row.

    Pooled z (0 when the pooled SE is 0), two-sided normal p, unpooled CI at
    the (optionally Bonferroni-adjusted) alpha. ``strict`` turns the
    reference's argument checks into ``raise_error``.
    """
    _check_alpha(alpha)
    require_columns(counts, ["treatment_conversions", "treatment_n", "control_conversions", "control_n"], "counts")
    eff_alpha = alpha / n_tests if bonferroni else alpha
    zc = z_quantile(1 - eff_alpha / 2)
    tx, tn = F.col("treatment_conversions").cast("double"), F.col("treatment_n").cast("double")
    cx, cn = F.col("control_conversions").cast("double"), F.col("control_n").cast("double")
    df = counts
    if strict:
        bad = ((tn <= 0) | (cn <= 0) | (tx > tn) | (cx > cn))
        df = df.withColumn("_guard", F.when(bad, F.raise_error(F.lit("invalid counts: n must be > 0 and "
                                                                     "conversions <= n"))))
    tr, cr = safe_div(tx, tn), safe_div(cx, cn)   # an empty arm has no rate: its row's results are null
    lift = tr - cr
    pooled = safe_div(tx + cx, tn + cn)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (safe_div(F.lit(1.0), tn) + safe_div(F.lit(1.0), cn)))
    z = F.when(se > 0, safe_div(lift, se)).when(se.isNotNull(), F.lit(0.0))
    margin = F.lit(zc) * F.sqrt(safe_div(tr * (F.lit(1.0) - tr), tn) + safe_div(cr * (F.lit(1.0) - cr), cn))
    out = (df.withColumn("treatment_rate", tr).withColumn("control_rate", cr)
           .withColumn("absolute_lift", lift)
           .withColumn("relative_lift", F.when(cr > 0, lift / cr).otherwise(F.lit(0.0)))
           .withColumn("z_score", z))
    out = (out.withColumn("p_value", two_sided_p(F.col("z_score")))
           .withColumn("statistically_significant", F.col("p_value") < F.lit(eff_alpha))
           .withColumn("ci_lower", F.col("absolute_lift") - margin)
           .withColumn("ci_upper", F.col("absolute_lift") + margin)
           .withColumn("bonferroni_applied", F.lit(bonferroni))
           .withColumn("effective_alpha", F.lit(float(eff_alpha))))
    return out.drop("_guard") if strict else out


def ab_revenue(rows: DataFrame, by=("campaign_id",), alpha: float = 0.05) -> DataFrame:
    """Welch t-test on revenue of ALL exposed users (non-converters are 0).

    Means, sample variances and counts are one aggregate per group; t, the
    Welch-Satterthwaite df, the p-value and the CI follow on that small frame.
    """
    _check_alpha(alpha)
    require_columns(rows, ["treatment_group", "revenue_generated", *by], "rows")
    t, c = F.col("treatment_group") == 1, F.col("treatment_group") == 0
    rev = F.coalesce(F.col("revenue_generated").cast("double"), F.lit(0.0))
    agg = rows.groupBy(*by).agg(
        F.avg(F.when(t, rev)).alias("treatment_mean"), F.avg(F.when(c, rev)).alias("control_mean"),
        F.var_samp(F.when(t, rev)).alias("_vt"), F.var_samp(F.when(c, rev)).alias("_vc"),
        F.count(F.when(t, 1)).alias("treatment_n"), F.count(F.when(c, 1)).alias("control_n"))
    nt, nc = F.col("treatment_n").cast("double"), F.col("control_n").cast("double")
    at, ac = F.col("_vt") / nt, F.col("_vc") / nc
    se = F.sqrt(at + ac)
    den = at * at / (nt - 1) + ac * ac / (nc - 1)
    dfw = F.when(den > 0, (at + ac) * (at + ac) / den).otherwise(nt + nc - 2)
    lift = F.col("treatment_mean") - F.col("control_mean")
    out = (agg.withColumn("absolute_lift", lift)
           .withColumn("relative_lift", F.when(F.col("control_mean") > 0, lift / F.col("control_mean"))
                       .otherwise(F.lit(0.0)))
           .withColumn("_se", se).withColumn("welch_df", dfw)
           .withColumn("t_statistic", safe_div(lift, se)))
    out = (out.withColumn("p_value", two_sided_t("t_statistic", "welch_df"))
           .withColumn("_tcrit", t_critical("welch_df", alpha)))
    return (out.withColumn("statistically_significant", F.col("p_value") < F.lit(alpha))
            .withColumn("ci_lower", F.col("absolute_lift") - F.col("_tcrit") * F.col("_se"))
            .withColumn("ci_upper", F.col("absolute_lift") + F.col("_tcrit") * F.col("_se"))
            .drop("_vt", "_vc", "_se", "_tcrit"))


def incremental_revenue(treatment_revenue, treatment_n, control_revenue, control_n) -> Column:
    """canonical incremental revenue (per-user difference x treated n).
    Null when an arm is empty (the reference raises)."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    tn, cn = col(treatment_n).cast("double"), col(control_n).cast("double")
    return (safe_div(col(treatment_revenue), tn) - safe_div(col(control_revenue), cn)) * tn


def roi_columns(incremental, total_cost) -> dict[str, Column]:
    """profit, ROI and ROI %; zero cost gives ROI 0, negative cost raises."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    inc, cost = col(incremental).cast("double"), col(total_cost).cast("double")
    roi = (F.when(cost < 0, F.raise_error(F.lit("total_cost must be >= 0")))
           .when(cost == 0, F.lit(0.0)).otherwise((inc - cost) / cost))
    return {"profit": inc - cost, "roi": roi, "roi_percentage": roi * 100}


def min_sample_size(baseline, mde: float, power: float = 0.8, alpha: float = 0.05) -> Column:
    """per-arm sample size for a relative minimum detectable effect."""
    _check_alpha(alpha)
    if mde <= 0:
        raise ValueError("mde must be positive.")
    p1 = F.col(baseline) if isinstance(baseline, str) else baseline
    p2 = p1 * F.lit(1 + mde)
    zsum = z_quantile(1 - alpha / 2) + z_quantile(power)
    pbar = (p1 + p2) / 2
    n = F.lit(2.0) * pbar * (F.lit(1.0) - pbar) * F.lit(zsum * zsum) / ((p2 - p1) * (p2 - p1))
    return F.when((p1 > 0) & (p1 < 1), F.ceil(n)).otherwise(F.raise_error(F.lit("baseline_rate must be in (0, 1)")))


def bonferroni(df: DataFrame, p_col: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """family-wise correction over all rows of ``df`` (n = number of tests)."""
    _check_alpha(alpha)
    n = df.agg(F.count(F.lit(1)).alias("n_tests"))
    j = df.crossJoin(F.broadcast(n))
    return (j.withColumn("adjusted_alpha", F.lit(float(alpha)) / F.col("n_tests"))
            .withColumn("adjusted_p_value", F.least(F.col(p_col) * F.col("n_tests"), F.lit(1.0)))
            .withColumn("bonferroni_significant", F.col(p_col) < F.col("adjusted_alpha")))


def _shown(value: Column, digits: int) -> Column:
    """Rounded before printing, as engines print halves differently; a negative zero has no sign."""
    return F.format_string(f"%.{digits}f", R(value, digits))


def ab_verdict(df: DataFrame, small_effect: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """small-effect flag, SCALE / KILL / ITERATE, and a message in plain words.

    Takes the rows of the conversion test (``treatment_rate``, ``control_rate``) or of the revenue test
    (``treatment_mean``, ``control_mean``). The message also has the interval where the row has one, the effective alpha
    where it was corrected, and cost and ROI where ``total_cost`` is above zero and ``roi`` is there."""
    sig, rel, has = F.col("statistically_significant"), F.col("relative_lift"), set(df.columns)
    rec = (F.when(sig & (rel > small_effect), "SCALE")
           .when(sig & (rel < -small_effect), "KILL").otherwise("ITERATE"))
    parts = [F.concat(F.when(sig, F.lit("The arms differ")).otherwise("No proven difference"), F.lit(", p "), _shown(F.col("p_value"), 4))]
    if "treatment_rate" in has:
        parts.append(F.concat(F.lit("converted "), _shown(F.col("treatment_rate") * 100, 2), F.lit(" % of the treated and "),
                              _shown(F.col("control_rate") * 100, 2), F.lit(" % of the others")))
    elif "treatment_mean" in has:
        parts.append(F.concat(F.lit("a treated user brings "), _shown(F.col("treatment_mean"), 2), F.lit(", another "),
                              _shown(F.col("control_mean"), 2)))
    parts.append(F.concat(F.lit("lift of "), _shown(rel * 100, 2), F.lit(" %")))
    if {"ci_lower", "ci_upper"} <= has:
        parts.append(F.concat(F.lit(f"{(1 - alpha) * 100:g} % interval of the difference "), _shown(F.col("ci_lower"), 4), F.lit(" to "),
                              _shown(F.col("ci_upper"), 4)))
    if {"bonferroni_applied", "effective_alpha"} <= has:
        parts.append(F.when(F.col("bonferroni_applied"), F.concat(F.lit("tested at alpha "), _shown(F.col("effective_alpha"), 4))))
    parts.append(F.when(F.abs(rel) < small_effect, F.lit("too small to matter much")))
    if {"total_cost", "roi"} <= has:
        parts.append(F.when(F.col("total_cost") > 0, F.concat(
            F.lit("cost "), _shown(F.col("total_cost"), 2), F.lit(", ROI "), _shown(F.col("roi") * 100, 2), F.lit(" %"))))
    text = F.concat_ws("; ", *parts, F.concat(F.lit("verdict "), rec))
    return (df.withColumn("small_effect", F.abs(rel) < small_effect)
            .withColumn("recommendation", rec).withColumn("message", text))


def campaign_counts(tables: CampaignTables) -> DataFrame:
    """J2 + one aggregate: arm counts, revenue and treated cost per campaign."""
    o = tables.outcomes.select("customer_id", "campaign_id", "converted", "revenue_generated")
    facts = tables.exposures.join(o, ["customer_id", "campaign_id"], "left")
    t, c = F.col("treatment_group") == 1, F.col("treatment_group") == 0
    return facts.groupBy("campaign_id").agg(
        F.min("channel").alias("channel"),
        F.count(F.when(t, 1)).alias("treatment_n"), F.count(F.when(c, 1)).alias("control_n"),
        F.coalesce(F.sum(F.when(t, F.col("converted"))), F.lit(0)).cast("bigint").alias("treatment_conversions"),
        F.coalesce(F.sum(F.when(c, F.col("converted"))), F.lit(0)).cast("bigint").alias("control_conversions"),
        F.coalesce(F.sum(F.when(t, F.col("revenue_generated"))), F.lit(0)).cast("double").alias("treatment_revenue"),
        F.coalesce(F.sum(F.when(c, F.col("revenue_generated"))), F.lit(0)).cast("double").alias("control_revenue"),
        F.coalesce(F.sum(F.when(t, F.col("cost_per_contact"))), F.lit(0)).cast("double").alias("total_cost"))


def ab_all_campaigns(tables: CampaignTables, min_arm: int = 100, alpha: float = 0.05) -> DataFrame:
    """every campaign with more than ``min_arm`` users in both arms."""
    counts = campaign_counts(tables).where((F.col("treatment_n") > min_arm) & (F.col("control_n") > min_arm))
    tested = ab_conversion(counts, alpha=alpha)
    inc = incremental_revenue("treatment_revenue", "treatment_n", "control_revenue", "control_n")
    tested = tested.withColumn("incremental_revenue", inc)
    roi = roi_columns("incremental_revenue", "total_cost")["roi"]
    return tested.select("campaign_id", "channel", "treatment_rate", "control_rate", "relative_lift", "p_value",
                         F.col("statistically_significant").alias("significant"), "incremental_revenue",
                         roi.alias("roi"))


def ab_summary(results: DataFrame) -> DataFrame:
    """tested, significant wins and losses, inconclusive."""
    sig, rel = F.col("significant"), F.col("relative_lift")
    wins, losses = F.count_if(sig & (rel > 0)), F.count_if(sig & (rel < 0))
    return results.agg(F.count(F.lit(1)).alias("tested"), wins.alias("significant_wins"),
                       losses.alias("significant_losses"),
                       (F.count(F.lit(1)) - wins - losses).alias("inconclusive"))


def ab_verdicts(tables: CampaignTables, alpha: float = 0.05) -> DataFrame:
    """F11 over every campaign at once: conversion test plus verdict."""
    res = ab_verdict(ab_conversion(campaign_counts(tables), alpha=alpha))
    return res.select("campaign_id", "channel", "treatment_rate", "control_rate", "relative_lift", "p_value",
                      "statistically_significant", "small_effect", "recommendation")


def ab_messages(tables: CampaignTables, alpha: float = 0.05) -> DataFrame:
    """F7 over every campaign, in words: the conversion test at the Bonferroni-corrected alpha with cost and ROI, and the
    revenue test."""
    counts = campaign_counts(tables)
    n = counts.count()      # campaigns
    tested = ab_conversion(counts, alpha=alpha, n_tests=max(n, 1), bonferroni=True)
    tested = tested.withColumn("incremental_revenue", incremental_revenue("treatment_revenue", "treatment_n", "control_revenue", "control_n"))
    tested = tested.withColumn("roi", roi_columns("incremental_revenue", "total_cost")["roi"])
    conv = ab_verdict(tested, alpha=alpha / max(n, 1)).select("campaign_id", F.lit("conversion").alias("test"), "recommendation", "message")
    facts = tables.exposures.join(tables.outcomes.select("customer_id", "campaign_id", "revenue_generated"), ["customer_id", "campaign_id"], "left")
    rev = ab_verdict(ab_revenue(facts, alpha=alpha), alpha=alpha).select("campaign_id", F.lit("revenue").alias("test"), "recommendation", "message")
    return conv.unionByName(rev)


def ab_test(rows: DataFrame, by=("campaign_id",), cost: DataFrame | None = None,
            alpha: float = 0.05) -> DataFrame:
    """F8: ``run_campaign_test`` for every group at once: conversion test,
    Welch revenue test, incremental revenue and (when a positive cost is
    given per group in ``cost``) ROI."""
    require_columns(rows, ["treatment_group", "converted", "revenue_generated"], "campaign_data")
    t, c = F.col("treatment_group") == 1, F.col("treatment_group") == 0
    counts = rows.groupBy(*by).agg(
        F.count(F.when(t, 1)).alias("treatment_n"), F.count(F.when(c, 1)).alias("control_n"),
        F.coalesce(F.sum(F.when(t, F.col("converted"))), F.lit(0)).alias("treatment_conversions"),
        F.coalesce(F.sum(F.when(c, F.col("converted"))), F.lit(0)).alias("control_conversions"),
        F.coalesce(F.sum(F.when(t, F.col("revenue_generated"))), F.lit(0)).cast("double").alias("treatment_revenue"),
        F.coalesce(F.sum(F.when(c, F.col("revenue_generated"))), F.lit(0)).cast("double").alias("control_revenue"))
    conv = ab_conversion(counts, alpha=alpha)
    conv = conv.select(*by, "treatment_n", "control_n", "treatment_revenue", "control_revenue",
                       *[F.col(x).alias(f"conv_{x}") for x in ("treatment_rate", "control_rate", "absolute_lift",
                                                              "relative_lift", "z_score", "p_value",
                                                              "statistically_significant", "ci_lower", "ci_upper")])
    revenue = ab_revenue(rows, by=by, alpha=alpha).select(
        *by, *[F.col(x).alias(f"rev_{x}") for x in ("treatment_mean", "control_mean", "absolute_lift",
                                                    "relative_lift", "t_statistic", "welch_df", "p_value",
                                                    "statistically_significant", "ci_lower", "ci_upper")])
    out = conv.join(revenue, list(by)).withColumn(
        "incremental_revenue", incremental_revenue("treatment_revenue", "treatment_n", "control_revenue",
                                                   "control_n"))
    if cost is not None:
        out = out.join(cost, list(by), "left")
        r = roi_columns("incremental_revenue", "total_cost")
        has = F.col("total_cost") > 0
        out = out.select("*", *[F.when(has, v).alias(k) for k, v in r.items()])
    return out
