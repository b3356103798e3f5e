"""Two-model (T-learner) uplift, quadrant segments and targeting.

Segmenting and targeting work on any frame holding ``treatment_prob`` and
``control_prob`` (model scores or the rule-based scores of ``audience``).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.functions.guards import require_columns
from adlift.functions.ranking import exact_medians, top_n_rows
from adlift.operators.response import ResponseModel, fit_responses, model_inputs, with_probability
from adlift.session import written

log = logging.getLogger(__name__)

# Segment labels and their recommendations.
SEGMENTS = ["Persuadables", "Sure Things", "Lost Causes", "Sleeping Dogs"]
RECOMMENDATIONS = {
    "Persuadables": "TARGET — high incremental impact",
    "Sure Things": "OPTIONAL — will convert anyway",
    "Lost Causes": "SUPPRESS — low conversion probability",
    "Sleeping Dogs": "NEVER TARGET — campaign hurts conversion",
}


@dataclass
class UpliftModels:
    treatment: ResponseModel
    control: ResponseModel
    metrics: DataFrame


def fit_uplift(df: DataFrame, seed: int = 42, folds: int = 5, max_iter: int = 1000) -> UpliftModels:
    """One response model on treated rows, one on control rows."""
    require_columns(df, ["treatment_group", "converted"], "uplift input")
    df = written(model_inputs(df, "treatment_group"), "uplift")     # both arms and their sizes are read from it
    t = df.where(F.col("treatment_group") == 1)
    c = df.where(F.col("treatment_group") == 0)
    sizes = df.agg(F.count_if(F.col("treatment_group") == 1).alias("t"),
                   F.count_if(F.col("treatment_group") == 0).alias("c")).first()
    if sizes["t"] < 100 or sizes["c"] < 100:
        log.warning("Small group sizes: treatment=%d, control=%d.", sizes["t"], sizes["c"])
    models, metrics = fit_responses({"treatment": t, "control": c}, seed=seed, folds=folds, max_iter=max_iter)
    return UpliftModels(models["treatment"], models["control"], metrics)


def score_uplift(models: UpliftModels, df: DataFrame) -> DataFrame:
    """Both probabilities and their difference for every row."""
    both = with_probability(models.control, with_probability(models.treatment, df, "treatment_prob"), "control_prob")
    return both.withColumn("uplift_score", F.col("treatment_prob") - F.col("control_prob"))


def uplift_stats(scored: DataFrame) -> DataFrame:
    """Mean uplift and the share of rows above zero, in percent."""
    return scored.agg(F.avg("uplift_score").alias("mean_uplift"),
                      (F.avg((F.col("uplift_score") > 0).cast("double")) * 100).alias("positive_pct"))


def segment_customers(df: DataFrame, approx: bool = False, accuracy: int = 100_000) -> DataFrame:
    """Quadrants by strict ``>`` against the median of each probability.
    The exact medians come from distributed ranks, as one row; ``approx`` uses
    ``percentile_approx``."""
    require_columns(df, ["treatment_prob", "control_prob"], "segment input")
    names = {"treatment_prob": "_tm", "control_prob": "_cm"}
    meds = (df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(a) for c, a in names.items()]) if approx
            else exact_medians(df, names))
    j = df.crossJoin(F.broadcast(meds))
    hi_t, hi_c = F.col("treatment_prob") > F.col("_tm"), F.col("control_prob") > F.col("_cm")
    seg = (F.when(hi_t & ~hi_c, SEGMENTS[0]).when(hi_t & hi_c, SEGMENTS[1])
           .when(~hi_t & ~hi_c, SEGMENTS[2]).when(~hi_t & hi_c, SEGMENTS[3]).otherwise("Unknown"))
    rec = F.create_map(*[x for k, v in RECOMMENDATIONS.items() for x in (F.lit(k), F.lit(v))])
    return (j.withColumn("segment", seg).withColumn("recommendation", rec[F.col("segment")])
            .drop("_tm", "_cm"))


def segment_distribution(segmented: DataFrame) -> DataFrame:
    """Rows, share of rows and recommendation per segment."""
    tot = segmented.agg(F.count(F.lit(1)).alias("_n"))
    per = segmented.groupBy("segment", "recommendation").agg(F.count(F.lit(1)).alias("count"))
    return (per.crossJoin(F.broadcast(tot))
            .select("segment", "count", (F.col("count") * 100.0 / F.col("_n")).alias("pct"), "recommendation")
            .orderBy(F.col("count").desc(), "segment"))


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Per segment: rows, mean uplift and mean probabilities."""
    return (segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"), F.avg("uplift_score").alias("avg_uplift_score"),
        F.avg("treatment_prob").alias("avg_treatment_prob"), F.avg("control_prob").alias("avg_control_prob"))
        .orderBy("segment"))


def compare_targeting(df: DataFrame, share: float = 0.3, mean_revenue: float | None = None,
                      key: list[str] | None = None) -> DataFrame:
    """Target the top ``floor(share * N)`` rows by treatment probability
    (response model) versus by uplift; value each as sum(uplift) x mean
    revenue of converters. Ties go to the smaller key. The top sets are cut
    with exact rank arithmetic (no global sort into one task)."""
    require_columns(df, ["treatment_prob", "uplift_score"], "targeting input")
    key = key or [k for k in ("customer_id", "campaign_id") if k in df.columns]
    if mean_revenue is None and "revenue_generated" not in df.columns:
        raise ValueError("mean_revenue must be supplied when revenue_generated is absent.")
    # the scores are read several times below, a column or two at a time
    cols = [*key, "treatment_prob", "uplift_score"] + [c for c in ("converted", "revenue_generated") if c in df.columns]
    df = written(df.select(*cols), "targeting")
    conv = F.col("converted") == 1 if "converted" in df.columns else F.lit(False)
    rev = F.col("revenue_generated").cast("double") if "revenue_generated" in df.columns else F.lit(None)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(conv, rev)).alias("c"), F.avg(rev).alias("a")).first()
    n = int(r["n"] * share)
    if mean_revenue is None:
        mean_revenue = float(r["c"] if r["c"] is not None else r["a"])
    # decimal sums: order-independent, so equal target sets give exactly equal revenue
    from pyspark.sql.types import DecimalType
    exact = F.sum(F.col("uplift_score").cast(DecimalType(38, 18))).cast("double")
    resp = top_n_rows(df, "treatment_prob", n, key).agg(exact.alias("_r"))
    upl = top_n_rows(df, "uplift_score", n, key).agg(exact.alias("_u"))
    m = F.lit(float(mean_revenue))
    out = resp.crossJoin(upl).select(
        (F.coalesce(F.col("_r"), F.lit(0.0)) * m).alias("response_model_revenue"),
        (F.coalesce(F.col("_u"), F.lit(0.0)) * m).alias("uplift_model_revenue"))
    imp = F.when(F.col("response_model_revenue") != 0,
                 (F.col("uplift_model_revenue") - F.col("response_model_revenue"))
                 / F.abs(F.col("response_model_revenue"))).otherwise(F.lit(0.0))
    return out.select("*", imp.alias("improvement"), (imp * 100).alias("improvement_pct"),
                      F.lit(n).alias("n_targeted"), m.alias("mean_revenue_per_uplift_unit"))
