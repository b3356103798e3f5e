"""Audience tools re-aimed from the reference's simulator (H1-H4).

The simulator draws random exposures; what a Spark user reuses from it is the
selection logic: weighted sampling of an audience, a deterministic 70/30 arm
split, the multiplicative response rule, and contact costs per channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlift.functions.numeric import safe_div
from adlift.functions.ranking import top_n_rows
from adlift.sources.schema import CHANNEL_COSTS, CHANNELS, INCOME_BANDS, MONEY

# Fixed values of the response rule: base rate, treatment multiplier, clip range,
# and the per-channel and per-income-band multipliers, in the model's order.
BASE_RATE = 0.04
TREATMENT_LIFT = 1.4
CLIP_LOW, CLIP_HIGH = 0.001, 0.15
CHANNEL_EFFECT = {"Email": 1.0, "Push": 0.8, "SMS": 1.1, "Paid Social": 0.9, "Search": 1.3}
INCOME_EFFECT = {"<30K": 0.7, "30-50K": 0.85, "50-75K": 1.0, "75-100K": 1.15, "100-150K": 1.25, ">150K": 1.4}


def hash_number(key: Column, seed: int) -> Column:
    """32 bits of the md5 of key and seed: any SQL engine gives the same, and nearby keys are independent."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from ``hash_number``."""
    return (hash_number(key, seed).cast("double") + 0.5) / 4294967296.0


def audience_sample(customers: DataFrame, n: int, seed: int = 42, key: str = "customer_id",
                    uniform: Column | None = None) -> DataFrame:
    """H1: weighted sample of ``n`` customers without replacement, weight
    (tenure + 1) * (spend + 1), by exponential keys (Efraimidis-Spirakis):
    the n smallest -ln(u) / w. The cut is exact rank arithmetic, not a global
    sort; the sample size is the feature."""
    u = uniform if uniform is not None else hash_uniform(F.col(key), seed)
    w = (F.col("customer_tenure") + 1) * (F.col("historical_spend") + 1)
    keyed = customers.withColumn("sample_key", -F.log(u) / w)
    return top_n_rows(keyed, "sample_key", n, [key], descending=False)


def assign_arms(exposures: DataFrame, treatment_share: float = 0.7, salt: int = 0) -> DataFrame:
    """H2: deterministic arm split per (customer, campaign) by hash."""
    camp = F.substring(F.col("campaign_id"), 6, 10).cast("bigint")
    u = hash_uniform(F.col("customer_id").cast("bigint") * 1000 + camp, salt)
    return exposures.withColumn("assigned_group", F.when(u < treatment_share, 1).otherwise(0))


def _lookup(col: str, table: dict[str, float]) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr


def rule_propensity(df: DataFrame, treated: Column | None = None) -> Column:
    """H3: the multiplicative conversion rule without noise, clipped."""
    t = F.col("treatment_group") if treated is None else treated
    p = (F.lit(BASE_RATE) * F.when(t == 1, F.lit(TREATMENT_LIFT)).otherwise(F.lit(1.0))
         * (F.lit(1.0) + F.col("customer_tenure") / 120.0 * 0.3)
         * (F.lit(1.0) + F.col("product_count") / 5.0 * 0.2)
         * _lookup("channel", CHANNEL_EFFECT) * _lookup("income_band", INCOME_EFFECT))
    return F.least(F.greatest(p, F.lit(CLIP_LOW)), F.lit(CLIP_HIGH))


def observed_uplift_scores(base: DataFrame) -> DataFrame:
    """Treated and control scores of every row: the converted share of its (channel, income band) in either arm,
    or of the whole arm where a cell has no row of that arm. One grouped sum over at most 30 cells, joined back."""
    # sums per cell first, so that the shares of a whole arm come from the few cells and ``base`` is read once
    sums = {f"_{what}{arm}": c for arm in (1, 0) for what, c in (
        ("won", F.sum(F.when(F.col("treatment_group") == arm, F.col("converted")))), ("n", F.count_if(F.col("treatment_group") == arm)))}
    cells = base.groupBy(F.col("channel").alias("_ch"), F.col("income_band").alias("_ib")).agg(*[c.alias(n) for n, c in sums.items()])
    every = Window.partitionBy(F.lit(0))    # over the cells

    def share(arm: int) -> Column:
        return F.coalesce(safe_div(f"_won{arm}", f"_n{arm}"), safe_div(F.sum(f"_won{arm}").over(every), F.sum(f"_n{arm}").over(every)))
    cells = cells.select("_ch", "_ib", share(1).alias("treatment_prob"), share(0).alias("control_prob"))
    same = F.col("channel").eqNullSafe(F.col("_ch")) & F.col("income_band").eqNullSafe(F.col("_ib"))
    return (base.join(F.broadcast(cells), same, "left").drop("_ch", "_ib")   # channels x income bands: a fixed domain
            .withColumn("uplift_score", F.col("treatment_prob") - F.col("control_prob")))


def attach_contact_cost(exposures: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """H4: cost per contact from the channel-cost dimension (5 rows, broadcast)."""
    if costs is None:
        spark = exposures.sparkSession
        costs = (spark.createDataFrame([(c, CHANNEL_COSTS[c]) for c in CHANNELS], "channel string, cost double")
                 .select("channel", F.col("cost").cast(MONEY).alias("cost_per_contact")))
    base = exposures.drop("cost_per_contact") if "cost_per_contact" in exposures.columns else exposures
    return base.join(F.broadcast(costs), "channel", "left")


__all__ = ["audience_sample", "assign_arms", "rule_propensity", "observed_uplift_scores", "attach_contact_cost",
           "hash_number", "hash_uniform", "INCOME_BANDS"]
