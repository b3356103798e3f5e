"""Conversions, touchpoints and the pairwise credits (D1-D6, D8, D14); totals that need no pairs are in ``sweep``.

Semantics kept from the reference: credit is shared per *customer* (all of a
customer's (exposure, conversion) pairs form one journey), control exposures
take part, identical conversions are merged, and ties get a total order
(exposure_date desc, campaign_id, conversion_date, revenue).

Scale notes. The pair table J6 is an equi-join on customer_id with a residual
``exposure_date <= conversion_date``; it is quadratic per customer by
definition. Per-customer quantities are computed as aggregates, never as
``Window.partitionBy(customer)``: the last touch is ``min(struct(order...))``
and the touch count / weight total is a ``groupBy`` joined back, so partial
aggregation runs map-side and a hot customer is never sorted in one task. J6
salts every customer the same way, and AQE splits skewed partitions of the
join-back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.functions.numeric import round_half_away as R, safe_div
from adlift.sources.mapped import CampaignTables

SALTS = 4
CUSTOMER = ("customer_id",)
CONVERSION = ("customer_id", "conversion_date", "revenue_generated")
PAIR_COLUMNS = ["customer_id", "campaign_id", "channel", "exposure_date", "cost_per_contact",
                "conversion_date", "revenue_generated"]


def conversions(tables: CampaignTables) -> DataFrame:
    """Distinct (customer, conversion date, revenue) of converted outcomes."""
    return (tables.outcomes.where(F.col("converted") == 1)
            .select("customer_id", "conversion_date", "revenue_generated").distinct())


def touchpoints(tables: CampaignTables, salt_buckets: int = SALTS, conv: DataFrame | None = None) -> DataFrame:
    """Every exposure paired with every later-or-same-day conversion of
    the same customer.

    Every customer's exposures are spread over ``salt_buckets`` salts by campaign
    and the (fewer) conversions are repeated once per salt, so the pairs of one
    customer are made by several tasks, whoever is hot. Each pair is made once.
    """
    conv = conversions(tables) if conv is None else conv
    e = tables.exposures.select("customer_id", "campaign_id", "channel", "exposure_date", "cost_per_contact")
    salt = F.pmod(F.xxhash64("campaign_id", "exposure_date"), F.lit(salt_buckets)).cast("int")
    es = e.withColumn("_salt", salt)
    cs = conv.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    cond = F.col("exposure_date") <= F.col("conversion_date")
    return es.join(cs, ["customer_id", "_salt"]).where(cond).select(*PAIR_COLUMNS)


# ---------------------------------------------------------------------------
# Last touch
# ---------------------------------------------------------------------------

def last_touch(pairs: DataFrame, keys=CUSTOMER) -> DataFrame:
    """D3: the most recent touch per journey, credit 1.0 (one row per customer)."""
    pick = F.min(F.struct(
        (-F.unix_date("exposure_date")).alias("k1"), F.col("campaign_id").alias("k2"),
        F.col("conversion_date").alias("k3"), F.col("revenue_generated").alias("k4"),
        F.col("channel"), F.col("exposure_date"), F.col("cost_per_contact"))).alias("t")
    return (pairs.groupBy(*keys).agg(pick)
            .select(F.col("customer_id"), F.col("t.k2").alias("campaign_id"), "t.channel", "t.exposure_date",
                    "t.cost_per_contact", F.col("t.k3").alias("conversion_date"),
                    F.col("t.k4").alias("revenue_generated"), F.lit(1.0).alias("attribution_credit")))


def roi_pct(rev, cost):
    return R(safe_div(rev - cost, cost) * 100, 2)


def last_touch_by_campaign(lt: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Per campaign: customers, revenue, cost, profit, ROI %."""
    agg = lt.groupBy("campaign_id", "channel").agg(
        F.countDistinct("customer_id").alias("conversions_attributed"),
        F.sum("revenue_generated").alias("_rev"), F.sum("cost_per_contact").alias("_cost"))
    rev, cost = F.col("_rev").cast("double"), F.col("_cost").cast("double")
    return (agg.join(campaigns.select("campaign_id", "campaign_name"), "campaign_id")
            .select("campaign_id", "campaign_name", "channel", "conversions_attributed",
                    rev.alias("revenue_attributed"), cost.alias("total_cost"),
                    (F.col("_rev") - F.col("_cost")).cast("double").alias("profit"),
                    roi_pct(rev, cost).alias("roi_percentage"))
            .orderBy(F.col("roi_percentage").desc_nulls_last(), "campaign_id"))


def last_touch_by_channel(lt: DataFrame) -> DataFrame:
    """Per channel, with average revenue per attributed conversion."""
    agg = lt.groupBy("channel").agg(
        F.countDistinct("customer_id").alias("total_conversions"),
        F.sum("revenue_generated").cast("double").alias("total_revenue"),
        F.sum("cost_per_contact").cast("double").alias("total_cost"),
        F.count("revenue_generated").alias("_n"))
    return (agg.select("channel", "total_conversions", "total_revenue", "total_cost",
                       R(safe_div("total_revenue", "_n"), 2).alias("avg_revenue_per_conversion"),
                       roi_pct(F.col("total_revenue"), F.col("total_cost")).alias("channel_roi_pct"))
            .orderBy(F.col("channel_roi_pct").desc_nulls_last(), "channel"))


# ---------------------------------------------------------------------------
# Linear and time decay
# ---------------------------------------------------------------------------

def _journey_totals(pairs: DataFrame, half_life_days: float | None, keys=CUSTOMER) -> DataFrame:
    """Touch count and decay-weight total per journey.

    A plain ``sum`` of doubles depends on the order rows arrive in, so results
    could flip at rounding boundaries between runs. For a whole-day half-life
    h the weights depend only on (q, r) = divmod(days, h): pairs are first
    counted per (journey, q, r), one term a distinct day however many pairs a
    journey has, and count times weight is added in sorted order.
    Deterministic, and bounded per journey by the days of history.
    """
    if half_life_days is None:
        return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_touches"))
    h = float(half_life_days)
    if not (h.is_integer() and h >= 1):
        return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_touches"),
                                        F.sum(_decay(half_life_days)).alias("total_weight"))
    hi = int(h)
    days = F.datediff(F.col("conversion_date"), F.col("exposure_date"))
    per = (pairs.groupBy(*keys, F.floor(days / F.lit(hi)).alias("_q"), F.pmod(days, F.lit(hi)).alias("_r"))
           .agg(F.count(F.lit(1)).alias("_n")))
    consts = F.array(*[F.lit(c) for c in decay_constants(hi)])
    terms = F.array_sort(F.collect_list(F.struct("_q", "_r", "_n")))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: (
        acc + t["_n"].cast("double") * (F.element_at(consts, t["_r"] + 1) * F.pow(F.lit(2.0), -t["_q"]))))
    return per.groupBy(*keys).agg(F.sum("_n").alias("total_touches"), total.alias("total_weight"))


def _days(pairs_conv="conversion_date", pairs_exp="exposure_date"):
    return F.datediff(F.col(pairs_conv), F.col(pairs_exp)).cast("double")


def decay_constants(half_life_days: int) -> list[float]:
    """0.5^(r / h) for r = 0 .. h-1, computed on the driver by rule."""
    return [0.5 ** (r / half_life_days) for r in range(half_life_days)]


def decay_weight(days, half_life_days: float):
    """0.5^(days / half_life) of an integer column. For a whole-day half-life h the exponent
    splits as days = q*h + r, so the weight is an exact power of two times one of h
    driver-side constants: identical bits in every engine (``pow`` differs by an
    ulp between JVM and C libraries)."""
    h = float(half_life_days)
    if h.is_integer() and h >= 1:
        hi = int(h)
        consts = F.array(*[F.lit(c) for c in decay_constants(hi)])
        q, rem = F.floor(days / F.lit(hi)), F.pmod(days, F.lit(hi))
        return F.element_at(consts, rem + 1) * F.pow(F.lit(2.0), -q)
    return F.pow(F.lit(0.5), days.cast("double") / F.lit(h))


def _decay(half_life_days: float):
    return decay_weight(F.datediff(F.col("conversion_date"), F.col("exposure_date")), half_life_days)


def linear(pairs: DataFrame, keys=CUSTOMER) -> DataFrame:
    """Equal credit over all of a customer's touches."""
    n = F.col("total_touches")
    return (pairs.join(_journey_totals(pairs, None, keys), list(keys))
            .select(*PAIR_COLUMNS, n,
                    R(F.lit(1.0) / n, 4).alias("attribution_credit"),
                    R(F.col("revenue_generated").cast("double") / n, 2).alias("attributed_revenue")))


def time_decay(pairs: DataFrame, half_life_days: float = 7.0, keys=CUSTOMER) -> DataFrame:
    """Weight 0.5^(days / half_life), normalised per customer."""
    w = _decay(half_life_days)
    share = F.col("decay_weight") / F.col("total_weight")
    return (pairs.join(_journey_totals(pairs, half_life_days, keys).drop("total_touches"), list(keys))
            .select(*PAIR_COLUMNS, _days().alias("days_to_conversion"), w.alias("decay_weight"), "total_weight")
            .select(*PAIR_COLUMNS, "days_to_conversion", "decay_weight", "total_weight",
                    R(share, 4).alias("attribution_credit"),
                    R(share * F.col("revenue_generated").cast("double"), 2).alias("attributed_revenue")))


def last_touch_summary(lt: DataFrame) -> DataFrame:
    """Attributed conversions and revenue per (campaign, channel)."""
    return (lt.groupBy("campaign_id", "channel").agg(
        F.count(F.lit(1)).alias("conversions_attributed"),
        R(F.sum("revenue_generated").cast("double"), 2).alias("revenue_attributed"))
        .orderBy(F.col("revenue_attributed").desc_nulls_last(), "campaign_id"))


def attribute(tables: CampaignTables, model: str = "last_touch", half_life_days: float = 7.0,
              scope: str = "customer", salt_buckets: int = SALTS) -> DataFrame:
    """One entry point for the three models.

    ``scope="customer"`` shares credit over all of a customer's pairs (the
    reference's behaviour); ``scope="conversion"`` treats each conversion as
    its own journey (a conversion key replaces the customer key).
    """
    if scope not in ("customer", "conversion"):
        raise ValueError(f"scope must be 'customer' or 'conversion', got {scope!r}")
    keys = CUSTOMER if scope == "customer" else CONVERSION
    pairs = touchpoints(tables, salt_buckets=salt_buckets)
    if model == "last_touch":
        return last_touch(pairs, keys)
    if model == "linear":
        return linear(pairs, keys)
    if model == "time_decay":
        return time_decay(pairs, half_life_days, keys)
    raise ValueError(f"unknown attribution model {model!r}")
