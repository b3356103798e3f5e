"""Attribution totals without the pair table: one sweep over the days of a journey.

Totals over all (exposure, later conversion) pairs of a customer need no pairs.
Both sides are first counted per day, which is partial aggregation, so however
many rows a customer has, one entry a calendar day (and campaign) remains. A
window runs over the days of a customer from the last to the first and carries
how many conversions lie ahead, the sums of their days and values, and the next
one; an exposure day multiplies what it meets. A decayed sum is that of the next
conversion day, faded by the distance to it, so nothing under- or overflows
however long the history is. Rows are linear in exposures and conversions.

Only credits that are rounded pair by pair (D9, D13) still look at single
distances. Weights halve every half-life, so distances beyond a reach derived
from the customer's totals are lost in a double: some 60 half-lives past the
nearest touch. Days within reach are found by an equi-join on (customer, range
of days), and counted per distance: a row a conversion and day within reach,
whatever the number of touches of a day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlift.functions.numeric import exact_sum, round_half_away as R, safe_div
from adlift.operators.attribution import conversions, decay_weight, roi_pct
from adlift.sources.mapped import CampaignTables

JOURNEY = ["customer_id", "campaign_id", "channel"]
RANGE_DAYS = 364
FADED = 120     # half-lives


def touch_days(tables: CampaignTables) -> DataFrame:
    """Exposures per customer, campaign, channel and day: touches and their cost."""
    return tables.exposures.groupBy(*JOURNEY, F.unix_date("exposure_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost_per_contact").cast("decimal(38,2)").alias("cost"))


def _faded(conv: DataFrame, columns: list[str], half_life_days: float) -> DataFrame:
    """``conv`` (a row per customer and day) with ``decay_<column>``: the column summed over this and the later days, each
    halved every half-life of its distance. Days more than FADED half-lives on are lost in a double."""
    ahead = Window.partitionBy("customer_id").orderBy("day").rangeBetween(0, math.ceil(FADED * half_life_days))
    near = F.collect_list(F.struct("day", *[F.col(c).cast("double").alias(c) for c in columns])).over(ahead)

    def faded(column: str) -> Column:
        return F.aggregate("_near", F.lit(0.0), lambda a, c: a + c[column] * decay_weight(c["day"] - F.col("day"), half_life_days))
    return conv.withColumn("_near", near).select(*conv.columns, *[faded(c).alias(f"decay_{c}") for c in columns])


def _sweep(touches: DataFrame, conv: DataFrame, values: tuple[str, ...], half_life_days: float | None) -> DataFrame:
    """Per journey row (JOURNEY) that meets a conversion: ``touches`` (pairs), ``cost``, ``days`` (summed distances),
    ``nearest`` (least distance) and the sum of every value column of ``conv`` over the pairs; with a half-life also ``weight`` (summed decay weights)
    and ``decayed_<value>``. ``conv`` has customer_id, day, n and the values as decimals, a row per customer and day."""
    decayed = ["n", *values] if half_life_days is not None else []
    if decayed:
        conv = _faded(conv, decayed, half_life_days)
    # a customer's days from the last on; the conversions of a day before its exposures, which they follow or share
    seen = conv.withColumn("conv_day", F.col("day"))
    rows = touches.withColumn("touch", F.lit(True)).unionByName(
        seen.withColumnRenamed("n", "convs").withColumn("touch", F.lit(False)), allowMissingColumns=True)
    back = Window.partitionBy("customer_id").orderBy(F.desc("day"), "touch").rowsBetween(Window.unboundedPreceding, 0)
    so_far = {"_convs": F.sum("convs"), "_conv_days": F.sum(F.col("convs") * F.col("conv_day")), "_next": F.last("conv_day", True)}
    so_far |= {f"_{v}": F.sum(v) for v in values} | {f"_decay_{c}": F.last(f"decay_{c}", True) for c in decayed}
    met = rows.select("*", *[c.over(back).alias(n) for n, c in so_far.items()]).where("touch and _convs > 0")
    sums = {"touches": F.col("n") * F.col("_convs"), "cost": F.col("cost") * F.col("_convs"),
            "days": F.col("n") * (F.col("_conv_days") - F.col("_convs") * F.col("day"))}
    nearest = F.min(F.col("_next") - F.col("day")).alias("nearest")
    sums |= {v: F.col("n") * F.col(f"_{v}") for v in values}
    if decayed:
        fade = decay_weight(F.col("_next") - F.col("day"), half_life_days)
        sums |= {"weight" if c == "n" else f"decayed_{c}": F.col("n") * fade * F.col(f"_decay_{c}") for c in decayed}
    return met.groupBy(*JOURNEY).agg(nearest, *[F.sum(c).alias(n) for n, c in sums.items()])


def journeys(tables: CampaignTables, half_life_days: float | None = None, revenue: bool = False) -> DataFrame:
    """The swept journeys: a row per customer, campaign and channel with later conversions, with the sums of ``_sweep``."""
    conv = conversions(tables).groupBy("customer_id", F.unix_date("conversion_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue_generated").cast("decimal(38,2)").alias("revenue"))
    return _sweep(touch_days(tables), conv, ("revenue",) if revenue else (), half_life_days)


def customer_totals(swept: DataFrame) -> DataFrame:
    """All touches and, where there is one, the whole decay weight per customer."""
    sums = {"total_touches": "touches"} | ({"total_weight": "weight"} if "weight" in swept.columns else {})
    return swept.groupBy("customer_id").agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def touch_stats(swept: DataFrame) -> DataFrame:
    """Touches per converting customer: mean, min, max and population standard deviation."""
    t = F.col("total_touches")
    squared = t.cast("double") * t.cast("double")   # of a large journey beyond a long
    return customer_totals(swept).agg(
        F.avg(t).alias("avg_touches_to_conversion"), F.min(t).alias("min_touches"), F.max(t).alias("max_touches"),
        R(F.sqrt(F.avg(squared) - F.avg(t) * F.avg(t)), 2).alias("stdev_touches"))


def linear_credits(tables: CampaignTables, swept: DataFrame) -> DataFrame:
    """Linear credits (4 digits) and revenue (2 digits), rounded a pair, summed per journey row."""
    totals = customer_totals(swept).select("customer_id", F.col("total_touches").alias("_n"))
    share = R(F.col("revenue_generated").cast("double") / F.col("_n"), 2).cast("decimal(38,2)")
    conv = conversions(tables).join(totals, "customer_id").groupBy(
        "customer_id", F.unix_date("conversion_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(share).cast("decimal(38,2)").alias("revenue"))
    credited = _sweep(touch_days(tables), conv, ("revenue",), None).join(totals, "customer_id")
    credit = R(F.lit(1.0) / F.col("_n"), 4).cast("decimal(38,4)") * F.col("touches")
    return credited.select(*JOURNEY, "touches", "cost", "days", credit.cast("decimal(38,4)").alias("credit"), "revenue")


def decayed_credits(tables: CampaignTables, swept: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """Time-decay credits (4 digits) and revenue (2 digits), rounded a pair, summed per journey row. The whole weight is
    added up over the near distances, nearest first, as the pairwise credits add it."""
    touches, h = touch_days(tables), float(half_life_days)
    reaches = touches.groupBy("customer_id").agg(F.min("day").alias("_first")).join(
        swept.groupBy("customer_id").agg((F.min("nearest") + F.ceil((F.log2(F.sum("touches")) + 56) * h)).alias("_reach")), "customer_id")
    day = F.unix_date("conversion_date")
    conv = conversions(tables).join(reaches, "customer_id").select(
        "customer_id", "revenue_generated", day.alias("_day"), F.greatest(day - F.col("_reach"), F.col("_first")).alias("_from"))
    spans = F.sequence(F.floor(F.col("_from") / RANGE_DAYS), F.floor(F.col("_day") / RANGE_DAYS))
    near = touches.withColumn("_range", F.floor(F.col("day") / RANGE_DAYS)).join(
        conv.where("_from <= _day").withColumn("_range", F.explode(spans)), ["customer_id", "_range"]).where("day between _from and _day")
    # read twice below; bounded by days and conversions
    near = near.select(*JOURNEY, (F.col("_day") - F.col("day")).alias("days"), "revenue_generated", "n").checkpoint()
    terms = F.array_sort(F.collect_list(F.struct("days", "n")))
    whole = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t["n"].cast("double") * decay_weight(t["days"], h))
    whole = near.groupBy("customer_id", "days").agg(F.sum("n").alias("n")).groupBy("customer_id").agg(whole.alias("_w"))
    share = safe_div(decay_weight(F.col("days"), h), "_w")
    return near.join(whole, "customer_id").groupBy(*JOURNEY).agg(
        F.sum(R(share, 4).cast("decimal(18,4)") * F.col("n")).cast("decimal(38,4)").alias("credit"),
        F.sum(R(share * F.col("revenue_generated").cast("double"), 2).cast("decimal(18,2)") * F.col("n")).cast("decimal(38,2)").alias("revenue"))


def _by_campaign(rows: DataFrame, campaigns: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    extra = extra or {}
    rev, cost = exact_sum("revenue", 2), F.sum("cost").cast("double")
    agg = rows.groupBy("campaign_id", "channel").agg(
        F.count(F.lit(1)).alias("customers_touched"),
        R(exact_sum("credit", 4), 2).alias("total_conversions_credited"),
        R(rev, 2).alias("revenue_attributed"), cost.alias("total_cost"), roi_pct(rev, cost).alias("roi_percentage"),
        *[c.alias(n) for n, c in extra.items()])
    return (agg.join(campaigns.select("campaign_id", "campaign_name"), "campaign_id")
            .select("campaign_id", "campaign_name", "channel", "customers_touched", "total_conversions_credited",
                    "revenue_attributed", "total_cost", "roi_percentage", *extra)
            .orderBy(F.col("roi_percentage").desc_nulls_last(), "campaign_id"))


def linear_by_campaign(tables: CampaignTables) -> DataFrame:
    """Customers touched, credited conversions, revenue, cost, ROI % per campaign."""
    return _by_campaign(linear_credits(tables, journeys(tables)), tables.campaigns)


def decayed_rows(tables: CampaignTables, half_life_days: float = 7.0) -> DataFrame:
    """The swept journeys with their time-decay credits."""
    swept = journeys(tables).checkpoint()
    credited = swept.join(decayed_credits(tables, swept, half_life_days), JOURNEY, "left")
    return credited.withColumns({c: F.coalesce(c, F.lit(0).cast(credited.schema[c].dataType)) for c in ("credit", "revenue")})


def time_decay_by_campaign(tables: CampaignTables, half_life_days: float = 7.0) -> DataFrame:
    """As D7 plus mean days from touch to conversion."""
    mean = R(F.sum("days").cast("double") / F.sum("touches").cast("double"), 1)
    return _by_campaign(decayed_rows(tables, half_life_days), tables.campaigns, {"avg_days_to_conversion": mean})


def last_touches(tables: CampaignTables) -> DataFrame:
    """D3 as an as-of lookup, one row per converting customer: the latest exposure up to the customer's last conversion
    (then smallest campaign), with the first conversion from it on (then smallest revenue). No pairs: a maximum, a
    minimum of structs over exposures, and one over conversions."""
    conv = conversions(tables)
    last = conv.groupBy("customer_id").agg(F.max("conversion_date").alias("_last"))
    touch = F.min(F.struct((-F.unix_date("exposure_date")).alias("back"), "campaign_id", "channel", "exposure_date",
                           "cost_per_contact")).alias("t")
    touch = tables.exposures.join(last, "customer_id").where("exposure_date <= _last").groupBy("customer_id").agg(touch)
    first = F.min(F.struct("conversion_date", "revenue_generated")).alias("c")
    met = conv.join(touch, "customer_id").where("conversion_date >= t.exposure_date").groupBy("customer_id").agg(
        F.min("t").alias("t"), first)
    return met.select("customer_id", "t.campaign_id", "t.channel", "t.exposure_date", "t.cost_per_contact",
                      "c.conversion_date", "c.revenue_generated", F.lit(1.0).alias("attribution_credit"))


def model_comparison(tables: CampaignTables, half_life_days: float = 7.0) -> DataFrame:
    """The three models side by side per channel. One written sweep gives the journeys and the cost of both shared
    models; their revenue is credited from it, and the last touch is looked up."""
    swept = journeys(tables).checkpoint()
    cost = swept.groupBy("channel").agg(F.sum("cost").cast("double").alias("cost"))
    parts = [rows.groupBy("channel").agg(exact_sum("revenue", 2).alias("rev")).select(F.lit(model).alias("attribution_model"), "channel", "rev")
             for model, rows in (("Linear", linear_credits(tables, swept)), ("Time-Decay", decayed_credits(tables, swept, half_life_days)))]
    shared = parts[0].unionByName(parts[1]).join(F.broadcast(cost), "channel")     # a row a channel
    last = last_touches(tables).groupBy("channel").agg(F.sum("revenue_generated").cast("double").alias("rev"),
                                                       F.sum("cost_per_contact").cast("double").alias("cost"))
    both = shared.unionByName(last.select(F.lit("Last-Touch").alias("attribution_model"), "channel", "rev", "cost"))
    return (both.select("attribution_model", "channel", R("rev", 2).alias("total_revenue"),
                        roi_pct(F.col("rev"), F.col("cost")).alias("roi_pct"))
            .orderBy("attribution_model", F.col("roi_pct").desc_nulls_last(), "channel"))


def budget_shift(tables: CampaignTables, half_life_days: float = 7.0) -> DataFrame:
    """Spend share versus time-decay revenue share per channel."""
    per = decayed_rows(tables, half_life_days).groupBy("channel").agg(
        F.sum("revenue").cast("decimal(38,2)").alias("_rev"), F.sum("cost").alias("_cost"))
    whole = per.agg(F.sum("_rev").cast("double").alias("_all_rev"), F.sum("_cost").cast("double").alias("_all_cost"))
    rev, cost = F.col("_rev").cast("double"), F.col("_cost").cast("double")
    spend_pct, rev_pct = safe_div(cost, "_all_cost") * 100, safe_div(rev, "_all_rev") * 100
    return (per.crossJoin(F.broadcast(whole))  # one-row totals (J10)
            .select("channel", R(rev, 2).alias("current_revenue"), cost.alias("current_spend"),
                    R(spend_pct, 2).alias("current_budget_pct"), roi_pct(rev, cost).alias("roi_pct"),
                    R(rev_pct, 2).alias("recommended_budget_pct"), R(rev_pct - spend_pct, 2).alias("budget_shift_pct"))
            .orderBy(F.col("roi_pct").desc_nulls_last(), "channel"))


def _summary(rows: DataFrame, credit: Column, revenue: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Unrounded credits summed in fixed point, so that arrival order cannot flip the rounding, then rounded."""
    return (rows.groupBy("campaign_id", "channel").agg(
        F.count(F.lit(1)).alias("customers_influenced"),
        R(F.sum(credit.cast("decimal(38,15)")).cast("double"), 2).alias("conversions_attributed"),
        R(F.sum(revenue.cast("decimal(38,15)")).cast("double"), 2).alias("revenue_attributed"),
        *[c.alias(n) for n, c in (extra or {}).items()])
        .orderBy(F.col("revenue_attributed").desc_nulls_last(), "campaign_id"))


def linear_summary(tables: CampaignTables) -> DataFrame:
    """Credit 1/n a pair, summed unrounded."""
    swept = journeys(tables, revenue=True)
    n = F.col("total_touches")
    rows = swept.join(customer_totals(swept), "customer_id")
    return _summary(rows, F.col("touches") / n, F.col("revenue").cast("double") / n)


def time_decay_summary(tables: CampaignTables, half_life_days: float = 7.0) -> DataFrame:
    """Unrounded decay shares summed; whole days averaged."""
    swept = journeys(tables, half_life_days, revenue=True)
    rows, w = swept.join(customer_totals(swept), "customer_id"), F.col("total_weight")
    mean = R(F.sum("days").cast("double") / F.sum("touches").cast("double"), 1)
    return _summary(rows, safe_div("weight", w), safe_div("decayed_revenue", w), {"avg_days_to_conversion": mean})
