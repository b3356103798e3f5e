"""Ranking metrics and plot data (G7, G8, G16, G17), all distributed.

All of them are read from one score table: the distinct score values, highest
first, with the positives and negatives at and above each (``rank_offsets``),
never from a global sort. ``score_table`` is built and written once and can
serve every metric of the same scores: ``auc_of``, ``precision_of``,
``roc_of`` and ``pr_of`` take it, the functions on scored rows build their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.functions.numeric import safe_div
from adlift.functions.ranking import rank_offsets


def score_table(scored: DataFrame, label: str = "label", score: str = "score", bins: int | None = None,
                by: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score (as ``threshold``): positives and negatives at it and strictly above it."""
    pos = (F.col(label) == 1).cast("long")
    offs = rank_offsets(scored, score, descending=True, bins=bins, by=by,
                        sums={"pos": pos, "neg": F.lit(1).cast("long") - pos})
    return offs.select(*by, F.col(score).alias("threshold"), "pos", "neg", "pos_before", "neg_before")


def auc_of(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area under the ROC curve; negatives alike in score count half."""
    beaten = F.sum("pos") * F.sum("neg") - F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5))
    agg = table.groupBy(*by).agg(beaten.alias("_u"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return agg.select(*by, safe_div("_u", F.col("positives") * F.col("negatives")).alias("roc_auc"), "positives", "negatives")


def precision_of(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Average precision, sum over thresholds of (recall step) x precision."""
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    agg = table.groupBy(*by).agg(F.sum(F.col("pos") * tp / (tp + fp)).alias("_s"), F.sum("pos").alias("_p"))
    return agg.select(*by, safe_div("_s", "_p").alias("average_precision"))


def roc_of(table: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score."""
    tot = table.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return table.crossJoin(F.broadcast(tot)).select(
        "threshold", safe_div(F.col("neg_before") + F.col("neg"), "_N").alias("fpr"),
        safe_div(F.col("pos_before") + F.col("pos"), "_P").alias("tpr"))


def pr_of(table: DataFrame) -> DataFrame:
    """(threshold, precision, recall) for every distinct score."""
    tot = table.agg(F.sum("pos").alias("_P"))
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    return (table.crossJoin(F.broadcast(tot))
            .select("threshold", (tp / (tp + fp)).alias("precision"), safe_div(tp, "_P").alias("recall")))


def curve_summary(scored: DataFrame, label: str = "label", score: str = "score", bins: int | None = None) -> DataFrame:
    """G7 and G8 together with the number of thresholds and the greatest F1, from one score table."""
    table = score_table(scored, label, score, bins).checkpoint()
    points = pr_of(table).agg(F.count(F.lit(1)).alias("thresholds"), F.max(
        safe_div(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))).alias("best_f1"))
    return auc_of(table).crossJoin(precision_of(table)).crossJoin(points)   # one row each


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", bins: int | None = None,
            by: tuple[str, ...] = ()) -> DataFrame:
    """G7 of scored rows."""
    return auc_of(score_table(scored, label, score, bins, by), by)


def average_precision(scored: DataFrame, label: str = "label", score: str = "score", bins: int | None = None,
                      by: tuple[str, ...] = ()) -> DataFrame:
    """G8 of scored rows."""
    return precision_of(score_table(scored, label, score, bins, by), by)


def roc_points(scored: DataFrame, label: str = "label", score: str = "score", bins: int | None = None) -> DataFrame:
    """G16 of scored rows: the ROC curve."""
    return roc_of(score_table(scored, label, score, bins))


def pr_points(scored: DataFrame, label: str = "label", score: str = "score", bins: int | None = None) -> DataFrame:
    """G16 of scored rows: the precision-recall curve."""
    return pr_of(score_table(scored, label, score, bins))


def histogram(df: DataFrame, col: str = "uplift_score", bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max; the maximum falls in the
    last bin (closed on the right), as in matplotlib."""
    rng = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = df.select(col).crossJoin(F.broadcast(rng))
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int") + 1,
                F.lit(bins)))
    counts = j.groupBy(idx.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"),
                         (F.col("_lo") + F.col("bin") * width).alias("bin_end"), "count")
