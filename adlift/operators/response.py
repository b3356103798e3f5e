"""Response (conversion propensity) model (G5, G6, G9, G10), fitted by ``logistic``.

Balanced-class L2 logistic regression. The reference minimises
0.5*|w|^2 + C * sum(s_i * loss_i) with balanced sample weights (sum s = n); Spark
minimises mean weighted loss + regParam * 0.5*|w|^2, so regParam = 1 / (C * n)
with standardization off (inputs are already scaled). Spark's StandardScaler
divides by the sample std, sklearn by the population std (factor
sqrt((n-1)/n)). ``fit_pipeline`` is the same model as a Spark ML pipeline.
"""

from __future__ import annotations

import statistics
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.functions.numeric import safe_div
from adlift.functions.ranking import exact_medians
from adlift.operators.curves import auc_of, precision_of, score_table
from adlift.operators.features import (FEATURES, FeatureConstants, encoder_stages, stratified_folds, stratified_split,
                                       training_frame, with_ordinal)
from adlift.operators.logistic import Logistic, fit_logistic, held_out_scores
from adlift.session import written


@dataclass
class ResponseModel:
    logistic: Logistic
    constants: FeatureConstants


def _balanced(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_p"))
    j = df.crossJoin(F.broadcast(counts))  # one row
    return j.withColumn("weight", F.when(F.col("label") == 1, safe_div("_n", 2.0 * F.col("_p")))
                        .otherwise(safe_div("_n", 2.0 * (F.col("_n") - F.col("_p"))))).drop("_n", "_p")


def fit_pipeline(train: DataFrame, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6) -> PipelineModel:
    """Encoders + balanced logistic regression fitted on ``train`` (label column ``label``)."""
    weighted = _balanced(with_ordinal(train)).cache()
    n = weighted.count()
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                            regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, tol=tol)
    model = Pipeline(stages=[*encoder_stages(), lr]).fit(weighted)
    weighted.unpersist()
    return model


def score(model: ResponseModel, df: DataFrame, refit_normalisers: bool = False) -> DataFrame:
    """P(convert) as ``score`` and the 0.5-threshold label ``predicted``.
    With ``refit_normalisers`` the feature constants come from ``df`` itself
    (the reference's behaviour); by default the training constants are reused."""
    consts = None if refit_normalisers else model.constants
    feats = with_ordinal(training_frame(df.withColumn("converted", F.coalesce(F.col("converted"), F.lit(0)))
                                        if "converted" in df.columns else df.withColumn("converted", F.lit(0)),
                                        constants=consts))
    p = model.logistic.probability()
    keys = [k for k in ("customer_id", "campaign_id") if k in feats.columns]
    return feats.select(*keys, "label", p.alias("score"), (p > 0.5).cast("int").alias("predicted"))


def with_probability(model: ResponseModel, df: DataFrame, name: str) -> DataFrame:
    """``df`` with P(convert) of every row as column ``name``; no join, so rows and their number stay as they are."""
    target = F.coalesce(F.col("converted"), F.lit(0)) if "converted" in df.columns else F.lit(0)
    packed = df.withColumn("_row", F.struct(*df.columns)).withColumn("converted", target)
    feats = with_ordinal(training_frame(packed, constants=model.constants, keep=("_row",)))
    return feats.select("_row.*", model.logistic.probability().alias(name))


def model_inputs(df: DataFrame, *more: str) -> DataFrame:
    """The columns of ``df`` that a fit reads, and ``more``."""
    names = {"customer_id", "campaign_id", *FEATURES, "converted", *more}
    return df.select(*[c for c in df.columns if c in names])


def _constants(groups: dict[str, DataFrame]) -> dict[str, FeatureConstants]:
    """The feature constants of every group: median and maximum of historical_spend, all groups in the same passes."""
    spend = reduce(DataFrame.unionByName, [df.select(*[
        (F.col("historical_spend") if g == h else F.lit(None)).cast("double").alias(f"s{i}") for i, h in enumerate(groups)])
        for g, df in groups.items()])
    r = exact_medians(spend, {f"s{i}": f"m{i}" for i in range(len(groups))}).crossJoin(
        spend.agg(*[F.max(f"s{i}").alias(f"x{i}") for i in range(len(groups))])).first()
    return {g: FeatureConstants(float(r[f"m{i}"]), float(r[f"x{i}"])) for i, g in enumerate(groups)}


def _dealt(rows: DataFrame, test_share: float, seed: int, folds: int) -> DataFrame:
    """Features with _group and _fold, dealt within each group; test rows have no fold."""
    frame = with_ordinal(stratified_split(rows, seed=seed, test_share=test_share, by=("_group",)))
    inputs = ["label", *FEATURES, "_income_ord"]
    if folds <= 1:
        return frame.select("_group", F.when(F.col("split") == "train", 0).cast("int").alias("_fold"), *inputs)
    frame = written(frame, "split")
    train = stratified_folds(frame.where("split = 'train'"), folds, seed=seed + 1, by=("_group",))
    test = frame.where("split = 'test'").withColumn("_fold", F.lit(None).cast("int"))
    return train.unionByName(test).select("_group", "_fold", *inputs)


def model_frame(df: DataFrame, constants: FeatureConstants, group: str, test_share: float, seed: int, folds: int) -> DataFrame:
    """The features of one group of rows with _group and _fold; test rows have no fold."""
    return _dealt(training_frame(df, constants=constants).withColumn("_group", F.lit(group)), test_share, seed, folds)


def fit_responses(groups: dict[str, DataFrame], test_share: float = 0.2, seed: int = 42, folds: int = 5, c: float = 1.0,
                  max_iter: int = 1000) -> tuple[dict[str, ResponseModel], DataFrame]:
    """G5 + G7 + G8 + G9 for several groups of rows at once: a model a group on its training part, evaluated on its test
    part, and k-fold AUC on the training part. All groups share one split, all fits their passes, and all curves one rank
    table. The groups are read several times: pass written tables. Returns the models and a metrics row a group (model,
    roc_auc, avg_precision, cv_mean, cv_std, n_train, n_test)."""
    constants = _constants(groups)
    rows = reduce(DataFrame.unionByName, [training_frame(df, constants=constants[g]).withColumn("_group", F.lit(g)) for g, df in groups.items()])
    frame = written(_dealt(rows, test_share, seed, folds), "frame")      # read once a step
    keys = [(g, out) for g in groups for out in [None, *(range(folds) if folds > 1 else [])]]
    fitted = fit_logistic(frame.where("_fold is not null"), keys, c=c, max_iter=max_iter)
    held = frame if folds > 1 else frame.where("_fold is null")      # without folds only the test rows are held out
    scored = held_out_scores(held, fitted).withColumn("_fold", F.coalesce("_fold", F.lit(-1)))
    by = ("_group", "_fold")
    table = written(score_table(scored, by=by), "scores")
    auc = {(r["_group"], r["_fold"]): r["roc_auc"] for r in auc_of(table, by).collect()}
    ap = {r["_group"]: r["average_precision"] for r in precision_of(table.where("_fold = -1"), by).collect()}
    sizes = {r["_group"]: r for r in frame.groupBy("_group").agg(
        F.count("_fold").alias("train"), F.count_if(F.col("_fold").isNull()).alias("test")).collect()}
    rows = []
    for g in groups:
        cv = [auc[g, k] for k in range(folds) if auc.get((g, k)) is not None] if folds > 1 else []
        rows.append((g, auc.get((g, -1)), ap.get(g), statistics.fmean(cv) if cv else None, statistics.pstdev(cv) if cv else None,
                     sizes[g]["train"] if g in sizes else 0, sizes[g]["test"] if g in sizes else 0))
    spark = frame.sparkSession
    metrics = spark.createDataFrame(rows, "model string, roc_auc double, avg_precision double, cv_mean double, cv_std double, "
                                          "n_train long, n_test long")
    return {g: ResponseModel(fitted[g, None], constants[g]) for g in groups}, metrics


def fit_response(df: DataFrame, test_share: float = 0.2, seed: int = 42, folds: int = 5,
                 c: float = 1.0, max_iter: int = 1000) -> tuple[ResponseModel, DataFrame]:
    """``fit_responses`` for one group: the model and its metrics row."""
    models, metrics = fit_responses({"all": written(model_inputs(df), "rows")}, test_share, seed, folds, c, max_iter)
    return models["all"], metrics.drop("model")


def feature_importance(model: ResponseModel, top_n: int | None = None) -> DataFrame:
    """Coefficients with names, by absolute size, with a plain-words reading."""
    rows = [(n, float(cf), abs(float(cf))) for n, cf in zip(model.logistic.names(), model.logistic.coefficients, strict=True)]
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double")
    df = df.withColumn("reading", F.format_string(
        "%s has a %s, %s weight of %.3f", F.col("feature"),
        F.when(F.col("abs_coefficient") > 0.5, "large").otherwise("small"),
        F.when(F.col("coefficient") > 0, "positive").otherwise("negative"), F.col("coefficient")))
    df = df.orderBy(F.col("abs_coefficient").desc(), "feature")
    return df.limit(top_n) if top_n else df
