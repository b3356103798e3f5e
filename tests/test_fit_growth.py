"""Fits over many rows: the steps do not grow with the rows, and the rows are made once."""
import numpy as np
from pyspark.sql import functions as F

from adlift.functions.ranking import exact_medians
from adlift.operators import features, logistic, roi, uplift
from adlift.operators.features import FEATURES
from adlift.plans import registry


def test_rounding_of_large_sums_ends_the_steps(spark, tables, monkeypatch):
    """The same rows 100 million times over, with sums rounded as sums of that many rows are."""
    base = features.with_ordinal(features.training_frame(roi.modeling_base(tables))).select("label", *FEATURES, "_income_ord")
    frame = base.withColumns({"_group": F.lit("t"), "_fold": F.lit(0)}).checkpoint()
    copies, steps, rng = 1e8, [], np.random.default_rng(1)
    step, moments = logistic._step, logistic._moments

    def many(*args):
        return {k: (n * copies, p * copies, m, d) for k, (n, p, m, d) in moments(*args).items()}

    def rounded(*args):
        steps.append(1)
        return {k: tuple(copies * np.asarray(v) * (1 + 1e-15 * rng.normal(size=np.shape(v))) + (copies * len(rows) * 1e-17 * rng.normal(size=np.shape(v)))
                         for v in sums) for k, sums in step(*args).items()}
    rows = range(frame.count())
    monkeypatch.setattr(logistic, "_moments", many)
    monkeypatch.setattr(logistic, "_step", rounded)
    model = logistic.fit_logistic(frame, [("t", None)], max_iter=20)["t", None]
    assert len(steps) < 10 and np.isfinite(model.coefficients).all()


def test_the_base_is_made_once(spark, tables, monkeypatch):
    made, base = spark.sparkContext.accumulator(0), roi.modeling_base

    def counted(t):
        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b
        rows = base(t)
        return rows.mapInArrow(run, rows.schema)
    monkeypatch.setattr(roi, "modeling_base", counted)
    rows = base(tables).count()
    assert registry._fitted_scores(tables).count() == rows and made.value == rows
    registry._uplift_model_metrics(tables).collect()
    assert made.value == 2 * rows


def test_split_and_folds_within_groups(spark):
    """The split of two groups at once is that of each alone, and has the ranks' quota; hashes may share a range."""
    df = spark.range(3000).select(F.col("id").alias("customer_id"), (F.col("id") % 7 == 0).cast("double").alias("label"),
                                  F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    df = df.unionByName(df.where("customer_id < 5").withColumn("label", F.lit(None).cast("double")))
    for cells in (1, 1 << 14):
        both = {tuple(r) for r in features.stratified_split(df, by=("g",), cells=cells).collect()}
        for g in ("a", "b"):
            own = df.where(F.col("g") == g)
            ranked = features.class_rank(own, "label", ["customer_id"])
            quota = F.floor(F.col("_size") * 0.2 + 0.5)
            want = ranked.select("customer_id", "label", "g", F.when(F.col("_rank") <= quota, "test").otherwise("train"))
            assert {r for r in both if r[2] == g} == set(map(tuple, want.collect()))
    folds = {tuple(r) for r in features.stratified_folds(df, 5, by=("g",)).collect()}
    assert folds == {tuple(r) for g in ("a", "b") for r in features.stratified_folds(df.where(F.col("g") == g), 5).collect()}


def test_constants_of_groups_equal_each_alone(spark, tables):
    from adlift.operators.response import _constants
    base = roi.modeling_base(tables)
    groups = {str(arm): base.where(F.col("treatment_group") == arm) for arm in (0, 1)}
    assert _constants(groups) == {g: features.fit_feature_constants(df) for g, df in groups.items()}
    assert exact_medians(base.limit(0), {"age": "m"}).first().m is None and uplift.SEGMENTS
