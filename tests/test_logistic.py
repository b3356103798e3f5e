"""The one-pass fits against Spark ML on the same rows."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from adlift.operators import response, roi, uplift
from adlift.operators.features import feature_names, fit_feature_constants
from adlift.operators.logistic import fit_logistic
from adlift.operators.response import fit_pipeline, model_frame


def test_models_equal_spark_ml(spark, tables):
    base = roi.modeling_base(tables)
    frame = None
    for group, arm in (("t", 1), ("c", 0)):
        rows = base.where(F.col("treatment_group") == arm)
        part = model_frame(rows, fit_feature_constants(rows), group, 0.2, 42, 3)
        frame = part if frame is None else frame.unionByName(part)
    frame = frame.where("_fold is not null").checkpoint()
    fitted = fit_logistic(frame, [("t", None), ("c", None), ("t", 0), ("t", 2), ("c", 1)])
    for group, out in (("t", None), ("c", 1)):
        rows = frame.where(F.col("_group") == group)
        train = rows if out is None else rows.where(F.col("_fold") != out)
        pipe = fit_pipeline(train.drop("_income_ord"), tol=1e-13)
        ours = dict(zip(fitted[group, out].names(), fitted[group, out].coefficients))
        theirs = dict(zip(feature_names(pipe), pipe.stages[-1].coefficients.toArray()))
        assert len(theirs) == len(pipe.stages[-1].coefficients) and set(ours) < set(theirs)
        assert all(value == pytest.approx(ours.get(n, 0.0), abs=1e-6) for n, value in theirs.items())
        assert pipe.stages[-1].intercept == pytest.approx(fitted[group, out].intercept, abs=1e-6)
        p = vector_to_array(F.col("probability")).getItem(1)
        both = pipe.transform(rows.withColumn("ours", fitted[group, out].probability())).agg(F.max(F.abs(p - F.col("ours")))).first()[0]
        assert both < 1e-6


def test_metrics_of_both_arms(spark, tables):
    models = uplift.fit_uplift(roi.modeling_base(tables), folds=3)
    rows = {r.model: r for r in models.metrics.collect()}
    assert set(rows) == {"treatment", "control"}
    assert all(0.3 < r.roc_auc < 1 and 0 < r.avg_precision < 1 and 0.3 < r.cv_mean < 1 and r.cv_std >= 0 for r in rows.values())
    assert sum(r.n_train + r.n_test for r in rows.values()) == roi.modeling_base(tables).count()
    names = [r.feature for r in response.feature_importance(models.treatment).collect()]
    assert "num__age" in names and "ord__income_band" in names
