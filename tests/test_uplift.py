"""Uplift scores by two models in a row, ties of a large top-n cut and large integer ranks."""
from pyspark.sql import functions as F

from adlift.functions.ranking import rank_offsets, top_n_rows
from adlift.operators import roi, uplift
from adlift.operators.response import score


def test_scores_keep_rows_and_equal_single_models(spark, tables):
    base = roi.modeling_base(tables).where("customer_id % 3 = 0")
    models = uplift.fit_uplift(base, folds=0)
    twice = base.unionByName(base)
    got = uplift.score_uplift(models, twice)
    assert got.count() == 2 * base.count() and set(base.columns) < set(got.columns)
    want = score(models.treatment, base).select("customer_id", "campaign_id", F.col("score").alias("p"))
    off = got.join(want, ["customer_id", "campaign_id"]).agg(F.max(F.abs(F.col("p") - F.col("treatment_prob")))).first()[0]
    assert off < 1e-12
    stats = uplift.uplift_stats(got).first()
    assert -1 < stats.mean_uplift < 1 and 0 <= stats.positive_pct <= 100


def test_top_n_inside_one_large_tie(spark):
    rows = [(i // 3, f"c{i % 3}", 1.0 if i < 900 else 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b string, score double")
    for n in (1, 2, 100, 899, 900, 901, 1000):
        got = sorted(map(tuple, top_n_rows(df, "score", n, ["a", "b"], bins=8).collect()))
        assert got == sorted(sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:n])


def test_ranks_of_integers_beyond_double_precision(spark):
    big = 1 << 60
    df = spark.range(100).select((F.col("id") + big).alias("v"))
    got = {r.v: r.n_before for r in rank_offsets(df, "v", bins=4).collect()}
    assert got == {big + i: i for i in range(100)}


def test_fitted_targeting_against_pandas(spark, tables):
    base = roi.modeling_base(tables)
    scored = uplift.score_uplift(uplift.fit_uplift(base, folds=0), base).checkpoint()
    got, rows = uplift.compare_targeting(scored).first(), scored.toPandas()
    n, value = int(len(rows) * 0.3), rows[rows.converted == 1].revenue_generated.astype(float).mean()

    def best(col):
        return rows.sort_values([col, "customer_id", "campaign_id"], ascending=[False, True, True]).head(n).uplift_score.sum() * value
    assert abs(got.response_model_revenue - best("treatment_prob")) < 1e-6 * abs(value)
    assert abs(got.uplift_model_revenue - best("uplift_score")) < 1e-6 * abs(value)
    assert got.n_targeted == n and got.uplift_model_revenue >= got.response_model_revenue
    parts = {r.segment: r.customer_count for r in uplift.segment_summary(uplift.segment_customers(scored)).collect()}
    high = (rows.treatment_prob > rows.treatment_prob.median(), rows.control_prob > rows.control_prob.median())
    assert parts["Persuadables"] == (high[0] & ~high[1]).sum() and parts["Sleeping Dogs"] == (~high[0] & high[1]).sum()
    assert sum(parts.values()) == len(rows)
