"""Distributed rank arithmetic against brute force."""
import random

from pyspark.sql import functions as F

from adlift.functions.ranking import exact_medians, order_statistics, rank_offsets, top_n_rows
from adlift.operators import curves


def _data(spark, n=2000, seed=7):
    rnd = random.Random(seed)
    rows = [(i, float(rnd.randint(0, 150)) / 7.0, rnd.randint(0, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, score double, label int")


def test_top_n_matches_sort(spark):
    rows, df = _data(spark)
    for n in (1, 37, 500, 1999, 2000, 5000):
        got = sorted(r["id"] for r in top_n_rows(df, "score", n, ["id"], bins=16).collect())
        want = sorted(i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:n])
        assert got == want


def test_rank_offsets_counts(spark):
    rows, df = _data(spark, 500)
    offs = {r["score"]: (r["n_at"], r["n_before"]) for r in rank_offsets(df, "score", bins=8).collect()}
    for v, (n_at, n_before) in offs.items():
        assert n_at == sum(1 for _, s, _ in rows if s == v)
        assert n_before == sum(1 for _, s, _ in rows if s < v)


def test_auc_matches_pairwise(spark):
    rows, df = _data(spark, 400)
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = curves.roc_auc(df, bins=8).first()["roc_auc"]
    assert abs(got - want) < 1e-12


def test_histogram_max_in_last_bin(spark):
    df = spark.range(101).select((F.col("id") / 100.0).alias("uplift_score"))
    h = {r["bin"]: r["count"] for r in curves.histogram(df, bins=50).collect()}
    assert sum(h.values()) == 101 and max(h) == 50


def test_exact_medians(spark):
    for n in (1, 2, 7, 500, 2000):
        rows, df = _data(spark, n)
        import statistics
        got = exact_medians(df.withColumn("gone", F.lit(None).cast("double")), {"score": "a", "id": "b", "gone": "c"}).first()
        assert abs(got.a - statistics.median(s for _, s, _ in rows)) < 1e-12
        assert got.b == statistics.median(i for i, _, _ in rows) and got.c is None


def test_order_statistics_narrow_to_the_value(spark):
    """Small sketches and limits, so that brackets are narrowed and halved, over ties, two heavy values and wide ranges."""
    rnd = random.Random(3)
    columns = {
        "ties": [float(rnd.randint(0, 5)) for _ in range(3000)],
        "two": [0.0] * 1500 + [1.0] * 1500,
        "wide": [rnd.lognormvariate(0, 30) for _ in range(3000)],
        "heavy": [7.0] * 2000 + [rnd.random() for _ in range(500)] + [8 + rnd.random() for _ in range(500)],
        "same": [3.0] * 3000,
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).checkpoint()
    places = [0, 499, 1499, 1500]
    got = order_statistics(df, {c: lambda n: [*places, n, -1] for c in columns}, accuracy=40, few=200)
    for c, values in columns.items():
        ordered = sorted(values)
        assert [r.value for r in got[c]] == [ordered[p] for p in places]
        assert [(r.before, r.equal) for r in got[c]] == [(sum(v < r.value for v in values), values.count(r.value)) for r in got[c]]
    big = spark.range(2 ** 60, 2 ** 60 + 2000)
    assert [r.value for r in order_statistics(big, {"id": lambda n: [5, 1000]}, few=500)["id"]] == [2 ** 60 + 5, 2 ** 60 + 1000]
    assert order_statistics(df.limit(0), {"two": lambda n: [0]}) == {"two": []}
