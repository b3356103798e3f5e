import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from adlift.llm import queries
from adlift.llm.whitening import OFFSET, cross_products, integers, pack, unpack, whiten

SF = "/root/testdata/sf0.01"


def test_cross_products_are_exact():
    rng = np.random.default_rng(2)
    for x in (rng.integers(-5, 5, (130, 7)), rng.integers(-2 ** 40, 2 ** 40, (65, 3)), rng.integers(-2 ** 62, 2 ** 62, (9, 2)),
              np.full((3, 4), 1_000_000), np.array([[-2 ** 62, 2 ** 62]])):
        sums, products = cross_products(x.astype(np.int64))
        o = x.astype(object)
        assert sums.tolist() == o.sum(axis=0).tolist() and products.tolist() == (o.T @ o).tolist()


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    x = np.concatenate([OFFSET + rng.integers(-2 ** b, 2 ** b, (4, 5)) for b in (3, 7, 8, 15, 16, 31, 32, 62)])
    back = np.empty_like(x)
    for rows, part in unpack(pack(x)):
        back[rows] = part
    assert (back == x).all()
    assert {len(v) for v in pack(x)} == {6, 11, 21, 41}


def check(rows, got, components=16):
    """The operator's rows against Python integers and numpy, for vectors of one length."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, d = len(distinct), len(distinct[0])
    s = [sum(x[j] for x in distinct) for j in range(d)]
    o = np.array(distinct, dtype=object)
    cov = np.array([[(n * int(p) - s[j] * s[k]) / n ** 2 for k, p in enumerate(row)] for j, row in enumerate(o.T @ o)])
    values = np.sort(np.linalg.eigvalsh(cov))[::-1][:components]
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert sorted(by) == sorted({i for i, _ in good}) and len(got) == len(good) * min(components, d)
    w = {}
    for i, x in good:
        own = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, min(components, d) + 1))
        assert {r.n for r in own} == {n}
        assert {int(r.deviation) for r in own} == {sum((n * c - t) ** 2 for c, t in zip(x, s))}
        assert np.allclose([r.explained for r in own], values / np.trace(cov), rtol=1e-9)
        w[tuple(x)] = [r.whitened for r in own]
    white = np.array([w[x] for x in distinct])
    error = np.abs(white.T @ white / n - np.eye(white.shape[1])).max()
    assert error < 1e-9 and {r.identity_error < 1e-9 for r in got} == {True}
    # the projections reproduce the centred rows along the components: same pairwise distances as by eigh
    e, v = np.linalg.eigh(cov)
    top = np.argsort(-e)[:components]
    own = (np.array(distinct) - np.array(s) / n) @ v[:, top] / np.sqrt(e[top])
    assert np.allclose(np.abs(own), np.abs(white), atol=1e-6)


def test_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op11_embedding_whitening(spark, SF)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(rows, got.collect())


def test_result_does_not_depend_on_partitions_or_repeats(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) * [1, 2, 3, 10, 300]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, x[:100])))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(rows, whiten(df.repartition(7)).collect())
    check(rows, whiten(df.coalesce(1), components=3).collect(), 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [0.0, 2.0, 0.5]), (3, None), (4, []), (5, [None, 1.0, 1.0]), (6, [nan, 1.0, 1.0]),
            (7, [1.0, inf, 1.0]), (None, [-1.0, 0.25, 0.5]), (8, [0.0, 0.0]), (9, [3.0, -4.0, 0.5]), (10, [1e300, 2.0, 1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("n", "x", "component", "whitened", "pair", "deviation", "dims", "vec")})
    got = whiten(df).collect()
    assert sorted({(str(r.vec_id), r.n) for r in got}) == [("1", 4), ("10", 1), ("2", 4), ("8", 1), ("9", 4), ("None", 4)]
    assert sum(r.vec_id == 1 for r in got) == 6 and sum(r.vec_id == 8 for r in got) == 2
    # the third dimension never varies, and a single vector has no variance at all
    assert [r.whitened is None for r in sorted((r for r in got if r.vec_id == 9), key=lambda r: r.component)] == [False, False, True]
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 for r in got if r.vec_id in (8, 10))
    assert all(r.identity_error < 1e-9 for r in got)
    assert whiten(df.limit(0)).count() == 0
    assert integers(np.array([-1e300, -0.001]), 64.0).tolist() == [-2 ** 62 + OFFSET, OFFSET - 1]
