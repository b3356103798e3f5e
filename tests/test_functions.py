"""Numeric helpers: engine-neutral rounding, normal tail, Student t."""
import math

import pytest

from adlift.functions import stats
from adlift.functions.student import t_critical, two_sided_t


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 1.96, 2.5, 5.0, 7.5, 9.0, 20.0])
def test_normal_tail_matches_erfc(z):
    exact = 0.5 * math.erfc(z / math.sqrt(2))
    assert stats.normal_tail_py(z) == pytest.approx(exact, rel=1e-8, abs=1e-300)


def _first(spark, column):
    return spark.range(1).select(column).first()[0]


def exact_tail(t, n):
    """P(|T| > t) by Simpson's rule in long double over u = t + exp(x) - 1; the gamma ratio by its product."""
    import numpy as np
    x = np.linspace(0, 60, 200001, dtype=np.longdouble)
    u = t + np.expm1(x)
    log = -(np.longdouble(n) + 1) / 2 * np.log1p(u * u / n) + x
    w = np.ones(200001, dtype=np.longdouble)
    w[1:-1:2], w[2:-1:2] = 4, 2
    ratio, a = np.longdouble(1), np.longdouble(n) / 2
    while a < 400:
        ratio *= a / (a + np.longdouble(0.5))
        a += 1
    ratio *= np.sqrt(a) * np.exp(-1 / (8 * a) + 1 / (192 * a ** 3) - 1 / (640 * a ** 5))
    return float(2 * ratio / np.sqrt(np.pi * np.longdouble(n)) * (w * np.exp(log)).sum() * x[1] / 3)


def test_t_p_value_against_normal_limit(spark):
    from pyspark.sql import functions as F
    # with huge df the t distribution is the normal one
    got = _first(spark, two_sided_t(F.lit(1.96), F.lit(1e7)))
    assert got == pytest.approx(2 * 0.5 * math.erfc(1.96 / math.sqrt(2)), rel=1e-5)


def test_t_quantile_known_values(spark):
    from pyspark.sql import functions as F
    assert _first(spark, t_critical(F.lit(10), 0.05)) == pytest.approx(2.228138852, rel=1e-7)
    assert _first(spark, t_critical(F.lit(1), 0.05)) == pytest.approx(12.70620474, rel=1e-7)


def test_t_tail_and_quantile_for_all_sizes(spark):
    from pyspark.sql import functions as F
    rows = [(t, n) for n in (1.0, 2.0, 2.5, 7.0, 40.0, 1e3, 1e5, 1e7, 1e10) for t in (0.0, 1e-6, 0.3, 1.0, 1.96, 3.7, 9.0, 30.0)]
    df = spark.createDataFrame(rows, "t double, n double")
    for r in df.select("t", "n", two_sided_t("t", "n").alias("p"), t_critical("n", 0.01).alias("c")).collect():
        assert r.p == pytest.approx(exact_tail(r.t, r.n), rel=1e-9, abs=1e-300), (r.t, r.n)
        assert exact_tail(r.c, r.n) == pytest.approx(0.01, rel=1e-9)
    none, nan = F.lit(None).cast("double"), F.lit(float("nan"))
    assert [_first(spark, c) for c in (two_sided_t(none, F.lit(3.0)), two_sided_t(F.lit(1.0), nan), two_sided_t(F.lit(1.0), F.lit(0.0)),
                                       t_critical(none, 0.05), two_sided_t(F.lit(float("-inf")), F.lit(3.0)))] == [None] * 4 + [0.0]


def test_round_half_away_column(spark):
    from pyspark.sql import functions as F

    from adlift.functions.numeric import round_half_away
    df = spark.createDataFrame([(1.005,), (-0.00005,), (2.5,), (-2.5,), (None,)], "x double")
    out = [r[0] for r in df.select(round_half_away(F.col("x"), 2)).collect()]
    assert out[2] == 2.5 and out[3] == -2.5 and out[4] is None
    assert out[1] == 0.0 and math.copysign(1, out[1]) == 1.0  # no negative zero


def test_sqlite_week(spark):
    from pyspark.sql import functions as F

    from adlift.functions.dates import year_week_monday
    df = spark.createDataFrame([("2023-01-01",), ("2024-01-01",), ("2024-12-30",)], "d string")
    got = [r[0] for r in df.select(year_week_monday(F.col("d").cast("date"))).collect()]
    assert got == ["2023-00", "2024-01", "2024-53"]
