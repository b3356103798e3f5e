"""Distribution functions for the A/B statistics.

Spark SQL has no ``erf``; the normal tail is built as a Column expression from
the double-precision rational approximation of Hart (1968) in the form given by
G. West, "Better approximations to cumulative normal functions" (2005), so the
oracle SQL can spell the same arithmetic. Quantiles of the normal law are
constants of a query and are taken on the driver with ``statistics.NormalDist``.
Student's t is in ``student``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Hart / West cumulative normal approximation,
# numerator then denominator, highest power first.
_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
        112.079291497871, 221.213596169931, 220.206867912376]
_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
        296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
_SPLIT = 7.07106781186547
_SQRT_2PI = 2.506628274631


def _horner_col(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_upper_tail(z) -> Column:
    """P(Z > |z|) for a standard normal Z, as a Column (null for null)."""
    z = F.col(z) if isinstance(z, str) else z
    a = F.abs(z.cast("double"))
    e = F.exp(-(a * a) / F.lit(2.0))
    near = e * _horner_col(_NUM, a) / _horner_col(_DEN, a)
    far_d = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        far_d = a + F.lit(k) / far_d
    far = e / far_d / F.lit(_SQRT_2PI)
    return F.when(a > 37, F.lit(0.0)).when(a < _SPLIT, near).otherwise(far)


def normal_cdf(z) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    t = normal_upper_tail(z)
    return F.when(z > 0, F.lit(1.0) - t).otherwise(t)


def two_sided_p(z) -> Column:
    """2 * (1 - Phi(|z|)), computed from the tail to avoid cancellation."""
    return F.lit(2.0) * normal_upper_tail(z)


def _horner_sql(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def normal_upper_tail_sql(z: str) -> str:
    a = f"abs(CAST({z} AS DOUBLE))"
    e = f"exp(-({a} * {a}) / 2.0)"
    near = f"({e} * {_horner_sql(_NUM, a)} / {_horner_sql(_DEN, a)})"
    far_d = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        far_d = f"({a} + {k!r} / {far_d})"
    far = f"({e} / {far_d} / {_SQRT_2PI!r})"
    return f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {_SPLIT!r} THEN {near} ELSE {far} END)"


def normal_tail_py(z: float) -> float:
    """Scalar twin, for tests and driver-side checks."""
    a = abs(z)
    if a > 37:
        return 0.0
    e = math.exp(-a * a / 2.0)
    if a < _SPLIT:
        num = _NUM[0]
        for c in _NUM[1:]:
            num = num * a + c
        den = _DEN[0]
        for c in _DEN[1:]:
            den = den * a + c
        return e * num / den
    d = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        d = a + k / d
    return e / d / _SQRT_2PI


def z_quantile(p: float) -> float:
    """Standard normal quantile (driver-side constant)."""
    return NormalDist().inv_cdf(p)
