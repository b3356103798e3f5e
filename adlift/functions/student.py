"""Student's t as Column expressions: two-sided p-value and critical value, for any degrees of freedom.

With v = sqrt(n ln(1 + u^2 / n)) the density of t with n degrees of freedom becomes
exp(-v^2 / 2) g(v^2 / n) / (sqrt(2 pi) c(n)) with g(y) = sqrt(y / (1 - exp(-y))), smooth and nearly 1, and
c(n) = sqrt(n / 2) Gamma(n / 2) / Gamma((n + 1) / 2). The tail is that integral from v on, by a fixed
Gauss-Legendre rule over the stretch in which the exponential falls by exp(-40), so small tails keep their
relative precision, and nothing cancels for large n. The gamma ratio is a series in 1 / n after a shift of 16.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from adlift.functions.stats import z_quantile

NODES = 48
NEWTON = 20
_SHIFT = 16


def _double(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a > 0."""
    ratio = F.lit(1.0)
    for i in range(_SHIFT):
        ratio = ratio * ((a + i) / (a + (i + 0.5)))
    r = 1.0 / (a + _SHIFT)
    log = r * (-1 / 8 + r * r * (1 / 192 + r * r * (-1 / 640 + r * r * (17 / 14336 - r * r * (31 / 18432)))))
    return ratio * F.sqrt(a + _SHIFT) * F.exp(log)


def _tail(t: Column, n: Column, scale: Column) -> Column:
    """P(|T| > t) for t >= 0; ``scale`` is gamma_ratio(n / 2) / sqrt(n)."""
    start = F.sqrt(n * F.log1p(t * t / n))
    length = 80.0 / (F.sqrt(start * start + 80.0) + start)
    x, w = np.polynomial.legendre.leggauss(NODES)
    rule = F.array(*[F.struct(F.lit(float((a + 1) / 2)).alias("x"), F.lit(float(b / 2)).alias("w")) for a, b in zip(x, w, strict=True)])

    def add(total: Column, node: Column) -> Column:
        v = start + length * node["x"]
        y = v * v / n
        # g(0) = 1; -expm1(-y) keeps its digits for small y
        g = F.when(y > 0, F.sqrt(F.try_divide(y, -F.expm1(-y)))).otherwise(1.0)
        return total + node["w"] * F.exp(-v * v / 2) * g
    return 2.0 / np.sqrt(np.pi) * scale * length * F.aggregate(rule, F.lit(0.0), add)


def _usable(n: Column) -> Column:
    return n.isNotNull() & ~F.isnan(n) & (n > 0)


def two_sided_t(t, df) -> Column:
    """P(|T| > |t|) with ``df`` degrees of freedom (of any size, whole or not); null for null, NaN and df <= 0."""
    t, n = F.abs(_double(t)), _double(df)
    p = _tail(F.least(t, F.lit(1e150)), n, gamma_ratio(n / 2) / F.sqrt(n))
    return F.when(_usable(n) & t.isNotNull() & ~F.isnan(t), F.when(t == float("inf"), 0.0).otherwise(F.least(p, F.lit(1.0))))


def t_critical(df, alpha: float) -> Column:
    """The t with P(|T| > t) = alpha, by Newton steps from the normal quantile. The tail is convex there, so the steps
    come from below and never pass the root."""
    n, z = _double(df), z_quantile(1 - alpha / 2)
    scale = gamma_ratio(n / 2) / F.sqrt(n)

    def step(t: Column, _: Column) -> Column:
        density = scale / np.sqrt(np.pi) * F.exp(-(n + 1) / 2 * F.log1p(t * t / n))
        return t + (_tail(t, n, scale) - alpha) / (2 * density)
    root = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.lit(float(z)), step)
    return F.when(_usable(n), root)
