"""Rounding and division that give identical doubles in Spark and DuckDB.

``round`` differs between engines on values such as 1.005 and on negative zero,
so every rounded output goes through :func:`round_half_away` instead: pure IEEE
arithmetic, ``sign(x) * floor(|x| * 10^n + 0.5) / 10^n + 0.0``. Each helper has a
``*_sql`` twin that spells the same formula for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c, digits: int) -> Column:
    """Round half away from zero to ``digits`` decimals; null stays null."""
    x = _col(c).cast("double")
    scale = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale) + F.lit(0.0)


def round_sql(expr: str, digits: int) -> str:
    scale = f"{float(10 ** digits)!r}"
    return f"(sign(CAST({expr} AS DOUBLE)) * floor(abs(CAST({expr} AS DOUBLE)) * {scale} + 0.5) / {scale} + 0.0)"


def safe_div(num, den) -> Column:
    """``num / den`` as DOUBLE, null when ``den`` is 0 or null (SQL NULLIF rule)."""
    d = _col(den).cast("double")
    return F.try_divide(_col(num).cast("double"), F.when(d != 0, d))


def div_sql(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def div_or_zero(num, den) -> Column:
    """Python-side rule of the reference: 0.0 instead of null when ``den`` is 0."""
    return F.coalesce(safe_div(num, den), F.lit(0.0))


def money(c) -> Column:
    """Money as DOUBLE for output; sums are kept in DECIMAL(18,2) before this."""
    return _col(c).cast("double")


def as_long(c) -> Column:
    return _col(c).cast("bigint")


def exact_sum(c, scale: int) -> Column:
    """Order-independent SUM of values already rounded to ``scale`` decimals:
    summed as DECIMAL (exact), returned as DOUBLE. Plain double sums depend on
    partition order, which changes results at rounding boundaries."""
    from pyspark.sql.types import DecimalType
    return F.sum(_col(c).cast(DecimalType(38, scale))).cast("double")


def exact_avg(c, scale: int) -> Column:
    return exact_sum(c, scale) / F.count(_col(c)).cast("double")


def exact_sum_sql(expr: str, scale: int) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(38,{scale}))) AS DOUBLE)"


def exact_avg_sql(expr: str, scale: int) -> str:
    return f"({exact_sum_sql(expr, scale)} / CAST(COUNT({expr}) AS DOUBLE))"
