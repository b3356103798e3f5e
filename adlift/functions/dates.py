"""Date helpers with the reference's SQLite semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_week_monday(d) -> Column:
    """SQLite ``strftime('%Y-%W', d)``: week of year with Monday as first day,
    days before the year's first Monday in week 00. Spark has no pattern for it.
    """
    d = F.col(d) if isinstance(d, str) else d
    # weekday with Monday = 0 ... Sunday = 6
    wd = F.pmod(F.dayofweek(d) + F.lit(5), F.lit(7))
    week = F.floor((F.dayofyear(d) + F.lit(6) - wd) / F.lit(7)).cast("int")
    return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def year_week_monday_sql(d: str) -> str:
    return (f"(CAST(year({d}) AS VARCHAR) || '-' || "
            f"lpad(CAST(CAST(floor((dayofyear({d}) + 6 - ((dayofweek({d}) + 6) % 7)) / 7) AS INTEGER) AS VARCHAR), 2, '0'))")


def days_between(later, earlier) -> Column:
    """JULIANDAY(later) - JULIANDAY(earlier) for DATE values, as DOUBLE."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return F.datediff(later, earlier).cast("double")
