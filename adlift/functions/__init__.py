"""Column-level helpers: engine-neutral rounding, safe division, statistics, dates."""

from adlift.functions.numeric import (div_or_zero, money, round_half_away, round_sql,  # noqa: F401
                                      safe_div, div_sql)
from adlift.functions.stats import normal_cdf, normal_upper_tail, two_sided_p, z_quantile  # noqa: F401
from adlift.functions.dates import year_week_monday, days_between  # noqa: F401
from adlift.functions.guards import require_columns  # noqa: F401
