"""Column -> Column expressions; all built-in Spark functions, no Python UDF."""

from insight.functions.expr import (  # noqa: F401
    band,
    clip,
    guarded_ratio,
    interval_bins,
    money,
    money_sum,
    pct_true,
    round_half_even,
    rule_score,
    comes_after,
)
from insight.functions.timeparts import (  # noqa: F401
    day_name,
    day_index,
    hour_of_day,
    in_hour_window,
    is_weekend,
    month_label,
    month_start,
    whole_days_between,
)
