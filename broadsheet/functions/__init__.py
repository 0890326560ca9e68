from .measures import (
    band,
    exact_mean,
    exact_sum,
    half_even,
    money_sum,
    month_key,
    pct_change,
    rounded,
    safe_ratio,
    strict_greatest,
    strict_sum,
    wide_sum,
)
from .parsing import DATE_FORMATS, date_parts, parse_date, quarter_number, quarter_year, respell, tidy

__all__ = [
    "DATE_FORMATS",
    "band",
    "date_parts",
    "exact_mean",
    "exact_sum",
    "half_even",
    "money_sum",
    "month_key",
    "parse_date",
    "pct_change",
    "quarter_number",
    "quarter_year",
    "respell",
    "rounded",
    "safe_ratio",
    "strict_greatest",
    "strict_sum",
    "tidy",
    "wide_sum",
]
