"""Column expressions that read quarters, dates and spellings out of raw text.

All of them turn unreadable text into null rather than failing under ANSI mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide which quarter labels are understood.
YEAR_PATTERN = r"(\d{4})"
QUARTER_PATTERN = r"(?i)([Qq]\d|Qtr\d|[1-4]th\s*Qtr)"

# Notations understood in a month or date column: the shape of the text and its format.
DATE_FORMATS = {
    r"^\d{4}-\d{2}$": "yyyy-MM",
    r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$": "yyyy-MM-dd HH:mm:ss",
    r"^\d{4}/\d{2}/\d{2}$": "yyyy/MM/dd",
    r"^[A-Za-z]{3}-\d{2}$": "MMM-yy",
    r"^[A-Za-z]{3}-\d{4}$": "MMM-yyyy",
}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _int_or_null(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("int")


def quarter_year(label: Column | str) -> Column:
    """First run of four digits as int, null without one."""
    return _int_or_null(F.regexp_extract(_column(label), YEAR_PATTERN, 1))


def quarter_number(label: Column | str) -> Column:
    """Digit of the first quarter mark as int, null for labels the pattern does not know."""
    mark = F.regexp_extract(_column(label), QUARTER_PATTERN, 1)
    return _int_or_null(F.regexp_replace(mark, "[^0-9]", ""))


def tidy(text: Column | str) -> Column:
    """Upper case without leading or trailing white space of any kind."""
    return F.upper(F.regexp_replace(_column(text), r"(?U)^\s+|\s+$", ""))


def respell(text: Column | str, spellings: dict[str, str]) -> Column:
    """Replace each pattern by its canonical spelling, case-sensitively."""
    return reduce(
        lambda c, item: F.regexp_replace(c, item[0], item[1]), spellings.items(), _column(text)
    )


def parse_date(text: Column | str, formats: dict[str, str] | None = None) -> Column:
    """Date by the format whose shape the text has, null when none fits or the date is no date.

    Only the one fitting format is tried: a failed parse costs far more than a pattern.
    """
    text = _column(text)
    return reduce(
        lambda case, f: case.when(text.rlike(f[0]), F.try_to_date(text, f[1])),
        (formats or DATE_FORMATS).items(),
        F,
    )


def date_parts(date: Column | str, prefix: str = "", month: str = "month_num") -> dict[str, Column]:
    """Year, month number, English month name and quarter, ready for `withColumns`."""
    date = _column(date)
    return {
        f"{prefix}year": F.year(date),
        f"{prefix}{month}": F.month(date),
        f"{prefix}month_name": F.date_format(date, "MMMM"),
        f"{prefix}quarter": F.quarter(date),
    }
