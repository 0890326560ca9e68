"""Column expressions for amounts, ratios, labels and keys.

Sums of well-formed figures are taken over longs, so they never depend on the order in which partial
sums arrive; what figures have beyond their usual digits is added beside. A division to double comes
last, and rounding after that.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


SUM = T.DecimalType(37, 12)
WIDE = T.DecimalType(38, 6)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(value: Column | str, digits: int, result: T.DecimalType = SUM) -> Column:
    """SUM of a double, as DECIMAL(38,12) or `result`: no row is rounded, only the sum, to its decimals.

    Rows are added as whole units of the digit given, which costs a fraction of adding decimals.
    The units go in two parts, 20 bits and the rest, so that neither sum can outgrow a long. What
    the units leave of a row is summed as a double; it is exactly 0 for rows with no more digits,
    whose sum is therefore the same in any order. Rows too large for a long of units are added
    apart, as whole numbers in limbs of 20 bits above which 60 bits are left for the rest: such
    numbers have next to no digits behind the point. The decimal is made once per group.
    """
    value, scale = _column(value).cast("double"), F.lit(float(10**digits))
    scaled = value * scale
    fits = F.abs(scaled) < F.lit(float(1 << 62))
    units = F.rint(F.when(fits, scaled)).cast("long")
    high = F.sum(F.shiftright(units, 20)).cast("decimal(20,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << 20) - 1)))
    total = F.coalesce((high * F.lit(1 << 20) + low).cast("decimal(26,0)"), F.lit(0).cast("decimal(26,0)"))

    whole = F.rint(F.when(~fits, value))
    top = F.floor(whole / F.lit(float(1 << 60)))
    below = (whole - top.cast("double") * F.lit(float(1 << 60))).cast("long")
    limbs = [top] + [F.shiftright(below, n).bitwiseAND(F.lit((1 << 20) - 1)) for n in (40, 20, 0)]
    large = reduce(
        lambda upper, limb: (upper * F.lit(1 << 20) + limb).cast("decimal(38,0)"),
        [F.coalesce(F.sum(limb), F.lit(0)).cast("decimal(38,0)") for limb in limbs],
    )
    rest = F.sum(F.coalesce(value - units.cast("double") / scale, value - whole)).cast(result)
    small = (total * F.lit(Decimal(1).scaleb(-digits))).cast(result)
    return (small + large.cast(result)).cast(result) + rest


def wide_sum(value: Column | str, digits: int = 2) -> Column:
    """SUM of amounts of any size, as DECIMAL(38,6): sums below 10 ** 32, six decimals."""
    return exact_sum(value, digits, WIDE).cast(WIDE)


def money_sum(amount: Column | str) -> Column:
    """SUM of an amount, exact for whole hundredths."""
    return exact_sum(amount, 2)


def strict_sum(*columns: Column | str) -> Column:
    """Row-wise sum, null when any part is null."""
    return reduce(lambda a, b: a + b, map(_column, columns))


def exact_mean(value: Column | str) -> Column:
    """AVG as double, exact before the division for values with up to six decimals; null for a
    group without values."""
    total = exact_sum(value, 6).cast("double")
    return total / F.nullif(F.count(_column(value)), F.lit(0))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator as double, null when the denominator is 0 or null."""
    denominator = _column(denominator).cast("double")
    return _column(numerator).cast("double") / F.nullif(denominator, F.lit(0.0))


def pct_change(current: Column | str, previous: Column | str) -> Column:
    """Percentage change, null without a non-zero previous value."""
    current, previous = _column(current), _column(previous)
    return safe_ratio((current - previous) * 100, previous)


def rounded(value: Column | str, digits: int) -> Column:
    """Round a quotient of whole numbers or decimals, ties away from zero.

    A quotient that is a tie in decimals may come out a last bit below it as a double; twelve
    decimal places are where the two agree.
    """
    return F.round(_column(value).cast("decimal(38,12)"), digits).cast("double")


def half_even(value: Column | str, digits: int = 2) -> Column:
    """Round a figure that is a double by nature: scale, nearest or even whole number, unscale.

    This is how both data frames and databases round doubles, ties included; `rounded` is how
    databases round decimals.
    """
    scale = float(10**digits)
    return F.rint(_column(value) * scale) / scale + 0.0  # no negative zero


def strict_greatest(*columns: Column | str) -> Column:
    """GREATEST that is null as soon as one argument is null (Spark's skips nulls)."""
    columns = [_column(c) for c in columns]
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(complete, F.greatest(*columns))


def band(value: Column | str, steps: list[tuple[str, float, object]], otherwise) -> Column:
    """First matching step `(operator, limit, result)` wins; a null value falls to `otherwise`."""
    value = _column(value)
    tests = {"<": value.__lt__, "<=": value.__le__, ">": value.__gt__, ">=": value.__ge__}
    chain = F
    for operator, limit, result in steps:
        chain = chain.when(tests[operator](F.lit(limit)), F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def month_key(year: Column | str, month: Column | str) -> Column:
    """'YYYY-MM', null when a part is null."""
    return F.concat(
        _column(year).cast("string"),
        F.lit("-"),
        F.lpad(_column(month).cast("string"), 2, "0"),
    )
