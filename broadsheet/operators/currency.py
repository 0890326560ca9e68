"""Amounts in several currencies to rupees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import half_even

# Rupees per unit of each known currency code.
RUPEE_RATES = {"INR": 1.0, "IN RUPEES": 1.0, "USD": 88.14, "EUR": 103.39}


def in_rupees(
    df: DataFrame,
    amount: str,
    currency: str,
    name: str,
    rates: dict[str, float] | DataFrame | None = None,
) -> DataFrame:
    """Add `name`: amount x rate, rounded half to even; null for an unknown currency.

    `rates` is a mapping (default: the fixed rates), compiled into one CASE, or a table
    `(currency, rate)` with one row per code, left-joined; Spark broadcasts it when it is small.
    """
    if not isinstance(rates, DataFrame):
        codes = (RUPEE_RATES if rates is None else rates).items()
        known = F.when(F.lit(False), F.lit(0.0))  # no rate at all, for an empty mapping
        rate = reduce(lambda case, r: case.when(F.col(currency) == r[0], F.lit(r[1])), codes, known)
        return df.withColumn(name, half_even(F.col(amount) * rate))
    table = rates.select(F.col("currency").alias("_code"), F.col("rate").alias("_rate"))
    joined = df.join(table, F.col(currency) == F.col("_code"), "left")
    return joined.withColumn(name, half_even(F.col(amount) * F.col("_rate"))).drop("_code", "_rate")
