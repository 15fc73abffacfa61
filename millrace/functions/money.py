"""Exact decimal money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def convert(amount: Column, rate: Column) -> Column:
    """amount x rate as decimal(38,12), exact: operands are narrowed so that Spark keeps all twelve digits; out of range is null."""
    return (amount.try_cast("decimal(20,4)") * rate.try_cast("decimal(17,8)")).try_cast("decimal(38,12)")


def less(gross: Column, discount: Column) -> Column:
    """gross - discount as decimal(38,12), exact."""
    return (gross.try_cast("decimal(36,12)") - discount.try_cast("decimal(24,4)")).try_cast("decimal(38,12)")


def reported(exact: Column) -> Column:
    """To two digits, halves away from zero."""
    return F.round(exact, 2).cast("decimal(28,2)")


def rate_or_one(currency: Column, rate: Column, home: str = "TWD") -> Column:
    """1 for the home currency; a missing foreign rate stays missing."""
    return F.when(currency == home, F.lit("1.00000000").cast("decimal(24,8)")).otherwise(rate)
