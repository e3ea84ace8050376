"""Exact rounding on integers and decimals.

All rounding is half-up on integer arithmetic, so a result is the same whatever
the order of the rows and whichever engine checks it.
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from duecheck.schemas import MONEY, RATE


def half_up(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a whole number, halves upwards; NULL over zero.

    Both sides must be whole and not negative.
    """
    safe = F.nullif(denominator, F.lit(0))
    return F.call_function("div", 2 * numerator + safe, 2 * safe)


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """A share rounded to ``digits`` places, as double."""
    scale = 10**digits
    return half_up(numerator * scale, denominator) / F.lit(scale)


def cents_to_money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def rate_e10(rate: Column) -> Column:
    """A rate in its smallest unit, as a whole decimal."""
    return (rate.cast(RATE) * F.lit(Decimal(10**10))).cast("decimal(18,0)")


def whole(column: Column) -> Column:
    return column.cast("decimal(20,0)")
