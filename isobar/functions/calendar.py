"""Calendar parts of a timestamp and their cyclic encoding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean days per year used by the annual cycle and annual totals.
DAYS_PER_YEAR = 365.25

# English month names in calendar order.
MONTH_NAMES = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)


def is_daytime(time: Column) -> Column:
    """1 from 06:00 to 17:59, else 0."""
    return F.hour(time).between(6, 17).cast("int")


def month_name(month: Column) -> Column:
    """Three-letter English name of a month number, whatever the session locale."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month.cast("int"))


def calendar_parts(time: Column) -> dict[str, Column]:
    """Year, month, month name, day of month and day of year by name."""
    return {
        "year": F.year(time),
        "month": F.month(time),
        "month_name": month_name(F.month(time)),
        "day": F.day(time),
        "dayofyear": F.dayofyear(time),
    }


def seasonal_encoding(time: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of year on the annual circle."""
    angle = F.dayofyear(time) * F.lit(2 * math.pi / DAYS_PER_YEAR)
    return F.sin(angle), F.cos(angle)
