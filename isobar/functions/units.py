"""Unit conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of a column name that mark a temperature.
TEMPERATURE_MARKS = ("temperature", "feels")


def to_fahrenheit(celsius: Column) -> Column:
    """Celsius to Fahrenheit; null stays null."""
    return celsius * 9 / 5 + 32


def temperatures_to_fahrenheit(
    df: DataFrame, marks: Sequence[str] = TEMPERATURE_MARKS
) -> DataFrame:
    """Convert every column whose name holds one of ``marks``."""
    return df.select(
        [
            to_fahrenheit(F.col(c)).alias(c) if any(m in c for m in marks) else F.col(c)
            for c in df.columns
        ]
    )


def display_temperature(value: Column) -> Column:
    """Whole degrees, halves to the even neighbour."""
    return F.bround(value, 0)
