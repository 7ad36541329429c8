"""Names for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_name(column_name: Column) -> Column:
    """A column name as words with capitals."""
    return F.initcap(F.replace(column_name, F.lit("_"), F.lit(" ")))


def file_name(place: Column) -> Column:
    """A place name in lower case with underscores, as stored files use it."""
    return F.replace(F.lower(place), F.lit(" "), F.lit("_"))
