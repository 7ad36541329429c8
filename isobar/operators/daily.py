"""From hourly readings to one row per local calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wind import circular_mean
from ..schema import DEFAULT_KEYS, PLACE_COLUMNS, require
from .clean import clean_cells, clean_hourly
from .series import BUCKET

# Which figures each reading gives per day, in output order.
DAILY_FIGURES = (
    ("temperature_2m", ("mean", "min", "max")),
    ("feels_like", ("mean", "min", "max")),
    ("relative_humidity_2m", ("mean",)),
    ("dew_point_2m", ("mean",)),
    ("precipitation", ("sum",)),
    ("rain", ("sum",)),
    ("snowfall", ("sum",)),
    ("surface_pressure", ("mean",)),
    ("cloud_cover", ("mean",)),
    ("wind_speed_10m", ("mean", "max")),
    ("wind_gusts_10m", ("max",)),
    ("shortwave_radiation", ("sum",)),
)


def null_safe_sum(c: str) -> Column:
    """Sum that is 0.0 when every value is missing."""
    return F.coalesce(F.sum(c), F.lit(0.0))


_FIGURES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": null_safe_sum}


def daily_figures(df: DataFrame, time: str = "time") -> list[Column]:
    """All aggregates of a day of the readings present: figures, first place, wind direction."""
    figures = [
        _FIGURES[kind](reading).alias(f"{reading}_{kind}")
        for reading, kinds in DAILY_FIGURES
        if reading in df.columns
        for kind in kinds
    ]
    # Earliest known value, not whichever row arrives first.
    places = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c)
        for c in PLACE_COLUMNS
        if c in df.columns
    ]
    dominant = [
        circular_mean(F.col(c)).alias(f"{c}_dominant") for c in ("wind_direction_10m",) if c in df.columns
    ]
    return [*figures, *places, *dominant]


def _daily(df: DataFrame, keys: Sequence[str], time: str, within: Sequence[str]) -> DataFrame:
    require(df, time, "wind_direction_10m")
    return (
        df.where(F.col(time).isNotNull())
        .groupBy(*keys, *within, F.to_date(time).alias("_day"))
        .agg(*daily_figures(df, time))
        .withColumn("_day", F.col("_day").cast("timestamp_ntz"))
        .withColumnRenamed("_day", time)
        .drop(*within)
    )


def aggregate_daily(
    df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, time: str = "time"
) -> DataFrame:
    """Daily means, extremes, sums, first place and dominant wind direction.

    Only readings that are present give figures; days without rows do not
    appear.  The partial aggregate before the exchange leaves at most one row
    per day and input task, so a hot key travels already reduced.
    """
    return _daily(df, keys, time, ())


def clean_daily(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    time: str = "time",
    threshold: float = 3.0,
    unit: str = "month",
    cell: str | None = None,
) -> DataFrame:
    """Daily table straight from raw readings.

    The daily aggregate groups inside the cleaning cells, so it adds no exchange.
    ``cell`` as in :func:`~isobar.operators.clean.clean_hourly`.
    """
    return _daily(clean_cells(df, keys, time, threshold, unit, cell), keys, time, (BUCKET,))


def hourly_to_daily(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    time: str = "time",
    threshold: float = 3.0,
    unit: str = "month",
) -> tuple[DataFrame, DataFrame]:
    """Clean hourly table and the daily table made from it.

    Both are lazy plans.  When both are used, write the hourly one first and
    aggregate the stored table with :func:`aggregate_daily`.
    """
    hourly = clean_hourly(df, keys, time, threshold, unit)
    return hourly, clean_daily(df, keys, time, threshold, unit)
