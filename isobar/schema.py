"""Table shapes, column groups and plan-time checks shared by every module."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_KEYS = ("station_id",)

# The readings an hourly archive payload carries, in payload order.
HOURLY_READINGS = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "apparent_temperature",
    "precipitation",
    "rain",
    "snowfall",
    "surface_pressure",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "shortwave_radiation",
)

PLACE_COLUMNS = ("latitude", "longitude", "elevation")

# Readings whose outliers are capped during cleaning.
CAPPED_READINGS = (
    "temperature_2m",
    "relative_humidity_2m",
    "surface_pressure",
    "wind_speed_10m",
)

# Columns of a table that describe a row rather than measure something.
NOT_VARIABLES = ("time", *PLACE_COLUMNS, "wind_direction_10m_dominant")

# Daily columns that may be forecast.
FORECAST_TARGETS = (
    "temperature_2m_mean",
    "feels_like_mean",
    "relative_humidity_2m_mean",
    "surface_pressure_mean",
    "wind_speed_10m_mean",
)

HOURLY_SCHEMA = T.StructType(
    [T.StructField("station_id", T.LongType()), T.StructField("time", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in (*HOURLY_READINGS, *PLACE_COLUMNS)]
)

STATION_SCHEMA = T.StructType(
    [
        T.StructField("station_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in PLACE_COLUMNS],
    ]
)


def require(df: DataFrame, *columns: str) -> None:
    """Fail while the plan is built when a mandatory column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"DataFrame must contain column(s): {', '.join(missing)}")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns of ``df``, in order, without ``exclude``."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def variable_columns(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> list[str]:
    """Measured variables: numeric columns that are neither keys nor descriptive."""
    return numeric_columns(df, exclude=(*keys, *NOT_VARIABLES))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL once at ingestion, so later code knows one kind of missing."""

    def clean(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        return F.col(f.name)

    return df.select([clean(f) for f in df.schema.fields])
