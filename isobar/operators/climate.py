"""Climatology tables: calendar means, monthly shape, totals, wind rose, key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_name
from ..schema import DEFAULT_KEYS, require
from .daily import null_safe_sum
from .quantiles import exact_quantiles
from .stats import QUARTILES, with_quantiles

# Compass sectors clockwise from north, and speed classes in km/h.
SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
SPEED_CLASSES = ("<5 km/h", "5-10 km/h", "10-20 km/h", ">20 km/h")
SPEED_EDGES = (5, 10, 20)


def _literals(values: Sequence[object]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _all_months(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key with each of the twelve months."""
    known = df.select(*keys).distinct()
    return known.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


def calendar_matrix(
    df: DataFrame, column: str = "temperature_2m_mean", keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """Mean by month and day of month over all years, one column per day.

    Twelve rows per key in calendar order; months or days never seen are null.
    The pivot values are given, so no extra job looks for them.
    """
    require(df, "time", column)
    dated = df.select(
        *keys, F.month("time").alias("month"), F.day("time").alias("_day"), F.col(column)
    )
    means = (
        dated.groupBy(*keys, "month").pivot("_day", list(range(1, 32))).agg(F.avg(column))
    )
    days = [F.col(str(d)).alias(f"day_{d}") for d in range(1, 32)]
    return (
        _all_months(means, keys)
        .join(means, [*keys, "month"], "left")
        .select(*keys, "month", month_name(F.col("month")).alias("month_name"), *days)
    )


def monthly_distribution(
    df: DataFrame,
    column: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Count, extremes and exact quartiles by calendar month, whatever the months hold."""
    require(df, "time", column)
    group = [*keys, "month"]
    dated = df.select(*keys, F.month("time").alias("month"), F.col(column).alias("value"))
    stats = dated.groupBy(*group).agg(
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return with_quantiles(stats, exact_quantiles(dated, group, "value", QUARTILES), group).select(
        *group, month_name(F.col("month")).alias("month_name"), "count", "min", *QUARTILES, "max"
    )


def monthly_histogram(
    df: DataFrame,
    low: float,
    high: float,
    bins: int = 20,
    column: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Count and share per month and equal-width bin; bins 0 and ``bins + 1`` hold
    values outside ``[low, high)``.  Stands in for the drawn density."""
    month = F.month("time").alias("month")
    placed = df.where(F.col(column).isNotNull()).select(
        *keys, month, F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")
    )
    counted = placed.groupBy(*keys, "month", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys, "month").agg(F.sum("n").alias("_total"))
    width = (high - low) / bins
    return counted.join(totals, [*keys, "month"]).select(
        *keys,
        "month",
        "bin",
        (F.lit(float(low)) + (F.col("bin") - 1) * width).alias("bin_start"),
        "n",
        (F.col("n") / F.col("_total")).alias("share"),
    )


def yearly_sum(
    df: DataFrame, column: str = "precipitation_sum", keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """Sum by year, 0.0 where every value is missing."""
    require(df, "time", column)
    return df.groupBy(*keys, F.year("time").alias("year")).agg(null_safe_sum(column).alias(column))


def monthly_mean(
    df: DataFrame, column: str = "precipitation_sum", keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """Mean by calendar month over all years."""
    require(df, "time", column)
    means = df.groupBy(*keys, F.month("time").alias("month")).agg(F.avg(column).alias(column))
    return means.select(*keys, "month", month_name(F.col("month")).alias("month_name"), column)


def wind_sector(direction: Column, centered: bool = False) -> Column:
    """Sector 0..7 of a direction.

    By default the first sector is [0, 45) degrees; ``centered`` turns the
    sectors by half a width so that north lies in the middle of the first.
    """
    turned = direction + 22.5 if centered else direction
    return F.floor(F.pmod(turned, F.lit(360.0)) / 45).cast("int") % 8


def speed_class(speed: Column) -> Column:
    """Class 0..3 of a speed; null for a negative one."""
    out = F.when(speed < 0, F.lit(None).cast("int"))
    for i, edge in enumerate(SPEED_EDGES):
        out = out.when(speed < edge, F.lit(i))
    return out.otherwise(F.lit(len(SPEED_EDGES)))


def wind_rose(
    df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, centered: bool = False
) -> DataFrame:
    """Percent of rows by sector and speed class; all 32 cells per key.

    Uses the daily columns when present, else the hourly ones.  The share is of
    all rows with both values known.
    """
    speed = "wind_speed_10m_mean" if "wind_speed_10m_mean" in df.columns else "wind_speed_10m"
    direction = (
        "wind_direction_10m_dominant"
        if "wind_direction_10m_dominant" in df.columns
        else "wind_direction_10m"
    )
    require(df, speed, direction)
    known = df.dropna(subset=[speed, direction])
    placed = known.select(
        *keys,
        wind_sector(F.col(direction), centered).alias("sector"),
        speed_class(F.col(speed)).alias("speed_class"),
    )
    counted = placed.groupBy(*keys, "sector", "speed_class").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    grid = totals.select(
        *keys, "_total", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sector")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("speed_class"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return grid.join(counted, [*keys, "sector", "speed_class"], "left").select(
        *keys,
        "sector",
        F.element_at(_literals(SECTORS), F.col("sector") + 1).alias("sector_name"),
        "speed_class",
        F.element_at(_literals(SPEED_CLASSES), F.col("speed_class") + 1).alias("speed_label"),
        n.alias("n"),
        (n / F.col("_total") * 100).alias("percent"),
    )


def kpis(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Key figures of a daily table."""
    return df.groupBy(*keys).agg(
        F.avg("temperature_2m_mean").alias("avg_temperature"),
        F.max("temperature_2m_max").alias("max_temperature"),
        F.min("temperature_2m_min").alias("min_temperature"),
        null_safe_sum("precipitation_sum").alias("total_precipitation"),
        F.avg("wind_speed_10m_mean").alias("avg_wind_speed"),
    )
