"""The figures behind a climate report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import DAYS_PER_YEAR
from ..schema import DEFAULT_KEYS

# Temperatures in Celsius at which energy demand changes.
COOLING_ABOVE = 25
HEATING_BELOW = 15


# The phrases of both labels.
def trend_label(start: Column, end: Column) -> Column:
    return (
        F.when(end > start, F.lit("Warm-up"))
        .when(end < start, F.lit("Cool-down"))
        .when(end == start, F.lit("Stable"))
    )


def energy_label(end: Column) -> Column:
    return (
        F.when(end > COOLING_ABOVE, F.lit("increased cooling loads"))
        .when(end < HEATING_BELOW, F.lit("heating requirements"))
        .when(end.isNotNull(), F.lit("moderate base energy demands"))
    )


def climate_summary(
    daily: DataFrame, forecast: DataFrame, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """History and forecast figures per key; a key without forecast keeps nulls.

    ``daily`` may lack the temperature or precipitation column: its figures are
    then null.  ``forecast`` holds one model's rows.
    """

    def history(column: str, *aggregates) -> list[Column]:
        if column in daily.columns:
            return [f(column).alias(name) for f, name in aggregates]
        return [F.lit(None).cast("double").alias(name) for _, name in aggregates]

    # The dashboard's daily names come first, the hourly ones are the fallback.
    temperature = "temperature_2m_mean" if "temperature_2m_mean" in daily.columns else "temperature_2m"
    rain = "precipitation_sum" if "precipitation_sum" in daily.columns else "precipitation"
    past = daily.groupBy(*keys).agg(
        *history(
            temperature,
            (F.avg, "mean_temperature"),
            (F.max, "max_temperature"),
            (F.min, "min_temperature"),
        ),
        *history(rain, (lambda c: F.avg(c) * DAYS_PER_YEAR, "annual_precipitation")),
    )
    ahead = forecast.groupBy(*keys).agg(
        F.min_by("forecast", "time").alias("forecast_start"),
        F.max_by("forecast", "time").alias("forecast_end"),
        F.count(F.lit(1)).alias("forecast_days"),
    )
    start, end = F.col("forecast_start"), F.col("forecast_end")
    return past.join(ahead, list(keys), "left").select(
        *past.columns,
        "forecast_start",
        "forecast_end",
        F.coalesce("forecast_days", F.lit(0).cast("long")).alias("forecast_days"),
        trend_label(start, end).alias("trend"),
        energy_label(end).alias("energy"),
    )
