"""Feels-like temperature: heat index, wind chill and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rothfusz regression, degrees Fahrenheit and percent humidity.
# (coefficient, power of temperature, power of humidity)
ROTHFUSZ = (
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-0.00683783, 2, 0),
    (-0.05481717, 0, 2),
    (0.00122874, 2, 1),
    (0.00085282, 1, 2),
    (-0.00000199, 2, 2),
)

# Range of validity and metric wind chill coefficients.
WARM_FROM_C = 26.7
HUMID_FROM_PCT = 40
COLD_UP_TO_C = 10.0
WINDY_ABOVE_KMH = 4.8
CHILL = (13.12, 0.6215, -11.37, 0.3965)
CHILL_EXPONENT = 0.16


def _power(base: Column, exponent: int) -> Column:
    out = base
    for _ in range(exponent - 1):
        out = out * base
    return out


def heat_index(temp_c: Column, humidity: Column) -> Column:
    """Heat index in Celsius; the temperature itself outside the warm, humid range."""
    temp_f = temp_c * 9 / 5 + 32
    total = F.lit(0.0)
    for coefficient, t_power, h_power in ROTHFUSZ:
        term = F.lit(coefficient)
        if t_power:
            term = term * _power(temp_f, t_power)
        if h_power:
            term = term * _power(humidity, h_power)
        total = total + term
    mild = (temp_c < WARM_FROM_C) | (humidity < HUMID_FROM_PCT)
    return F.when(mild, temp_c).otherwise((total - 32) * 5 / 9)


def wind_chill(temp_c: Column, wind_kmh: Column) -> Column:
    """Wind chill in Celsius; the temperature itself when it is warm or calm."""
    base, per_degree, per_wind, per_both = CHILL
    gust = F.pow(wind_kmh, F.lit(CHILL_EXPONENT))
    chilled = base + per_degree * temp_c + per_wind * gust + per_both * temp_c * gust
    mild = (temp_c > COLD_UP_TO_C) | (wind_kmh <= WINDY_ABOVE_KMH)
    return F.when(mild, temp_c).otherwise(chilled)


def feels_like(temp_c: Column, humidity: Column, wind_kmh: Column) -> Column:
    """Heat index when warm, wind chill when cold and moving air, else temperature."""
    return (
        F.when(temp_c >= WARM_FROM_C, heat_index(temp_c, humidity))
        .when((temp_c <= COLD_UP_TO_C) & (wind_kmh > 0), wind_chill(temp_c, wind_kmh))
        .otherwise(temp_c)
    )


def feels_like_of(df: DataFrame) -> Column:
    """``feels_like`` from whichever readings ``df`` carries, decided at plan time."""
    have = set(df.columns)
    if {"temperature_2m", "relative_humidity_2m"} <= have:
        wind = F.col("wind_speed_10m") if "wind_speed_10m" in have else F.lit(0.0)
        return feels_like(F.col("temperature_2m"), F.col("relative_humidity_2m"), wind)
    for fallback in ("apparent_temperature", "temperature_2m"):
        if fallback in have:
            return F.col(fallback)
    return F.lit(0.0)
