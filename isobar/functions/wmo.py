"""Weather codes of the World Meteorological Organization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code to text.
WMO_TEXT = {
    0: "Clear sky",
    1: "Mainly clear",
    2: "Partly cloudy",
    3: "Overcast",
    45: "Fog",
    48: "Depositing rime fog",
    51: "Light drizzle",
    53: "Moderate drizzle",
    55: "Dense drizzle",
    61: "Slight rain",
    63: "Moderate rain",
    65: "Heavy rain",
    71: "Slight snow fall",
    73: "Moderate snow fall",
    75: "Heavy snow fall",
    77: "Snow grains",
    80: "Slight rain showers",
    81: "Moderate rain showers",
    82: "Violent rain showers",
    85: "Slight snow showers",
    86: "Heavy snow showers",
    95: "Thunderstorm: Slight or moderate",
    96: "Thunderstorm with slight hail",
    99: "Thunderstorm with heavy hail",
}

# Codes of each weather class.
CATEGORY_CODES = {
    "cloudy": (1, 2, 3, 45, 48),
    "rainy": (51, 53, 55, 61, 63, 65, 80, 81, 82),
    "snowy": (71, 73, 75, 77, 85, 86),
    "thunderstorm": (95, 96, 99),
}


def wmo_description(code: Column, default: str = "Unknown conditions") -> Column:
    """Text of a weather code.

    The dictionary is 24 fixed entries, so it travels inside the expression as
    a literal map: no join, no exchange.
    """
    entries = [F.lit(v) for pair in WMO_TEXT.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), code.cast("int")), F.lit(default))


def weather_category(code: Column) -> Column:
    """Class of a weather code; anything unlisted counts as clear."""
    out = F
    for name, codes in CATEGORY_CODES.items():
        out = out.when(code.isin(*codes), F.lit(name))
    return out.otherwise(F.lit("clear"))
