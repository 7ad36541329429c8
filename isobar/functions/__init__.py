"""Column functions: no state, no exchange, all inside code generation."""

from .calendar import calendar_parts, is_daytime, month_name, seasonal_encoding
from .comfort import feels_like, feels_like_of, heat_index, wind_chill
from .units import display_temperature, temperatures_to_fahrenheit, to_fahrenheit
from .wind import circular_mean, wind_components
from .wmo import weather_category, wmo_description

__all__ = [
    "calendar_parts",
    "circular_mean",
    "display_temperature",
    "feels_like",
    "feels_like_of",
    "heat_index",
    "is_daytime",
    "month_name",
    "seasonal_encoding",
    "temperatures_to_fahrenheit",
    "to_fahrenheit",
    "weather_category",
    "wind_chill",
    "wind_components",
    "wmo_description",
]
