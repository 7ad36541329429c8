"""Wind direction arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Average components are rounded here before the angle is taken, so opposite
# winds that cancel give 0 instead of the angle of their rounding noise.
_NOISE_DECIMALS = 12


def wind_components(direction: Column) -> tuple[Column, Column]:
    """Sine and cosine of a direction in degrees."""
    angle = F.radians(direction)
    return F.sin(angle), F.cos(angle)


def circular_mean(direction: Column) -> Column:
    """Aggregate: direction of the mean unit vector, in [0, 360)."""
    sine, cosine = wind_components(direction)
    angle = F.degrees(
        F.atan2(F.round(F.avg(sine), _NOISE_DECIMALS), F.round(F.avg(cosine), _NOISE_DECIMALS))
    )
    positive = F.pmod(angle, F.lit(360.0))
    return F.when(positive >= 360.0, F.lit(0.0)).otherwise(positive)
