"""The daily aggregate and the row-wise cleaning steps on arriving readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.comfort import feels_like_of
from ..functions.calendar import is_daytime
from ..functions.wmo import wmo_description
from ..operators.clean import cap_to_bounds
from ..operators.daily import daily_figures
from ..schema import CAPPED_READINGS, DEFAULT_KEYS


def stream_daily(
    readings: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, lateness: str = "2 days"
) -> DataFrame:
    """The columns of the daily aggregate from a stream of readings; rows later than ``lateness`` are dropped.

    A watermark needs an instant, so naive local times are read in the session
    zone, which must be UTC, and given back as naive times.
    """
    timed = readings.withColumn("_ts", F.col("time").cast("timestamp"))
    return (
        timed.withWatermark("_ts", lateness)
        .groupBy(*keys, F.window("_ts", "1 day"))
        .agg(*daily_figures(readings))
        .withColumn("time", F.col("window.start").cast("timestamp_ntz"))
        .drop("window")
    )


def stream_clean(
    readings: DataFrame, bounds: DataFrame, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """Cap readings to stored bounds and add the derived columns.

    ``bounds`` is a static table from
    :func:`~isobar.operators.clean.outlier_bounds`; no state is kept.
    """
    capped = [c for c in CAPPED_READINGS if c in readings.columns]
    clean = cap_to_bounds(readings.join(bounds, list(keys), "left"), capped)
    out = clean.withColumn("feels_like", feels_like_of(clean)).withColumn(
        "is_daytime", is_daytime(F.col("time"))
    )
    if "weather_code" in out.columns:
        out = out.withColumn("description", wmo_description(F.col("weather_code")))
    return out
