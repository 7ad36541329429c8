"""Mean forecast: the fallback model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...schema import DEFAULT_KEYS
from .common import days_after, train_rows


def forecast_mean(
    split: DataFrame,
    forecast_days: int | Column = 90,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Training mean with two sample deviations either side, ``forecast_days`` rows.

    The number of days may be a column that is the same in all rows of a key.
    """
    days = F.max(forecast_days if isinstance(forecast_days, Column) else F.lit(forecast_days))
    level = train_rows(split).groupBy(*keys).agg(
        days.cast("int").alias("_days"),
        F.avg(target).alias("forecast"),
        (2 * F.stddev_samp(target)).alias("_w"),
        F.max("time").alias("_last"),
    )
    return level.select(
        "*", F.explode(F.expr("sequence(1, _days)")).alias("_i")
    ).select(
        *keys,
        F.lit("mean").alias("model"),
        days_after(F.col("_last"), F.col("_i")).alias("time"),
        "forecast",
        (F.col("forecast") - F.col("_w")).alias("lower_ci"),
        (F.col("forecast") + F.col("_w")).alias("upper_ci"),
    )
