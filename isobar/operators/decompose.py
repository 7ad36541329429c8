"""Additive decomposition of a series into trend, season and remainder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_KEYS, require
from .clean import fill_forward_backward
from .series import BLOCK, CORE, LENGTH, POSITION, block_window, with_blocks, with_position

# Bounds of the period used when a series is shorter than two periods.
SHORT_PERIODS = (7, 30)


def _moving_average(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``trend``: a centred moving average whose width is a column.

    A block is one array of rows with sums running along it, so any width is the
    difference of two of its elements.  A block holds a bounded number of rows.
    """
    summed = blocks.withColumn("_sum", F.sum("_x").over(block_window(keys)))
    arrays = summed.groupBy(*keys, BLOCK).agg(
        F.sort_array(F.collect_list(F.struct(POSITION, "time", "_x", "_sum", CORE))).alias("_rows"),
        F.first("_period").alias("_period"),
        F.first(LENGTH).alias(LENGTH),
    )
    p, n = F.col("_period"), F.col(LENGTH)
    half = F.floor(p / 2).cast("int")
    whole = n >= 2 * p
    at_rows = F.col("_rows")
    last = F.size("_rows") - 1

    def reach(i: Column, back: Column, ahead: Column) -> tuple[Column, Column, Column]:
        low, high = F.greatest(i - back, F.lit(0)), F.least(i + ahead, last)
        before = F.when(low > 0, F.get(at_rows, low - 1)["_sum"]).otherwise(0.0)
        return low, high, F.get(at_rows, high)["_sum"] - before

    def averaged(row: Column, i: Column) -> Column:
        low, high, total = reach(i, half, half)
        # An even width counts the two ends half.
        ends = F.when(p % 2 == 0, (F.get(at_rows, low)["_x"] + F.get(at_rows, high)["_x"]) / 2).otherwise(0.0)
        inside = (row[POSITION] >= half) & (row[POSITION] + half < n)
        # Too short to decompose: a plain rolling mean over what is there.
        few_low, few_high, few = reach(i, half, F.floor((p - 1) / 2).cast("int"))
        trend = F.when(~whole, few / (few_high - few_low + 1)).when(inside, (total - ends) / p)
        return F.struct(row[POSITION].alias(POSITION), row["time"].alias("time"), row["_x"].alias("_x"), row[CORE].alias(CORE), trend.alias("trend"))

    rows = arrays.select(*keys, "_period", LENGTH, F.inline(F.transform("_rows", averaged)))
    return rows.where(CORE).drop(CORE)


def seasonal_decompose(
    df: DataFrame,
    target: str = "temperature_2m_mean",
    period: int = 365,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """``(keys, time, observed, trend, seasonal, resid, period)`` per row.

    Gaps are filled forward, then back.  A series shorter than two periods uses
    a period between 7 and 30 set by its length; one below 14 rows gets a
    rolling mean as trend and no season.  The moving average is continued at
    both ends by a line through the nearest period of trend values; the season
    is the mean remainder by phase, centred on zero.
    """
    require(df, "time", target)
    least, most = SHORT_PERIODS
    series = df.select(*keys, "time", F.col(target).cast("double").alias("_x"))
    placed = with_position(fill_forward_backward(series, keys, ["_x"], unit="year"), keys)
    n = F.col(LENGTH)
    short = F.greatest(F.lit(least), F.least(F.floor(n / 2) - 1, F.lit(most)))
    sized = placed.withColumn(
        "_period", F.when(n >= 2 * period, F.lit(period)).otherwise(short).cast("int")
    )
    reach = max(period // 2, most // 2) + 1
    blocks = with_blocks(sized, keys, before=reach, after=reach)
    smooth = _moving_average(blocks, keys)

    at, p = F.col(POSITION), F.col("_period")
    front = F.floor(p / 2)
    back = F.col(LENGTH) - 1 - front
    ranges = {
        "front": (at >= front) & (at < F.least(front + p, back)),
        "back": (at >= F.greatest(front, back - p)) & (at < back),
    }
    lines = smooth.groupBy(*keys).agg(
        *[
            fit(F.when(inside, F.col("trend")), at).alias(f"_{end}_{name}")
            for end, inside in ranges.items()
            for name, fit in (("slope", F.regr_slope), ("level", F.regr_intercept))
        ]
    )
    decomposes = F.col(LENGTH) >= 2 * p

    def extended(end: str):
        return F.col(f"_{end}_level") + F.col(f"_{end}_slope") * at

    trended = (
        smooth.join(lines, list(keys))
        .withColumn(
            "trend",
            F.when(decomposes & (at < front), extended("front"))
            .when(decomposes & (at > back), extended("back"))
            .otherwise(F.col("trend")),
        )
        .withColumn("_phase", (at % p).cast("int"))
        .select(*keys, "time", "_x", "trend", "_phase", "_period", decomposes.alias("_full"))
    )
    phases = trended.groupBy(*keys, "_phase").agg(F.avg(F.col("_x") - F.col("trend")).alias("_m"))
    centred = phases.select(
        *keys, "_phase", (F.col("_m") - F.avg("_m").over(Window.partitionBy(*keys))).alias("_s")
    )
    seasonal = F.when(F.col("_full"), F.col("_s")).otherwise(F.lit(0.0))
    return (
        trended.join(centred, [*keys, "_phase"])
        .withColumn("seasonal", seasonal)
        .select(
            *keys,
            "time",
            F.col("_x").alias("observed"),
            "trend",
            "seasonal",
            (F.col("_x") - F.col("trend") - F.col("seasonal")).alias("resid"),
            F.col("_period").alias("period"),
        )
    )
