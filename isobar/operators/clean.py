"""Repairing hourly readings: gaps, outliers and the derived feels-like column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.comfort import feels_like_of
from ..schema import CAPPED_READINGS, DEFAULT_KEYS, numeric_columns, require
from .series import BUCKET, POSITION, neighbours


def parse_time(df: DataFrame, time: str = "time") -> DataFrame:
    """Require and parse the time column.

    Times are naive local station times and stay ``TIMESTAMP_NTZ``.  No sort
    happens here: order is part of each window that needs it.
    """
    require(df, time)
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return df
    return df.withColumn(time, F.col(time).cast("timestamp_ntz"))


def _between(c: str) -> str:
    """Straight line between the known neighbours by row position; edges level."""
    share = f"({POSITION} - `_prev_at_{c}`) / CAST(`_next_at_{c}` - `_prev_at_{c}` AS DOUBLE)"
    return (
        f"CASE WHEN `{c}` IS NOT NULL THEN CAST(`{c}` AS DOUBLE) "
        f"WHEN `_prev_{c}` IS NOT NULL AND `_next_{c}` IS NOT NULL "
        f"THEN `_prev_{c}` + (`_next_{c}` - `_prev_{c}`) * {share} "
        f"ELSE CAST(coalesce(`_prev_{c}`, `_next_{c}`) AS DOUBLE) END AS `{c}`"
    )


def _imputed(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    unit: str,
    linear: Sequence[str],
    level: Sequence[str],
    moments: Sequence[str] = (),
    cell: str | None = None,
) -> DataFrame:
    """Fill ``linear`` columns by interpolation and ``level`` ones forward, then back.

    ``moments`` and ``cell`` as in :func:`~isobar.operators.series.neighbours`.
    """
    near = neighbours(
        df, keys, [*linear, *level], time, unit, positions=linear, cell=cell, moments=moments
    )
    extra = [f"`_{name}_{c}`" for c in moments for name in ("mean", "std")]

    def filled(c: str) -> str:
        if c in linear:
            return _between(c)
        if c in level:
            return f"coalesce(`_prev_{c}`, `_next_{c}`) AS `{c}`"
        return f"`{c}`"

    return near.selectExpr(*[filled(c) for c in df.columns], BUCKET, *extra)


def _with_unplaced(done: DataFrame, df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """``done`` and, unfilled, the rows of ``df`` that lack a key or a time.

    They belong to no place in a series, but a cleaning step loses no rows.
    """
    lacking = " OR ".join(f"`{c}` IS NULL" for c in (*keys, time))
    return done.unionByName(df.where(lacking), allowMissingColumns=True)


def interpolate_linear(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] | None = None,
    time: str = "time",
    unit: str = "month",
) -> DataFrame:
    """Fill gaps of numeric columns linearly by row position.

    Leading gaps take the first known value, trailing gaps the last; an all-null
    series stays null.  Elapsed time plays no part.  Rows without a key or a
    time stay as they are.
    """
    columns = list(columns or numeric_columns(df, exclude=(*keys, time)))
    return _with_unplaced(_imputed(df, keys, time, unit, columns, ()).drop(BUCKET), df, keys, time)


def fill_forward_backward(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] | None = None,
    time: str = "time",
    unit: str = "month",
) -> DataFrame:
    """Fill nulls of any type with the last known value, else the next one.

    Rows without a key or a time stay as they are.
    """
    columns = list(columns or [c for c in df.columns if c not in (*keys, time)])
    return _with_unplaced(_imputed(df, keys, time, unit, (), columns).drop(BUCKET), df, keys, time)


def missing_report(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Nulls per column: ``(keys, column_name, missing)``."""
    columns = list(columns or [c for c in df.columns if c not in keys])
    counted = df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot(list(keys), columns, "column_name", "missing")


def outlier_bounds(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] = CAPPED_READINGS,
    threshold: float = 3.0,
) -> DataFrame:
    """Per key, ``_low_<c>`` and ``_high_<c>``: mean less or plus ``threshold`` sample
    standard deviations; null where the deviation is zero or undefined."""
    aggregates = []
    for c in columns:
        mean, spread = F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))
        aggregates += [
            (mean - threshold * spread).alias(f"_low_{c}"),
            (mean + threshold * spread).alias(f"_high_{c}"),
        ]
    return df.groupBy(*keys).agg(*aggregates)


def cap_to_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clip columns to joined ``_low_``/``_high_`` bounds and drop the bounds."""

    def capped(c: str) -> str:
        usable = f"`_low_{c}` IS NOT NULL AND `{c}` IS NOT NULL"
        clipped = f"least(greatest(`{c}`, `_low_{c}`), `_high_{c}`)"
        return f"CASE WHEN {usable} THEN {clipped} ELSE `{c}` END AS `{c}`"

    bounds = {f"_{side}_{c}" for side in ("low", "high") for c in columns}
    kept = [c for c in df.columns if c not in bounds]
    return df.selectExpr(*[capped(c) if c in columns else f"`{c}`" for c in kept])


def cap_outliers(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] = CAPPED_READINGS,
    threshold: float = 3.0,
) -> DataFrame:
    """Clip each column to its per-series bounds.  Absent columns are skipped.

    The bounds are one row per key.  They are joined without a hint: the engine
    broadcasts them when their measured size allows and otherwise sorts and
    merges, splitting a hot key.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    bounds = outlier_bounds(df, keys, columns, threshold)
    return cap_to_bounds(df.join(bounds, list(keys), "left"), columns)


def outlier_report(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] = CAPPED_READINGS,
    threshold: float = 3.0,
) -> DataFrame:
    """Values beyond the bounds: ``(keys, variable, outliers, lower_limit, upper_limit)``."""
    columns = [c for c in columns if c in df.columns]
    bounds = outlier_bounds(df, keys, columns, threshold)

    def beyond(c: str) -> Column:
        return (F.col(c) < F.col(f"_low_{c}")) | (F.col(c) > F.col(f"_high_{c}"))

    rows = [
        F.struct(
            F.lit(c).alias("variable"),
            F.count_if(beyond(c)).alias("outliers"),
            F.first(f"_low_{c}").alias("lower_limit"),
            F.first(f"_high_{c}").alias("upper_limit"),
        )
        for c in columns
    ]
    joined = df.join(bounds, list(keys), "left")
    return joined.groupBy(*keys).agg(F.array(*rows).alias("_rows")).select(*keys, F.inline("_rows"))


def clean_cells(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    time: str = "time",
    threshold: float = 3.0,
    unit: str = "month",
    cell: str | None = None,
) -> DataFrame:
    """:func:`clean_hourly` that keeps the ``_bucket`` cell and its partitioning.

    One exchange moves the readings, on ``(keys, _bucket)``.  The summary of the
    cells brings each cell both what it needs from its neighbours and the bounds
    of the whole series, so filling and capping happen in one pass.  Rows without a
    key or a time have no cell and are left out.
    """
    parsed = parse_time(df, time)
    linear = numeric_columns(parsed, exclude=(*keys, time, cell))
    level = [c for c in parsed.columns if c not in (*keys, time, cell, *linear)]
    capped = [c for c in CAPPED_READINGS if c in linear]
    imputed = _imputed(parsed, keys, time, unit, linear, level, capped, cell)
    bounded = imputed.selectExpr(
        *[f"`{c}`" for c in (*parsed.columns, BUCKET)],
        *[
            f"`_mean_{c}` {sign} {float(threshold)}D * `_std_{c}` AS `_{side}_{c}`"
            for c in capped
            for side, sign in (("low", "-"), ("high", "+"))
        ],
    )
    clean = cap_to_bounds(bounded, capped)
    return clean.withColumn("feels_like", feels_like_of(clean))


def clean_hourly(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    time: str = "time",
    threshold: float = 3.0,
    unit: str = "month",
    cell: str | None = None,
) -> DataFrame:
    """Parse, fill gaps, cap outliers and add ``feels_like``, in this order.

    Rows without a key or a time stay, unfilled and uncapped.  ``cell`` names the column
    of a table from :func:`~isobar.sources.tables.store_cells` that the rows are stored
    by; it takes the place of ``unit`` and is not part of the result.
    """
    clean = clean_cells(df, keys, time, threshold, unit, cell).drop(BUCKET)
    parsed = parse_time(df, time)
    whole = _with_unplaced(clean, parsed.withColumn("feels_like", feels_like_of(parsed)), keys, time)
    return whole.drop(cell) if cell else whole


def regularize_daily(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] | None = None,
    time: str = "time",
    unit: str = "year",
) -> DataFrame:
    """One row per calendar day from first to last, gaps filled forward, then back.

    A filled row simply stands for all days up to the next row, so the missing
    days are generated from it; no calendar table and no join with one.
    """
    columns = list(columns or [c for c in df.columns if c not in (*keys, time)])
    near = neighbours(df, keys, columns, time, unit, next_time=True)
    day = F.expr("interval 1 day")
    until = F.coalesce(F.col("_next_time"), F.col(time) + day) - day
    return near.select(
        *keys,
        F.explode(F.sequence(F.col(time), until, day)).alias(time),
        *[F.coalesce(f"_prev_{c}", f"_next_{c}").alias(c) for c in columns],
    )
