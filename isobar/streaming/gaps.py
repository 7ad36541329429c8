"""Filling gaps and running outlier bounds on arriving readings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StructField,
    StructType,
    TimestampNTZType,
)

from ..schema import CAPPED_READINGS, DEFAULT_KEYS, require

#: State of this kind needs a store that keeps lists and timers; name it in
#: ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Series:
    """What is known of one series so far, per column.

    ``rows`` have been given out.  ``last`` is the last known value and ``at`` its row;
    ``n``, ``mean`` and ``m2`` sum up the filled values that have been given out.
    """

    FIELDS = ("last", "at", "n", "mean", "m2")

    def __init__(self, columns: int, state: tuple | None = None):
        if state is None:
            empty = np.zeros(columns)
            self.rows, self.settled = 0, None
            self.last, self.at = np.full(columns, np.nan), np.full(columns, -1.0)
            self.n, self.mean, self.m2 = empty.copy(), empty.copy(), empty.copy()
        else:
            self.rows, self.settled = state[0], state[1]
            for name, values in zip(self.FIELDS, state[2:], strict=True):
                setattr(self, name, np.array(values, float))

    def state(self) -> tuple:
        return (self.rows, self.settled, *[[float(v) for v in getattr(self, f)] for f in self.FIELDS])

    def fill(self, time: np.ndarray, values: np.ndarray, overdue: float) -> tuple[np.ndarray, int]:
        """The settled rows in order, filled, and how many of them are final.

        A gap is closed by the next known value, or by time: when its first row is not
        after ``overdue``, what has come of it stays level.
        """
        filled, final = values.copy(), len(time)
        place = np.arange(len(time)) + self.rows
        for c in range(values.shape[1]):
            known = np.flatnonzero(~np.isnan(values[:, c]))
            points, level = place[known].astype(float), values[known, c]
            if not np.isnan(self.last[c]):
                points, level = np.append(self.at[c], points), np.append(self.last[c], level)
            if len(points):
                filled[:, c] = np.interp(place, points, level)
            end = known[-1] + 1 if len(known) else 0
            if end < len(time) and time[end] > overdue:
                final = min(final, end)
        return filled, final

    def give(self, values: np.ndarray, filled: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Takes in the final rows; the outlier bounds of the series up to each of them."""
        bounds = []
        for c in range(values.shape[1]):
            x = filled[:, c]
            there = ~np.isnan(x)
            # Deviations from the mean so far keep the digits of high levels.
            level = self.mean[c] if self.n[c] else (x[there][0] if there.any() else 0.0)
            away = np.where(there, x - level, 0.0)
            n = self.n[c] + np.cumsum(there)
            total = np.cumsum(away)
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = level + total / n
                m2 = np.maximum(self.m2[c] + np.cumsum(away * away) - total * total / n, 0.0)
                spread = np.sqrt(m2 / (n - 1))
            spread[~(spread > 0)] = np.nan
            bounds.append((mean - threshold * spread, mean + threshold * spread))
            if n[-1] > 0:
                self.n[c], self.mean[c], self.m2[c] = n[-1], mean[-1], m2[-1]
            known = np.flatnonzero(~np.isnan(values[:, c]))
            if len(known):
                self.last[c], self.at[c] = values[known[-1], c], self.rows + known[-1]
        self.rows += len(filled)
        low, high = (np.column_stack([b[i] for b in bounds]) for i in (0, 1))
        return low, high


class GapFiller(StatefulProcessor):
    """Rows wait until the watermark has passed them and all their gaps are closed."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], max_gap: int, threshold: float):
        self.keys, self.columns = list(keys), list(columns)
        self.max_gap, self.threshold = max_gap, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        value = [StructField(f"c{i}", DoubleType()) for i in range(len(self.columns))]
        self.waiting = handle.getListState("waiting", StructType([StructField("at", LongType()), *value]))
        self.series = handle.getValueState(
            "series",
            StructType(
                [StructField("rows", LongType()), StructField("settled", LongType())]
                + [StructField(f, ArrayType(DoubleType())) for f in Series.FIELDS]
            ),
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        # By place, as the engine renames some columns: keys, watermark time, time, values.
        fresh = arrived.iloc[:, len(self.keys) + 1 :].to_numpy(float, na_value=np.nan)
        yield from self.advance(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, np.empty((0, len(self.columns) + 1)), timerValues)

    def advance(self, key, fresh: np.ndarray, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        held = self.series.get()
        series = Series(len(self.columns), held)
        if series.settled is not None:
            # The rows after it may have been given out.
            fresh = fresh[fresh[:, 0] > series.settled]
        kept = [tuple(r) for r in self.waiting.get()]
        old = np.array(kept, float).reshape(-1, len(self.columns) + 1)
        table = np.concatenate([old, fresh])
        table = table[np.argsort(table[:, 0], kind="stable")]
        ready = int(np.searchsorted(table[:, 0], passed, side="right"))
        time, values = table[:ready, 0], table[:ready, 1:]
        filled, final = series.fill(time, values, passed - self.max_gap)
        if ready:
            series.settled = int(time[-1])
        if final:
            # A gap that time has closed counts as known from here on.
            open_end = np.isnan(values[final - 1])
            first_open = series.rows + final - 1
            low, high = series.give(values[:final], filled[:final], self.threshold)
            closed = open_end & np.array([np.isnan(values[final:, c]).all() for c in range(values.shape[1])])
            closed &= ready == final
            series.last[closed], series.at[closed] = filled[final - 1][closed], first_open
            out = {k: [v] * final for k, v in zip(self.keys, key, strict=True)}
            out["time"] = pd.to_datetime(time[:final].astype("int64"), unit="us")
            for c, name in enumerate(self.columns):
                out[name] = filled[:final, c]
            for c, name in enumerate(self.columns):
                out[f"_low_{name}"], out[f"_high_{name}"] = low[:, c], high[:, c]
            yield pd.DataFrame(out)
        rest = table[final:]
        if len(rest):
            self.waiting.put([(int(r[0]), *[float(v) for v in r[1:]]) for r in rest])
            later = rest[rest[:, 0] > passed, 0]
            wake = [later[0]] if len(later) else []
            if ready > final:
                wake.append(rest[0, 0] + self.max_gap)
            for at in wake:
                self.handle.registerTimer(max(int(-(-at // 1000)), int(passed // 1000) + 1))
        else:
            self.waiting.clear()
        self.series.update(series.state())

    def close(self) -> None:
        pass


def stream_fill(
    readings: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] = CAPPED_READINGS,
    lateness: str = "2 days",
    max_gap: str = "7 days",
    threshold: float = 3.0,
) -> DataFrame:
    """Gaps of arriving readings filled as :func:`~isobar.operators.clean.interpolate_linear`
    does, with running outlier bounds.

    A row comes out once the watermark has passed it and every gap it is in is closed, by
    a known value or after ``max_gap``; a gap closed by time stays level at the last known
    value, or missing if there was none.  ``_low_<c>`` and ``_high_<c>`` are the mean less
    and plus ``threshold`` deviations of the filled series up to that row, for
    :func:`~isobar.operators.clean.cap_to_bounds`; null while the deviation is zero or
    undefined.  Columns other than these are left out.

    The state of a series is its rows of the last ``lateness`` and ``max_gap`` and a few
    numbers a column.  Rows later than ``lateness`` and rows without a key or a time are
    dropped.  The session needs the state store :data:`STATE_STORE`.
    """
    require(readings, *keys, "time")
    columns = [c for c in columns if c in readings.columns]
    spark = readings.sparkSession
    gap = spark.sql(f"SELECT INTERVAL {max_gap} AS g").select(F.expr("CAST(g AS INTERVAL DAY TO SECOND)")).first()[0]
    there = F.lit(True)
    for c in (*keys, "time"):
        there = there & F.col(c).isNotNull()
    timed = readings.where(there).withColumn("_ts", F.col("time").cast("timestamp")).select(
        *keys, "_ts", F.unix_micros("_ts").alias("_at"), *[F.col(c).cast("double").alias(c) for c in columns]
    )
    bounds = [StructField(f"{side}{c}", DoubleType()) for c in columns for side in ("_low_", "_high_")]
    shape = StructType(
        [readings.schema[k] for k in keys]
        + [StructField("time", TimestampNTZType())]
        + [StructField(c, DoubleType()) for c in columns]
        + bounds
    )
    filler = GapFiller(keys, columns, int(gap.total_seconds() * 1e6), threshold)
    given = (
        timed.withWatermark("_ts", lateness)
        .groupBy(*keys)
        .transformWithStateInPandas(filler, shape, outputMode="Append", timeMode="EventTime")
    )
    # A missing value is NaN in Python.
    numbers = [F.nanvl(F.col(f.name), F.lit(None).cast("double")).alias(f.name) for f in shape.fields[len(keys) + 1 :]]
    return given.select(*keys, "time", *numbers)
