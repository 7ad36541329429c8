import numpy as np
import pandas as pd
import pytest

from conftest import raw_hourly, to_pandas, to_spark
from isobar.operators.clean import cap_to_bounds, interpolate_linear
from isobar.streaming.gaps import STATE_STORE, Series, stream_fill

SETTING = "spark.sql.streaming.stateStore.providerClass"
COLUMNS = ["temperature_2m", "surface_pressure"]


@pytest.fixture
def arrive(spark, tmp_path):
    """Runs a stream over parts that arrive one after another."""

    def run(parts, **how):
        source, sink = str(tmp_path / "in"), str(tmp_path / "out")
        spark.conf.set(SETTING, STATE_STORE)
        try:
            for i, part in enumerate(parts):
                df = to_spark(spark, part)
                df.coalesce(1).write.mode("append").parquet(source)
                stream = stream_fill(spark.readStream.schema(df.schema).parquet(source), columns=COLUMNS, **how)
                writer = stream.writeStream.format("parquet").option("path", sink)
                writer = writer.option("checkpointLocation", str(tmp_path / "state"))
                writer.trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.unset(SETTING)
        return to_pandas(spark.read.schema(stream.schema).parquet(sink))

    return run


def expected(spark, frame):
    """Batch filling, and bounds of all rows up to each."""
    rows = interpolate_linear(to_spark(spark, frame[["station_id", "time", *COLUMNS]]), columns=COLUMNS)
    want = to_pandas(rows)
    for c in COLUMNS:
        grown = want.groupby("station_id")[c].expanding()
        mean, std = (getattr(grown, f)().reset_index(drop=True) for f in ("mean", "std"))
        std = std.replace(0.0, np.nan)
        want[f"_low_{c}"], want[f"_high_{c}"] = mean - 3 * std, mean + 3 * std
    return want


def test_filled_stream_equals_batch(spark, arrive):
    frame = raw_hourly({1: 400, 2: 150}, missing=0.3)[["station_id", "time", *COLUMNS]]
    frame.loc[frame.station_id.eq(1) & (frame.index < 5), "temperature_2m"] = np.nan
    start = frame.time.min()
    # Parts overlap: rows come up to a day late, out of order.
    day = ((frame.time - start) // pd.Timedelta(hours=20) // 6 + (frame.index % 5 == 0)).to_numpy()
    parts = [p.sample(frac=1, random_state=3) for _, p in frame.groupby(day)]
    assert len(parts) > 4
    got = arrive(parts, lateness="9 days", max_gap="60 days")
    want = expected(spark, frame)
    border = frame.time.max() - pd.Timedelta(days=9)
    # Final are the rows before the border, up to the last row that is known in every column.
    keep = []
    for _, one in frame[frame.time <= border].sort_values("time").groupby("station_id"):
        ends = [one.time[one[c].notna()].max() for c in COLUMNS]
        keep.append(pd.Series(min(ends), index=[one.station_id.iloc[0]]))
    last = pd.concat(keep)
    want = want[want.time <= want.station_id.map(last)].reset_index(drop=True)
    assert len(want) > 350
    pd.testing.assert_frame_equal(got, want[got.columns], rtol=1e-9)
    capped = to_pandas(cap_to_bounds(to_spark(spark, got), COLUMNS))
    assert (capped["surface_pressure"].dropna() < 1400).any()


def test_time_closes_a_gap(arrive):
    hours = pd.date_range("2024-01-01", periods=30, freq="D")
    values = [np.nan, 4.0, np.nan, *[np.nan] * 20, 10.0, *[11.0] * 6]
    frame = pd.DataFrame({"station_id": 1, "time": hours, "temperature_2m": values, "surface_pressure": 1000.0})
    parts = [frame.iloc[i : i + 1] for i in range(0, 30)]
    parts = [pd.concat(parts[i : i + 5]) for i in range(0, 30, 5)]
    got = arrive(parts, lateness="1 hour", max_gap="8 days")
    assert got["time"].is_monotonic_increasing and got["time"].is_unique
    filled = got.set_index("time")["temperature_2m"]
    assert filled.iloc[0] == filled.iloc[1] == 4.0
    # The first days of the gap were given out level before the next value was known.
    assert (filled.iloc[2:10] == 4.0).all()
    assert filled.iloc[23] == 10.0 and filled.iloc[22] <= 10.0
    assert got["_low_surface_pressure"].isna().all()


def test_series_state_can_be_cut_anywhere():
    rng = np.random.default_rng(5)
    x = 1e6 + rng.normal(size=(200, 2))
    x[rng.random((200, 2)) < 0.4] = np.nan
    x[-1] = 1e6
    time = np.arange(200.0)
    whole = Series(2)
    filled, final = whole.fill(time, x, -1.0)
    low, high = whole.give(x[:final], filled[:final], 3.0)
    assert final == 200
    for cut in (1, 7, 90, 199):
        part, out, start = Series(2), [], 0
        for stop in (cut, 200):
            f, n = part.fill(time[start:stop], x[start:stop], -1.0)
            if n:
                out.append(np.hstack([f[:n], *part.give(x[start : start + n], f[:n], 3.0)]))
            part = Series(2, part.state())
            start += n
        np.testing.assert_allclose(np.vstack(out), np.hstack([filled, low, high]), rtol=1e-12)
