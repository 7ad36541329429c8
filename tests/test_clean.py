import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import raw_hourly, to_pandas, to_spark
from isobar.operators import clean, daily
from isobar.sources import tables
from isobar.schema import CAPPED_READINGS


def expected_clean(frame):
    """The same cleaning with pandas, one station at a time."""
    out = []
    for _, one in frame.groupby("station_id"):
        one = one.sort_values("time").reset_index(drop=True)
        numbers = [c for c in one.columns if c not in ("station_id", "time")]
        one[numbers] = one[numbers].interpolate(method="linear", limit_direction="both")
        for c in CAPPED_READINGS:
            mean, std = one[c].mean(), one[c].std()
            if std > 0:
                one[c] = one[c].clip(mean - 3 * std, mean + 3 * std)
        out.append(one)
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def frame():
    # Station 1 holds most rows; 3 and 4 are tiny.
    return raw_hourly({1: 6000, 2: 400, 3: 2, 4: 1})


@pytest.mark.parametrize("unit", ["day", "month", "year"])
def test_clean_hourly_matches_pandas_for_any_cell_size(spark, frame, unit):
    got = to_pandas(clean.clean_hourly(to_spark(spark, frame), unit=unit))
    want = expected_clean(frame)
    for c in want.columns:
        if c not in ("station_id", "time"):
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, equal_nan=True, err_msg=c)
    assert got["feels_like"].notna().sum() == want["temperature_2m"].notna().sum()


def test_result_does_not_depend_on_partitions_or_other_keys(spark, frame):
    whole = to_pandas(clean.clean_hourly(to_spark(spark, frame).repartition(13)))
    alone = to_pandas(clean.clean_hourly(to_spark(spark, frame[frame.station_id == 2])))
    part = whole[whole.station_id == 2].reset_index(drop=True)
    pd.testing.assert_frame_equal(part, alone)


def test_interpolation_goes_by_row_position(spark):
    times = pd.to_datetime(
        ["2020-01-01", "2020-01-02", "2020-02-10", "2020-05-01", "2020-05-02", "2021-01-01"]
    )
    frame = pd.DataFrame({"station_id": 1, "time": times, "x": [None, 1, None, None, 4, None]})
    got = to_pandas(clean.interpolate_linear(to_spark(spark, frame)))
    assert got["x"].tolist() == [1, 1, 2, 3, 4, 4]


def test_fill_reaches_over_many_empty_cells(spark):
    times = pd.date_range("2000-01-01", periods=300, freq="10D")
    frame = pd.DataFrame({"station_id": 1, "time": times, "s": [None] * 150 + ["b"] + [None] * 149})
    got = to_pandas(clean.fill_forward_backward(to_spark(spark, frame)))
    assert set(got["s"]) == {"b"}


def test_constant_and_single_values_are_left_alone(spark):
    frame = pd.DataFrame(
        {
            "station_id": [1, 1, 1, 2],
            "time": pd.date_range("2020-01-01", periods=4, freq="h"),
            "temperature_2m": [5.1, 5.1, 5.1, 9.3],
        }
    )
    df = to_spark(spark, frame)
    for result in (clean.cap_outliers(df), clean.clean_hourly(df)):
        assert to_pandas(result)["temperature_2m"].tolist() == pytest.approx([5.1, 5.1, 5.1, 9.3])


def test_missing_time_column_is_an_error(spark):
    with pytest.raises(ValueError, match="time"):
        clean.clean_hourly(spark.range(1).withColumnRenamed("id", "station_id"))
    with pytest.raises(ValueError, match="wind_direction_10m"):
        daily.aggregate_daily(to_spark(spark, pd.DataFrame({"station_id": [1], "time": [pd.Timestamp(0)]})))


def test_empty_input(spark, frame):
    none = to_spark(spark, frame).limit(0)
    assert clean.clean_hourly(none).count() == 0
    assert daily.clean_daily(none).count() == 0


def test_daily_matches_pandas_and_both_routes_agree(spark, frame):
    df = to_spark(spark, frame)
    hourly, direct = daily.hourly_to_daily(df)
    stepwise = to_pandas(daily.aggregate_daily(hourly))
    direct = to_pandas(direct)
    pd.testing.assert_frame_equal(direct, stepwise, rtol=1e-9)
    want = expected_clean(frame)
    grouped = want.groupby(["station_id", want["time"].dt.normalize()])
    for column, figure in (("temperature_2m", "mean"), ("wind_speed_10m", "max"), ("precipitation", "sum")):
        np.testing.assert_allclose(
            direct[f"{column}_{figure}"], grouped[column].agg(figure).to_numpy(), rtol=1e-9
        )
    assert (direct["rain_sum"] == 0.0).all()
    assert direct["wind_direction_10m_dominant"].between(0, 360, inclusive="left").all()


def test_regularize_fills_every_day(spark):
    times = pd.to_datetime(["2019-12-30", "2020-01-02", "2021-03-01"])
    frame = pd.DataFrame({"station_id": 1, "time": times, "v": [None, 2.0, 5.0]})
    got = to_pandas(clean.regularize_daily(to_spark(spark, frame)))
    want = frame.set_index("time")["v"].asfreq("D").ffill().bfill()
    assert got["time"].tolist() == want.index.tolist()
    assert got["v"].tolist() == want.tolist()


def test_reports(spark, frame):
    df = to_spark(spark, frame)
    missing = clean.missing_report(df).where("station_id = 1").toPandas()
    counts = dict(zip(missing["column_name"], missing["missing"], strict=True))
    one = frame[frame.station_id == 1]
    assert counts["rain"] == 6000
    assert counts["temperature_2m"] == one["temperature_2m"].isna().sum()
    found = clean.outlier_report(df).where("station_id = 1 and variable = 'surface_pressure'").first()
    z = (one["surface_pressure"] - one["surface_pressure"].mean()) / one["surface_pressure"].std()
    assert found["outliers"] == (z.abs() > 3).sum()


def test_one_exchange_moves_the_readings(spark, frame, tmp_path):
    """The daily plan shuffles rows once, by cell; all else is one row per cell."""
    to_spark(spark, frame).write.parquet(str(tmp_path / "raw"))
    plan = daily.clean_daily(spark.read.parquet(str(tmp_path / "raw")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = text.splitlines()
    moved = [x for x in lines if "- Exchange hashpartitioning(station_id" in x and "_bucket" in x]
    assert len(moved) == 1
    assert any("ReusedExchange" in x and "_bucket" in x for x in lines)


@pytest.mark.parametrize("level, spread", [(1013.0, 8.0), (101_325.0, 0.5), (1e7, 0.01)])
def test_bounds_keep_their_digits_at_high_levels(spark, level, spread):
    rng = np.random.default_rng(3)
    n = 3000
    values = level + rng.normal(0, spread, n)
    values[1234] = level + 1000 * spread
    values[rng.random(n) < 0.2] = np.nan
    frame = pd.DataFrame(
        {"station_id": 1, "time": pd.date_range("2020-01-10", periods=n, freq="h"), "surface_pressure": values}
    )
    frame["temperature_2m"] = frame["relative_humidity_2m"] = frame["wind_speed_10m"] = 10.0
    got = to_pandas(clean.clean_hourly(to_spark(spark, frame)))["surface_pressure"]
    filled = frame["surface_pressure"].interpolate().bfill()
    centred = filled - level
    high = level + (centred.mean() + 3 * centred.std())
    want = filled.clip(level + (centred.mean() - 3 * centred.std()), high)
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-9 * spread + 4 * np.spacing(level))


def test_rows_without_a_time_or_key_stay(spark):
    rows = [(1, "2020-01-01 00:00:00", 1.0), (1, "2020-01-01 01:00:00", None), (1, None, 7.0), (None, "2020-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "station_id long, time string, temperature_2m double").withColumn(
        "time", F.col("time").cast("timestamp_ntz")
    )
    for step in (clean.interpolate_linear, clean.fill_forward_backward):
        got = step(df).collect()
        assert sorted(str(r.temperature_2m) for r in got) == ["1.0", "1.0", "7.0", "None"]
    full = df.withColumn("relative_humidity_2m", F.lit(50.0)).withColumn("wind_speed_10m", F.lit(5.0))
    assert clean.clean_hourly(full).count() == 4


@pytest.mark.parametrize("ordered", ["false", "true"])
def test_a_table_in_cells_moves_no_reading(spark, frame, tmp_path, ordered):
    raw = to_spark(spark, frame)
    name = f"cells_{ordered}"
    tables.store_cells(raw, name, str(tmp_path / name), buckets=6)
    stored = spark.table(name)
    plan = daily.clean_daily(stored, cell=tables.CELL)
    setting = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set(setting, ordered)
    try:
        tree = plan._jdf.queryExecution().executedPlan()
        lines = tree.toString().splitlines()
        got = to_pandas(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset(setting)
    # What moves is the summary of the cells: to the series' carry, and back to the cells.
    moved = [x for x in lines if "Exchange hashpartitioning" in x]
    assert moved and all("temperature_2m" not in x.split("hashpartitioning")[1] for x in moved)
    scans = [i for i, x in enumerate(lines) if "FileScan" in x]
    assert scans and all("SelectedBucketsCount: 6 out of 6" in lines[i] for i in scans)
    for i in scans:
        above = [x for x in lines[max(0, i - 4) : i] if "Exchange" in x]
        assert not above, above
    sorts = sum("Sort [" in x and "time" in x and "DESC" not in x for x in lines)
    assert sorts == 0 if ordered == "true" else sorts > 0
    pd.testing.assert_frame_equal(got, to_pandas(daily.clean_daily(raw)), rtol=1e-9)
    whole = clean.clean_hourly(stored, cell=tables.CELL)
    assert tables.CELL not in whole.columns
    pd.testing.assert_frame_equal(to_pandas(whole), to_pandas(clean.clean_hourly(raw)), rtol=1e-9)
