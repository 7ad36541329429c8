import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import raw_hourly, to_pandas, to_spark
from isobar.operators import clean, climate, daily, spatial, stats
from isobar.operators.quantiles import exact_quantiles, quantile_sketches
from isobar.sources import payload, stations, tables
from isobar.streaming.readings import stream_clean, stream_daily


@pytest.fixture(scope="module")
def frame():
    return raw_hourly({1: 3000, 2: 500})


@pytest.fixture(scope="module")
def days(spark, frame):
    return daily.clean_daily(to_spark(spark, frame)).cache()


def test_describe(days):
    got = stats.describe_stats(days).toPandas()
    want = days.toPandas()
    for row in got.itertuples():
        x = want[want.station_id == row.station_id][row.variable]
        assert row.count == x.count()
        found = [row.mean, row.std, row.min, row.q25, row.q50, row.q75, row.max]
        np.testing.assert_allclose(found, x.describe().to_numpy()[1:], rtol=1e-9)
        np.testing.assert_allclose([row.skewness, row.kurtosis], [x.skew(), x.kurt()], atol=1e-7)


def test_quantiles_of_a_hot_group_with_ties(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(30000), rng.normal(size=30001), np.full(9, 1e9)])
    frame = pd.DataFrame({"g": 1, "v": values})
    wanted = {"low": 0.01, "middle": 0.5, "high": 0.999, "top": 1.0}
    row = exact_quantiles(to_spark(spark, frame), ["g"], "v", wanted).first()
    for name, q in wanted.items():
        assert row[name] == pytest.approx(np.quantile(values, q))


def test_quantiles_of_odd_values(spark):
    rows = [(None, v) for v in (1.0, 2.0, 4.0)] + [(1, None), (2, float("inf")), (2, float("-inf")), (2, 3.0), (3, float("nan")), (3, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    wanted = {"low": 0.0, "middle": 0.5, "high": 0.75}
    got = {r.g: (r.low, r.middle, r.high) for r in exact_quantiles(df, ["g"], "v", wanted).collect()}
    assert got == {None: (1.0, 2.0, 3.0), 2: (float("-inf"), 3.0, float("inf")), 3: (5.0, 5.0, 5.0)}
    assert exact_quantiles(df.where("false"), ["g"], "v", wanted).count() == 0


def test_quantiles_from_stored_sketches(spark, tmp_path):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 60000), "month": rng.integers(1, 13, 60000), "v": np.exp(rng.normal(0, 4, 60000))})
    df = to_spark(spark, frame)
    quantile_sketches(df, ["g", "month"], "v").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 24
    wanted = {"a": 0.1, "b": 0.5, "c": 0.505, "d": 0.99}
    for group in (["g"], []):
        for row in exact_quantiles(df, group, "v", wanted, stored).collect():
            x = frame["v"] if not group else frame.loc[frame.g == row.g, "v"]
            for name, q in wanted.items():
                assert row[name] == pytest.approx(np.quantile(x, q), rel=1e-12)
    other = df.withColumn("v", F.col("v") * 3)
    with pytest.raises(Exception, match="outside the range"):
        exact_quantiles(other, ["g"], "v", wanted, stored).collect()


def test_correlations(days):
    columns = ["temperature_2m_mean", "feels_like_max", "surface_pressure_mean", "rain_sum"]
    got = stats.correlation_matrix(days, columns=columns).toPandas()
    assert len(got) == 2 * 16
    want = days.toPandas().groupby("station_id")[columns].corr()
    for row in got.itertuples():
        expected = want.loc[(row.station_id, row.var_x), row.var_y]
        if "rain_sum" in (row.var_x, row.var_y):
            # The all-zero column does not vary.
            assert pd.isna(row.corr)
        else:
            assert row.corr == pytest.approx(expected)
    lower = stats.correlation_matrix(days, columns=columns, lower_triangle=True).toPandas()
    assert {(r.var_x, r.var_y) for r in lower.itertuples()} == {
        (columns[i], columns[j]) for i in range(4) for j in range(i)
    }


def test_calendar_matrix_has_all_months(days):
    got = climate.calendar_matrix(days).toPandas()
    assert got.groupby("station_id").size().to_dict() == {1: 12, 2: 12}
    one = days.toPandas()
    one = one[(one.station_id == 1) & (one.time.dt.month == 2) & (one.time.dt.day == 3)]
    cell = got[(got.station_id == 1) & (got.month == 2)]["day_3"].iloc[0]
    assert cell == pytest.approx(one["temperature_2m_mean"].mean())
    assert got[got.month == 12]["day_31"].isna().all()


@pytest.mark.parametrize("centered", [False, True])
def test_wind_rose_sums_to_hundred(days, centered):
    got = climate.wind_rose(days, centered=centered).toPandas()
    assert (got.groupby("station_id").size() == 32).all()
    np.testing.assert_allclose(got.groupby("station_id")["percent"].sum(), 100)


def test_histogram_counts_every_row(days):
    got = climate.monthly_histogram(days, 0, 20, 10).toPandas()
    assert got["n"].sum() == days.count()
    np.testing.assert_allclose(got.groupby(["station_id", "month"])["share"].sum(), 1)


def test_map_tables(spark):
    places = spark.createDataFrame(
        [(i, f"n{i}", f"Land{i % 2} ", float(i), float(i * i), float(i)) for i in range(6)],
        "station_id long, name string, country string, latitude double, longitude double, "
        "temperature_2m_mean double",
    )
    weights = spatial.heat_weights(places).toPandas()["weight"]
    assert (weights.min(), weights.max()) == (0.0, 1.0)
    level = spatial.heat_weights(places.withColumn("temperature_2m_mean", F.lit(4.0))).toPandas()
    assert (level["weight"] == 0.0).all()
    grid = spatial.regional_grid(places, cells=11, levels=14).toPandas()
    assert len(grid) == 121
    assert grid["value"].between(0, 5).all()
    assert grid["level"].between(1, 14).all()
    corner = grid[(grid.row == 0) & (grid.col == 0)]["value"].iloc[0]
    assert corner == 0.0
    assert spatial.regional_grid(places.limit(3)).count() == 0
    borders = spark.createDataFrame([(" LAND0",), ("land1",), ("sea",)], "name string")
    joined = spatial.country_join(borders, spatial.country_average(places)).toPandas()
    assert dict(zip(joined["name_clean"], joined["temperature_2m_mean"], strict=True)) == {
        "land0": 2.0,
        "land1": 3.0,
    }


def test_payload_files(spark, tmp_path):
    hourly = {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None]}
    answers = [
        {"station_id": 1, "latitude": 1.0, "longitude": 2.0, "hourly": hourly},
        {"station_id": 2, "latitude": 3.0, "longitude": 4.0, "elevation": 7.0, "hourly": hourly},
        {"station_id": 3, "latitude": 5.0, "longitude": 6.0, "error": True},
    ]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(a) for a in [*answers, answers[0]]))
    read = payload.read_archive(spark, str(tmp_path))
    rows = to_pandas(payload.hourly_rows(read))
    assert rows["elevation"].tolist() == [0.0, 0.0, 7.0, 7.0]
    assert rows["time"].iloc[1] == pd.Timestamp("2024-01-01 01:00")
    assert rows["rain"].isna().all()
    assert tuple(payload.payload_report(read).first()) == (4, 1)


def test_current_conditions(spark, tmp_path):
    answers = [
        {"station_id": 1, "current": {"time": "2024-01-01T00:00", "temperature_2m": 3.0, "weather_code": 61}},
        {"station_id": 1, "current": {"time": "2024-01-01T01:00", "temperature_2m": 4.0, "weather_code": 63, "is_day": 0}},
        {"station_id": 2, "hourly": {"time": []}},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(a) for a in answers))
    table = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "station_id long, name string")
    got = stations.current_by_station(table, payload.read_realtime(spark, str(tmp_path)))
    rows = [tuple(r) for r in got.orderBy("station_id").collect()]
    assert rows == [(1, "A", 4.0, 63, 0), (3, "C", 24.0, 0, 1)]


def test_stored_readings_prune(spark, frame, tmp_path):
    path = str(tmp_path / "hourly")
    df = to_spark(spark, frame)
    tables.write_hourly(df, path, buckets=4)
    assert tables.read_hourly(spark, path, buckets=4).count() == len(frame)
    some = tables.read_hourly(spark, path, [2], "2020-01-12", "2020-01-20", buckets=4)
    inside = frame[(frame.station_id == 2) & frame.time.between("2020-01-12", "2020-01-20 23:59")]
    assert some.count() == len(inside)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(time" in plan
    assert "station_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_only_missing_readings_are_written(spark, frame, tmp_path):
    path = str(tmp_path / "hourly")
    df = to_spark(spark, frame)
    tables.write_hourly(df.where("station_id <> 2 OR day(time) < 14"), path, buckets=4)
    for _ in range(2):
        tables.write_missing_hourly(df, path, buckets=4)
        got = to_pandas(tables.read_hourly(spark, path, buckets=4).select(*df.columns))
        pd.testing.assert_frame_equal(got, to_pandas(df))
    tables.write_missing_hourly(df.limit(0), path, buckets=4)


def test_malformed_and_repeated_payload_rows(spark, tmp_path):
    hours = ["2024-01-01T00:00", "soon", None]
    answers = [
        {"station_id": 1, "hourly": {"time": hours, "temperature_2m": [t, 9.0, 9.0]}} for t in (1.0, 3.0, 2.0)
    ]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(a) for a in answers))
    read = payload.read_archive(spark, str(tmp_path)).repartition(3)
    rows = payload.hourly_rows(read).collect()
    assert [(r.station_id, r.temperature_2m) for r in rows] == [(1, 3.0)]
    assert [tuple(r) for r in payload.malformed_times(read).collect()] == [(1, 3)]


def test_csv_round_trip_keeps_missing(spark, frame, tmp_path):
    df = to_spark(spark, frame)
    tables.write_daily_csv(df, str(tmp_path / "csv"))
    back = tables.read_hourly_csv(spark, str(tmp_path / "csv"), df.schema)
    pd.testing.assert_frame_equal(to_pandas(back), to_pandas(df))


def test_station_lookup(spark):
    table = spark.createDataFrame(
        [(5, "London", None, 1.0, 2.0, None), (3, "london ", "UK", 3.0, 4.0, 9.0)],
        "station_id long, name string, country string, latitude double, longitude double, elevation double",
    )
    asked = spark.createDataFrame([(" LONDON",), ("Atlantis",)], "query string")
    rows = stations.station_lookup(asked, table).collect()
    assert [(r["query"], r["station_id"], r["country"]) for r in rows] == [(" LONDON", 3, "UK")]


def test_streams(spark, frame, tmp_path):
    columns = ["station_id", "time", "temperature_2m", "relative_humidity_2m", "wind_speed_10m"]
    df = to_spark(spark, frame[columns])
    df.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(stream, name):
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / name))
        sink = sink.option("checkpointLocation", str(tmp_path / f"{name}-state"))
        sink.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(str(tmp_path / name))

    got = to_pandas(run(stream_daily(arriving), "daily"))
    last = frame["time"].max() - pd.Timedelta(days=2)
    want = frame[frame.time.dt.normalize() + pd.Timedelta(days=1) <= last]
    want = want.groupby(["station_id", want["time"].dt.normalize()])["temperature_2m"].mean()
    np.testing.assert_allclose(got["temperature_2m_mean"], want.to_numpy(), equal_nan=True)

    bounds = clean.outlier_bounds(df, columns=["temperature_2m"], threshold=1.0)
    with_all = bounds.select("*", *[F.lit(None).cast("double").alias(f"_{s}_{c}") for s in ("low", "high") for c in columns[3:]])
    cleaned = run(stream_clean(arriving, with_all), "clean")
    assert cleaned.count() == len(frame)
    one = frame[frame.station_id == 1]["temperature_2m"]
    top = cleaned.where("station_id = 1").agg(F.max("temperature_2m")).first()[0]
    assert top == pytest.approx(one.mean() + one.std())


def ranges(spark, *rows):
    made = spark.createDataFrame([(s, f"2024-01-{a:02d}", f"2024-01-{b:02d}") for s, a, b in rows], "station_id bigint, a string, b string")
    return made.selectExpr("station_id", "cast(a AS timestamp_ntz) AS start", "cast(b AS timestamp_ntz) AS end")


def as_days(df):
    return sorted((r.station_id, r.start.day, r.end.day) for r in df.collect())


def test_range_subtraction(spark):
    wanted = ranges(spark, (1, 1, 20), (1, 15, 25), (2, 3, 4), (3, 1, 9), (4, 5, 5), (None, 1, 9))
    have = ranges(spark, (1, 5, 8), (1, 7, 10), (1, 24, 28), (3, 1, 9), (5, 1, 2))
    assert as_days(tables.merged_ranges(wanted)) == [(1, 1, 25), (2, 3, 4), (3, 1, 9)]
    assert as_days(tables.missing_ranges(wanted, have)) == [(1, 1, 5), (1, 10, 24), (2, 3, 4)]
    assert as_days(tables.missing_ranges(wanted, have.limit(0))) == as_days(tables.merged_ranges(wanted))
    assert as_days(tables.missing_ranges(wanted.limit(0), have)) == []


def test_overlapping_requests_write_only_the_gap(spark, tmp_path):
    hours = spark.range(24 * 20).selectExpr(
        "id % 2 AS station_id", "cast('2024-01-01' AS timestamp_ntz) + make_dt_interval(0, id) AS time", "id * 1.0D AS temperature_2m"
    )
    path = str(tmp_path / "store")
    for request in ((1, 2, 6), (1, 4, 9), (1, 3, 5)):
        tables.write_ranges(hours, ranges(spark, request, (0, 1, 2)), path, buckets=2)
    stored = tables.read_hourly(spark, path, buckets=2)
    assert as_days(tables.stored_ranges(spark, path)) == [(0, 1, 2), (1, 2, 6), (1, 6, 9)]
    assert stored.count() == stored.select("station_id", "time").distinct().count() == 12 + 7 * 12


@pytest.mark.parametrize("shape", ["even", "clustered", "line"])
def test_nearest_grid_equals_brute_force(spark, shape):
    rng = np.random.default_rng(8)
    n = 300
    lat, lon = rng.uniform(-60, 70, n), rng.uniform(-170, 170, n)
    if shape == "clustered":
        lat[:200], lon[:200] = lat[0] + rng.normal(size=200) * 0.01, lon[0] + rng.normal(size=200) * 0.01
    if shape == "line":
        lat[:] = 5.0
    frame = pd.DataFrame({"latitude": lat, "longitude": lon, "temperature_2m_mean": rng.normal(size=n)})
    places = spark.createDataFrame(frame)
    everyone = spatial.regional_grid(places, cells=9, nearest=n).toPandas().sort_values(["row", "col"], ignore_index=True)
    plain = spatial.regional_grid(places, cells=9).toPandas().sort_values(["row", "col"], ignore_index=True)
    pd.testing.assert_frame_equal(everyone, plain)
    got = spatial.regional_grid(places, cells=9, nearest=6).toPandas()
    assert len(got) == 81
    for row in got.itertuples():
        d2 = (frame.latitude - row.latitude) ** 2 + (frame.longitude - row.longitude) ** 2
        near = d2.nsmallest(6).index
        want = np.average(frame.temperature_2m_mean[near], weights=1 / d2[near]) if d2[near].min() else frame.temperature_2m_mean[near[0]]
        assert row.value == pytest.approx(want)
