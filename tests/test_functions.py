import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import to_spark
from isobar.functions import (
    circular_mean,
    display_temperature,
    feels_like,
    heat_index,
    is_daytime,
    temperatures_to_fahrenheit,
    weather_category,
    wind_chill,
    wmo_description,
)
from isobar.functions.comfort import feels_like_of
from isobar.functions.text import display_name, file_name
from isobar.operators.climate import speed_class, wind_sector


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("t", "rh", "expected"),
    [
        (26.6, 80.0, 26.6),
        (30.0, 39.9, 30.0),
        # Worked out term by term: 86 F, 70 percent give 95.070 F; 80.06 F, 40 percent 79.971 F.
        (30.0, 70.0, (95.0703 - 32) / 1.8),
        (26.7, 40.0, (79.9708 - 32) / 1.8),
    ],
)
def test_heat_index(spark, t, rh, expected):
    assert value(spark, heat_index(F.lit(t), F.lit(rh))) == pytest.approx(expected, abs=5e-3)


def test_heat_index_of_unknown_humidity_is_unknown(spark):
    assert value(spark, heat_index(F.lit(30.0), F.lit(None).cast("double"))) is None


@pytest.mark.parametrize(
    ("t", "v", "expected"),
    [
        (10.1, 30.0, 10.1),
        (0.0, 4.8, 0.0),
        (-10.0, 30.0, 13.12 - 6.215 - 11.37 * 30**0.16 - 3.965 * 30**0.16),
    ],
)
def test_wind_chill(spark, t, v, expected):
    assert value(spark, wind_chill(F.lit(t), F.lit(v))) == pytest.approx(expected, abs=1e-9)


def test_feels_like_branches(spark):
    assert value(spark, feels_like(F.lit(20.0), F.lit(90.0), F.lit(50.0))) == 20.0
    assert value(spark, feels_like(F.lit(5.0), F.lit(90.0), F.lit(0.0))) == 5.0
    assert value(spark, feels_like(F.lit(5.0), F.lit(90.0), F.lit(None).cast("double"))) == 5.0
    assert value(spark, feels_like(F.lit(5.0), F.lit(9.0), F.lit(20.0))) < 5.0


def test_feels_like_falls_back_on_present_columns(spark):
    one = spark.range(1)
    assert one.select(feels_like_of(one)).first()[0] == 0.0
    warm = one.withColumn("temperature_2m", F.lit(7.0))
    assert warm.select(feels_like_of(warm)).first()[0] == 7.0
    apparent = warm.withColumn("apparent_temperature", F.lit(3.0))
    assert apparent.select(feels_like_of(apparent)).first()[0] == 3.0


def test_codes(spark):
    assert value(spark, wmo_description(F.lit(95))) == "Thunderstorm: Slight or moderate"
    assert value(spark, wmo_description(F.lit(4))) == "Unknown conditions"
    assert value(spark, wmo_description(F.lit(4), "Clear")) == "Clear"
    found = [value(spark, weather_category(F.lit(c))) for c in (0, 3, 65, 86, 99, 4)]
    assert found == ["clear", "cloudy", "rainy", "snowy", "thunderstorm", "clear"]


def test_day_and_text(spark):
    hours = [5, 6, 17, 18]
    df = to_spark(spark, pd.DataFrame({"time": [pd.Timestamp(2024, 1, 1, h) for h in hours]}))
    assert [r[0] for r in df.select(is_daytime(F.col("time"))).collect()] == [0, 1, 1, 0]
    assert value(spark, display_temperature(F.lit(2.5))) == 2.0
    assert value(spark, display_name(F.lit("wind_speed_mean"))) == "Wind Speed Mean"
    assert value(spark, file_name(F.lit("New York"))) == "new_york"


def test_fahrenheit_touches_temperatures_only(spark):
    df = spark.range(1).select(
        F.lit(10.0).alias("temperature_2m_mean"), F.lit(10.0).alias("wind_speed_10m_mean")
    )
    assert tuple(temperatures_to_fahrenheit(df).first()) == (50.0, 10.0)


@pytest.mark.parametrize(
    ("directions", "expected"), [([350.0, 10.0], 0.0), ([0.0, 180.0], 0.0), ([90.0, 180.0], 135.0)]
)
def test_circular_mean(spark, directions, expected):
    df = spark.createDataFrame([(d,) for d in directions], "d double")
    assert df.agg(circular_mean(F.col("d"))).first()[0] == pytest.approx(expected, abs=1e-9)


def test_wind_classes(spark):
    assert [value(spark, wind_sector(F.lit(x))) for x in (0.0, 44.9, 45.0, 359.9, 360.0)] == [
        0, 0, 1, 7, 0,
    ]
    assert value(spark, wind_sector(F.lit(350.0), centered=True)) == 0
    assert [value(spark, speed_class(F.lit(x))) for x in (-1.0, 0.0, 5.0, 19.9, 20.0)] == [
        None, 0, 1, 2, 3,
    ]
