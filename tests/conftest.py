import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def to_spark(spark, frame):
    """pandas to Spark with naive times and NULL for missing."""
    df = spark.createDataFrame(frame)
    if "time" in frame.columns:
        df = df.withColumn("time", F.col("time").cast("timestamp_ntz"))
    from isobar.schema import nan_to_null

    return nan_to_null(df)


def to_pandas(df, by=("station_id", "time")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def seasonal_series(lengths, seed=0):
    """Daily series with trend, year, week and fixed noise; one station per length."""
    rng = np.random.default_rng(seed)
    parts = []
    for station, n in enumerate(lengths, start=1):
        time = pd.date_range("1990-01-01", periods=n, freq="D")
        t = np.arange(n)
        value = (
            10
            + 0.001 * t
            + 8 * np.sin(2 * np.pi * time.dayofyear / 365.25)
            + 2 * np.cos(2 * np.pi * t / 7)
            + rng.normal(size=n)
        )
        parts.append(pd.DataFrame({"station_id": station, "time": time, "v": value}))
    return pd.concat(parts, ignore_index=True)


def raw_hourly(rows_per_station, seed=1, missing=0.2):
    """Hourly readings with gaps, planted outliers and an all-null column."""
    rng = np.random.default_rng(seed)
    parts = []
    for station, n in rows_per_station.items():
        hours = np.sort(rng.choice(n * 2, size=n, replace=False))
        frame = pd.DataFrame(
            {
                "station_id": station,
                "time": pd.Timestamp("2020-01-10") + pd.to_timedelta(hours, unit="h"),
                "temperature_2m": rng.normal(15, 12, n),
                "relative_humidity_2m": rng.uniform(10, 100, n),
                "wind_speed_10m": rng.gamma(2, 6, n),
                "wind_direction_10m": rng.uniform(0, 360, n),
                "surface_pressure": rng.normal(1013, 8, n),
                "precipitation": rng.gamma(0.3, 2, n),
                "rain": np.full(n, np.nan),
                "latitude": 10.0 + station,
            }
        )
        frame.loc[rng.random(n) < 0.01, "surface_pressure"] = 1400.0
        for c in ("temperature_2m", "relative_humidity_2m", "surface_pressure", "precipitation"):
            frame.loc[rng.random(n) < missing, c] = np.nan
        parts.append(frame)
    return pd.concat(parts, ignore_index=True)
