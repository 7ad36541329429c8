"""Weather tables derived from the given star-schema tables.

The given tables hold no readings, so hourly weather is derived from order
lines: twenty suppliers make one station, so stations grow with the data while
each station keeps the same density.  Nulls and outliers are planted.  The odd
offsets keep interpolated values off the exact borders of the feels-like formula,
where the last bit of a sum would decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIERS_PER_STATION = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings, unique on ``(station_id, time)``."""
    hours = F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    per_hour = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.floor(F.col("l_suppkey") / SUPPLIERS_PER_STATION).alias("station_id"),
            (F.col("l_shipdate") + hours).alias("time"),
        )
        .agg(
            F.avg("l_quantity").alias("q"),
            F.avg("l_discount").alias("d"),
            F.avg("l_tax").alias("x"),
            F.min("l_extendedprice").alias("p"),
            F.min("l_orderkey").alias("k"),
        )
    )
    k = F.col("k")
    return per_hour.select(
        "station_id",
        "time",
        F.when(k % 11 != 0, F.round(F.col("q") * 0.9 - 5.0137, 6)).alias("temperature_2m"),
        F.when(k % 13 != 0, F.round(F.col("d") * 1000 + 0.137, 6)).alias("relative_humidity_2m"),
        F.when(k % 509 == 0, 150.0).otherwise(F.round(F.col("x") * 500, 6)).alias("wind_speed_10m"),
        (k * 37 % 360).cast("double").alias("wind_direction_10m"),
        F.when(k % 499 == 0, 1400.0).otherwise(980 + F.col("p") / 1500).alias("surface_pressure"),
        F.when(k % 4 == 0, F.round(F.col("x") * 50, 6)).otherwise(0.0).alias("precipitation"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension: one row per station with name, country and place."""
    station = F.floor(F.col("s_suppkey") / SUPPLIERS_PER_STATION)
    suppliers = table(spark, sf_dir, "supplier").select(
        station.alias("station_id"), "s_name", F.col("s_nationkey").alias("n_nationkey")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    i = F.col("station_id")
    return (
        suppliers.join(nations, "n_nationkey")
        .groupBy("station_id")
        .agg(F.min("s_name").alias("name"), F.min("n_name").alias("country"))
        .select(
            "station_id",
            "name",
            "country",
            ((i * 37) % 140 - 70).cast("double").alias("latitude"),
            ((i * 101) % 360 - 180).cast("double").alias("longitude"),
            ((i * 13) % 900).cast("double").alias("elevation"),
        )
    )
