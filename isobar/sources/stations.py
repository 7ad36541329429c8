"""The station table: lookup by name, and current conditions by station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def station_lookup(requests: DataFrame, stations: DataFrame) -> DataFrame:
    """First station whose name matches each request (column ``query``).

    Blanks and case do not matter.  The first match is the one with the lowest
    id; a request without a match gives no row.  The best station of a name is
    found by an aggregate, which combines before the exchange, so a name shared
    by many stations stays small.
    """
    name = F.lower(F.trim("name"))
    first = stations.groupBy(name.alias("_name")).agg(
        F.min_by(
            F.struct(
                "station_id",
                "name",
                "latitude",
                "longitude",
                F.coalesce("elevation", F.lit(0.0)).alias("elevation"),
                F.coalesce("country", F.lit("Unknown")).alias("country"),
            ),
            "station_id",
        ).alias("_first")
    )
    asked = requests.withColumn("_name", F.lower(F.trim("query")))
    return asked.join(first, "_name").select("query", "_first.*")


def current_by_station(stations: DataFrame, payloads: DataFrame) -> DataFrame:
    """Latest temperature, weather code and day flag per station.

    A station whose payload is absent gets 24 degrees, code 0, day; a payload
    without ``current`` gives no row; a missing day flag counts as day.  When a
    station has several payloads the newest counts.
    """
    latest = payloads.groupBy("station_id").agg(
        F.max_by("current", F.coalesce(F.col("current.time"), F.lit(""))).alias("_current"),
        F.lit(True).alias("_answered"),
    )
    joined = stations.select("station_id", "name").join(latest, "station_id", "left")
    answered = F.coalesce("_answered", F.lit(False))

    def value(field: str, fallback: float | int):
        return F.when(answered, F.col(f"_current.{field}")).otherwise(F.lit(fallback))

    return joined.where(~answered | F.col("_current").isNotNull()).select(
        "station_id",
        "name",
        value("temperature_2m", 24.0).alias("temp"),
        value("weather_code", 0).alias("weather_code"),
        F.coalesce(value("is_day", 1), F.lit(1)).alias("is_day"),
    )
