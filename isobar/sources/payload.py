"""JSON answers of weather services: parallel arrays turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import HOURLY_READINGS

_D, _I, _S = T.DoubleType(), T.IntegerType(), T.StringType()


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _arrays(fields: dict[str, T.DataType]) -> T.StructType:
    return _struct({n: T.ArrayType(t) for n, t in fields.items()})


# Fields of the service's answers.
ARCHIVE_HOURLY = {"time": _S, **{c: _D for c in HOURLY_READINGS}}
REALTIME_CURRENT = {
    "time": _S,
    "temperature_2m": _D,
    "relative_humidity_2m": _D,
    "apparent_temperature": _D,
    "precipitation": _D,
    "rain": _D,
    "showers": _D,
    "snowfall": _D,
    "weather_code": _I,
    "surface_pressure": _D,
    "wind_speed_10m": _D,
    "wind_direction_10m": _D,
    "is_day": _I,
}
REALTIME_HOURLY = {
    "time": _S,
    "temperature_2m": _D,
    "relative_humidity_2m": _D,
    "apparent_temperature": _D,
    "precipitation_probability": _D,
    "weather_code": _I,
}
REALTIME_DAILY = {
    "time": _S,
    "temperature_2m_max": _D,
    "temperature_2m_min": _D,
    "apparent_temperature_max": _D,
    "apparent_temperature_min": _D,
    "precipitation_sum": _D,
    "precipitation_probability_max": _D,
    "wind_speed_10m_max": _D,
    "uv_index_max": _D,
}

_REQUEST = {"station_id": T.LongType(), "latitude": _D, "longitude": _D, "elevation": _D}
ARCHIVE_SCHEMA = _struct({**_REQUEST, "hourly": _arrays(ARCHIVE_HOURLY)})
REALTIME_SCHEMA = _struct(
    {
        **_REQUEST,
        "current": _struct(REALTIME_CURRENT),
        "hourly": _arrays(REALTIME_HOURLY),
        "daily": _arrays(REALTIME_DAILY),
    }
)


def parse_archive(texts: DataFrame, column: str = "value") -> DataFrame:
    """Parsed archive payloads from a column of JSON text."""
    return texts.select(F.from_json(column, ARCHIVE_SCHEMA).alias("_p")).select("_p.*")


def parse_realtime(texts: DataFrame, column: str = "value") -> DataFrame:
    """Parsed real-time payloads from a column of JSON text."""
    return texts.select(F.from_json(column, REALTIME_SCHEMA).alias("_p")).select("_p.*")


def read_archive(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Archive payload files, one object per line unless ``multiline``."""
    return spark.read.schema(ARCHIVE_SCHEMA).json(path, multiLine=multiline)


def read_realtime(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Real-time payload files."""
    return spark.read.schema(REALTIME_SCHEMA).json(path, multiLine=multiline)


def _rows(payloads: DataFrame, block: str, fields: dict[str, T.DataType], *keep: Column) -> DataFrame:
    """One row per array position of a struct of parallel arrays.

    A variable the answer leaves out counts as an empty array, which the zip
    pads with nulls; a missing array would void the whole row.
    """
    zipped = F.arrays_zip(
        *[
            F.coalesce(F.col(f"{block}.{n}"), F.array().cast(T.ArrayType(t))).alias(n)
            for n, t in fields.items()
        ]
    )
    rows = payloads.where(F.col(block).isNotNull()).select(*keep, F.inline(zipped))
    return rows.withColumn("time", F.col("time").try_cast("timestamp_ntz"))


def hourly_rows(payloads: DataFrame) -> DataFrame:
    """Hourly readings with place; a missing elevation is 0.0.

    A payload without ``hourly`` gives no rows; :func:`payload_report` counts
    those.  A time that cannot be read is left out; :func:`malformed_times` counts
    these.  A time may arrive in several payloads: the greatest row in column order
    is kept, so the result does not depend on the order of arrival.
    """
    rows = _rows(payloads, "hourly", ARCHIVE_HOURLY, F.col("station_id"), F.struct(
        "latitude", "longitude", F.coalesce("elevation", F.lit(0.0)).alias("elevation")
    ).alias("_place"))
    flat = rows.select("station_id", "time", *HOURLY_READINGS, "_place.*")
    others = [c for c in flat.columns if c not in ("station_id", "time")]
    kept = (
        flat.where(F.col("time").isNotNull())
        .groupBy("station_id", "time")
        .agg(F.max(F.struct(*others)).alias("_row"))
    )
    return kept.select("station_id", "time", "_row.*")


def malformed_times(payloads: DataFrame) -> DataFrame:
    """Per station, hourly times that cannot be read."""
    bad = F.filter("hourly.time", lambda t: t.isNotNull() & t.try_cast("timestamp_ntz").isNull())
    return payloads.groupBy("station_id").agg(F.sum(F.coalesce(F.size(bad), F.lit(0))).alias("malformed"))


def payload_report(payloads: DataFrame) -> DataFrame:
    """One row: payloads read, and those without hourly readings."""
    return payloads.agg(
        F.count(F.lit(1)).alias("payloads"),
        F.count_if(F.col("hourly").isNull()).alias("without_hourly"),
    )


def current_rows(payloads: DataFrame) -> DataFrame:
    """One row of current conditions per payload that has them."""
    known = payloads.where(F.col("current").isNotNull())
    return known.select("station_id", "current.*").withColumn(
        "time", F.col("time").try_cast("timestamp_ntz")
    )


def outlook_hourly_rows(payloads: DataFrame) -> DataFrame:
    """Hourly outlook rows."""
    return _rows(payloads, "hourly", REALTIME_HOURLY, F.col("station_id"))


def outlook_daily_rows(payloads: DataFrame) -> DataFrame:
    """Daily outlook rows."""
    return _rows(payloads, "daily", REALTIME_DAILY, F.col("station_id"))
