"""Stored tables: raw hourly readings and daily exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.series import bucket_of
from ..schema import DEFAULT_KEYS, HOURLY_SCHEMA, nan_to_null
from ..storage import use_checkpoints

STATION_BUCKET = "station_bucket"
YEAR = "year"
#: Column of a table in cells that says which calendar cell a reading is in.
CELL = "cell"


def read_hourly_csv(
    spark: SparkSession, path: str, schema: T.StructType = HOURLY_SCHEMA
) -> DataFrame:
    """Raw hourly CSV with a header.  The schema is given, so the files are read once.

    Text that says NaN reads as missing.
    """
    return nan_to_null(spark.read.schema(schema).csv(path, header=True, nanValue="nan"))


def station_bucket(station: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(station), F.lit(buckets)).cast("int")


def write_hourly(df: DataFrame, path: str, buckets: int = 64, mode: str = "error") -> None:
    """Store raw readings so that a station and date range read few files.

    Directories are station bucket and year, a number that does not grow with
    the stations.  The rebalance step evens out file sizes: it splits the year
    of a hot station and joins small ones.  Files are sorted by station and
    time, so their statistics prune within a directory.
    """
    placed = df.withColumn(
        STATION_BUCKET, station_bucket(F.col("station_id"), buckets)
    ).withColumn(YEAR, F.year("time"))
    even = placed.hint("rebalance", STATION_BUCKET, YEAR)
    ordered = even.sortWithinPartitions(STATION_BUCKET, YEAR, "station_id", "time")
    ordered.write.partitionBy(STATION_BUCKET, YEAR).mode(mode).parquet(path)


def write_missing_hourly(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Append the readings whose station and time are not stored yet.

    Stored years outside those of ``df`` are not read.
    """
    spark = df.sparkSession
    first, last = df.select(F.year(F.min("time")), F.year(F.max("time"))).first()
    if first is None:
        return
    stored = spark.read.parquet(path).where(F.col(YEAR).between(first, last))
    fresh = df.join(stored.select("station_id", "time"), ["station_id", "time"], "left_anti")
    write_hourly(fresh.select(*df.columns), path, buckets, mode="append")


def store_cells(
    df: DataFrame,
    table: str,
    path: str | None = None,
    keys: Sequence[str] = DEFAULT_KEYS,
    unit: str = "month",
    buckets: int = 256,
    mode: str = "error",
) -> None:
    """Store raw readings as a table bucketed by key and calendar cell, ``cell``.

    Cleaning and the daily aggregate group by just these columns, so with
    ``cell=CELL`` they read such a table without an exchange of the readings.  A key
    that holds a third of all rows is spread over the buckets by its cells.  Each
    bucket is one file, sorted by key, cell and time: choose ``buckets`` so that a file
    has some hundred megabytes.  Under
    ``spark.sql.legacy.bucketedTableScan.outputOrdering`` the engine also trusts the
    order of the files and leaves out the sort by time.

    The readings are stored at ``path``, or in the warehouse.  Rows without a key or a
    time are stored too.
    """
    placed = df.withColumn(CELL, bucket_of(F.col("time"), unit))
    # The writer deals rows to buckets by the same hash, so a task writes one bucket.
    dealt = placed.repartition(buckets, *keys, CELL).write.bucketBy(buckets, *keys, CELL)
    writer = dealt.sortBy(*keys, CELL, "time").mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(table)


#: Where a stored table notes what has been fetched; the leading underscore keeps it out of reads.
RANGES = "_ranges"


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """``station_id, start, end`` without overlaps: ranges that meet or overlap become one.

    An end is exclusive; empty ranges and those with a null count for nothing.  Windows
    run over the ranges of one station, which are as many as its fetches.
    """
    order = Window.partitionBy("station_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.where("start < end AND station_id IS NOT NULL").withColumn(
        "_opens", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    )
    grouped = opened.withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("station_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def missing_ranges(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """What of the wanted ranges no stored range covers: interval subtraction per station.

    Both sides are merged first.  Each wanted range is cut by the stored ones it
    overlaps: a gap runs from the end of one, or its own start, to the start of the
    next, or its own end.
    """
    known = merged_ranges(stored).withColumnsRenamed({"start": "_from", "end": "_to"})
    asked = merged_ranges(wanted)
    cut = asked.join(known, "station_id", "left").withColumn("_over", (F.col("_from") < F.col("end")) & (F.col("_to") > F.col("start")))
    cuts = cut.groupBy("station_id", "start", "end").agg(
        F.sort_array(F.collect_list(F.when(F.col("_over"), F.struct("_from", "_to")))).alias("_cuts")
    )
    starts = F.concat(F.array("start"), F.col("_cuts._to"))
    ends = F.concat(F.col("_cuts._from"), F.array("end"))
    gaps = cuts.select("station_id", F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("_gap"))
    return gaps.select("station_id", "_gap.start", "_gap.end").where("start < end")


def stored_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The ranges that :func:`write_ranges` has stored at ``path``."""
    return spark.read.parquet(f"{path}/{RANGES}")


def write_ranges(df: DataFrame, wanted: DataFrame, path: str, buckets: int = 64) -> None:
    """Store the readings of ``wanted`` (``station_id, start, end``) that are not stored yet.

    Only the interval table is read to find the gaps, no stored reading.  A gap counts
    as stored even where ``df`` has no reading in it.  Gaps are noted after their
    readings; should a run end in between, :func:`write_missing_hourly` fills the same
    readings without doubling them.  The first call makes the table.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{RANGES}")
    begun = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    known = stored_ranges(spark, path) if begun else wanted.select("station_id", "start", "end").limit(0)
    # The gaps are read twice, and the note that is appended must be the one that was used.
    use_checkpoints(spark)
    gaps = missing_ranges(wanted, known).checkpoint()
    bounds = gaps.withColumnsRenamed({"station_id": "_station", "start": "_start", "end": "_end"})
    inside = (F.col("station_id") == F.col("_station")) & (F.col("time") >= F.col("_start")) & (F.col("time") < F.col("_end"))
    write_hourly(df.join(bounds, inside).select(*df.columns), path, buckets, mode="append")
    gaps.write.mode("append").parquet(f"{path}/{RANGES}")


def read_hourly(
    spark: SparkSession,
    path: str,
    station_ids: Sequence[int] | None = None,
    start: str | None = None,
    end: str | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Stored readings; stations and dates prune directories, then row groups."""
    df = spark.read.parquet(path)
    if station_ids is not None:
        wanted = [F.lit(int(s)).cast("long") for s in station_ids]
        in_bucket = [F.col(STATION_BUCKET) == station_bucket(s, buckets) for s in wanted]
        some = F.lit(False)
        for condition in in_bucket:
            some = some | condition
        df = df.where(some).where(F.col("station_id").isin([int(s) for s in station_ids]))
    if start:
        df = df.where(F.col(YEAR) >= int(start[:4]))
    if end:
        df = df.where(F.col(YEAR) <= int(end[:4]))
    return date_range(df, start, end).drop(STATION_BUCKET, YEAR)


def date_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows from ``start`` to ``end``, both days whole.  Plain comparisons with the
    time column, so a columnar scan skips what cannot match."""
    time = F.col("time")
    if start:
        df = df.where(time >= F.to_timestamp_ntz(F.lit(f"{start} 00:00:00")))
    if end:
        after = F.to_timestamp_ntz(F.lit(f"{end} 00:00:00")) + F.expr("interval 1 day")
        df = df.where(time < after)
    return df


def write_daily_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Daily table as CSV with a header."""
    df.write.option("header", True).mode(mode).csv(path)
