"""Station, country and map tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_KEYS, require

# Boundary names that differ from the names stations carry.
COUNTRY_ALIASES = {
    "united states of america": "united states",
    "united kingdom": "united kingdom",
    "russian federation": "russia",
}


def clean_country_name(name: Column, aliases: bool = False) -> Column:
    """Lower case without outer blanks; ``aliases`` also maps boundary names."""
    clean = F.lower(F.trim(name))
    if not aliases:
        return clean
    pairs = F.create_map(*[F.lit(v) for pair in COUNTRY_ALIASES.items() for v in pair])
    return F.coalesce(F.try_element_at(pairs, clean), clean)


def station_summary(
    daily: DataFrame, stations: DataFrame, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """Mean daily temperature and precipitation per station with its place.

    Stations without daily rows do not appear.  Both sides are one row per
    station by the time they meet.
    """
    means = daily.groupBy(*keys).agg(
        F.avg("temperature_2m_mean").alias("temperature_2m_mean"),
        F.avg("precipitation_sum").alias("precipitation_sum"),
    )
    place = stations.select(*keys, "name", "latitude", "longitude", "country")
    return means.join(place, list(keys)).select(
        *keys,
        "name",
        "latitude",
        "longitude",
        "country",
        "temperature_2m_mean",
        "precipitation_sum",
    )


def country_average(summary: DataFrame, column: str = "temperature_2m_mean") -> DataFrame:
    """Mean over the stations of each country."""
    require(summary, "country", column)
    return summary.groupBy("country").agg(F.avg(column).alias(column))


def country_join(
    boundaries: DataFrame, averages: DataFrame, column: str = "temperature_2m_mean"
) -> DataFrame:
    """Boundaries with their country's average; boundaries without one are dropped.

    Names are compared cleaned.  Every boundary is offered (a left join) and the
    unmatched ones fall to the null filter, which the optimizer turns into an
    inner join.
    """
    named = boundaries.withColumn("name_clean", clean_country_name(F.col("name"), aliases=True))
    averaged = averages.withColumn("name_clean", clean_country_name(F.col("country")))
    return named.join(averaged, "name_clean", "left").dropna(subset=[column])


def heat_weights(summary: DataFrame, column: str = "temperature_2m_mean") -> DataFrame:
    """Rows ``(latitude, longitude, weight)`` with the value scaled to 0..1.

    The extremes are scalar subqueries: one row, computed once, no join.
    """
    known = summary.dropna(subset=["latitude", "longitude", column])
    low = known.select(F.min(column)).scalar()
    high = known.select(F.max(column)).scalar()
    reach = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return known.select("latitude", "longitude", ((F.col(column) - low) / reach).alias("weight"))


def _near_stations(framed: DataFrame, cells: int, nearest: int) -> DataFrame:
    """Stations with every grid point (``_row``, ``_col``) that may have them among its nearest.

    Stations are counted per cell around a grid point.  Rings of cells around a point
    are added up until they hold ``nearest`` stations; none of these is further than
    the ring's corner, so only cells within that distance are searched.  The tables of
    cells and rings have a size that the grid fixes.  Stations meet grid points by an
    equal join on the cell, a few for each station where stations are many.
    """

    def step(c: str) -> Column:
        return (F.col(f"_high_{c}") - F.col(f"_low_{c}")) / (cells - 1)

    def cell(c: str) -> Column:
        at = F.round(F.try_divide(F.col(c) - F.col(f"_low_{c}"), step(c)))
        return F.coalesce(at, F.lit(0.0)).cast("int")

    placed = framed.select("*", cell("latitude").alias("_i"), cell("longitude").alias("_j"))
    counts = placed.groupBy("_i", "_j").agg(
        F.count("*").alias("_count"), F.max(step("latitude")).alias("_dy"), F.max(step("longitude")).alias("_dx")
    )
    every = F.sequence(F.lit(0), F.lit(cells - 1))
    seen = counts.withColumn("_row", F.explode(every)).withColumn("_col", F.explode(every))
    ring = F.greatest(F.abs(F.col("_row") - F.col("_i")), F.abs(F.col("_col") - F.col("_j")))
    rings = seen.groupBy("_row", "_col", ring.alias("_ring")).agg(
        F.sum("_count").alias("_count"), F.max("_dy").alias("_dy"), F.max("_dx").alias("_dx")
    )
    around = Window.partitionBy("_row", "_col").orderBy("_ring")
    enough = F.when(F.sum("_count").over(around) >= nearest, F.col("_ring"))
    reach = rings.withColumn("_enough", enough).groupBy("_row", "_col").agg(
        F.coalesce(F.min("_enough"), F.lit(cells)).alias("_enough"), F.max("_dy").alias("_dy"), F.max("_dx").alias("_dx")
    )
    corner = (F.col("_enough") + 0.5) * F.hypot("_dy", "_dx")

    def searched(index: str, by: str) -> Column:
        width = F.coalesce(F.floor(F.try_divide(corner, F.col(by)) + 0.5 + 1e-9), F.lit(cells))
        width = F.least(width, F.lit(cells)).cast("int")
        return F.sequence(F.greatest(F.col(index) - width, F.lit(0)), F.least(F.col(index) + width, F.lit(cells - 1)))

    search = reach.select("_row", "_col", F.explode(searched("_row", "_dy")).alias("_i"), searched("_col", "_dx").alias("_j"))
    search = search.withColumn("_j", F.explode("_j"))
    return placed.join(search, ["_i", "_j"]).drop("_i", "_j")


def regional_grid(
    summary: DataFrame,
    column: str = "temperature_2m_mean",
    cells: int = 24,
    levels: int = 14,
    minimum_points: int = 4,
    nearest: int | None = None,
) -> DataFrame:
    """Value and level per grid cell by inverse-distance weighting of stations.

    ``nearest`` weighs only so many stations, those closest to the grid point (ties by
    place and value); see :func:`_near_stations`.  Otherwise all stations count.

    Stands in for a drawn contour map; its numbers are not those of a
    triangulation.  The grid is ``cells`` squared whatever the number of
    stations: each input task adds up its own stations per grid cell, so at most
    that many rows leave a task.  Fewer than ``minimum_points`` places give no rows.
    """
    known = summary.dropna(subset=["latitude", "longitude", column]).select(
        "latitude", "longitude", F.col(column).cast("double").alias("value")
    )

    def overall(aggregate: Column) -> Column:
        return known.select(aggregate).scalar()

    def axis(c: str) -> Column:
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        steps = F.sequence(F.lit(0), F.lit(cells - 1))
        return F.transform(
            steps,
            lambda i: F.struct(i.alias("i"), (low + (high - low) * i / (cells - 1)).alias("at")),
        )

    framed = known.select(
        "*",
        *[overall(F.min(c)).alias(f"_low_{c}") for c in ("latitude", "longitude")],
        *[overall(F.max(c)).alias(f"_high_{c}") for c in ("latitude", "longitude")],
    )
    distance = F.pow(F.col("_y.at") - F.col("latitude"), F.lit(2)) + F.pow(
        F.col("_x.at") - F.col("longitude"), F.lit(2)
    )
    if nearest is None:
        met = framed.withColumn("_y", F.explode(axis("latitude"))).withColumn("_x", F.explode(axis("longitude")))
    else:
        met = _near_stations(framed, cells, nearest).select(
            "*", axis("latitude")[F.col("_row")].alias("_y"), axis("longitude")[F.col("_col")].alias("_x")
        )
    spread = met.withColumn("_d2", distance)
    if nearest is not None:
        order = Window.partitionBy("_row", "_col").orderBy("_d2", "latitude", "longitude", "value")
        spread = spread.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= nearest)
    weight = F.try_divide(F.lit(1.0), F.col("_d2"))
    on_point = F.col("_d2") == 0
    cell_values = spread.groupBy(
        F.col("_y.i").alias("row"),
        F.col("_x.i").alias("col"),
        F.col("_y.at").alias("latitude"),
        F.col("_x.at").alias("longitude"),
    ).agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(
            F.avg(F.when(on_point, F.col("value"))),
            F.try_divide(F.sum(F.col("value") * weight), F.sum(weight)),
        ).alias("value"),
    )
    low, high = overall(F.min("value")), overall(F.max("value"))
    level = F.when(high == low, F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)) * levels) + 1, F.lit(levels))
    )
    return cell_values.where(F.col("points") >= minimum_points).select(
        "row", "col", "latitude", "longitude", "value", F.greatest(level, F.lit(1)).cast("int").alias("level")
    )
