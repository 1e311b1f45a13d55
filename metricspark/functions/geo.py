"""Locations as metric labels and values, with math functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: mean radius of the earth in kilometres.
EARTH_RADIUS_KM = 6371.0088


def grid_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """The lower left corner of the cell a point lies in, as a label."""
    row, column = F.floor(lat / degrees), F.floor(lon / degrees)
    return F.concat_ws(":", row.cast("string"), column.cast("string"))


def distance_km(lat: Column, lon: Column, to_lat: Column | float, to_lon: Column | float) -> Column:
    """Great circle distance."""
    to_lat = F.lit(to_lat) if isinstance(to_lat, (int, float)) else to_lat
    to_lon = F.lit(to_lon) if isinstance(to_lon, (int, float)) else to_lon
    half_lat, half_lon = F.radians(to_lat - lat) / 2, F.radians(to_lon - lon) / 2
    h = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * F.pow(
        F.sin(half_lon), F.lit(2)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


# Fixed value: kilometres of a degree of latitude.
KM_A_DEGREE = EARTH_RADIUS_KM * math.pi / 180

# Points of a cell that meet its places in one task, and the most cells that may be split further.
CELL_POINTS = 100_000
SPLIT_CELLS = 10_000


def _reach(lat: Column, degrees: float) -> Column:
    """How far, in degrees of longitude, a circle of so many degrees around a point of a latitude reaches."""
    slack = 1e-6
    edge = F.abs(lat) + F.lit(degrees)
    sine = F.lit(math.sin(math.radians(degrees))) / F.cos(F.radians(F.least(F.abs(lat), F.lit(90.0))))
    return F.when(edge >= 90 - slack, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) + slack)


def _columns_of(row: Column, degrees: float) -> Column:
    """How many cells a row of the grid has: none is narrower than a circle's reach at the row's far edge."""
    far = F.least(F.greatest(F.abs(row * degrees), F.abs((row + 1) * degrees)), F.lit(90.0))
    return F.greatest(F.floor(360.0 / _reach(far, degrees)), F.lit(1)).cast("int")


def _column_of(lon: Column, columns: Column) -> Column:
    """The cell of a longitude, on a scale that goes on beyond the date line."""
    return F.floor((lon + 180.0) / 360.0 * columns)


def near(
    points: DataFrame,
    places: DataFrame,
    radius_km: float,
    point: tuple[str, str] = ("lat", "lon"),
    place: tuple[str, str] = ("place_lat", "place_lon"),
    cell_points: int = CELL_POINTS,
) -> DataFrame:
    """Each point with every place within a radius, as their columns and `km`.

    Latitudes are cut into rows as high as the radius, and each row into cells as wide as a circle reaches there, so a
    place lies in reach of few cells: it goes to all of them, a point to its own, and the two meet by an equi-join on the
    cell. Cells with very many points are dealt over salts, for which their places are repeated. Circles around a pole
    cover its rows whole, and cells go round beyond the date line. Points and places without coordinates meet nothing.
    """
    if radius_km < 0:
        raise ValueError("a radius is not negative")
    degrees = max(radius_km / KM_A_DEGREE * (1 + 1e-9), 1e-3)
    lat, lon = (F.col(c).cast("double") for c in point)
    row = F.floor(lat / degrees)
    located = (
        points.where(lat.isNotNull() & lon.isNotNull())
        .withColumn("near_row", row)
        .withColumn("near_column", F.pmod(_column_of(lon, _columns_of(row, degrees)), _columns_of(row, degrees)))
    )
    to_lat, to_lon = (F.col(c).cast("double") for c in place)
    own = F.floor(to_lat / degrees)
    columns = _columns_of(F.col("near_row"), degrees)
    reach = _reach(to_lat, degrees)
    first, last = _column_of(to_lon - reach, columns), _column_of(to_lon + reach, columns)
    # a place reaches round the earth at most once
    covered = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + columns)), lambda c: F.pmod(c, columns)))
    spread = (
        places.where(to_lat.isNotNull() & to_lon.isNotNull())
        .withColumn("near_row", F.explode(F.sequence(own - 1, own + 1)))
        .withColumn("near_column", F.explode(covered))
    )
    cells = located.groupBy("near_row", "near_column").agg(F.count(F.lit(1)).alias("near_points"))
    total = cells.agg(F.sum("near_points")).first()[0] or 0
    share = max(cell_points, math.ceil(total / SPLIT_CELLS))
    crowded = cells.where(F.col("near_points") > share).withColumn("near_salts", F.ceil(F.col("near_points") / share).cast("int"))
    crowded = F.broadcast(crowded.drop("near_points"))  # as many as there are shares at most
    cell = ["near_row", "near_column"]
    salts = F.coalesce("near_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*point, F.spark_partition_id(), F.monotonically_increasing_id()), salts).cast("int")
    dealt = located.join(crowded, cell, "left").withColumn("near_salt", salt).drop("near_salts")
    copies = spread.join(crowded, cell, "left").withColumn("near_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("near_salts")
    met = dealt.join(copies, [*cell, "near_salt"]).withColumn("km", distance_km(lat, lon, to_lat, to_lon))
    return met.where(F.col("km") <= radius_km).drop(*cell, "near_salt")
