"""Coordinates, names and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.core.shared import broadcast_if_small


def dms_to_dd(text: Column) -> Column:
    """Degrees, minutes and seconds in a text -> decimal degrees (double); NULL where no number is found.

    Unsigned numbers are read in order, anything else parts them. Negative with a leading minus, or with S or W
    anywhere in either case.
    """
    clean = F.trim(text.cast("string"))
    numbers = F.transform(F.regexp_extract_all(clean, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    part = lambda k: F.coalesce(F.get(numbers, F.lit(k)), F.lit(0.0))
    size = part(0) + part(1) / 60.0 + part(2) / 3600.0
    sign = F.when(clean.startswith("-") | clean.rlike("[sSwW]"), -1.0).otherwise(1.0)
    return F.when(F.size(numbers) > 0, sign * size)


def coordinate(df: DataFrame, name: str) -> Column:
    """Decimal degrees of a column of numbers or of texts, NULL where it is neither."""
    if df.schema[name].dataType.typeName() == "string":
        return dms_to_dd(F.col(f"`{name}`"))
    return F.col(f"`{name}`").cast("double")


def safe_filename(name: Column) -> Column:
    """Runs of anything but letters, digits, dot, underscore and minus become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def expand_area(stations: DataFrame, *, margin: float = 0.5) -> DataFrame:
    """One row ``north, west, south, east`` around all stations."""
    lat, lon = (F.col(c).cast("double") for c in ("station_lat", "station_lon"))
    return stations.agg(
        (F.max(lat) + margin).alias("north"), (F.min(lon) - margin).alias("west"), (F.min(lat) - margin).alias("south"), (F.max(lon) + margin).alias("east"),
    )


def nearest_cells(grid: DataFrame, stations: DataFrame, *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each station with the grid's nearest latitude and longitude, each found on its own axis.

    Ties go to the smaller coordinate. Axes hold one row for each distinct coordinate; a station meets an
    axis, never the cells.
    """
    def pick(axis: str, own: str, name: str) -> DataFrame:
        values = grid.select(F.col(axis).cast("double").alias("__g")).distinct().where("__g is not null")
        met = stations.select("station_name", own).join(broadcast_if_small(values))  # an axis: distinct coordinates of one dimension
        best = F.min_by("__g", F.struct(F.abs(F.col("__g") - F.col(own)), F.col("__g")))
        return met.groupBy("station_name").agg(best.alias(name))

    return pick(lat, "station_lat", "cell_lat").join(pick(lon, "station_lon", "cell_lon"), "station_name")


def sample_at_points(grid: DataFrame, stations: DataFrame, *, lat: str = "lat", lon: str = "lon", time: str = "time") -> DataFrame:
    """Grid rows of every station's nearest cell: ``station_name, timestamp`` and the variables, one long table."""
    stamp = "valid_time" if "valid_time" in grid.columns else time
    cells = nearest_cells(grid, stations, lat=lat, lon=lon)
    hit = (F.col(lat).cast("double") == F.col("cell_lat")) & (F.col(lon).cast("double") == F.col("cell_lon"))
    variables = [c for c in grid.columns if c not in (lat, lon, time, "valid_time")]
    return grid.join(broadcast_if_small(cells), hit).select("station_name", F.col(stamp).alias("timestamp"), *variables)


def merge_station_frames(frames: list[DataFrame]) -> DataFrame:
    """Full outer join on station and timestamp; of columns that repeat, the first frame's stay."""
    out = frames[0]
    for other in frames[1:]:
        fresh = [c for c in other.columns if c not in out.columns]
        out = out.join(other.select("station_name", "timestamp", *fresh), ["station_name", "timestamp"], "full")
    return out
