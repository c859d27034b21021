"""Station metadata."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.core.errors import SchemaError
from tidewater.functions.geo import coordinate
from tidewater.sources.tables import load_table


def stations_from(df: DataFrame, *, name_col: str = "Measuring station", lon_col: str = "Longitude", lat_col: str = "Latitude") -> DataFrame:
    """``station_name, station_lon, station_lat`` (decimal degrees) from a table.

    Headers match with white space around them ignored; coordinates are numbers or degree texts, else NULL.
    """
    by_name = {}
    for c in df.columns:
        by_name.setdefault(c.strip(), c)
    found = {w: w if w in df.columns else by_name.get(w.strip()) for w in (name_col, lon_col, lat_col)}
    missing = [w for w, c in found.items() if c is None]
    if missing:
        raise SchemaError(f"station columns not found: {missing}; available: {df.columns}")
    return df.select(
        F.col(f"`{found[name_col]}`").alias("station_name"), coordinate(df, found[lon_col]).alias("station_lon"), coordinate(df, found[lat_col]).alias("station_lat"),
    )


def load_stations(
    spark: SparkSession, path: str | os.PathLike, *, name_col: str = "Measuring station", lon_col: str = "Longitude", lat_col: str = "Latitude", **options,
) -> DataFrame:
    return stations_from(load_table(spark, path, **options), name_col=name_col, lon_col=lon_col, lat_col=lat_col)
