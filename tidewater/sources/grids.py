"""Archives of gridded data, and grids as long tables."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidewater.core.errors import ExtractionError
from tidewater.sources.tables import require

#: What a GRIB file begins with, and its suffixes.
GRIB_MAGIC, GRIB_SUFFIXES = b"GRIB", (".grib", ".grib2", ".grb", ".grb2")


def is_grib(path: str | os.PathLike) -> bool:
    path = Path(path)
    if path.suffix.lower() in GRIB_SUFFIXES:
        return True
    with path.open("rb") as file:
        return file.read(4) == GRIB_MAGIC


def extract_archive(archive: str | os.PathLike, folder: str | os.PathLike) -> list[Path]:
    """GRIB files of a ZIP archive (unpacked into ``folder``), sorted; a GRIB file itself is its own list."""
    archive, folder = Path(archive), Path(folder)
    if not archive.exists():
        raise ExtractionError(f"no archive at {archive}")
    if zipfile.is_zipfile(archive):
        folder.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(archive) as file:
            file.extractall(folder)
        found = sorted(p for p in folder.rglob("*") if p.is_file() and is_grib(p))
        if not found:
            raise ExtractionError(f"{archive} holds no GRIB file")
        return found
    if is_grib(archive):
        return [archive]
    raise ExtractionError(f"{archive} is neither a ZIP archive nor a GRIB file")


def open_grids(spark: SparkSession, files: list[Path]) -> list[DataFrame]:
    """Long tables (time, lat, lon, variables), one for each type of level. Needs cfgrib."""
    cfgrib = require("cfgrib", "reading GRIB files")
    out = []
    for file in files:
        for grid in cfgrib.open_datasets(str(file)):
            table = grid.to_dataframe().reset_index().rename(columns={"latitude": "lat", "longitude": "lon"})
            out.append(spark.createDataFrame(table))
    return out
