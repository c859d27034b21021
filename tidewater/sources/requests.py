"""Requests to reanalysis data stores. Builders are pure; the client that sends them can be passed in."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from tidewater.core.errors import ConfigurationError, CredentialsError, ExtractionError, SchemaError
from tidewater.functions.geo import expand_area
from tidewater.sources.tables import require


def day(when: str | dt.date | dt.datetime) -> dt.date:
    """The calendar day of a date, a time or an ISO text."""
    if isinstance(when, dt.datetime):
        return when.date()
    return when if isinstance(when, dt.date) else dt.datetime.fromisoformat(str(when)).date()


def _days(start, end) -> tuple[dt.date, dt.date]:
    first, last = day(start), day(end)
    if last < first:
        raise ConfigurationError(f"end ({end}) is before start ({start})")
    return first, last


def date_grid(start, end) -> tuple[list[str], list[str], list[str]]:
    """Years, months and days that occur in an inclusive range. The store combines them freely, so a range over
    several months also covers days outside it."""
    first, last = _days(start, end)
    days = [first + dt.timedelta(k) for k in range((last - first).days + 1)]
    return tuple(sorted({d.strftime(f) for d in days}) for f in ("%Y", "%m", "%d"))


def hours(step: int = 1) -> list[str]:
    if not 1 <= step <= 24:
        raise ConfigurationError(f"a step of hours is 1 to 24, got {step}")
    return [f"{h:02d}:00" for h in range(0, 24, step)]


def box(area: Sequence[float] | None) -> list[float]:
    if area is None or len(area) != 4:
        raise ConfigurationError(f"area is [north, west, south, east], got {area!r}")
    return [float(x) for x in area]


class CopernicusExtractor:
    """A data store: its address, default dataset and variables, and how its requests look."""

    STORE_NAME = "Copernicus Data Store"
    API_URL = "https://cds.climate.copernicus.eu/api"
    DEFAULT_DATASET = ""
    DEFAULT_VARIABLES: tuple[str, ...] = ()
    STEP_HOURS = 1

    def __init__(self, *, url: str | None = None, key: str | None = None, output_dir: str | os.PathLike = "data", client: Any = None, quiet: bool = True):
        self.url, self.key, self.output_dir = url or self.API_URL, key or os.getenv("CDSAPI_KEY"), Path(output_dir)
        self.quiet, self._client = quiet, client

    def client(self) -> Any:
        """The store's client: the one given, else one made once from url and key (or its own settings file)."""
        if self._client is None:
            api = require("cdsapi", "downloading from a data store")
            try:
                self._client = api.Client(**{k: v for k, v in (("url", self.url), ("key", self.key), ("quiet", self.quiet)) if v is not None})
            except Exception as why:
                raise CredentialsError(f"no client for {self.STORE_NAME}: pass key=, set CDSAPI_KEY or write ~/.cdsapirc ({why})") from why
        return self._client

    def retrieve(self, request: dict[str, Any], target: str | os.PathLike, dataset: str | None = None) -> Path:
        name = dataset or self.DEFAULT_DATASET
        if not name:
            raise ConfigurationError("no dataset given, and the store has no default")
        target = Path(target)
        target.parent.mkdir(parents=True, exist_ok=True)
        client = self.client()
        try:
            client.retrieve(name, request).download(str(target))
        except Exception as why:
            raise ExtractionError(f"{self.STORE_NAME} did not deliver {name!r}: {why}") from why
        return target

    def dates(self, start, end) -> dict[str, Any]:
        years, months, days = date_grid(start, end)
        return {"year": years, "month": months, "day": days}

    def build_request(
        self, *, area: Sequence[float], start, end, variables: Sequence[str] | None = None, times: Sequence[str] | None = None,
        data_format: str = "grib", download_format: str = "zip",
    ) -> dict[str, Any]:
        if type(self) is CopernicusExtractor:
            raise NotImplementedError("use a store's own class")
        request = {"variable": list(self.DEFAULT_VARIABLES if variables is None else variables), **self.dates(start, end)}
        request |= {"time": list(times) if times is not None else hours(self.STEP_HOURS), "data_format": data_format}
        return request | {"download_format": download_format, "area": box(area)}

    @staticmethod
    def expand_area(stations: DataFrame, *, margin: float = 0.5) -> list[float]:
        """[north, west, south, east] around all stations."""
        missing = [c for c in ("station_lat", "station_lon") if c not in stations.columns]
        if missing:
            raise SchemaError(f"station columns not found: {missing}; available: {stations.columns}")
        return list(expand_area(stations, margin=margin).first())

    def extract_to_frames(
        self, request: dict[str, Any] | None = None, *, stations: DataFrame, dataset: str | None = None, save_dir: str | None = None, opener: Any = None, **build: Any,
    ) -> DataFrame:
        """Download, open, sample at the stations and merge: one long table ``station_name, timestamp, ...``.

        ``opener`` turns the extracted files into a list of grid frames (long tables of time, lat, lon and
        variables); the default needs cfgrib. ``save_dir`` gets one CSV folder partitioned by station.
        """
        import tempfile

        from tidewater.core.shared import scratch
        from tidewater.functions.geo import merge_station_frames, sample_at_points, safe_filename
        from tidewater.sources.grids import extract_archive, open_grids

        if not hasattr(stations, "schema"):
            raise SchemaError("stations must be a frame; load_stations makes one")
        if request is not None and build:
            raise ConfigurationError("pass a request or what to build it from, not both")
        request = request if request is not None else self.build_request(**build)
        zipped = request.get("download_format", "zip") == "zip"
        suffix = ".zip" if zipped else ".nc" if str(request.get("data_format", "grib")).startswith("netcdf") else ".grib"
        with tempfile.TemporaryDirectory() as folder:
            archive = self.retrieve(request, Path(folder) / f"download{suffix}", dataset)
            grids = (opener or open_grids)(stations.sparkSession, extract_archive(archive, Path(folder) / "files"))
            # Stored before the files go. The driver reads them: an opener must not leave that to executors.
            out = scratch(merge_station_frames([sample_at_points(g, stations) for g in grids]), "extracted")
        if save_dir is not None:
            out.withColumn("file", safe_filename("station_name")).write.mode("overwrite").partitionBy("file").option("header", True).csv(save_dir)
        return out


class ERA5Extractor(CopernicusExtractor):
    """ERA5 hourly data on single levels."""

    STORE_NAME, DEFAULT_DATASET = "Climate Data Store", "reanalysis-era5-single-levels"
    # The store's variable names.
    DEFAULT_VARIABLES = (
        "10m_u_component_of_wind", "10m_v_component_of_wind", "2m_temperature", "surface_pressure", "total_precipitation",
        "boundary_layer_height", "surface_net_solar_radiation",
    )

    def build_request(self, *, product_type: str = "reanalysis", **more: Any) -> dict[str, Any]:
        return {"product_type": product_type, **super().build_request(**more)}


class ERA5LandExtractor(CopernicusExtractor):
    """ERA5-Land hourly data; it takes no product type."""

    STORE_NAME, DEFAULT_DATASET = "Climate Data Store, land", "reanalysis-era5-land"
    # The store's variable names.
    DEFAULT_VARIABLES = (
        "2m_temperature", "total_precipitation", "volumetric_soil_water_layer_1", "leaf_area_index_high_vegetation",
        "skin_temperature", "snow_depth",
    )


class CAMSExtractor(CopernicusExtractor):
    """CAMS global reanalysis of composition: three-hourly, one date range."""

    STORE_NAME, API_URL, DEFAULT_DATASET = "Atmosphere Data Store", "https://ads.atmosphere.copernicus.eu/api", "cams-global-reanalysis-eac4"
    STEP_HOURS = 3
    # The store's variable names.
    DEFAULT_VARIABLES = (
        "particulate_matter_2.5um", "particulate_matter_10um", "nitrogen_dioxide", "ozone", "carbon_monoxide", "sulphur_dioxide",
    )

    def dates(self, start, end) -> dict[str, Any]:
        first, last = _days(start, end)
        return {"date": f"{first}/{last}"}
