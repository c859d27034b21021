"""Tables, stations, requests, grids, the command line."""

from __future__ import annotations

import zipfile

import pytest
from helpers_frames import frame, hourly
from pyspark.sql import functions as F

from tidewater import cli
from tidewater.core.errors import ColumnNotFoundError, ConfigurationError, CredentialsError, ExtractionError, MissingDependencyError, SchemaError
from tidewater.functions import geo
from tidewater.sources.grids import extract_archive
from tidewater.sources.requests import CAMSExtractor, CopernicusExtractor, ERA5Extractor, ERA5LandExtractor, hours
from tidewater.sources.stations import load_stations
from tidewater.sources.tables import load_table, save_table


@pytest.mark.parametrize("name", ["a.csv", "b.tsv", "c.parquet"])
@pytest.mark.parametrize("single", [False, True])
def test_round_trip(spark, tmp_path, name, single):
    df = frame(spark, hourly(30))
    path = save_table(df, tmp_path / "new" / name, single_file=single)
    assert path.endswith(name) and (tmp_path / "new" / name).is_file() == single
    back = load_table(spark, path, time_col="ts", set_time_index=True)
    assert back.columns == df.columns
    want = [(r.ts, None if r.no2 is None else round(r.no2, 6)) for r in df.orderBy("ts").collect()]
    assert [(r.ts, None if r.no2 is None else round(r.no2, 6)) for r in back.collect()] == want


def test_projection_reaches_the_scan(spark, tmp_path):
    path = save_table(frame(spark, hourly(10)), tmp_path / "t.parquet")
    df = load_table(spark, path, columns=["o3"], time_col="ts")
    assert df.columns == ["o3", "ts"]
    plan = df.where("o3 > 10")._jdf.queryExecution().executedPlan().toString()
    assert "no2" not in plan and "PushedFilters: [IsNotNull(o3), GreaterThan(o3,10.0)]" in plan


def test_table_errors(spark, tmp_path):
    with pytest.raises(SchemaError):
        load_table(spark, tmp_path / "x.doc")
    with pytest.raises(FileNotFoundError):
        load_table(spark, tmp_path / "x.csv")
    df = frame(spark, hourly(5))
    with pytest.raises(SchemaError):
        save_table(df, tmp_path / "deep" / "x.doc")
    assert not (tmp_path / "deep").exists()
    path = save_table(df, tmp_path / "x.parquet")
    with pytest.raises(SchemaError):
        load_table(spark, path, columns=["nope"])
    with pytest.raises(ColumnNotFoundError):
        load_table(spark, path, time_col="nope")
    with pytest.raises(SchemaError):
        load_table(spark, path, time_col="no2")
    with pytest.raises(SchemaError):
        load_table(spark, save_table(df.drop("ts"), tmp_path / "y.parquet"), set_time_index=True)
    (tmp_path / "z.xlsx").write_bytes(b"")
    with pytest.raises((MissingDependencyError, ValueError)):
        load_table(spark, tmp_path / "z.xlsx")


def test_degrees(spark):
    rows = [("46°18'27\"N", 46.3075), ("10°00'00\"S", -10.0), ("46-18-27N", 46.3075), ("9-31-48-W", -9.53), ("-5 30", -5.5), ("12.5", 12.5), ("none", None), ("", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, dd double").select(geo.dms_to_dd(F.col("t")).alias("x"), "dd").collect()
    for r in got:
        assert r.x == (pytest.approx(r.dd) if r.dd is not None else None)


def test_stations(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,Measuring station ,Longitude,Latitude\n1,Alpha,"15°58\'48""E","45°48\'36""N"\n2,Beta,16.44,46.31\n')
    got = load_stations(spark, tmp_path / "s.csv").collect()
    assert [r.station_name for r in got] == ["Alpha", "Beta"] and got[0].station_lon == pytest.approx(15.98) and got[1].station_lat == 46.31
    with pytest.raises(SchemaError):
        load_stations(spark, tmp_path / "s.csv", name_col="Nope")


def test_file_names(spark):
    df = spark.createDataFrame([(" Graz / Nord?",), ("a_b.c-d",), ("///",)], "n string")
    assert [r[0] for r in df.select(geo.safe_filename(F.col("n"))).collect()] == ["Graz_Nord", "a_b.c-d", ""]


def test_grid_sampling_and_merge(spark):
    grid = spark.createDataFrame([(t, la, lo, 100 * t + 10 * la + lo) for t in (1, 2) for la in (45.0, 46.0) for lo in (15.0, 16.0)], "time int, lat double, lon double, t2m double")
    stations = spark.createDataFrame([("A", 15.5, 45.2), ("B", 15.9, 45.9)], "station_name string, station_lon double, station_lat double")
    got = {(r.station_name, r.timestamp): r.t2m for r in geo.sample_at_points(grid, stations).collect()}
    assert got == {("A", 1): 565.0, ("A", 2): 665.0, ("B", 1): 576.0, ("B", 2): 676.0}
    other = spark.createDataFrame([("A", 1, 0.0, 5.0), ("C", 9, 0.0, 7.0)], "station_name string, timestamp int, t2m double, blh double")
    merged = {(r.station_name, r.timestamp): (r.t2m, r.blh) for r in geo.merge_station_frames([geo.sample_at_points(grid, stations), other]).collect()}
    assert merged[("A", 1)] == (565.0, 5.0) and merged[("C", 9)] == (None, 7.0) and merged[("B", 2)] == (676.0, None)
    assert ERA5Extractor.expand_area(stations) == pytest.approx([46.4, 15.0, 44.7, 16.4])
    with pytest.raises(SchemaError):
        ERA5Extractor.expand_area(grid)


def test_requests():
    era = ERA5Extractor(client=object()).build_request(area=(49, 9, 46, 17), start="2020-12-30", end="2021-01-02")
    assert era["product_type"] == "reanalysis" and era["year"] == ["2020", "2021"] and era["month"] == ["01", "12"] and era["day"] == ["01", "02", "30", "31"]
    assert len(era["time"]) == 24 and era["area"] == [49.0, 9.0, 46.0, 17.0] and len(era["variable"]) == 7
    cams = CAMSExtractor(client=object()).build_request(area=(1, 2, 0, 3), start="2023-01-01T12:00", end="2023-01-01", times=None)
    assert cams["date"] == "2023-01-01/2023-01-01" and cams["time"][:2] == ["00:00", "03:00"] and "year" not in cams
    land = ERA5LandExtractor(client=object()).build_request(area=(1, 2, 0, 3), start="2023-01-01", end="2023-01-01", variables=["x"], times=["06:00"])
    assert "product_type" not in land and land["variable"] == ["x"] and land["time"] == ["06:00"]
    for bad in ({"area": (1, 2, 3)}, {"area": None}, {"start": "2024-01-02", "end": "2024-01-01"}):
        with pytest.raises(ConfigurationError):
            ERA5Extractor(client=object()).build_request(**{"area": (1, 2, 0, 3), "start": "2024-01-01", "end": "2024-01-02", **bad})
    for step in (0, 25):
        with pytest.raises(ConfigurationError):
            hours(step)
    with pytest.raises(NotImplementedError):
        CopernicusExtractor().build_request(area=(1, 2, 0, 3), start="2024-01-01", end="2024-01-01")


class FakeStore:
    def __init__(self, content=None):
        self.content = content

    def retrieve(self, dataset, request):
        self.asked = (dataset, request)
        return self

    def download(self, target):
        if self.content is None:
            raise OSError("no network")
        with zipfile.ZipFile(target, "w") as file:
            file.writestr("b.grib", self.content)
            file.writestr("a.bin", self.content)
            file.writestr("readme.txt", "x")


def test_extraction(spark, tmp_path):
    grid = spark.createDataFrame([(1, 45.0, 15.0, 2.5)], "time int, lat double, lon double, t2m double")
    stations = spark.createDataFrame([("A", 15.1, 45.1)], "station_name string, station_lon double, station_lat double")
    seen = []

    def opener(session, files):
        seen.extend(p.name for p in files)
        return [grid]

    store = FakeStore(b"GRIB....")
    out = ERA5Extractor(client=store).extract_to_frames(stations=stations, opener=opener, area=(46, 15, 45, 16), start="2024-01-01", end="2024-01-01", save_dir=str(tmp_path / "out"))
    assert [tuple(r) for r in out.collect()] == [("A", 1, 2.5)] and seen == ["a.bin", "b.grib"]
    assert store.asked[0] == "reanalysis-era5-single-levels" and (tmp_path / "out" / "file=A").exists()
    with pytest.raises(ExtractionError):
        ERA5Extractor(client=FakeStore()).retrieve({}, tmp_path / "x.zip")
    with pytest.raises(ConfigurationError):
        ERA5Extractor(client=store).extract_to_frames({}, stations=stations, area=(1, 2, 0, 3))
    with pytest.raises(ConfigurationError):
        CopernicusExtractor(client=store).retrieve({}, tmp_path / "x.zip")
    with pytest.raises(MissingDependencyError):
        ERA5Extractor().client()
    assert issubclass(CredentialsError, ExtractionError)


def test_archives(tmp_path):
    (tmp_path / "x.dat").write_bytes(b"GRIBxxx")
    assert extract_archive(tmp_path / "x.dat", tmp_path / "o") == [tmp_path / "x.dat"]
    (tmp_path / "y.dat").write_bytes(b"nothing")
    for bad in ("y.dat", "missing.zip"):
        with pytest.raises(ExtractionError):
            extract_archive(tmp_path / bad, tmp_path / "o")


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([]) == 0 and "preprocess" in capsys.readouterr().out
    assert cli.main(["info"]) == 0 and "cfgrib" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    path = save_table(frame(spark, hourly(60)), tmp_path / "in.parquet")
    assert cli.main(["preprocess", path, str(tmp_path / "out.parquet")]) == 0
    out = spark.read.parquet(str(tmp_path / "out.parquet"))
    assert out.count() == 60 and "hour_sin" in out.columns and out.where("no2 is null").count() == 0
    (tmp_path / "c.json").write_text('{"steps": [{"step": "MissingValueHandler", "params": {"strategy": "ffill"}}, {"step": "Scaler"}]}')
    assert cli.main(["preprocess", path, str(tmp_path / "out.csv"), "--config", str(tmp_path / "c.json"), "--time-col", "ts"]) == 0
    assert load_table(spark, tmp_path / "out.csv").count() == 60
