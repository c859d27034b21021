"""Queries over whole tables leave no key out."""

from __future__ import annotations

from pathlib import Path

import pytest

from tidewater.plans import registry

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def test_every_station_is_sampled(spark):
    keys = [r[0] for r in spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey").collect()]
    seen = {r[0] for r in registry.QUERIES["grid_nearest"](spark, str(DATA)).select("station_name").distinct().collect()}
    assert seen == {f"S{k}" for k in keys}
    lats, lons = [k * 37 % 100 / 10 for k in keys], [k * 53 % 100 / 10 for k in keys]
    box = registry.QUERIES["area_box"](spark, str(DATA)).first()
    assert (box.north, box.west, box.south, box.east) == pytest.approx((max(lats) + 0.5, min(lons) - 0.5, min(lats) - 0.5, max(lons) + 0.5))
