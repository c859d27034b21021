"""Steps in a row."""

from __future__ import annotations

import pytest
from helpers_frames import frame, hourly

from tidewater.core.axis import Axis
from tidewater.core.errors import ConfigurationError, NotFittedError, SchemaError
from tidewater.core.step import Pipeline, Step, make_pipeline
from tidewater.operators import MissingValueHandler, OutlierHandler, Scaler, TemporalFeatures


def steps():
    return [MissingValueHandler(["no2", "o3"], "interpolate", limit=3, axis=Axis("ts")), ("clip", OutlierHandler()), TemporalFeatures("ts"), Scaler(["no2"])]


def test_fit_transform_is_fit_then_transform(spark):
    df = frame(spark, hourly())
    once = Pipeline(steps()).fit_transform(df).orderBy("ts").collect()
    pipe = Pipeline(steps()).fit(df)
    assert pipe.transform(df).orderBy("ts").collect() == once
    assert pipe.output_columns() == pipe.transform(df).columns
    assert df.columns == ["ts", "no2", "o3", "pm10"]


def test_names_and_slices(spark):
    pipe = Pipeline(steps())
    assert list(pipe.named_steps) == ["missingvaluehandler0", "clip", "temporalfeatures2", "scaler3"]
    assert len(pipe) == 4 and pipe["clip"] is pipe[1] and len(pipe[1:3]) == 2
    with pytest.raises(NotFittedError):
        pipe.fit(frame(spark, hourly(48)))[:2].transform(frame(spark, hourly(48)))
    with pytest.raises(TypeError):
        pipe[1.5]
    assert "Scaler" in repr(pipe)


def test_refused(spark):
    for bad in ([], [("a", Scaler()), ("a", Scaler())], [1], 5):
        with pytest.raises(ConfigurationError):
            Pipeline(bad)
    with pytest.raises(NotFittedError):
        make_pipeline(Scaler()).transform(frame(spark, hourly(5)))
    with pytest.raises(SchemaError):
        make_pipeline(Scaler()).fit("no frame")


def test_configuration():
    pipe = Pipeline.from_config([{"step": "MissingValueHandler", "params": {"strategy": "mean"}}, {"step": "Scaler", "name": "scale"}])
    assert list(pipe.named_steps) == ["missingvaluehandler0", "scale"] and pipe[0].strategy == "mean"
    for bad in ([{"step": "Nope"}], [{}], [3], 4):
        with pytest.raises(ConfigurationError):
            Pipeline.from_config(bad)


def test_own_step(spark):
    class Twice(Step):
        numeric_only = True

        def __init__(self, columns=None):
            self.columns = columns

        def apply(self, df):
            return df.withColumns({c: df[c] * 2 for c in self.columns_})

    df = spark.createDataFrame([(1, "a", True)], "x int, s string, b boolean")
    out = make_pipeline(Twice()).fit_transform(df).first()
    assert (out.x, out.s, out.b) == (2, "a", True)
    assert Twice("x").copy().params() == {"columns": "x"}


def test_scratch_restores_the_setting(spark):
    from tidewater.core.shared import CLEAN_UP, scratch

    before = spark.conf.get(CLEAN_UP)
    df = spark.range(100).repartition(3)
    kept = scratch(df.groupBy((df.id % 7).alias("k")).count(), "test")
    assert sorted(r.k for r in kept.collect()) == list(range(7)) and spark.conf.get(CLEAN_UP) == before
    assert df.count() == 100 and scratch(df, "again").count() == 100
