"""Plot data, streams, small utilities."""

from __future__ import annotations

import logging

import numpy as np
import pytest
from helpers_frames import frame, gaps, hourly

from tidewater.core.errors import ConfigurationError, SchemaError
from tidewater.core.logging import enable_logging, get_logger
from tidewater.operators import LagFeatures, MissingValueHandler, OutlierHandler, Scaler, TemporalFeatures
from tidewater.core.axis import Axis
from tidewater.core.step import Pipeline
from tidewater.plans import plots
from tidewater.streaming import carried_forward, causal_features, transform_stream, windowed_means


def test_plot_data(spark):
    data = hourly()
    df = frame(spark, data)
    bars = plots.missingness(df).collect()
    assert bars[-1].column == "no2" and bars[-1].fraction == pytest.approx(3 / 240)
    assert plots.missingness(df, kind="matrix").where("no2").count() == 3
    hist = plots.distributions(df, ["pm10"], bins=10).toPandas().sort_values("bin")
    assert hist["n"].sum() == 240 and hist["n"].tolist() == [n for n in np.histogram(data["pm10"], 10)[0] if n]
    flat = plots.distributions(spark.createDataFrame([(1.0,), (1.0,)], "x double")).collect()
    assert [(r.bin, r.n) for r in flat] == [(0, 2)]
    wave = plots.density(df, "o3", points=50).toPandas()
    assert np.trapezoid(wave["density"], wave["x"]) == pytest.approx(1, abs=0.02)
    box = {r.column: r for r in plots.boxplots(df).collect()}
    assert box["pm10"].whisker_high < 500 and box["o3"].median == pytest.approx(data["o3"].median())
    assert plots.seasonality(df, "ts", "o3", by="hour").count() == 24
    assert plots.outliers(df, "pm10", bounds={"upper": 100}).where("is_out").count() == 1
    assert plots.outliers(df, "pm10", bounds=(float("-inf"), None)).where("is_out").count() == 0
    assert len(plots.correlation(df, cluster=True, method="spearman").collect()) == 3
    pairs, r2 = plots.predictions(df, "no2", "o3", time="ts")
    assert pairs.count() == 240 and r2.count() == 1
    for bad in (lambda: plots.seasonality(df, "ts", "o3", by="year"), lambda: plots.missingness(df, kind="pie"), lambda: plots.outliers(df, "o3"), lambda: plots.correlation(df, method="x")):
        with pytest.raises(ConfigurationError):
            bad()
    with pytest.raises(SchemaError):
        plots.boxplots(df.select("ts"))


def stream_of(spark, tmp_path, data, parts=3):
    df = frame(spark, data)
    ids = sorted(data["id"])
    for k, some in enumerate(np.array_split(ids, parts)):
        df.where(df.id.between(int(some[0]), int(some[-1]))).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def drained(spark, stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_fitted_steps_run_on_streams(spark, tmp_path):
    df, stream = stream_of(spark, tmp_path, gaps(60, 1))
    pipe = Pipeline([MissingValueHandler("x", "mean"), OutlierHandler("x"), TemporalFeatures("ts"), Scaler(["x"])]).fit(df)
    got = drained(spark, transform_stream(stream, pipe), tmp_path, "plain").orderBy("id").collect()
    assert got == pipe.transform(df).orderBy("id").collect()
    for step in (LagFeatures("x", lags=[1], axis=Axis("ts")), MissingValueHandler("x", "ffill", axis=Axis("ts")), OutlierHandler("x", "rolling_sigma", axis=Axis("ts"))):
        with pytest.raises(ConfigurationError):
            transform_stream(stream, step)


def test_stateful_streams_match_batch(spark, tmp_path):
    data = gaps(60, 2, keys=3)
    df, stream = stream_of(spark, tmp_path, data)
    axis = Axis("ts", keys=("key",), tie="id")
    batch = LagFeatures("x", lags=[1, 2], windows=[4], agg="mean", axis=axis).fit_transform(df)
    want = {(r.key, r.ts): (r.x_lag1, r.x_lag2, r.x_roll4_mean) for r in batch.collect()}
    got = drained(spark, causal_features(stream, "key", "ts", "x", lags=[1, 2], windows=[4], agg="mean"), tmp_path, "causal").collect()
    assert len(got) == 60
    for r in got:
        assert [None if v is None or np.isnan(v) else round(v, 9) for v in (r.x_lag1, r.x_lag2, r.x_roll4_mean)] == [None if v is None else round(v, 9) for v in want[(r.key, r.ts)]]
    filled = MissingValueHandler("x", "ffill", limit=1, axis=axis).fit_transform(df)
    want = {(r.key, r.ts): r.x for r in filled.collect()}
    for r in drained(spark, carried_forward(stream, "key", "ts", "x", limit=1), tmp_path, "carried").collect():
        assert (None if r.x is None or np.isnan(r.x) else r.x) == want[(r.key, r.ts)]


def test_windowed_means(spark, tmp_path):
    _, stream = stream_of(spark, tmp_path, gaps(60, 3))
    out = drained(spark, windowed_means(stream, "ts", ["x"], width="1 day", late="1 hour"), tmp_path, "means", "complete")
    assert out.agg({"n": "sum"}).first()[0] == 60


def test_logging():
    one, two = enable_logging("DEBUG"), enable_logging(logging.INFO)
    assert one is two and sum(getattr(h, "_tidewater", False) for h in one.handlers) == 1
    assert get_logger("x").name == "tidewater.x" and get_logger("tidewater.y").name == "tidewater.y"
