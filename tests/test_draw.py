"""Figures: refused without matplotlib, and the calls they make with a stand-in for it."""

from __future__ import annotations

import sys
from unittest.mock import MagicMock

import pytest
from helpers_frames import frame, hourly
from pyspark.sql import functions as F

import tidewater
from tidewater.core.errors import ConfigurationError, MissingDependencyError
from tidewater.models.registry import make_regressor
from tidewater.operators import OutlierHandler
from tidewater.plans import draw


@pytest.fixture
def canvas(monkeypatch):
    mpl = MagicMock()
    mpl.pyplot.subplots.side_effect = lambda: (MagicMock(), MagicMock())
    monkeypatch.setitem(sys.modules, "matplotlib", mpl)
    monkeypatch.setitem(sys.modules, "matplotlib.pyplot", mpl.pyplot)
    return mpl


def test_needs_matplotlib(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "matplotlib", None)
    with pytest.raises(MissingDependencyError):
        draw.plot_boxplots(frame(spark, hourly(30)))
    with pytest.raises(MissingDependencyError):
        draw.set_style()


def test_figures(spark, canvas):
    df = frame(spark, hourly(120)).withColumn("guess", F.col("pm10") + 1)
    assert draw.plot_missingness(df).barh.call_args[0][0].iloc[-1] == "no2"
    assert draw.plot_missingness(df, kind="matrix").imshow.call_args[0][0].sum() == 4
    bars = draw.plot_distribution(df, "o3").bar.call_args
    assert (bars[0][1] * bars[1]["width"]).sum() == pytest.approx(1)
    cells = draw.plot_correlation(df, ["no2", "o3", "pm10"], annot=True, cluster=True).imshow.call_args[0][0]
    assert all(cells[i][i] == 1 for i in range(3)) and cells[0][1] == cells[1][0]
    assert draw.plot_timeseries(df, "ts", ["o3"]).plot.call_args[0][0].is_monotonic_increasing
    assert len(draw.plot_seasonality(df, "ts", "o3").bxp.call_args[0][0]) == 24
    assert [b["label"] for b in draw.plot_boxplots(df, ["o3", "pm10"]).bxp.call_args[0][0]] == ["o3", "pm10"]
    ax = draw.plot_outliers(df, "pm10", "ts", handler=OutlierHandler("pm10").fit(df))
    assert 500.0 in ax.plot.call_args_list[1][0][1].tolist()
    assert "R2" in draw.plot_predictions(df, "pm10", "guess").set_title.call_args[0][0]
    assert draw.plot_predictions(df, "pm10", "guess", kind="timeseries", time="ts").plot.call_count == 2
    assert draw.plot_residuals(df, "pm10", "guess").plot.call_args[0][1].round(9).eq(-1).all()
    model = make_regressor("linear").fit(df, ["pm10", "o3"], "guess")
    assert draw.plot_feature_importance(model, top_n=1).barh.call_args[0][0] == ["pm10"]
    with draw.style():
        canvas.rcParams.update.assert_called_once()
    for bad in ({"kind": "pie"}, {"kind": "timeseries"}):
        with pytest.raises(ConfigurationError):
            draw.plot_predictions(df, "pm10", "guess", **bad)


def test_package_names():
    assert tidewater.Pipeline.__module__ == "tidewater.core.step" and callable(tidewater.load_table) and tidewater.models
    assert "Axis" in dir(tidewater)
    with pytest.raises(AttributeError):
        tidewater.nope


def test_figures_of_many_rows_leave_no_place_out(spark, canvas, monkeypatch):
    monkeypatch.setattr(draw, "POINTS", 50)
    monkeypatch.setattr(draw, "SIDE", 10)
    df = spark.range(0, 4000, 1, 4).select(
        F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") == 1234, 1e6).otherwise(F.col("id") % 5).cast("double").alias("x"),
        F.when(F.col("id").between(2000, 2999), None).otherwise(F.lit(1.0)).alias("gap"), F.lit(2.0).alias("same"),
    )
    shown = draw.plot_timeseries(df, "ts", ["x"]).plot.call_args[0]
    assert 10 <= len(shown[0]) <= 100 and shown[1].max() == 1e6 and shown[0].is_monotonic_increasing
    assert len(draw._some(df, "ts", "same")) == 10 and len(draw._some(df, "same", "x")) == 2
    cells = draw.plot_missingness(df, ["gap", "same"], kind="matrix").imshow.call_args[0][0]
    assert 50 <= len(cells) <= 54 and cells[:, 0].mean() == pytest.approx(0.25, abs=0.02) and cells[:, 1].sum() == 0
    assert len(draw._some(df.limit(0), "ts", "x")) == 0
