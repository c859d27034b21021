"""Calendar, wind, lag, correlation and scaling steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers_frames import frame, gaps, hourly, pandas_of

from tidewater.core.axis import Axis
from tidewater.core.errors import ColumnNotFoundError, ConfigurationError, MissingDependencyError, SchemaError
from tidewater.functions import calendar, stats
from tidewater.operators import CorrelationFilter, LagFeatures, MissingValueHandler, Scaler, TemporalFeatures, WindDecomposer

AXIS = Axis("ts", tie="id")


def test_calendar_fields_match_pandas(spark):
    data = pd.DataFrame({"ts": pd.date_range("2023-12-28 05:30", periods=800, freq="11h")})
    got = pandas_of(TemporalFeatures("ts", add=list(calendar.FIELDS)).fit_transform(frame(spark, data)), "ts")
    t = data["ts"].dt
    want = {
        "year": t.year, "quarter": t.quarter, "month": t.month, "day": t.day, "dayofweek": t.dayofweek, "dayofyear": t.dayofyear,
        "weekofyear": t.isocalendar().week, "hour": t.hour, "minute": t.minute, "is_weekend": (t.dayofweek >= 5), "is_month_start": t.is_month_start,
        "is_month_end": t.is_month_end, "season": (t.month % 12 + 3) // 3,
    }
    for name, x in want.items():
        assert got[name].tolist() == x.astype(int).tolist(), name
    np.testing.assert_allclose(got["hour_sin"] ** 2 + got["hour_cos"] ** 2, 1.0)
    np.testing.assert_allclose(got["dayofyear_sin"], np.sin(2 * np.pi * (t.dayofyear - 1) / 365.25), atol=1e-12)


def test_temporal_options(spark):
    df = frame(spark, hourly(30))
    step = TemporalFeatures(add=["hour", "month"], cyclical=["hour"], drop_raw_cyclical=True, prefix="t_").fit(df)
    assert step.transform(df).columns[-3:] == ["t_month", "t_hour_sin", "t_hour_cos"]
    assert step.output_columns() == step.transform(df).columns
    for bad in ({"add": ["eon"]}, {"cyclical": ["year"]}, {"add": ["is_holiday"]}):
        with pytest.raises(ConfigurationError):
            TemporalFeatures("ts", **bad).fit(df)
    with pytest.raises(ColumnNotFoundError):
        TemporalFeatures("when").fit(df)
    with pytest.raises(SchemaError):
        TemporalFeatures("no2").fit(df)
    with pytest.raises(MissingDependencyError):
        TemporalFeatures("ts", add=["is_holiday"], holidays_country="AT").fit(df)
    days = TemporalFeatures("ts", add=["is_holiday"], cyclical=(), holidays=["2024-01-01"]).fit_transform(df)
    assert days.where("is_holiday = 1").count() == 24


def test_text_times(spark):
    df = spark.createDataFrame([("2024-02-29 10:00:00",), ("nonsense",), (None,)], "t string")
    got = [r.day for r in TemporalFeatures("t", add=["day"], cyclical=()).fit_transform(df).collect()]
    assert got == [29, None, None]
    with pytest.raises(SchemaError):
        TemporalFeatures("t").fit(spark.createDataFrame([("nonsense",)], "t string"))


def test_wind(spark):
    df = spark.createDataFrame([(0.0, 3.0, 4.0), (90.0, 0.0, 1.0), (180.0, 1.0, 0.0), (None, None, 1.0)], "wd double, u double, v double")
    out = WindDecomposer("wd", speed_from_uv=("u", "v")).fit_transform(df).collect()
    np.testing.assert_allclose([r.wd_x for r in out[:3]], [1, 0, -1], atol=1e-12)
    np.testing.assert_allclose([r.wd_y for r in out[:3]], [0, 1, 0], atol=1e-12)
    assert out[0].wind_speed == 5.0 and out[3].wind_speed is None and out[3].wd_x is None
    step = WindDecomposer("wd", speed_from_uv=("u", "v"), drop_original=True).fit(df)
    assert step.transform(df).columns == ["wd_x", "wd_y", "wind_speed"] == step.output_columns()
    with pytest.raises(SchemaError):
        WindDecomposer(speed_from_uv=("u", "v"), speed_out="wd").fit(df)
    with pytest.raises(SchemaError):
        WindDecomposer("nope").fit(df)
    with pytest.raises(ConfigurationError):
        WindDecomposer().fit(df)


@pytest.mark.parametrize("agg", ["median", "mean", "min", "max", "std"])
@pytest.mark.parametrize("blocks", [None, 9])
def test_lags_and_rolls_match_pandas(spark, agg, blocks):
    data = gaps(70, 4)
    axis = Axis("ts", tie="id", block_rows=blocks)
    step = LagFeatures("x", lags=[1, 12], windows=[3, 20], agg=agg, axis=axis)
    out = step.fit_transform(frame(spark, data))
    assert out.columns[-4:] == ["x_lag1", "x_lag12", f"x_roll3_{agg}", f"x_roll20_{agg}"]
    got = pandas_of(out, "id")
    for k in (1, 12):
        np.testing.assert_allclose(got[f"x_lag{k}"], data["x"].shift(k))
    for w in (3, 20):
        np.testing.assert_allclose(got[f"x_roll{w}_{agg}"], getattr(data["x"].shift(1).rolling(w, min_periods=1), agg)(), rtol=1e-9, atol=1e-9)


def test_lag_errors(spark):
    df = frame(spark, gaps(5, 0))
    for bad in ({}, {"lags": [0]}, {"lags": [True]}, {"windows": [2], "agg": "sum"}):
        with pytest.raises(ConfigurationError):
            LagFeatures("x", axis=AXIS, **bad).fit(df)
    with pytest.raises(ConfigurationError):
        LagFeatures("x", lags=[1]).fit(df)
    with pytest.raises(SchemaError):
        LagFeatures("ts", lags=[1], axis=AXIS).fit(df)


def test_correlation_filter(spark):
    rows = [(1.0, 2.0, 5.0, 7.0), (2.0, 4.0, 1.0, 7.0), (3.0, 6.0, 4.0, 7.0), (4.0, 8.0, 2.0, 7.0), (5.0, 10.0, 3.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double")
    assert CorrelationFilter(0.9).fit_transform(df).columns == ["a", "c", "flat"]
    assert CorrelationFilter(0.9, protect="b").fit(df).dropped_columns_ == []
    assert CorrelationFilter(0.9, columns=["b", "a"]).fit(df).dropped_columns_ == ["a"]
    with pytest.raises(ConfigurationError):
        CorrelationFilter(0).fit(df)


@pytest.mark.parametrize("levels, rows", [(4, 100_000), (12, 7), (10_000, 50), (10_000, 100_000)])
def test_kendall_counts_discordant_pairs_in_blocks(spark, monkeypatch, levels, rows):
    monkeypatch.setattr(stats, "KENDALL_ROWS", rows)
    rng = np.random.default_rng(levels + rows)
    x = rng.integers(0, levels, 400).astype(float)
    y = np.where(rng.random(400) < 0.3, 5.0, x + rng.integers(-levels // 2, levels // 2, 400))  # a third of one value
    data = pd.DataFrame({"x": x, "y": y, "flat": 1.0})
    df = frame(spark, pd.concat([data, pd.DataFrame({"x": [1.0, None], "y": [None, 2.0], "flat": [1.0, 1.0]})]))
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (dx * dy).sum() / np.sqrt((dx != 0).sum() * float((dy != 0).sum()))
    assert stats.kendall(df, "x", "y") == pytest.approx(want, abs=1e-12)
    assert stats.kendall(df, "x", "x") == pytest.approx(1.0) and stats.kendall(df, "x", "flat") is None
    assert stats.kendall(df.limit(0), "x", "y") is None


def test_kendall_grid_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(stats, "KENDALL_ROWS", 1)
    monkeypatch.setattr(stats, "KENDALL_SIDE", 8)
    x = np.random.default_rng(0).permutation(500).astype(float)
    y = np.random.default_rng(1).permutation(500).astype(float)
    want = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / (500 * 499)
    assert stats.kendall(frame(spark, pd.DataFrame({"x": x, "y": y})), "x", "y") == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("method", ["standard", "minmax", "robust", "maxabs"])
def test_scaler(spark, method):
    data = hourly()[["ts", "no2", "o3"]].assign(flat=3.0)
    df = frame(spark, data)
    step = Scaler(["no2", "flat"], method).fit(df)
    got = pandas_of(step.transform(df), "ts")
    x = data["no2"]
    centre, scale = {
        "standard": (x.mean(), x.std(ddof=0)), "minmax": (x.min(), x.max() - x.min()),
        "robust": (x.median(), x.quantile(0.75) - x.quantile(0.25)), "maxabs": (0.0, x.abs().max()),
    }[method]
    np.testing.assert_allclose(got["no2"], (x - centre) / scale, rtol=1e-9)
    np.testing.assert_allclose(got["flat"], 1.0 if method == "maxabs" else 0.0)
    np.testing.assert_allclose(pandas_of(step.inverse_transform(step.transform(df)), "ts")["no2"], x, rtol=1e-9)
    with pytest.raises(ColumnNotFoundError):
        step.inverse_transform(df.drop("flat"))
    with pytest.raises(SchemaError):
        Scaler("ts", method).fit(df)


def test_no_python_in_plans(spark):
    df = frame(spark, gaps(20, 0, keys=2))
    axis = Axis("ts", keys=("key",), tie="id")
    out = LagFeatures("x", lags=[1], windows=[3], axis=axis).fit_transform(df)
    out = Scaler("x").fit_transform(TemporalFeatures("ts").fit_transform(out))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("blocks", [1, 4, 50])
def test_blocks_within_series(spark, blocks):
    """Long series split into blocks, null keys and short series among them: as with one window a series."""
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"k": ["a"] * 40 + ["b"] * 3 + [None] * 9 + ["d"], "ts": pd.date_range("2024-01-01", periods=53, freq="h"), "x": rng.normal(size=53)})
    data.loc[rng.random(53) < 0.4, "x"] = np.nan
    df = spark.createDataFrame(data).repartition(5)
    plain, split = Axis("ts", keys=("k",)), Axis("ts", keys=("k",), block_rows=blocks)
    for make in (
        lambda a: LagFeatures("x", lags=[1, 6], windows=[3], agg="mean", axis=a), lambda a: MissingValueHandler("x", "interpolate", limit=2, axis=a),
        lambda a: MissingValueHandler("x", "ffill", axis=a),
    ):
        one, other = (sorted(map(str, make(a).fit_transform(df).collect())) for a in (plain, split))
        assert one == other
