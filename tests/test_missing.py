"""Missing values against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers_frames import frame, gaps, hourly, pandas_of

from tidewater.core.axis import Axis
from tidewater.core.errors import ColumnNotFoundError, ConfigurationError, NotFittedError
from tidewater.operators import MissingValueHandler

AXIS = Axis("ts", tie="id")
KEYED = Axis("ts", keys=("key",), tie="id")
BLOCKS = Axis("ts", tie="id", block_rows=7)


def same(got, want):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("axis", [AXIS, BLOCKS], ids=["window", "blocks"])
@pytest.mark.parametrize("how,limit", [("ffill", None), ("ffill", 2), ("bfill", None), ("bfill", 1)])
def test_carry(spark, seed, axis, how, limit):
    data = gaps(60, seed)
    got = MissingValueHandler("x", how, limit=limit, axis=axis).fit_transform(frame(spark, data))
    same(pandas_of(got, "id")["x"], getattr(data["x"], how)(limit=limit))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("axis", [AXIS, BLOCKS], ids=["window", "blocks"])
@pytest.mark.parametrize("limit", [None, 1, 3])
def test_interpolate_by_time(spark, seed, axis, limit):
    data = gaps(60, seed)
    got = MissingValueHandler("x", "interpolate", limit=limit, axis=axis).fit_transform(frame(spark, data))
    want = data.set_index("ts")["x"].interpolate(method="time", limit=limit)
    same(pandas_of(got, "id")["x"], want)


@pytest.mark.parametrize("axis", [AXIS, KEYED, BLOCKS], ids=["window", "keys", "blocks"])
def test_neighbours_take_no_frame_that_is_gone_through_for_each_row(spark, axis):
    for how in ("interpolate", "bfill"):
        got = MissingValueHandler("x", how, axis=axis).fit_transform(frame(spark, gaps(60, 0)))
        assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("axis", [AXIS, BLOCKS], ids=["window", "blocks"])
def test_between_neighbours_of_one_time_no_line_is_defined(spark, axis):
    data = pd.DataFrame({"id": range(4), "ts": pd.to_datetime(["2024-01-01"] * 3 + ["2024-01-02"]), "x": [1.0, np.nan, 5.0, np.nan]})
    got = MissingValueHandler("x", "interpolate", axis=axis).fit_transform(frame(spark, data))
    same(pandas_of(got, "id")["x"], [1.0, np.nan, 5.0, 5.0])


def test_interpolate_keeps_series_apart(spark):
    data = gaps(80, 5, keys=3)
    got = MissingValueHandler("x", "interpolate", axis=KEYED).fit_transform(frame(spark, data))
    want = data.groupby("key", group_keys=False).apply(lambda g: g.assign(x=g.set_index("ts")["x"].interpolate(method="time").to_numpy()), include_groups=False)
    same(pandas_of(got, "id")["x"], want.sort_values("id")["x"])


@pytest.mark.parametrize("how", ["mean", "median"])
def test_statistics(spark, how):
    data = hourly()
    got = MissingValueHandler(["no2", "o3"], how).fit_transform(frame(spark, data))
    want = data.fillna({c: getattr(data[c], how)() for c in ("no2", "o3")})
    same(pandas_of(got, "ts")[["no2", "o3"]], want[["no2", "o3"]])


def test_most_frequent_takes_the_least_of_ties(spark):
    got = MissingValueHandler("v", "most_frequent").fit(spark.createDataFrame([(3,), (1,), (3,), (1,), (None,)], "v int"))
    assert got.statistics_ == {"v": 1}


def test_drop_indicator_and_threshold(spark):
    data = pd.DataFrame({"k": range(5), "a": [1, np.nan, 3, 4, 5.0], "b": [np.nan, np.nan, np.nan, 4, 5.0]})
    step = MissingValueHandler(["a", "b"], "drop", add_indicator=True, column_missing_threshold=0.5)
    out = step.fit_transform(frame(spark, data))
    assert out.columns == ["k", "a", "a__missing", "b__missing"] == step.output_columns()
    assert [r.k for r in out.orderBy("k").collect()] == [0, 2, 3, 4]
    assert [r.b__missing for r in out.orderBy("k").collect()] == [1, 1, 0, 0]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 4.0), (3, None)], "k int, x double")
    assert MissingValueHandler("x", "drop").fit_transform(df).count() == 1
    out = MissingValueHandler("x", "constant", fill_value=0.0).fit_transform(df)
    assert [r.x for r in out.orderBy("k").collect()] == [0.0, 4.0, 0.0]


def test_empty_frame(spark):
    df = spark.createDataFrame([], "k int, x double")
    for how in ("drop", "mean", "median", "most_frequent"):
        assert MissingValueHandler(["x"], how, add_indicator=True).fit_transform(df).count() == 0


def test_errors(spark):
    df = frame(spark, hourly(24))
    with pytest.raises(ConfigurationError):
        MissingValueHandler(strategy="guess").fit(df)
    with pytest.raises(ConfigurationError):
        MissingValueHandler(strategy="constant").fit(df)
    with pytest.raises(ConfigurationError):
        MissingValueHandler("no2", "ffill").fit(df)
    with pytest.raises(ColumnNotFoundError):
        MissingValueHandler("nope").fit(df)
    with pytest.raises(KeyError):
        MissingValueHandler("nope").fit(df)
    with pytest.raises(NotFittedError):
        MissingValueHandler().transform(df)


def test_iterative_recovers_a_linear_relation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    data = pd.DataFrame({"k": range(300), "a": x[:, 0], "b": x[:, 1], "c": 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.01, 300)})
    holes = data.copy()
    holes.loc[::7, "c"] = np.nan
    holes.loc[[k for k in range(3, 300, 11) if k % 7], "a"] = np.nan
    step = MissingValueHandler(["a", "b", "c"], "iterative").fit(frame(spark, holes))
    got = pandas_of(step.transform(frame(spark, holes)), "k")
    assert not got[["a", "b", "c"]].isna().any().any()
    assert np.abs(got["c"] - data["c"]).max() < 0.3
    known = holes["c"].notna()
    same(got["c"][known], data["c"][known])


def test_iterative_same_on_driver_and_distributed(spark, monkeypatch):
    from tidewater.models import imputer

    data = hourly(120)
    data["k"] = range(len(data))
    df = frame(spark, data)
    near = imputer.IterativeImputer(["no2", "o3", "pm10"], max_iter=2).fit(df)
    monkeypatch.setattr(imputer, "DRIVER_ROWS", 0)
    far = imputer.IterativeImputer(["no2", "o3", "pm10"], max_iter=2).fit(df)
    same(pandas_of(near.transform(df), "k")["no2"], pandas_of(far.transform(df), "k")["no2"])
