"""Outliers against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers_frames import frame, gaps, hourly, pandas_of

from tidewater.core.axis import Axis
from tidewater.core.errors import ConfigurationError, SchemaError
from tidewater.operators import OutlierHandler


def expected_bounds(x: pd.Series, method: str):
    if method == "iqr":
        a, b = x.quantile([0.25, 0.75])
        return a - 1.5 * (b - a), b + 1.5 * (b - a)
    if method == "zscore":
        return x.mean() - 3 * x.std(), x.mean() + 3 * x.std()
    if method == "modified_zscore":
        reach = 3.5 * (x - x.median()).abs().median() / 0.6745
        return x.median() - reach, x.median() + reach
    return tuple(x.quantile([0.01, 0.99]))


@pytest.mark.parametrize("method", ["iqr", "zscore", "modified_zscore", "quantile"])
def test_bounds_and_treatments(spark, method):
    data = hourly()
    df = frame(spark, data)
    low, high = expected_bounds(data["pm10"], method)
    clip = OutlierHandler("pm10", method).fit(df)
    np.testing.assert_allclose(clip.bounds_["pm10"], (low, high), rtol=1e-9)
    out = (data["pm10"] < low) | (data["pm10"] > high)
    assert clip.n_outliers_ == out.sum() and out.sum() > 0
    np.testing.assert_allclose(pandas_of(clip.transform(df), "ts")["pm10"], data["pm10"].clip(low, high))
    assert OutlierHandler("pm10", method, "drop").fit_transform(df).count() == (~out).sum()
    blank = pandas_of(OutlierHandler("pm10", method, "nan").fit_transform(df), "ts")["pm10"]
    assert blank.isna().sum() == out.sum()
    flag = OutlierHandler("pm10", method, "flag").fit(df)
    assert pandas_of(flag.transform(df), "ts")["is_outlier"].tolist() == out.astype(int).tolist()
    assert flag.output_columns() == flag.transform(df).columns


@pytest.mark.parametrize("window", [72, 5, 6])
@pytest.mark.parametrize("blocks", [None, 11])
def test_rolling_sigma(spark, window, blocks):
    data = gaps(150, 3, share=0.1)
    data.loc[[20, 90], "x"] = [400.0, -300.0]
    roll = data["x"].rolling(window, center=True, min_periods=1)
    mean, reach = roll.mean(), 1.5 * roll.std().fillna(0)
    step = OutlierHandler("x", "rolling_sigma", window=window, sigma=1.5, axis=Axis("ts", tie="id", block_rows=blocks))
    got = pandas_of(step.fit_transform(frame(spark, data)), "id")["x"]
    np.testing.assert_allclose(got, data["x"].clip(mean - reach, mean + reach), rtol=1e-9, atol=1e-9)


def test_missing_is_never_out(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 1.0), (5, 1.0), (6, 900.0)], "k int, x double")
    out = OutlierHandler("x", "iqr", "flag").fit_transform(df)
    assert [r.is_outlier for r in out.orderBy("k").collect()] == [0, 0, 0, 0, 0, 1]
    clipped = OutlierHandler("x", "iqr").fit_transform(df).orderBy("k").collect()
    assert clipped[0].x is None and clipped[1].x is None


def test_isolation_forest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    x[:5] += 12
    data = pd.DataFrame({"k": range(400), "a": x[:, 0], "b": x[:, 1]})
    data.loc[10, "a"] = np.nan
    step = OutlierHandler(["a", "b"], "isolation_forest", "flag", contamination=0.02)
    got = pandas_of(step.fit_transform(frame(spark, data)), "k")["is_outlier"]
    assert got[:5].tolist() == [1] * 5 and got.sum() <= 10 and got[10] == 0
    again = pandas_of(OutlierHandler(["a", "b"], "isolation_forest", "flag", contamination=0.02).fit_transform(frame(spark, data)), "k")["is_outlier"]
    assert again.tolist() == got.tolist()


def test_errors(spark):
    df = frame(spark, hourly(24))
    for bad in ({"method": "x"}, {"strategy": "x"}, {"method": "isolation_forest"}, {"quantiles": (0.9, 0.1)}, {"method": "rolling_sigma"}):
        with pytest.raises(ConfigurationError):
            OutlierHandler("no2", **bad).fit(df)
    with pytest.raises(SchemaError):
        OutlierHandler("ts").fit(df)


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], "k int, x double")
    for method in ("iqr", "zscore", "modified_zscore", "quantile"):
        step = OutlierHandler("x", method).fit(empty)
        assert step.outlier_fraction_ == 0.0 and step.transform(empty).count() == 0
    flat = spark.createDataFrame([(k, 2.0) for k in range(5)], "k int, x double")
    assert OutlierHandler("x", "zscore", "drop").fit_transform(flat).count() == 5


@pytest.mark.parametrize("few", [3, 40, 10_000])
def test_exact_quantiles(spark, monkeypatch, few):
    """Brackets narrowed to few values: ties, constants, missing values, columns without any."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from tidewater.functions import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"a": rng.normal(size=3000), "b": np.where(rng.random(3000) < 0.7, 0.0, rng.exponential(size=3000)), "c": 5.0, "d": rng.integers(0, 4, 3000).astype(float), "e": rng.normal(size=3000) * 1e-300, "g": np.where(rng.random(3000) < 0.3, np.inf, -np.inf)})
    data.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(data).repartition(5).withColumn("f", F.lit(None).cast("double"))
    shares = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    cells = [F.when(~F.isnan(c), F.col(c)) for c in df.columns]
    got = quantiles.quantile_values(df, cells, shares)
    assert got.pop() is None
    for c, q in zip(data, got):
        if c == "g":
            assert [v for v in q if not np.isnan(v)] == [-np.inf] * 4 + [np.inf] * 3
            continue
        assert q == pytest.approx(np.nanquantile(data[c], shares).tolist(), rel=1e-12, abs=1e-310)
