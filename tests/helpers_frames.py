"""Small frames for the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

START = pd.Timestamp("2024-01-01")


def hourly(n: int = 240, seed: int = 0) -> pd.DataFrame:
    """An hourly station: a cycle with noise, gaps and a spike."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    out = pd.DataFrame({
        "ts": START + pd.to_timedelta(t, "h"),
        "no2": 20 + 10 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 3, n),
        "o3": 40 + 15 * np.cos(2 * np.pi * t / 24) + rng.normal(0, 4, n),
        "pm10": 15 + rng.gamma(2, 3, n),
    })
    out.loc[5:7, "no2"] = np.nan
    if n > 100:
        out.loc[100, "o3"] = np.nan
        out.loc[50, "pm10"] = 500.0
    return out


def gaps(n: int, seed: int, share: float = 0.35, keys: int = 1) -> pd.DataFrame:
    """Random values with random gaps at uneven times, in one or several series."""
    rng = np.random.default_rng(seed)
    out = pd.DataFrame({
        "id": np.arange(n),
        "key": rng.integers(0, keys, n),
        "ts": START + pd.to_timedelta(np.sort(rng.choice(n * 50, n, replace=False)), "min"),
        "x": np.where(rng.random(n) < share, np.nan, rng.normal(0, 10, n)),
    })
    return out


def frame(spark, data: pd.DataFrame):
    """A Spark frame in which NaN is NULL and times have no zone."""
    from pyspark.sql import functions as F

    out = spark.createDataFrame(data)
    floats = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    times = [f.name for f in out.schema.fields if f.dataType.typeName() == "timestamp"]
    new = {c: F.when(~F.isnan(c), F.col(c)) for c in floats} | {c: F.col(c).cast("timestamp_ntz") for c in times}
    return out.withColumns(new) if new else out


def pandas_of(df, order: str):
    """Rows as pandas, in order, NULL as NaN."""
    return df.toPandas().sort_values(order, kind="stable").reset_index(drop=True)
