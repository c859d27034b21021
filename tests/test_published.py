"""The documented first study: 30 days of hourly data, cleaned, a forest scored over blocks and on held-out days.

The published figures are means and deviations over folds of a made-up series; ours is made by the same rule (a daily wave and
normal noise of 3) from other draws, so scores must lie near the published ones, not on them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidewater.core.axis import Axis
from tidewater.core.step import Pipeline
from tidewater.evaluation.metrics import score
from tidewater.evaluation.splits import BlockingTimeSeriesSplit, temporal_train_test_split
from tidewater.evaluation.validation import cross_val_report
from tidewater.models.registry import make_regressor
from tidewater.operators import MissingValueHandler, OutlierHandler, Scaler, TemporalFeatures

AXIS = Axis("ts", block_rows=None)

# Published means and standard deviations over five folds, and scores on the held-out days.
FOLDS = {"mae": (2.755, 0.427), "rmse": (3.528, 0.554), "r2": (0.764, 0.072), "index_of_agreement": (0.936, 0.016), "fac2": (0.977, 0.019)}
HELD_OUT = {"mae": 2.652, "rmse": 3.367, "r2": 0.815, "pearson_r": 0.903, "spearman_r": 0.908, "index_of_agreement": 0.947, "fac2": 0.979}


@pytest.fixture(scope="module")
def clean(spark):
    rng, h = np.random.default_rng(0), np.arange(720)
    no2 = 20 + 10 * np.sin(2 * np.pi * h / 24) + rng.normal(0, 3, 720)
    o3 = 40 + 15 * np.cos(2 * np.pi * h / 24) + rng.normal(0, 4, 720)
    pm10 = 15 + rng.gamma(2, 3, 720)
    no2[5:8], o3[100], pm10[50], no2[300] = np.nan, np.nan, 500, -200
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=720, freq="h"), "no2": no2, "o3": o3, "pm10": pm10}))
    pipe = Pipeline([
        MissingValueHandler(["no2", "o3", "pm10"], "interpolate", limit=6, axis=AXIS), OutlierHandler(["no2", "o3", "pm10"], "iqr", "clip"),
        TemporalFeatures("ts"), Scaler(["o3", "pm10"]),
    ], store=True)
    return pipe.fit_transform(df)


def test_folds(clean):
    features = [c for c in clean.columns if c not in ("ts", "no2")]
    assert clean.count() == 720 and len(features) == 15
    forest = make_regressor("random_forest", n_estimators=100, max_depth=8)
    report = cross_val_report(forest, clean, axis=AXIS, features=features, target="no2", cv=BlockingTimeSeriesSplit(5, gap=24), metrics=list(FOLDS))
    mean = next(r.asDict() for r in report.collect() if r.fold == "mean")
    for m, (published, deviation) in FOLDS.items():
        assert abs(mean[m] - published) <= 2 * deviation, (m, mean[m], published)


def test_held_out_days(clean):
    features = [c for c in clean.columns if c not in ("ts", "no2")]
    train, test = temporal_train_test_split(clean, AXIS, test_size=0.2, gap=24)
    assert (train.count(), test.count()) == (552, 144)
    got = score(make_regressor("random_forest", n_estimators=100, max_depth=8).fit(train, features, "no2").predict(test, "p"), "no2", "p", metrics=list(HELD_OUT))
    for m, published in HELD_OUT.items():
        assert abs(got[m] - published) <= (0.7 if m in ("mae", "rmse") else 0.12), (m, got[m], published)
