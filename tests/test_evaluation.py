"""Splits, metrics, cross-validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from helpers_frames import frame, gaps

from tidewater.core.axis import Axis
from tidewater.core.errors import ColumnNotFoundError, ConfigurationError, SchemaError
from tidewater.evaluation import METRICS, BlockingTimeSeriesSplit, ExpandingWindowSplit, SlidingWindowSplit, TimeSeriesSplit, cross_val_report, regression_metrics, score, temporal_train_test_split
from tidewater.evaluation import splits
from tidewater.evaluation.splits import holdout
from tidewater.models.registry import make_regressor

AXIS = Axis("ts", tie="id")
SPLITTERS = [BlockingTimeSeriesSplit(4, gap=3), SlidingWindowSplit(50, 20, step=10, gap=2), ExpandingWindowSplit(40, 20, gap=1), TimeSeriesSplit(4, gap=2)]


@pytest.mark.parametrize("cv", SPLITTERS, ids=lambda c: type(c).__name__)
def test_folds_never_look_ahead(cv):
    folds = cv.folds(203)
    assert len(folds) == cv.get_n_splits(203)
    for f in folds:
        assert 0 <= f.train_from < f.train_to <= f.test_from < f.test_to <= 203
        assert f.test_from - f.train_to == cv.gap


def test_fold_shapes():
    folds = BlockingTimeSeriesSplit(3, gap=1).folds(20)
    assert [f.train_from for f in folds] == [0, 6, 12] and folds[-1].test_to == 20
    assert [tuple(f) for f in SlidingWindowSplit(10, 5).folds(30)] == [(0, 10, 10, 15), (5, 15, 15, 20), (10, 20, 20, 25), (15, 25, 25, 30)]
    assert ExpandingWindowSplit(10, 5).folds(30)[-1] == (0, 25, 25, 30)
    assert TimeSeriesSplit(3).folds(10) == [(0, 4, 4, 6), (0, 6, 6, 8), (0, 8, 8, 10)]


def test_split_errors():
    for make in (lambda: BlockingTimeSeriesSplit(1), lambda: BlockingTimeSeriesSplit(gap=-1), lambda: SlidingWindowSplit(0, 1), lambda: SlidingWindowSplit(1, 1, step=0), lambda: ExpandingWindowSplit(1, 0)):
        with pytest.raises(ConfigurationError):
            make()
    for cv, n in ((BlockingTimeSeriesSplit(5), 3), (BlockingTimeSeriesSplit(5), 9), (BlockingTimeSeriesSplit(2, gap=9), 10), (SlidingWindowSplit(10, 5), 14), (TimeSeriesSplit(5), 4)):
        with pytest.raises(ConfigurationError):
            cv.folds(n)
    with pytest.raises(ConfigurationError):
        SlidingWindowSplit(2, 2).get_n_splits()
    for bad in (0.0, 1.0, 0, 100):
        with pytest.raises(ConfigurationError):
            holdout(100, bad)
    with pytest.raises(ConfigurationError):
        holdout(10, 5, gap=5)


@pytest.mark.parametrize("blocks", [None, 13])
def test_split_and_assign_agree(spark, blocks):
    df = frame(spark, gaps(90, 1)).select("id", "ts", "x")
    axis, cv = Axis("ts", tie="id", block_rows=blocks), SlidingWindowSplit(30, 10, step=20)
    made = cv.assign(df, axis).toPandas()
    for k, (train, test) in enumerate(cv.split(df, axis)):
        for role, part in (("train", train), ("test", test)):
            assert sorted(r.id for r in part.collect()) == sorted(made[(made.fold == k) & (made.role == role)].id)


@pytest.mark.parametrize("cv", [*SPLITTERS, ExpandingWindowSplit(3, 7, step=2)], ids=lambda c: type(c).__name__)
def test_summary_is_that_of_the_assigned_rows(spark, cv, monkeypatch):
    monkeypatch.setattr(splits, "RUN_FOLDS", 4)
    df = frame(spark, gaps(203, 1)).select("id", "ts", "x")
    made = cv.assign(df, AXIS).toPandas().groupby(["fold", "role"])["x"]
    got = cv.summary(df, AXIS, {"rows": ("count", "*"), "n": ("count", "x"), "low": ("min", "x"), "high": ("max", "x"), "total": ("sum", "x")})
    got = got.toPandas().set_index(["fold", "role"]).sort_index()
    assert list(got.index) == list(made.size().index)
    np.testing.assert_allclose(got, np.stack([made.size(), made.count(), made.min(), made.max(), made.sum()], 1), rtol=1e-9)


def test_summary_of_growing_sets_does_not_repeat_rows_for_each_fold(spark):
    rows, folds = 3_000, 2_980
    df = spark.range(rows).selectExpr("id", "id AS ts")
    cv = ExpandingWindowSplit(20, 1)
    assert cv._placed(df, AXIS, first_only=True).count() == rows - 1 + folds
    got = cv.summary(df, AXIS, {"rows": ("count", "*"), "total": ("sum", "id")}).where("role = 'train'").agg(F.count("*"), F.max("rows"), F.sum("rows")).first()
    assert tuple(got) == (folds, rows - 1, sum(range(20, rows)))


def test_holdout(spark):
    df = frame(spark, gaps(100, 2))
    train, test = temporal_train_test_split(df, AXIS, test_size=0.2, gap=3)
    assert (train.count(), test.count()) == (77, 20)
    assert train.agg({"ts": "max"}).first()[0] < test.agg({"ts": "min"}).first()[0]
    assert holdout(5, 0.5).test_from == 3 and holdout(15, 0.5).test_from == 7  # half to even


def test_metric_example(spark):
    df = spark.createDataFrame(list(zip([12.0, 18.0, 25.0, 9.0, 30.0, 22.0], [14.0, 16.0, 24.0, 11.0, 27.0, 20.0])) + [(None, 1.0), (2.0, float("nan"))], "o double, p double")
    got = score(df, "o", "p")
    want = {
        "mae": 2.0, "mse": 4.333333333333333, "rmse": 2.0816659994661326, "r2": 0.9175475687103594, "mape": 12.181818181818182, "smape": 11.880179872218791,
        "wape": 0.10344827586206896, "nmae": 0.18604651162790697, "nrmse": 0.19364334878754722, "bias": -0.6666666666666666, "pearson_r": 0.9860868434351835,
        "spearman_r": 1.0, "index_of_agreement": 0.973595125253893, "fac2": 1.0,
    }
    assert tuple(got) == METRICS
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12), k


def test_undefined_metrics_are_null(spark):
    zeros = score(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "o double, p double"), "o", "p")
    assert zeros["mae"] == 1.5 and all(zeros[k] is None for k in ("r2", "mape", "wape", "nmae", "pearson_r", "spearman_r", "fac2"))
    one = score(spark.createDataFrame([(2.0, 3.0)], "o double, p double"), "o", "p")
    assert one["pearson_r"] is None and one["r2"] is None and one["mape"] == 50.0


def test_metrics_by_group_and_distributed(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"g": rng.integers(0, 3, 300), "o": rng.integers(1, 40, 300).astype(float)})
    data["p"] = data["o"] + rng.normal(0, 4, 300)
    df = spark.createDataFrame(data).repartition(5)
    whole, far = score(df, "o", "p"), regression_metrics(df, "o", "p", distributed=True).first().asDict()
    for k in METRICS:
        assert far[k] == pytest.approx(whole[k], rel=1e-9)
    assert whole["spearman_r"] == pytest.approx(data["o"].rank().corr(data["p"].rank()))
    for row in regression_metrics(df, "o", "p", by=["g"]).collect():
        part = score(df.where(f"g = {row.g}"), "o", "p")
        assert all(row[k] == pytest.approx(part[k], rel=1e-9) for k in METRICS)


def test_metric_errors(spark):
    df = spark.createDataFrame([(1.0, None)], "o double, p double")
    with pytest.raises(SchemaError):
        score(df, "o", "p")
    with pytest.raises(ConfigurationError):
        score(df, "o", "p", metrics=["nope"])
    with pytest.raises(ColumnNotFoundError):
        regression_metrics(df, "o", "p", by=["g"])


def test_cross_validation(spark):
    rng = np.random.default_rng(3)
    data = gaps(200, 3, share=0.0)
    data["y"] = 3 * data["x"] - 2 + rng.normal(0, 0.1, 200)
    df = frame(spark, data)
    report = cross_val_report(make_regressor("linear"), df, axis=AXIS, features=["x"], target="y", cv=BlockingTimeSeriesSplit(4, gap=2), metrics=iter(["r2", "mae"]))
    rows = {r.fold: r for r in report.collect()}
    assert set(rows) == {"0", "1", "2", "3", "mean", "std"} and rows["mean"].r2 > 0.99
    assert rows["mean"].mae == pytest.approx(np.mean([rows[str(k)].mae for k in range(4)]))
    assert rows["std"].mae == pytest.approx(np.std([rows[str(k)].mae for k in range(4)], ddof=1))
    single = cross_val_report(make_regressor("linear"), df, axis=AXIS, features=["x"], target="y", cv=ExpandingWindowSplit(150, 50), metrics=["mae"])
    assert {r.fold: r.mae for r in single.collect()}["std"] is None
