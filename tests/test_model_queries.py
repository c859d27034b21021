"""Registered model queries that SQL cannot express, held against what must be true of their results."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from tidewater.plans import registry
from tidewater.plans.panel import TYPES, gappy_panel, hourly_panel

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def run(spark, name):
    return registry.QUERIES[name](spark, str(DATA))


def test_imputer_keeps_what_is_known_and_stays_among_it(spark):
    folder = str(DATA.parent / "sf0.01")  # of the smallest panel most cells are missing
    before = gappy_panel(spark, folder).toPandas().set_index("hour").sort_index()[list(TYPES)].astype(float)
    after = registry.QUERIES["iterative_impute"](spark, folder).toPandas().set_index("hour").sort_index()[list(TYPES)].astype(float)
    known = before.notna()
    assert np.allclose(after.where(known).fillna(0), before.fillna(0)) and after.notna().all().all()
    for c in TYPES:
        reach = 0.5 * (before[c].max() - before[c].min())
        assert after[c].between(before[c].min() - reach, before[c].max() + reach).all()


def test_isolation_flags_the_outer_rows(spark):
    df = run(spark, "isolation_flag").toPandas()
    assert 0.03 <= df.is_outlier.mean() <= 0.07
    x = df[["l_quantity", "l_extendedprice", "l_discount"]]
    away = ((x - x.mean()).abs() / x.std()).max(axis=1)
    assert away[df.is_outlier == 1].mean() > 1.2 * away[df.is_outlier == 0].mean()


def test_factors_rebuild_the_panel(spark):
    from tidewater.models.nmf import NMFApportionment
    from tidewater.operators import MissingValueHandler

    df = MissingValueHandler(list(TYPES), "mean").fit_transform(gappy_panel(spark, str(DATA)))
    model = NMFApportionment(2, columns=list(TYPES), max_iter=15).fit(df)
    out = run(spark, "nmf_factors").toPandas()
    parts = [c for c in out.columns if c not in (*TYPES, "hour")]
    w = out[parts].to_numpy(float)
    assert len(parts) == 2 and (w >= 0).all()
    x = df.toPandas().set_index("hour").loc[out["hour"], list(TYPES)].to_numpy(float)
    x = (x - model.low_) / model.span_
    error = np.linalg.norm(x - w @ model.h_)
    assert (model.h_ >= 0).all() and error == pytest.approx(model.reconstruction_err_, rel=0.02)
    assert error < 0.9 * np.linalg.norm(x - x.mean(0)) + np.sqrt(len(x)) * 0.05


def test_forest_fits_better_than_the_mean(spark):
    df = run(spark, "forest_predict").toPandas()
    y, p = df.l_extendedprice, df.prediction
    assert p.between(y.min(), y.max()).all() and 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0


def test_importances_are_what_shuffling_costs(spark):
    got = {r.feature: r.importance_mean for r in run(spark, "permutation_importance").collect()}
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").toPandas()
    x = df[["l_quantity", "l_discount", "l_tax"]]
    w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), df.l_extendedprice, rcond=None)[0][1:]
    for f, k in zip(x.columns, w):  # a linear model loses twice the variance that a feature brings
        assert got[f] == pytest.approx(2 * k * k * x[f].var() / df.l_extendedprice.var(), abs=0.01)


def test_shapley_values_of_the_query_add_up(spark):
    from pyspark.sql import functions as F

    from tidewater.models.interpret import tree_shap_values
    from tidewater.models.registry import make_regressor

    df = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_partkey") % 10).cast("double").alias("digit"))
    model = make_regressor("gradient_boosting", maxIter=5).fit(df, ["p_size", "digit"], "p_retailprice")
    rows = model.predict(tree_shap_values(model, df)).toPandas()
    assert np.allclose(rows.shap_p_size + rows.shap_digit + rows.shap_base, rows.prediction)
    got = {r.feature: r.mean_abs_shap for r in run(spark, "tree_shap").collect()}
    assert got == pytest.approx({"p_size": rows.shap_p_size.abs().mean(), "digit": rows.shap_digit.abs().mean()})


def test_forecast_continues_the_series(spark):
    out = run(spark, "forecast").toPandas().sort_values("ds")
    panel = hourly_panel(spark, str(DATA)).select("hour", "view").toPandas().dropna()
    ahead = out[out.ds > panel.hour.max()]
    assert len(ahead) == 48 and (ahead.ds.diff().dropna() == np.timedelta64(1, "h")).all()
    assert (out.yhat_lower <= out.yhat).all() and (out.yhat <= out.yhat_upper).all()
    assert abs(ahead.yhat.mean() - panel.view.mean()) < 2 * panel.view.std()


def test_hybrid_fits_no_worse_than_its_forecaster(spark):
    from pyspark.sql import functions as F

    from tidewater.models.forecast import ProphetForecaster

    df = hourly_panel(spark, str(DATA)).select(F.col("hour").alias("ds"), "click", "view", F.hour("hour").cast("double").alias("h")).na.drop()
    out = run(spark, "hybrid_forecast").toPandas().sort_values("ds")
    y = df.toPandas().sort_values("ds").view.to_numpy()
    alone = ProphetForecaster().fit(df.withColumn("y", F.col("view"))).predict(future=df.select("ds")).toPandas().sort_values("ds").yhat.to_numpy()
    assert len(out) == len(y) and np.mean((out.prediction - y) ** 2) <= 1.05 * np.mean((alone - y) ** 2)


def test_network_predicts_every_row(spark):
    out = run(spark, "network_predict").toPandas()
    assert np.isfinite(out.prediction).all() and np.mean((out.prediction - out.view) ** 2) < 2 * out.view.var()
