"""Models."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers_frames import START, frame, pandas_of
from pyspark.sql import functions as F

from tidewater.core.axis import Axis
from tidewater.core.errors import ConfigurationError, NotFittedError, SchemaError
from tidewater.evaluation.metrics import score
from tidewater.models import (
    CNNRegressor, HybridProphetRegressor, LSTMRegressor, MLPRegressor, NMFApportionment, ProphetFeatures, ProphetForecaster, list_regressors, make_regressor,
    make_sequences, permutation_importance_report, shap_importance, tree_shap_values,
)
from tidewater.models.interpret import extract_importances, importance_table
from tidewater.models.nmf import weights


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    data = pd.DataFrame(x, columns=["a", "b", "noise"]).assign(k=range(300))
    data["y"] = 3 * data["a"] - 2 * data["b"] + 1 + rng.normal(0, 0.1, 300)
    return frame(spark, data).persist()


FAST = {"random_forest": {"numTrees": 20}, "extra_trees": {"n_estimators": 20}, "gradient_boosting": {"maxIter": 15}, "hist_gradient_boosting": {"maxIter": 15}, "mlp": {"epochs": 60, "dropout": 0.0}}


@pytest.mark.parametrize("name", [n for n in list_regressors() if n != "xgboost"])
def test_every_regressor_learns(problem, name):
    params = {"alpha": 0.01} if name in ("lasso", "elasticnet") else FAST.get(name, {})
    model = make_regressor(name.upper(), **params).fit(problem, ["a", "b", "noise"], "y")
    assert score(model.predict(problem), "y", "prediction")["r2"] > 0.75
    gap = problem.limit(1).withColumn("a", F.lit(None).cast("double"))
    assert model.predict(gap).first().prediction is None
    with pytest.raises(NotFittedError):
        model.copy().predict(problem)


def test_linear_is_exact(problem):
    model = make_regressor("linear").fit(problem, ["a", "b"], "y")
    data = problem.toPandas()
    z = np.column_stack((np.ones(300), data["a"], data["b"]))
    want = np.linalg.lstsq(z, data["y"], rcond=None)[0]
    np.testing.assert_allclose([model.intercept_, *model.coefficients_.values()], want, rtol=1e-6)
    lasso = make_regressor("lasso", alpha=0.5).fit(problem, ["a", "b", "noise"], "y")
    left = data["y"] - lasso.intercept_ - data[["a", "b", "noise"]] @ np.array(list(lasso.coefficients_.values()))
    pull = [float((data[c] - data[c].mean()) @ left) / 300 for c in ("a", "b", "noise")]
    np.testing.assert_allclose(pull[:2], [0.5, -0.5], atol=1e-6)  # the optimality conditions
    assert lasso.coefficients_["noise"] == 0 and abs(pull[2]) <= 0.5
    ridge = make_regressor("ridge", alpha=5.0).fit(problem, ["a", "b"], "y")
    x = z[:, 1:] - z[:, 1:].mean(0)
    np.testing.assert_allclose(list(ridge.coefficients_.values()), np.linalg.solve(x.T @ x + 5 * np.eye(2), x.T @ (data["y"] - data["y"].mean())), rtol=1e-6)


def test_registry_errors(problem):
    for bad in ("nope", 3):
        with pytest.raises(ConfigurationError):
            make_regressor(bad)
    with pytest.raises(ConfigurationError):
        make_regressor("knn", wrong=1)
    with pytest.raises(ConfigurationError):
        make_regressor("xgboost")
    with pytest.raises(SchemaError):
        make_regressor("linear").fit(problem.withColumn("t", F.lit("x")), ["t"], "y")


def test_knn_beyond_one_block(spark, problem, monkeypatch):
    """Many blocks merged give what brute force gives, with ties, repeated rows and missing cells."""
    from tidewater.models import registry

    rng = np.random.default_rng(5)
    train = pd.DataFrame({"a": rng.integers(0, 8, 500).astype(float), "b": rng.integers(0, 8, 500).astype(float), "y": rng.normal(size=500)})
    asked = pd.DataFrame({"a": rng.integers(-2, 10, 90).astype(float), "b": rng.integers(0, 16, 90) / 2.0}).assign(k=range(90))
    for name, n in (("KNN_ROWS", 100), ("KNN_BLOCK", 30), ("KNN_POINTS", 20)):
        monkeypatch.setattr(registry, name, n)
    df = frame(spark, asked).withColumn("b", F.when(F.col("k") != 7, F.col("b")))
    got = make_regressor("knn", n_neighbors=4).fit(frame(spark, train), ["a", "b"], "y").predict(df).collect()
    ordered = train.sort_values(["a", "b", "y"])
    assert len(got) == 90
    for r in got:
        far = (ordered["a"] - r.a) ** 2 + (ordered["b"] - r.b) ** 2 if r.b is not None else None
        want = None if far is None else ordered["y"].to_numpy()[np.argsort(far.to_numpy(), kind="stable")[:4]].mean()
        assert r.prediction == (want if want is None else pytest.approx(want))


def test_importances(spark, problem):
    model = make_regressor("linear").fit(problem, ["a", "b", "noise"], "y")
    table = importance_table(problem, extract_importances(model), top=2).collect()
    assert [r.feature for r in table] == ["a", "b"]
    rows = permutation_importance_report(model, problem, "y", n_repeats=2).collect()
    assert [r.feature for r in rows] == ["a", "b", "noise"] and rows[0].importance_mean > 0.5 and abs(rows[2].importance_mean) < 0.01
    with pytest.raises(ConfigurationError):
        extract_importances(make_regressor("knn").fit(problem, ["a"], "y"))


@pytest.mark.parametrize("name,params", [("decision_tree", {}), ("random_forest", {"numTrees": 5}), ("gradient_boosting", {"maxIter": 5})])
def test_shapley_values_add_up(problem, name, params):
    model = make_regressor(name, **params).fit(problem, ["a", "b", "noise"], "y")
    explained = tree_shap_values(model, model.predict(problem)).toPandas()
    total = explained[["shap_a", "shap_b", "shap_noise", "shap_base"]].sum(1)
    np.testing.assert_allclose(total, explained["prediction"], atol=1e-6)
    top = shap_importance(tree_shap_values(model, problem)).first()
    assert top.feature == "a"


def test_shapley_base_counts_every_row(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.normal(size=3000)})
    data["y"] = 3 * data["a"] + (data["b"] > 3.0) * 1000  # a branch of few rows
    df = frame(spark, data)
    model = make_regressor("decision_tree", maxDepth=4).fit(df, ["a", "b"], "y")
    explained = tree_shap_values(model, model.predict(df)).toPandas()
    np.testing.assert_allclose(explained["shap_base"], explained["prediction"].mean(), rtol=1e-9)
    np.testing.assert_allclose(explained[["shap_a", "shap_b", "shap_base"]].sum(1), explained["prediction"], atol=1e-6)


def test_shapley_values_by_definition(problem):
    """One tree: each value is the mean over orders of what a feature adds to the conditional expectation."""
    from itertools import permutations

    from tidewater.models.interpret import _trees_of

    model = make_regressor("decision_tree", maxDepth=3).fit(problem, ["a", "b", "noise"], "y")
    tree = _trees_of(model)[0]
    x = problem.toPandas()[["a", "b", "noise"]].to_numpy()
    tree.cover = tree.count(x).tolist()

    def value(row, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return value(row, known, left if row[f] <= tree.threshold[node] else right)
        return (tree.cover[left] * value(row, known, left) + tree.cover[right] * value(row, known, right)) / tree.cover[node]

    for row in x[:5]:
        want = np.zeros(3)
        for order in permutations(range(3)):
            for k, f in enumerate(order):
                want[f] += (value(row, set(order[: k + 1])) - value(row, set(order[:k]))) / 6
        phi = np.zeros(3)
        tree.shap(row, phi)
        np.testing.assert_allclose(phi, want, atol=1e-9)


def test_nmf(spark):
    rng = np.random.default_rng(0)
    v = rng.uniform(0, 1, (120, 2)) @ rng.uniform(0.2, 1, (2, 4)) * (1 + rng.normal(0, 0.02, (120, 4)))
    df = frame(spark, pd.DataFrame(v, columns=list("wxyz")).assign(k=range(120)))
    model = NMFApportionment(2, columns=list("wxyz"), scale=False, max_iter=60).fit(df)
    out = pandas_of(model.transform(df), "k")
    made = out[["factor_1", "factor_2"]].to_numpy() @ model.loadings().to_numpy()
    assert np.linalg.norm(made - v) / np.linalg.norm(v) < 0.1 and (model.loadings().to_numpy() >= 0).all()
    assert (weights(v, model.h_) >= 0).all()
    with pytest.raises(ConfigurationError):
        NMFApportionment().loadings()
    with pytest.raises(SchemaError):
        NMFApportionment(columns=["x"]).fit(df.withColumn("x", F.lit(None).cast("double")))
    with pytest.raises(SchemaError):
        NMFApportionment(columns=["x"], scale=False).fit(df.withColumn("x", F.lit(-1.0)))


def daily(n=400):
    t = np.arange(n)
    rng = np.random.default_rng(2)
    return pd.DataFrame({"ds": START + pd.to_timedelta(t, "D"), "y": 10 + 0.05 * t + 3 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.2, n), "temp": rng.normal(size=n)})


def test_forecaster(spark):
    data = daily()
    model = ProphetForecaster().fit(frame(spark, data))
    back = pandas_of(model.predict(), "ds")
    assert list(back.columns) == ["ds", "yhat", "yhat_lower", "yhat_upper"]
    assert np.corrcoef(back["yhat"], data["y"])[0, 1] > 0.98
    inside = ((data["y"] >= back["yhat_lower"]) & (data["y"] <= back["yhat_upper"])).mean()
    assert 0.7 < inside < 0.9
    ahead = pandas_of(model.predict(periods=14, freq="D"), "ds")
    assert len(ahead) == 414 and ahead["ds"].iloc[-1] == data["ds"].iloc[-1] + pd.Timedelta(days=14)
    t = np.arange(400, 414)
    assert np.abs(ahead["yhat"].iloc[-14:] - (10 + 0.05 * t + 3 * np.sin(2 * np.pi * t / 7))).max() < 1.5
    assert model.predict(future=["2025-06-01"]).count() == 1
    for bad in (lambda: ProphetForecaster().predict(), ):
        with pytest.raises(NotFittedError):
            bad()
    with pytest.raises(SchemaError):
        ProphetForecaster().fit(spark.createDataFrame([(None, 1.0)], "ds timestamp_ntz, y double"))
    with pytest.raises(SchemaError):
        ProphetForecaster().fit(spark.createDataFrame([(1.0,)], "y double"))
    with pytest.raises(ConfigurationError):
        model.predict(periods=1, freq="fortnight")


def test_logistic_growth(spark):
    t = np.arange(200)
    data = pd.DataFrame({"ds": START + pd.to_timedelta(t, "D"), "y": 10 / (1 + np.exp(-(t - 100) / 20))})
    back = pandas_of(ProphetForecaster(growth="logistic", cap=10.0, weekly_seasonality=False).fit(frame(spark, data)).predict(), "ds")
    assert np.abs(back["yhat"] - data["y"]).max() < 1.0


def test_hybrid_and_features(spark):
    df = frame(spark, daily(120))
    made = ProphetFeatures("y").fit(df)
    assert made.prophet_feature_names_ == ["yhat", "yhat_lower", "yhat_upper", "trend", "weekly"]
    assert set(made.prophet_feature_names_) <= set(made.transform(df).columns)
    model = HybridProphetRegressor(make_regressor("linear")).fit(df, ["temp"], "y")
    out = model.predict(df)
    assert out.columns == ["ds", "y", "temp", "prediction"] and score(out, "y", "prediction")["r2"] > 0.9
    with pytest.raises(ConfigurationError):
        HybridProphetRegressor(time="when").fit(df, ["temp"], "y")


def test_sequences(spark):
    rows = [(k, float(k), None if k == 7 else float(10 * k)) for k in range(50)]
    df = spark.createDataFrame(rows, "t int, a double, b double")
    for blocks in (None, 6):
        out = make_sequences(df, Axis("t", block_rows=blocks), ["a", "b"], "a", window=5, horizon=2).orderBy("t").collect()
        assert len(out) == 50 - 5 - 2 + 1
        assert [s[0] for s in out[3].sequence] == [3, 4, 5, 6, 7] and out[3].sequence[4][1] is None and out[3].target_next == 9.0
    with pytest.raises(ConfigurationError):
        make_sequences(df, Axis("t"), ["a"], window=0)


@pytest.mark.parametrize("kind", [LSTMRegressor, CNNRegressor])
def test_sequence_networks(spark, kind):
    t = np.arange(260)
    df = frame(spark, pd.DataFrame({"t": t, "x": np.sin(t / 6), "y": np.sin((t + 1) / 6)}))
    small = {"hidden": 12} if kind is LSTMRegressor else {"channels": (8,)}
    model = kind(window=6, epochs=30, learning_rate=0.01, dropout=0.0, axis=Axis("t"), **small).fit(df, ["x"], "y")
    out = model.predict(df)
    assert out.count() == 260
    assert out.where("prediction is null").agg({"t": "max"}).first()[0] == 5
    assert score(out, "y", "prediction")["r2"] > 0.8
    with pytest.raises(ConfigurationError):
        kind(window=0)


@pytest.mark.parametrize("make", [lambda: MLPRegressor(hidden=(5, 4), dropout=0.0), lambda: LSTMRegressor(hidden=3, dropout=0.0), lambda: CNNRegressor(channels=(4, 3), dropout=0.0), lambda: CNNRegressor(channels=(3,), kernel_size=2, dropout=0.0)])
def test_gradients(make):
    net, rng = make(), np.random.default_rng(0)
    x = rng.normal(size=(4, 3)) if isinstance(net, MLPRegressor) else rng.normal(size=(4, 5, 3))
    y, w = rng.normal(size=4), {k: v + rng.normal(0, 0.2, v.shape) for k, v in net.start(3, rng).items()}
    out, kept = net.forward(w, x)
    grads = net.backward(w, kept, 2 * (out - y) / 4)
    for name, v in w.items():
        flat = v.reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old, loss = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                loss.append(np.mean((net.forward(w, x)[0] - y) ** 2))
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-4, abs=1e-7), name
