"""Regressors by name, over frames: ``fit(df, features, target)`` and ``predict(df, name)``."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number, require_numeric, resolve
from tidewater.core.errors import ConfigurationError, NotFittedError, SchemaError
from tidewater.sources.tables import require


class Regressor(ABC):
    """A regressor with named features. Rows with a missing feature or target are not learned from and predict NULL."""

    def __init__(self, **params: Any):
        self.params = params
        self.features_: list[str] | None = None

    def copy(self) -> Regressor:
        return type(self)(**self.params)

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> Regressor:
        self.features_ = resolve(df, list(features))
        require_numeric(df, [*self.features_, target], type(self).__name__)
        self.target_ = target
        rows = df.select(*[number(df, c).alias(c) for c in self.features_], number(df, target).alias("__y")).na.drop()
        self.learn(rows)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.features_ is None:
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        resolve(df, self.features_)
        return self.apply(df, name)

    @abstractmethod
    def learn(self, rows: DataFrame) -> None:
        """Learn from complete rows of the features and ``__y``."""

    @abstractmethod
    def apply(self, df: DataFrame, name: str) -> DataFrame:
        """Append the prediction."""

    def importances(self) -> dict[str, float]:
        """Weight of each feature; ConfigurationError where the model has none."""
        raise ConfigurationError(f"{type(self).__name__} has no feature importances")


class Linear(Regressor):
    """Linear regression from cross products (one aggregate), with optional penalties; predicts by a plain expression.

    Without ``l1_ratio``, ``alpha`` weighs the squared coefficients against the sum of squared errors (ridge); with
    it, against half their mean (lasso, elastic net).
    """

    def __init__(self, *, alpha: float = 0.0, l1_ratio: float = 0.0, max_iter: int = 10_000, tol: float = 1e-9):
        if alpha < 0 or not 0 <= l1_ratio <= 1:
            raise ConfigurationError(f"alpha is not negative and l1_ratio in [0, 1]; got {alpha} and {l1_ratio}")
        super().__init__(alpha=alpha, l1_ratio=l1_ratio, max_iter=max_iter, tol=tol)

    def learn(self, rows: DataFrame) -> None:
        from tidewater.models.gram import elastic_net, moments

        p = self.params
        n, means, s = moments(rows)
        if not n:
            raise SchemaError("there are no complete rows to learn from")
        xx, xy = s[:-1, :-1], s[:-1, -1]
        if p["alpha"] and p["l1_ratio"]:
            w = elastic_net(xx, xy, n, p["alpha"], p["l1_ratio"], p["max_iter"], p["tol"])
        else:
            w = np.linalg.lstsq(xx + p["alpha"] * np.eye(len(xx)), xy, rcond=None)[0]
        self.coefficients_ = dict(zip(self.features_, map(float, w)))
        self.intercept_ = float(means[-1] - means[:-1] @ w)

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        out = F.lit(self.intercept_)
        for c, w in self.coefficients_.items():
            out = out + number(df, c) * F.lit(w)
        return df.withColumn(name, out)

    def importances(self) -> dict[str, float]:
        return {c: abs(w) for c, w in self.coefficients_.items()}


class Trees(Regressor):
    """A tree ensemble of Spark ML (splits over binned features)."""

    def __init__(self, *, kind: str, **params: Any):
        super().__init__(kind=kind, **params)

    def learn(self, rows: DataFrame) -> None:
        from pyspark.ml import regression
        from pyspark.ml.feature import VectorAssembler

        params = {k: v for k, v in self.params.items() if k != "kind"}
        try:
            model = getattr(regression, self.params["kind"])(featuresCol="__x", labelCol="__y", **params)
        except TypeError as why:
            raise ConfigurationError(f"{self.params['kind']} does not take these parameters: {why}") from why
        self.assembler_ = VectorAssembler(inputCols=self.features_, outputCol="__x", handleInvalid="skip")
        self.model_ = model.fit(self.assembler_.transform(rows))

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        known = F.lit(True)
        for c in self.features_:
            known = known & number(df, c).isNotNull()
        cells = F.array(*[F.coalesce(number(df, c), F.lit(0.0)) for c in self.features_])
        made = self.model_.setPredictionCol("__p").transform(df.withColumn("__x", array_to_vector(cells)))
        return made.withColumn(name, F.when(known, F.col("__p"))).drop("__x", "__p")

    def importances(self) -> dict[str, float]:
        return dict(zip(self.features_, map(float, self.model_.featureImportances.toArray())))


#: Training rows that nearest neighbours hold and broadcast at most; rows of a block, and points compared with it at a
#: time, beyond that.
KNN_ROWS, KNN_BLOCK, KNN_POINTS = 50_000, 20_000, 1_000


def _nearest(x: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the ``k`` nearest of the sorted rows ``x``, in order."""
    far = ((x - row) ** 2).sum(1)
    some = np.arange(len(far))
    if len(far) > k and not np.isnan(edge := np.partition(far, k - 1)[k - 1]):
        some = np.flatnonzero(far <= edge)
    at = some[np.argsort(far[some], kind="stable")[:k]]
    return at, far[at]


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Rows of doubles as matrices of at most ``rows`` rows, sorted."""
    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.to_numpy(np.float64))
            n += len(batch)
            if n >= rows:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    def cut(held: list[np.ndarray]) -> pd.DataFrame:
        whole = np.concatenate(held)
        parts = [whole[k : k + rows] for k in range(0, len(whole), rows)]
        return pd.DataFrame({"cells": [p[np.lexsort(p.T[::-1])].tobytes() for p in parts]})

    return df.mapInPandas(pack, "cells binary")


class Knn(Regressor):
    """Mean of the ``n_neighbors`` nearest training rows (Euclidean; ties: the smaller feature values).

    Brute force in batches against the broadcast training set. Beyond ``KNN_ROWS`` rows the training set stays a table:
    the different points asked for meet every block of it, and the nearest of each block are merged.
    """

    def __init__(self, *, n_neighbors: int = 5):
        super().__init__(n_neighbors=n_neighbors)

    def learn(self, rows: DataFrame) -> None:
        got = rows.limit(KNN_ROWS + 1).toPandas()
        self.rows_ = rows if len(got) > KNN_ROWS else None
        if len(got) < self.params["n_neighbors"]:
            raise ConfigurationError(f"{len(got)} training rows are fewer than n_neighbors={self.params['n_neighbors']}")
        got = got.sort_values([*self.features_, "__y"]).to_numpy(np.float64)
        self.x_, self.y_ = (got[:, :-1], got[:, -1]) if self.rows_ is None else (None, None)

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        if self.rows_ is not None:
            return self._merged(df, name)
        held = df.sparkSession.sparkContext.broadcast((self.x_, self.y_))
        k = self.params["n_neighbors"]

        @F.pandas_udf("double")
        def nearest(cells: pd.Series) -> pd.Series:
            x, y = held.value
            out = np.full(len(cells), np.nan)
            for i, row in enumerate(cells):
                if row is not None and not np.isnan(np.asarray(row, float)).any():
                    out[i] = y[_nearest(x, np.asarray(row, float), k)[0]].mean()
            return pd.Series(out)

        made = nearest(F.array(*[number(df, c) for c in self.features_]))
        return df.withColumn(name, F.when(~F.isnan(made), made))

    def _merged(self, df: DataFrame, name: str) -> DataFrame:
        k, m = self.params["n_neighbors"], len(self.features_)
        points = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(self.features_)]).na.drop().distinct()
        blocks = _packed(self.rows_, KNN_BLOCK).withColumnRenamed("cells", "block")
        both = blocks.hint("shuffle_replicate_nl").crossJoin(_packed(points, KNN_POINTS))

        def candidates(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for block, cells in zip(batch["block"], batch["cells"]):
                    train = np.frombuffer(block).reshape(-1, m + 1)
                    x, out = np.ascontiguousarray(train[:, :-1]), []
                    for row in np.frombuffer(cells).reshape(-1, m):
                        at, far = _nearest(x, row, k)
                        out += [(row.tolist(), float(d), x[i].tolist(), float(train[i, -1])) for i, d in zip(at, far)]
                    yield pd.DataFrame(out, columns=["__at", "far", "x", "y"])

        found = both.mapInPandas(candidates, "__at array<double>, far double, x array<double>, y double")
        near = F.slice(F.sort_array(F.collect_list(F.struct("far", "x", "y"))), 1, k)
        total = F.aggregate(near, F.lit(0.0), lambda a, v: a + v["y"])
        means = found.groupBy("__at").agg((total / k).alias("__mean"))
        at = F.array(*[number(df, c) for c in self.features_])
        made = df.withColumn("__cells", at).join(means, F.col("__cells") == F.col("__at"), "left").drop("__cells", "__at")
        return made.withColumn(name, F.col("__mean")).drop("__mean")


class KernelSvr(Regressor):
    """Support-vector-like regression: random Fourier features of a Gaussian kernel (Rahimi & Recht 2007) under a
    Huber loss. An approximation: the robust loss stands in for the epsilon-insensitive one."""

    def __init__(self, *, C: float = 1.0, gamma: float | None = None, n_components: int = 200, epsilon: float = 1.35, seed: int = 0):
        super().__init__(C=C, gamma=gamma, n_components=n_components, epsilon=epsilon, seed=seed)

    def learn(self, rows: DataFrame) -> None:
        from pyspark.ml.regression import LinearRegression

        p, m = self.params, len(self.features_)
        stats = rows.agg(*[F.array(F.avg(c), F.stddev_pop(c)) for c in [*self.features_, "__y"]], F.count("*")).first()
        self.centre_, self.scale_ = [s[0] for s in stats[:-1]], [s[1] or 1.0 for s in stats[:-1]]
        rng = np.random.default_rng(p["seed"])
        gamma = p["gamma"] or 1.0 / m
        self.w_ = rng.normal(0, np.sqrt(2 * gamma), (m, p["n_components"]))
        self.b_ = rng.uniform(0, 2 * np.pi, p["n_components"])
        y = (F.col("__y") - self.centre_[-1]) / self.scale_[-1]
        data = self._mapped(rows, "__x").withColumn("__y", y)
        n = max(stats[-1], 1)
        self.model_ = LinearRegression(featuresCol="__x", labelCol="__y", loss="huber", epsilon=p["epsilon"], regParam=1.0 / (p["C"] * n), standardization=False).fit(data)

    def _mapped(self, df: DataFrame, name: str) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        centre, scale, w, b = np.array(self.centre_[:-1]), np.array(self.scale_[:-1]), self.w_, self.b_

        @F.pandas_udf("array<double>")
        def fourier(cells: pd.Series) -> pd.Series:
            x = (np.vstack(cells.to_numpy()) - centre) / scale if len(cells) else np.zeros((0, len(centre)))
            return pd.Series(list(np.sqrt(2.0 / w.shape[1]) * np.cos(x @ w + b)))

        cells = F.array(*[F.coalesce(number(df, c), F.lit(m)) for c, m in zip(self.features_, self.centre_)])
        return df.withColumn(name, array_to_vector(fourier(cells)))

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        known = F.lit(True)
        for c in self.features_:
            known = known & number(df, c).isNotNull()
        made = self.model_.setPredictionCol("__p").transform(self._mapped(df, "__x"))
        return made.withColumn(name, F.when(known, F.col("__p") * self.scale_[-1] + self.centre_[-1])).drop("__x", "__p")


def _xgboost(**params: Any) -> Regressor:
    try:
        require("xgboost", "the regressor 'xgboost'")
    except ImportError as why:
        raise ConfigurationError(str(why)) from why
    from tidewater.models.boosted import XgboostRegressor

    return XgboostRegressor(**params)


def _mlp(**params: Any) -> Regressor:
    from tidewater.models.neural import MLPRegressor

    return MLPRegressor(**params)


def _trees(kind: str, **defaults: Any) -> Callable[..., Regressor]:
    """Usual names of other libraries are understood."""
    names = {"n_estimators": "numTrees" if kind == "RandomForestRegressor" else "maxIter", "max_depth": "maxDepth", "random_state": "seed", "learning_rate": "stepSize", "min_samples_leaf": "minInstancesPerNode", "max_bins": "maxBins"}

    def make(**params: Any) -> Regressor:
        return Trees(kind=kind, **{**defaults, **{names.get(k, k): v for k, v in params.items()}})

    return make


#: Name -> maker. extra_trees has no counterpart in Spark ML: a forest over all rows approximates it.
REGRESSORS: dict[str, Callable[..., Regressor]] = {
    "decision_tree": _trees("DecisionTreeRegressor", seed=0),
    "elasticnet": lambda alpha=1.0, l1_ratio=0.5, **p: Linear(alpha=alpha, l1_ratio=l1_ratio, **p),
    "extra_trees": _trees("RandomForestRegressor", numTrees=100, subsamplingRate=1.0, bootstrap=False, featureSubsetStrategy="all", seed=0),
    "gradient_boosting": _trees("GBTRegressor", maxIter=100, maxDepth=3, stepSize=0.1, seed=0),
    "hist_gradient_boosting": _trees("GBTRegressor", maxIter=100, maxBins=255, stepSize=0.1, seed=0),
    "knn": Knn,
    "lasso": lambda alpha=1.0, **p: Linear(alpha=alpha, l1_ratio=1.0, **p),
    "linear": Linear,
    "mlp": _mlp,
    "random_forest": _trees("RandomForestRegressor", numTrees=100, featureSubsetStrategy="all", seed=0),
    "ridge": lambda alpha=1.0, **p: Linear(alpha=alpha, **p),
    "svr": KernelSvr,
    "xgboost": _xgboost,
}


def list_regressors() -> list[str]:
    return sorted(REGRESSORS)


def make_regressor(name: str = "random_forest", **params: Any) -> Regressor:
    """A regressor by name, in any case."""
    if not isinstance(name, str) or name.lower() not in REGRESSORS:
        raise ConfigurationError(f"unknown regressor {name!r}; known: {list_regressors()}")
    try:
        return REGRESSORS[name.lower()](**params)
    except TypeError as why:
        raise ConfigurationError(f"{name} does not take these parameters: {why}") from why
